"""Queries of the change-impact plans (paths, evidence, coverage, judging, locks, references) on analytical tables that
stand in for the relations of a change, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import graph, ranking
from . import coverage, evidence, judging, locks, paths, policy, references
from .queries import _EDGES, _edges, _flags, query, t

# Paths of a workspace: crates/brand7/src/small_ring.rs and the like; brand3 is outside of all packages.
_PLACES = """SELECT p_partkey, p_size, 'crates/' || replace(lower(p_brand), '#', '') || CASE p_size % 5 WHEN 0 THEN '/src/' WHEN 1 THEN '/tests/' WHEN 2 THEN '/benches/' WHEN 3 THEN '/target/' ELSE '/sub/src/' END
|| replace(p_name, ' ', '_') || CASE WHEN p_size % 7 = 0 THEN '.toml' ELSE '.rs' END AS path FROM part"""
_DIRS = "SELECT DISTINCT 'crates/' || replace(lower(p_brand), '#', '') AS dir FROM part WHERE p_brand <> 'Brand#3' UNION SELECT 'crates/brand1/sub'"
_CHANGES = f"""SELECT p_partkey AS change_id, CASE WHEN p_size % 11 <> 0 THEN path END AS new_path, CASE WHEN p_partkey % 3 = 0 THEN 'crates/brand2/old/' || p_partkey || '.rs' ELSE path END AS old_path,
CASE WHEN p_size % 11 = 0 THEN 'deleted' WHEN p_partkey % 5 = 0 THEN 'added' ELSE 'modified' END AS status FROM ({_PLACES})"""


def _crate(spark, sf):
    return F.concat(F.lit("crates/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")))


def _places(spark, sf):
    size = F.col("p_size") % 5
    inner = F.when(size == 0, "/src/").when(size == 1, "/tests/").when(size == 2, "/benches/").when(size == 3, "/target/").otherwise("/sub/src/")
    path = F.concat(_crate(spark, sf), inner, F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 7 == 0, ".toml").otherwise(".rs"))
    return t(spark, sf, "part").select("p_partkey", "p_size", path.alias("path"))


def _dirs(spark, sf):
    own = t(spark, sf, "part").filter("p_brand <> 'Brand#3'").select(_crate(spark, sf).alias("dir"))
    return own.union(spark.createDataFrame([("crates/brand1/sub",)], "dir string")).distinct().select("dir", F.col("dir").alias("pkg"))


def _changes(spark, sf):
    key, gone = F.col("p_partkey"), F.col("p_size") % 11 == 0
    old = F.when(key % 3 == 0, F.concat(F.lit("crates/brand2/old/"), key.cast("string"), F.lit(".rs"))).otherwise(F.col("path"))
    status = F.when(gone, "deleted").when(key % 5 == 0, "added").otherwise("modified")
    return _places(spark, sf).select(key.alias("change_id"), F.when(~gone, F.col("path")).alias("new_path"), old.alias("old_path"), status.alias("status"))


_RULES = (paths.Rule(("crates/brand7/**",), ("crates/brand8",), exclusive=True), paths.Rule(("**/*.toml", "crates/brand9/src/*"), ("crates/brand4", "crates/brand6"), reach=False))
_SETTINGS = policy.Settings(full_run=("crates/brand5/**",), ignore=("**/tests/**",))
_POLICY = f"""c AS ({_CHANGES}), d AS ({_DIRS}), s AS (SELECT *, unnest(list_distinct(list_filter([new_path, old_path], lambda x: x IS NOT NULL))) AS path FROM c),
u AS (SELECT path, max_by(dir, length(dir)) AS pkg FROM (SELECT DISTINCT path FROM s) JOIN d ON prefix(path, dir || '/') GROUP BY path),
p AS (SELECT change_id, s.path, pkg, coalesce(s.path = new_path, false) AS new_side, coalesce(s.path = old_path, false) AND status <> 'added' AS old_side,
  CASE WHEN prefix(s.path, 'crates/brand7/') THEN 1 ELSE 0 END + CASE WHEN suffix(s.path, '.toml') OR regexp_full_match(s.path, 'crates/brand9/src/[^/]*') THEN 2 ELSE 0 END AS rules,
  CASE WHEN prefix(s.path, 'crates/brand5/') THEN 'full' WHEN prefix(s.path, 'crates/brand7/') THEN 'rule' WHEN regexp_full_match(s.path, '(.*/)?tests/.*') THEN 'ignored' WHEN pkg IS NULL THEN 'outside'
  WHEN suffix(s.path, '.rs') THEN 'source' ELSE 'whole' END AS policy FROM s LEFT JOIN u ON s.path = u.path)"""


def _policed(spark, sf):
    return paths.path_policy(_changes(spark, sf), _dirs(spark, sf), _SETTINGS, _RULES)


@query(f"WITH {_POLICY} SELECT change_id, path, pkg, new_side, old_side, rules, policy FROM p")
def d2_path_policy(spark, sf):
    rows = _policed(spark, sf).withColumn("rules", F.aggregate("rules", F.lit(0), lambda a, r: a + F.when(r == 0, 1).otherwise(2)))
    return rows.select("change_id", "path", "pkg", "new_side", "old_side", "rules", "policy")


@query(f"WITH {_POLICY}, f AS (SELECT DISTINCT unnest([rules & 1, rules & 2]) AS r FROM p WHERE policy <> 'full') SELECT pkg, rule, reach FROM f JOIN (VALUES (1, 'crates/brand8', 0, true), (2, 'crates/brand4', 1, false), (2, 'crates/brand6', 1, false)) AS v(r, pkg, rule, reach) USING (r)")
def d4_rule_packages(spark, sf):
    return paths.rule_packages(_policed(spark, sf), _dirs(spark, sf).withColumn("name", F.col("dir")), _RULES)


@query(f"WITH {_POLICY} SELECT DISTINCT pkg FROM p WHERE policy IN ('whole', 'source') UNION SELECT 'crates/brand8'")
def u1_changed_packages(spark, sf):
    return paths.changed_packages(_policed(spark, sf), spark.createDataFrame([("crates/brand8",)], "pkg string"))


@query(f"WITH c AS ({_CHANGES}) SELECT change_id, unnest(list_distinct(list_filter([new_path, old_path], lambda x: x IS NOT NULL))) AS path FROM c")
def u2_sides(spark, sf):
    return _changes(spark, sf).select("change_id", F.explode(X.either_side(F.col("new_path"), F.col("old_path"))).alias("path"))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT n_nationkey AS node, 0 AS hops FROM nation WHERE n_nationkey IN (1, 4) UNION SELECT dst, hops + 1 FROM r JOIN e ON src = node WHERE hops < 2),
m AS (SELECT node, min(hops) AS hops FROM r GROUP BY node) SELECT node AS pkg, hops FROM m UNION ALL SELECT n_nationkey, 0 FROM nation WHERE n_regionkey = 2 AND n_nationkey NOT IN (SELECT node FROM m)""")
def d5_reach(spark, sf):
    pkg = F.col("n_nationkey").alias("pkg")
    nations = t(spark, sf, "nation")
    return paths.reached_packages(nations.filter("n_nationkey = 1").select(pkg), nations.filter("n_nationkey IN (1, 4)").select(pkg), nations.filter("n_regionkey = 2").select(pkg), _edges(spark, sf), 2)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT n_nationkey AS start, n_nationkey AS node FROM nation WHERE n_regionkey = 1 UNION SELECT start, dst FROM r JOIN e ON src = node)
SELECT start, node FROM r WHERE start <> node AND node % 3 = 0""")
def g2_member_dependents(spark, sf):
    nations = t(spark, sf, "nation").withColumn("node", F.col("n_nationkey"))
    return graph.dependents_of(nations.filter("n_regionkey = 1").select("node"), _edges(spark, sf), nations.filter("node % 3 = 0").select("node"))


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT n_nationkey AS pkg FROM nation WHERE n_regionkey = 4 UNION SELECT dst FROM r JOIN e ON src = pkg) SELECT pkg FROM r")
def g5_exempt(spark, sf):
    blind = t(spark, sf, "nation").filter("n_regionkey = 4").select(F.col("n_nationkey").alias("pkg"))
    return coverage.exempt_packages(blind, _edges(spark, sf))


@query("""SELECT DISTINCT n.n_nationkey AS src, c_nationkey AS dst FROM customer JOIN nation AS m ON m.n_nationkey = c_custkey % 25 JOIN (SELECT n_name, min(n_nationkey) AS n_nationkey FROM nation GROUP BY n_name) AS n ON n.n_name = m.n_name
WHERE c_custkey % 3 = 0 AND n.n_nationkey <> c_nationkey""")
def j4_package_edges(spark, sf):
    nations = t(spark, sf, "nation")
    named = t(spark, sf, "customer").join(nations.select(F.col("n_nationkey").alias("k"), "n_name"), F.col("c_custkey") % 25 == F.col("k"))
    dependencies = named.select(F.col("c_nationkey").alias("pkg"), F.col("n_name").alias("dep_name"), F.when(F.col("c_custkey") % 3 == 0, "here").alias("path"))
    return paths.package_edges(dependencies, nations.select(F.col("n_nationkey").alias("pkg"), F.col("n_name").alias("name")))


@query("SELECT p_name, min(r.n_nationkey) AS pkg FROM (SELECT DISTINCT p_name, 'NATION_' || p_size AS probe FROM part) JOIN nation AS r ON n_name = probe GROUP BY p_name, probe")
def j5_by_name(spark, sf):
    probes = t(spark, sf, "part").select("p_name", F.concat(F.lit("NATION_"), F.col("p_size").cast("string")).alias("probe")).distinct()
    found = paths.by_name(probes, t(spark, sf, "nation").select(F.col("n_nationkey").alias("pkg"), F.col("n_name").alias("name")), "probe")
    return found.select("p_name", "pkg")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS path, coalesce(string_agg((l_linenumber * 3) || '-' || (l_linenumber * 3 + 1), ',' ORDER BY l_linenumber), '') AS ranges FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def j6_ranges_of_files(spark, sf):
    n = F.col("l_linenumber").cast("int")
    ranges = t(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), (n * 3).alias("a"), (n * 3 + 1).alias("b"))
    found = paths.ranges_of(t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path")), ranges)
    return found.select("path", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string"))), ",").alias("ranges"))


@query(f"""WITH f AS (SELECT DISTINCT path FROM ({_PLACES}) WHERE suffix(path, '.rs')), d AS ({_DIRS}), o AS (SELECT path, max_by(dir, length(dir)) AS pkg FROM f JOIN d ON prefix(path, dir || '/') GROUP BY path)
SELECT path, pkg FROM o WHERE NOT contains(path, '/target/') AND NOT prefix(substr(path, length(pkg) + 2), 'benches/')""")
def f7_package_files(spark, sf):
    return paths.package_files(_places(spark, sf).select("path").distinct(), _dirs(spark, sf)).select("path", "pkg")


@query(f"SELECT DISTINCT path, dir FROM ({_PLACES}) JOIN (VALUES ('crates/brand1/sub'), ('crates/brand1'), ('crates/brand2/src')) AS v(dir) ON path = dir OR prefix(path, dir || '/')")
def j11_under_directory(spark, sf):
    dirs = spark.createDataFrame([("crates/brand1/sub",), ("crates/brand1",), ("crates/brand2/src",)], "dir string")
    return paths.under(_places(spark, sf).select("path").distinct(), dirs, "path", "dir").select("path", "dir")


_FUNCTIONS = "SELECT p_brand AS file, p_type AS name, min(p_partkey) AS fid FROM part WHERE p_size < 20 GROUP BY p_brand, p_type"


def _functions(spark, sf):
    return t(spark, sf, "part").filter("p_size < 20").select(F.col("p_brand").alias("file"), F.col("p_type").alias("name"), F.col("p_partkey").alias("fid"))


@query(f"""WITH f AS ({_FUNCTIONS}), p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'new' END AS path, CASE WHEN p_size % 3 = 0 THEN 'Brand#1' END AS old_path, p_type FROM part)
SELECT p_partkey, coalesce(a.fid, b.fid) AS fid FROM p LEFT JOIN f AS a ON a.file = path AND a.name = p_type LEFT JOIN f AS b ON b.file = old_path AND b.name = p_type""")
def j10_function_of(spark, sf):
    probes = t(spark, sf, "part").select("p_partkey", F.expr("CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'new' END").alias("path"), F.expr("CASE WHEN p_size % 3 = 0 THEN 'Brand#1' END").alias("old_path"), F.col("p_type").alias("key"))
    return coverage.function_of(probes, _functions(spark, sf)).select("p_partkey", "fid")


@query(f"""WITH f AS ({_FUNCTIONS}), i AS (SELECT p_partkey AS pkg, p_brand, p_type, p_size, p_partkey % 13 = 0 AS proc_macro FROM part WHERE p_size % 5 <> 4),
k AS (SELECT i.*, list_transform(CASE p_size % 5 WHEN 0 THEN ['x'] WHEN 1 THEN ['ECONOMY', 'SMALL'] ELSE [] END, lambda m: m) AS ms FROM i)
SELECT pkg, CASE WHEN proc_macro THEN 'runs inside the compiler' WHEN p_size % 5 = 2 THEN 'may run at compile time' WHEN p_size % 5 = 3 THEN 'no body for coverage to see' ELSE 'not in the map' END AS why FROM k
WHERE proc_macro OR p_size % 5 IN (2, 3) OR (p_size % 5 = 0 AND NOT EXISTS (SELECT 1 FROM f WHERE file = p_brand AND name = p_type))
OR (p_size % 5 = 1 AND (SELECT count(*) FROM f WHERE file = p_brand AND name IN ('ECONOMY', 'SMALL')) < 2)""")
def d8_blind_changes(spark, sf):
    size = F.col("p_size") % 5
    kind = F.when(size == 0, "fn").when(size == 1, "impl").when(size == 2, "const fn").when(size == 3, "struct").otherwise("test")
    part = t(spark, sf, "part")
    items = part.select(F.col("p_partkey").alias("pkg"), F.col("p_brand").alias("path"), F.lit(None).cast("string").alias("old_path"), F.when(size == 1, "").otherwise(F.col("p_type")).alias("name"), F.lit(None).cast("string").alias("owner"), kind.alias("kind"), F.array(F.lit("ECONOMY"), F.lit("SMALL")).alias("methods"))
    functions = _functions(spark, sf)
    both = functions.unionByName(functions.withColumn("name", F.concat(F.lit("::"), F.col("name"))))  # methods of the unnamed type
    packages = part.select(F.col("p_partkey").alias("pkg"), (F.col("p_partkey") % 13 == 0).alias("proc_macro"))
    return coverage.changed_functions(items, both, packages)[1].select("pkg", "why")


_COVERED = """WITH f AS (SELECT DISTINCT l_orderkey, p_partkey, 'n' || p_size AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size IN (7, 8, 9)),
g AS (SELECT l_orderkey, p_partkey, name, lag(name) OVER (PARTITION BY l_orderkey ORDER BY p_partkey) AS before FROM f),
s AS (SELECT l_orderkey, count(*) AS n, string_agg(name, ',' ORDER BY p_partkey) AS names FROM g WHERE before IS DISTINCT FROM name GROUP BY l_orderkey),
h AS (SELECT DISTINCT l.l_orderkey, coalesce(n, 0)::INTEGER AS n, coalesce(names, '') AS names FROM lineitem AS l LEFT JOIN s ON s.l_orderkey = l.l_orderkey),
c AS (SELECT names, o_orderkey AS test_id, o_custkey % 40 AS pkg, CASE WHEN o_orderkey % 9 = 0 THEN 'changed' END AS must, CASE WHEN o_orderkey % 4 = 0 THEN 'Dependency' END AS kind, n FROM orders LEFT JOIN h ON l_orderkey = o_orderkey)"""


def _covered(spark, sf, used):
    key = F.col("o_orderkey")
    rows = t(spark, sf, "orders").select(key.alias("test_id"), (F.col("o_custkey") % 40).alias("pkg"), F.when(key % 9 == 0, "changed").alias("must"), F.when(key % 4 == 0, "Dependency").alias("evidence_kind"), F.lit(None).cast("int").alias("evidence_n"), F.lit(None).cast("array<string>").alias("symbols"))
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tid"), F.col("l_partkey").alias("fid"))
    functions = t(spark, sf, "part").select(F.col("p_partkey").alias("fid"), F.concat(F.lit("n"), F.col("p_size").cast("string")).alias("name"), "p_size")
    changed = functions.filter("p_size IN (7, 8, 9)").select("fid")
    exempt = spark.createDataFrame([(3,), (5,)], "pkg long")
    return coverage.apply_coverage(rows, lines.select(F.col("tid").alias("test_id"), "tid").distinct(), lines, changed, functions, exempt, used).select("test_id", F.array_join("covered", ",").alias("covered"), "n_hit", "gated", "must", "evidence_kind", "evidence_n", F.array_join("symbols", ",").alias("symbols"))


@query(f"""{_COVERED} SELECT test_id, names AS covered, n AS n_hit, coalesce(n = 0, false) AND must IS NULL AND kind IS NULL AND pkg NOT IN (3, 5) AS gated, must, CASE WHEN n > 0 AND must IS NULL THEN coalesce(kind, 'Covered') ELSE kind END AS evidence_kind,
CASE WHEN n > 0 AND must IS NULL AND kind IS NULL THEN n END AS evidence_n, CASE WHEN n > 0 AND must IS NULL AND kind IS NULL THEN names END AS symbols FROM c""")
def d8_full_gate(spark, sf):
    return _covered(spark, sf, "gate")


@query(f"""{_COVERED} SELECT test_id, names AS covered, n AS n_hit, false AS gated, CASE WHEN n > 0 THEN coalesce(must, 'covered') ELSE must END AS must, CASE WHEN n > 0 AND must IS NULL THEN coalesce(kind, 'Covered') ELSE kind END AS evidence_kind,
CASE WHEN n > 0 AND must IS NULL AND kind IS NULL THEN n END AS evidence_n, CASE WHEN n > 0 AND must IS NULL AND kind IS NULL THEN names END AS symbols FROM c""")
def d8_must_boost(spark, sf):
    return _covered(spark, sf, coverage.policy_used("must", 3, 200))


@query("""SELECT (SELECT count(DISTINCT p_brand) FROM part) AS files, (SELECT count(*) FROM part) AS functions, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS packages, (SELECT count(*) FROM orders) AS tests,
(SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS tests_without, (SELECT count(*) FROM lineitem) AS hits""")
def k14_map_counts(spark, sf):
    hits = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tid"), F.col("l_partkey").alias("fid"))
    return coverage.map_counts(t(spark, sf, "part").withColumn("file", F.col("p_brand")), t(spark, sf, "orders").select(F.col("o_orderkey").alias("tid"), F.col("o_orderstatus").alias("package")), hits)


@query("""SELECT DISTINCT l_orderkey AS tid, fid FROM lineitem JOIN (SELECT p_size AS symbol, min_by(p_brand, p_partkey) AS file, min_by(p_type, p_partkey) AS name FROM part GROUP BY p_size) AS i ON symbol = l_suppkey % 50
JOIN (SELECT p_brand AS file, p_type AS name, min(p_partkey) AS fid FROM part WHERE p_size < 20 GROUP BY p_brand, p_type) AS f USING (file, name)""")
def j27_executed_functions(spark, sf):
    symbols = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tid"), (F.col("l_suppkey") % 50).cast("int").alias("symbol"))
    items = t(spark, sf, "part").select(F.col("p_size").alias("symbol"), F.col("p_brand").alias("file"), F.col("p_type").alias("key"), F.col("p_partkey").alias("seq"))
    return coverage.executed_functions(symbols, items, _functions(spark, sf))


# A call graph: parts are functions, and a line item is a reference from its part to the part of its supplier's number.
_NODES = """n AS (SELECT p_partkey AS node, p_brand || '/' || p_size AS file, p_partkey % 2 AS scope, CASE WHEN p_size % 10 = 0 THEN 'new' ELSE replace(p_name, ' ', '_') END AS name, CASE WHEN p_size % 3 = 0 THEN p_type END AS owner, p_partkey % 7 = 0 AS is_test FROM part)"""
_REFS = f"""{_NODES}, r AS (SELECT DISTINCT l_partkey AS node, CASE l_suppkey % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'method' WHEN 2 THEN 'seg' ELSE 'last' END AS ref_kind, p_type AS qual, n.name FROM lineitem JOIN part ON p_partkey = l_suppkey JOIN n ON n.node = l_suppkey),
o AS (SELECT r.*, n.file, n.scope FROM r JOIN n USING (node)),
l AS (SELECT o.node, ref_kind, qual, o.name, arg_min(x.node, (CASE WHEN x.scope = o.scope THEN 0 ELSE 1 END, x.node)) AS target FROM o JOIN n AS x ON x.file = o.file AND x.name = o.name AND NOT x.is_test AND x.owner IS NULL AND x.scope IN (o.scope, 0) WHERE ref_kind = 'plain' GROUP BY ALL
  UNION ALL SELECT o.node, ref_kind, qual, o.name, x.node FROM o JOIN n AS x ON x.file = o.file AND x.name = o.name AND NOT x.is_test AND x.owner IS NOT NULL WHERE ref_kind = 'method'
  UNION ALL SELECT o.node, ref_kind, qual, o.name, min(x.node) FROM o JOIN n AS x ON x.file = o.file AND x.name = o.name AND NOT x.is_test AND x.owner = o.qual WHERE ref_kind = 'last' GROUP BY ALL),
e AS (SELECT DISTINCT node, 'local' AS kind, target, NULL::VARCHAR AS owner, NULL::VARCHAR AS name FROM l
  UNION SELECT node, CASE WHEN name <> 'new' THEN 'global' ELSE 'qualified' END, NULL, CASE WHEN name = 'new' THEN qual END, name FROM o ANTI JOIN l USING (node, ref_kind, qual, name) WHERE name <> 'new' OR ref_kind = 'last')"""


def _nodes(spark, sf):
    size = F.col("p_size")
    name = F.when(size % 10 == 0, "new").otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    return t(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.concat_ws("/", "p_brand", size.cast("string")).alias("file"), (F.col("p_partkey") % 2).alias("scope"), name.alias("name"), F.when(size % 3 == 0, F.col("p_type")).alias("owner"), (F.col("p_partkey") % 7 == 0).alias("is_test"))


def _references(spark, sf):
    nodes, kind = _nodes(spark, sf), F.col("l_suppkey") % 4
    targets = t(spark, sf, "part").select(F.col("p_partkey").alias("l_suppkey"), F.col("p_type").alias("qual")).join(nodes.select(F.col("node").alias("l_suppkey"), "name").hint("merge"), "l_suppkey")
    refs = t(spark, sf, "lineitem").join(targets.hint("merge"), "l_suppkey")
    refs = refs.select(F.col("l_partkey").alias("node"), F.when(kind == 0, "plain").when(kind == 1, "method").when(kind == 2, "seg").otherwise("last").alias("ref_kind"), "qual", "name").distinct()
    scopes = nodes.select("file").distinct().crossJoin(F.broadcast(spark.createDataFrame([(0, 0, 0), (1, 1, 0), (1, 0, 1)], "scope long, ancestor long, hops int")))  # three rows
    return nodes, refs, scopes


@query(f"WITH {_REFS} SELECT * FROM e")
def j16_owner_fallback(spark, sf):
    return evidence.resolved(*_references(spark, sf))


_ITEMS = "i AS (SELECT DISTINCT p_brand || '/' || p_size AS file, CASE WHEN p_size % 10 = 0 THEN 'new' ELSE replace(p_name, ' ', '_') END AS name, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN p_type END AS owner FROM part WHERE p_partkey % 97 IN (0, 1, 2))"


def _changed(spark, sf, nodes):
    items = nodes.filter("node % 97 IN (0, 1, 2)").select("file", "name", F.when(F.col("node") % 2 == 0, F.col("owner")).alias("owner"))
    return evidence.changed_nodes(items, nodes)


@query(f"WITH {_NODES}, {_ITEMS} SELECT i.file, i.name, i.owner, node FROM i LEFT JOIN n ON n.file = i.file AND n.name = i.name AND n.owner IS NOT DISTINCT FROM i.owner AND NOT is_test")
def j18_changed_nodes(spark, sf):
    return _changed(spark, sf, _nodes(spark, sf))


@query(f"""WITH {_REFS}, {_ITEMS}, c AS (SELECT i.*, node FROM i LEFT JOIN n ON n.file = i.file AND n.name = i.name AND n.owner IS NOT DISTINCT FROM i.owner AND NOT is_test),
h0 AS (SELECT e.node, concat_ws('::', c.owner, c.name) AS label, c.file FROM e JOIN c ON (kind = 'local' AND e.target = c.node) OR (kind = 'global' AND e.name = c.name) OR (kind = 'qualified' AND c.name = 'new' AND e.owner = c.owner)),
a AS (SELECT node, name, owner, file FROM n WHERE NOT is_test AND node IN (SELECT node FROM h0) AND node NOT IN (SELECT node FROM c WHERE node IS NOT NULL)),
h1 AS (SELECT e.node, concat_ws('::', a.owner, a.name) AS label, a.file FROM e JOIN a ON (kind = 'local' AND e.target = a.node) UNION SELECT e.node, concat_ws('::', a.owner, a.name), a.file FROM e JOIN a ON kind = 'global' AND e.name = a.name AND a.name <> 'new'
  UNION SELECT e.node, concat_ws('::', a.owner, a.name), a.file FROM e JOIN a ON kind = 'qualified' AND a.name = 'new' AND e.owner = a.owner),
t AS (SELECT * FROM n WHERE is_test),
z AS (SELECT t.node, 0 AS d, label, true AS own FROM t JOIN h0 USING (node) UNION SELECT t.node, 1, label, h1.file = t.file FROM t JOIN h1 USING (node) WHERE t.node NOT IN (SELECT node FROM h0)),
y AS (SELECT node, d, bool_or(own) AS near FROM z GROUP BY ALL)
SELECT node, CASE WHEN d = 0 THEN 'Direct' WHEN near THEN 'Helper' ELSE 'Transitive' END AS kind, CAST(count(DISTINCT label) FILTER (own OR NOT near) AS INTEGER) AS n_symbols, min(label) FILTER (own OR NOT near) AS first_symbol FROM z JOIN y USING (node, d) GROUP BY node, d, near""")
def d7_evidence(spark, sf):
    nodes, refs, scopes = _references(spark, sf)
    found = evidence.causes(nodes, evidence.linked(nodes, refs, scopes), _changed(spark, sf, nodes), 1, nodes.filter("is_test"))
    return evidence.test_evidence(nodes, found, 1).select("node", "kind", F.size("symbols").alias("n_symbols"), F.get("symbols", F.lit(0)).alias("first_symbol"))


@query(f"WITH {_NODES} SELECT o_orderkey AS test_id, min(node) AS node FROM orders JOIN n ON file = 'Brand#' || (o_custkey % 25) || '/' || (o_orderkey % 50) AND name = CASE WHEN o_orderkey % 50 % 10 = 0 THEN 'new' ELSE 'hot_gear' END AND is_test AND node % 100 BETWEEN 20 AND 70 GROUP BY 1")
def j17_test_nodes(spark, sf):
    place = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25).cast("string"), F.lit("/"), (F.col("o_orderkey") % 50).cast("string"))
    tests = t(spark, sf, "orders").select(F.col("o_orderkey").alias("test_id"), place.alias("file"), F.when(F.col("o_orderkey") % 50 % 10 == 0, "new").otherwise("hot_gear").alias("name"), F.lit(20).alias("start"), F.lit(70).alias("end"))
    return evidence.test_nodes(tests, _nodes(spark, sf).withColumn("line", F.col("node") % 100))


@query("""WITH c AS (SELECT o_orderkey AS test_id, o_custkey % 10 AS pkg, CASE WHEN o_orderkey % 9 = 0 THEN 'changed' END AS must, CASE o_orderkey % 4 WHEN 0 THEN 'Direct' WHEN 1 THEN 'Transitive' END AS kind FROM orders)
SELECT test_id, CASE WHEN kind = 'Direct' THEN coalesce(must, 'direct') WHEN pkg = 3 THEN coalesce(must, 'package') ELSE must END AS must, CASE WHEN kind IS NULL AND pkg IN (1, 2) THEN 'Dependency' ELSE kind END AS evidence_kind,
CASE WHEN kind IS NOT NULL THEN 'f' WHEN pkg = 1 THEN 'lock: a|lock: b' WHEN pkg = 2 THEN 'lock: c' END AS symbols FROM c""")
def j28_evidence(spark, sf):
    key = F.col("o_orderkey")
    rows = t(spark, sf, "orders").select(key.alias("test_id"), (F.col("o_custkey") % 10).alias("pkg"), F.when(key % 9 == 0, "changed").alias("must"))
    found = rows.filter("test_id % 4 < 2").select("test_id", F.when(F.col("test_id") % 4 == 0, "Direct").otherwise("Transitive").alias("kind"), F.lit(1).alias("n"), F.array(F.lit("f")).alias("symbols"))
    why = spark.createDataFrame([(1, "lock: b"), (1, "lock: a"), (2, "lock: c")], "pkg long, why string")
    applied = evidence.apply_evidence(rows, found, why)
    return evidence.force_whole(applied, spark.createDataFrame([(3,)], "pkg long")).select("test_id", "must", "evidence_kind", F.array_join("symbols", "|").alias("symbols"))


# Candidates of judging: orders, in files and modules.
_OPEN = """c AS (SELECT o_orderkey AS position, o_orderpriority AS file, o_custkey % 700 AS module, CASE WHEN o_custkey % 100 = 0 AND o_orderkey % 6 = 0 THEN 0.2 ELSE 0.0 END AS bonus FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 5 <> 0),
g AS (SELECT file, module, min(position) AS first, count(*) AS members, bool_or(bonus > 0) AS evidence FROM c GROUP BY file, module),
q AS (SELECT *, row_number() OVER (PARTITION BY (NOT evidence AND members > 1) ORDER BY first) AS k FROM g),
s AS (SELECT *, CASE WHEN evidence THEN 'kept-evidence' WHEN members = 1 THEN 'single' WHEN k <= 150 THEN 'ask' ELSE 'overbudget' END AS plan FROM q),
z AS (SELECT *, CASE WHEN plan = 'ask' AND module % 7 <> 0 THEN (module % 10) / 10.0 END AS group_score FROM s),
w AS (SELECT *, CASE WHEN plan <> 'ask' THEN plan WHEN group_score IS NULL THEN 'failed' WHEN group_score < 0.3 THEN 'dropped' ELSE 'kept' END AS screen FROM z)"""


def _open(spark, sf):
    key = F.col("o_orderkey")
    return t(spark, sf, "orders").select(key.alias("position"), F.col("o_orderpriority").alias("file"), (F.col("o_custkey") % 700).alias("module"), F.when((F.col("o_custkey") % 100 == 0) & (key % 6 == 0), 0.2).otherwise(0.0).alias("bonus"), F.when(key % 17 == 0, "changed").alias("must"), (key % 5 == 0).alias("gated"))


def _screened(spark, sf):
    groups = judging.screening_plan(judging.test_groups(_open(spark, sf)), 150)
    answers = groups.filter("module % 7 <> 0").select("file", "module", ((F.col("module") % 10) / 10.0).alias("score"))
    return judging.screened(groups, answers, 0.3)


@query(f"WITH {_OPEN} SELECT file, module, first, members, evidence FROM g")
def a1_test_groups(spark, sf):
    return judging.test_groups(_open(spark, sf))


@query(f"WITH {_OPEN} SELECT file, module, screen, group_score::DOUBLE AS group_score FROM w")
def d10_screening(spark, sf):
    return _screened(spark, sf).select("file", "module", "screen", "group_score")


@query(f"""WITH {_OPEN}, x AS (SELECT position, screen, screen IN ('kept-evidence', 'single', 'kept') AS alive FROM c JOIN w USING (file, module)), y AS (SELECT *, row_number() OVER (PARTITION BY alive ORDER BY position) AS k FROM x)
SELECT position, screen, CASE WHEN NOT alive THEN 'notasked' WHEN k * 2 <= 500 - (SELECT count(*) FROM w WHERE plan = 'ask') THEN 'ask' ELSE 'overbudget' END AS judge FROM y""")
def w3_two_stages(spark, sf):
    return judging.judging_plan(_open(spark, sf), graph.cut(_screened(spark, sf)), 500, 2).select("position", "screen", "judge")


@query("""WITH v AS (SELECT o_orderkey AS test_id, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 101) / 101.0::DOUBLE END AS names, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 89) / 89.0::DOUBLE END AS body FROM orders)
SELECT test_id, names, body, CASE WHEN names IS NULL AND body IS NULL THEN 'failed' ELSE 'judged' END AS judge FROM v""")
def d11_view_scores(spark, sf):
    i = F.col("test_id")
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("test_id"), F.lit("ask").alias("judge"))
    answers = rows.filter(i % 3 != 0).select("test_id", F.lit("names").alias("view"), ((i % 101) / 101.0).alias("score")).unionByName(rows.filter(i % 4 != 0).select("test_id", F.lit("body").alias("view"), ((i % 89) / 89.0).alias("score")))
    return judging.view_scores(rows, answers).select("test_id", "names", "body", "judge")


@query(f"WITH {_OPEN} SELECT file, module, '{{\"file\":\"' || file || '\",\"module\":' || module || ',\"tests\":\"' || substr(string_agg(DISTINCT 't' || position, ', ' ORDER BY 't' || position), 1, 600) || '\"}}' AS question FROM c GROUP BY file, module")
def x23_group_questions(spark, sf):
    rows = judging.open_candidates(_open(spark, sf)).withColumn("name", F.concat(F.lit("t"), F.col("position").cast("string")))
    return judging.group_questions(rows.select("file", "module").distinct(), rows.select("file", "module", "name"))


@query("SELECT o_custkey % 10 AS part, count(*) AS requests, sum(o_custkey) AS input_tokens, round(sum(o_custkey) * 0.042 / 1000000, 9) AS cost FROM orders GROUP BY 1 HAVING o_custkey % 10 = 3")
def a9_usage(spark, sf):
    rows = t(spark, sf, "orders").filter("o_custkey % 10 = 3").select(F.lit(1).alias("requests"), F.col("o_custkey").alias("input_tokens"), F.lit(0).alias("output_tokens"))
    return policy.usage_cost(rows).select(F.lit(3).cast("long").alias("part"), "requests", "input_tokens", F.round("cost", 9).alias("cost"))


# Two states of a lock file: parts are entries, named by their brand, with their type as version.
@query("""WITH x AS (SELECT p_brand AS name, p_type AS version, 'old' AS side FROM part WHERE p_size < 12 AND p_brand <> 'Brand#4' UNION SELECT p_brand, p_type, 'new' FROM part WHERE p_size BETWEEN 9 AND 20 AND p_brand <> 'Brand#5'),
v AS (SELECT name, coalesce(string_agg(DISTINCT version, '/' ORDER BY version) FILTER (side = 'old'), '') AS o, coalesce(string_agg(DISTINCT version, '/' ORDER BY version) FILTER (side = 'new'), '') AS n FROM x GROUP BY name)
SELECT name, name || ' ' || CASE WHEN o = '' THEN n || ' (added)' WHEN n = '' THEN o || ' (removed)' WHEN o = n THEN n || ' (checksum or dependencies)' ELSE o || ' → ' || n END AS what FROM v""")
def a7_version_sets(spark, sf):
    part = t(spark, sf, "part").select("p_size", F.col("p_brand").alias("name"), F.col("p_type").alias("version"))
    old = part.filter("p_size < 12 AND name <> 'Brand#4'").withColumn("side", F.lit("old"))
    return locks.version_sets(old.unionByName(part.filter("p_size BETWEEN 9 AND 20 AND name <> 'Brand#5'").withColumn("side", F.lit("new"))))


@query("""WITH o AS (SELECT p_brand, p_type AS k1, CASE WHEN p_type <> 'SMALL' THEN p_name END AS k2, min(p_size) AS v FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL), n AS (SELECT p_brand, p_type AS k1, CASE WHEN p_type <> 'SMALL' AND NOT (p_type = 'ECONOMY' AND p_brand = 'Brand#2') THEN p_name END AS k2, min(p_size) AS v FROM part WHERE p_partkey % 4 <> 0 GROUP BY ALL),
d AS (SELECT coalesce(o.p_brand, n.p_brand) AS p_brand, coalesce(o.k1, n.k1) AS k1, coalesce(o.k2, n.k2) AS k2 FROM o FULL JOIN n ON o.p_brand = n.p_brand AND o.k1 = n.k1 AND o.k2 IS NOT DISTINCT FROM n.k2 WHERE o.v IS DISTINCT FROM n.v),
m AS (SELECT d.p_brand, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.p_brand = d.p_brand AND o.k1 = d.k1 AND o.k2 IS NOT NULL) AND EXISTS (SELECT 1 FROM n WHERE n.p_brand = d.p_brand AND n.k1 = d.k1 AND n.k2 IS NOT NULL) THEN '[' || k1 || '.' || k2 || ']' ELSE '[' || k1 || ']' END AS label FROM d),
l AS (SELECT p_brand, list_sort(list(DISTINCT label)) AS l FROM m GROUP BY p_brand)
SELECT p_brand, array_to_string(list_slice(l, 1, 6), ', ') || CASE WHEN len(l) > 6 THEN ' and ' || (len(l) - 6) || ' more' ELSE '' END AS keys FROM l""")
def j9_differing_keys(spark, sf):
    part = t(spark, sf, "part").withColumn("k1", F.col("p_type"))
    table_ = F.when(F.col("p_type") != "SMALL", F.col("p_name"))
    old = part.filter("p_partkey % 3 <> 0").withColumn("k2", table_)
    new = part.filter("p_partkey % 4 <> 0").withColumn("k2", F.when(~((F.col("p_type") == "ECONOMY") & (F.col("p_brand") == "Brand#2")), table_))
    least = lambda df: df.groupBy("p_brand", "k1", "k2").agg(F.min("p_size").alias("value"))
    return locks.differing_keys(least(old), least(new), ["p_brand"])


@query(f"""WITH p AS (SELECT p_partkey, path, split_part(path, '/', 2) AS crate FROM ({_PLACES})), f AS (SELECT DISTINCT path AS file FROM p WHERE p_partkey % 50 = 0),
l AS (SELECT DISTINCT crate AS pkg, path AS text FROM p WHERE p_partkey % 7 = 0),
h AS (SELECT DISTINCT pkg, file FROM l JOIN f ON string_split(text, '/')[-1] = string_split(file, '/')[-1]
  UNION SELECT DISTINCT pkg, file FROM l JOIN f ON list_contains(list_transform(range(1, len(string_split(file, '/'))), lambda i: string_split(file, '/')[i] || '/' || string_split(file, '/')[i + 1]), string_split(text, '/')[-2] || '/' || string_split(text, '/')[-1]))
SELECT pkg, file FROM h""")
def j19_named_files(spark, sf):
    rows = _places(spark, sf)
    files = rows.filter("p_partkey % 50 = 0").select(F.col("path").alias("file"), F.lit(False).alias("gitlink")).distinct()
    literals = rows.filter("p_partkey % 7 = 0").select(F.split("path", "/")[1].alias("pkg"), F.lit("x.rs").alias("path"), F.lit(1).alias("line"), F.concat(F.lit("../"), "path").alias("text")).distinct()
    return references.named_files(literals, files).select("pkg", "file")


@query(f"WITH f AS (SELECT DISTINCT path AS file FROM ({_PLACES})) SELECT file FROM f WHERE NOT suffix(file, 'ring.rs')")
def u4_unnamed_files(spark, sf):
    files = _places(spark, sf).select(F.col("path").alias("file")).distinct()
    return references.unnamed_files(files, files.filter(F.col("file").endswith("ring.rs")))


@query("SELECT page_id, length(trim(url)) > 0 AND octet_length(encode(url)) <= 512 AND (contains(url, '/') OR contains(url, '.')) AS candidate FROM pages")
def f11_literal_candidates(spark, sf):
    return t(spark, sf, "pages").select("page_id", references.literal_candidate(F.col("url")).alias("candidate"))


@query("""WITH f AS (SELECT o_orderkey % 17 = 0 AS must, o_orderkey % 5 = 0 AS gated, o_orderkey % 11 = 0 AS dropped FROM orders)
SELECT 'candidates' AS layer, count(*) AS n FROM f UNION ALL SELECT 'forced', count(*) FILTER (must) FROM f UNION ALL SELECT 'not covered', count(*) FILTER (NOT must AND gated) FROM f UNION ALL SELECT 'screened out', count(*) FILTER (NOT must AND NOT gated AND dropped) FROM f""")
def k5_summary(spark, sf):
    return policy.summary(policy.decide(_flags(spark, sf))).filter(F.col("layer").isin("candidates", "forced", "not covered", "screened out"))


@query("""SELECT '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":' || p_size || '}' AS value FROM part""")
def k3_report(spark, sf):
    return policy.report(t(spark, sf, "part"), "p_partkey", "p_name", "p_size")


@query("SELECT p_name AS name, CASE WHEN p_size > 25 THEN 'selected: ' ELSE 'skipped: ' END || p_brand || '; ' || CASE p_size % 3 WHEN 0 THEN 'coverage unknown' WHEN 1 THEN 'covers no changed function' ELSE 'covers 4 changed' END || CASE WHEN p_size % 2 = 0 THEN '; evidence Direct' ELSE '' END AS why FROM part WHERE contains(p_name, 'ring')")
def k6_explanations(spark, sf):
    size = F.col("p_size")
    rows = t(spark, sf, "part").select(F.col("p_name").alias("name"), (size > 25).alias("selected"), F.array("p_brand").alias("reasons"), F.when(size % 3 == 1, 0).when(size % 3 == 2, 4).alias("n_hit"), F.when(size % 2 == 0, "Direct").alias("evidence_kind"))
    return policy.explain(rows, "name", "ring")


@query("SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id FROM events ORDER BY user_id, event_type, event_id")
def a14_first_occurrence(spark, sf):
    from ..operators.joins import first_wins

    return first_wins(t(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id, list_aggregate(list_transform(list_distinct(list(event_type ORDER BY event_id)), lambda x: 1), 'count') AS n FROM events GROUP BY user_id")
def a15_distinct_in_order(spark, sf):
    lists = t(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    return lists.select("user_id", F.size(F.array_distinct(F.transform("x", lambda x: x["event_type"]))).cast("long").alias("n"))


@query("SELECT count(DISTINCT p_brand) AS files, count(DISTINCT p_type) AS packages FROM part")
def a11_distinct_counts(spark, sf):
    return t(spark, sf, "part").agg(F.count_distinct("p_brand").alias("files"), F.count_distinct("p_type").alias("packages"))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT 0 AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM r JOIN e ON src = node WHERE hops < 24), m AS (SELECT node, min(hops) AS hops FROM r GROUP BY node)
SELECT n_name AS name, hops, row_number() OVER (ORDER BY hops, n_name) AS place FROM m JOIN nation ON n_nationkey = node""")
def t_b_reach_order(spark, sf):
    starts = t(spark, sf, "nation").filter("n_nationkey = 0").select(F.lit(0).alias("start"), F.col("n_nationkey").alias("node"))
    found = graph.reach(starts, _edges(spark, sf)).join(t(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name")), "node")
    return ranking.numbered(found.select("name", "hops"), "hops", "name").withColumnRenamed("number", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_size, p_name, p_partkey) - 1 AS fid FROM part")
def t_c_function_order(spark, sf):
    rows = t(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    return ranking.numbered(rows, "p_brand", "p_size", "p_name", "p_partkey").select("p_partkey", (F.col("number") - 1).alias("fid"))


@query("SELECT user_id, arg_min(event_id, ts) AS oldest FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id")
def t_d_oldest_since(spark, sf):
    return t(spark, sf, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'").groupBy("user_id").agg(F.min_by("event_id", "ts").alias("oldest"))


@query("SELECT doc_id, substr(text, 1, 80) AS head FROM documents")
def t_f_truncate(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.truncated(F.col("text"), 80).alias("head"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, 'f' || CASE WHEN user_id = 1 THEN ', 1 commit' ELSE ', ' || user_id || ' commits' END AS line FROM events""")
def x8_times_and_counts(spark, sf):
    line = F.concat_ws(", ", F.lit("f"), X.counted(F.col("user_id"), "commit"))
    return t(spark, sf, "events").select("event_id", X.rfc3339(F.col("ts")).alias("at"), line.alias("line"))


@query("SELECT p_partkey, concat_ws('::', nullif(p_type, 'SMALL'), p_name) AS path FROM part")
def x3_qualified(spark, sf):
    return t(spark, sf, "part").select("p_partkey", X.qualified(F.when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_type")), F.col("p_name")).alias("path"))


@query("SELECT p_partkey, replace(replace(replace('p/' || p_brand || '$' || p_name, '/', '~2f'), '#', '~23'), ' ', '~20') AS key FROM (SELECT p_partkey, p_brand, p_name FROM part)".replace("'$'", "'~24'"))
def x6_test_keys(spark, sf):
    return t(spark, sf, "part").select("p_partkey", X.test_key(F.concat(F.lit("p/"), "p_brand"), F.col("p_name")).alias("key"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS lines FROM documents")
def x16_line_slice(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("lines"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) || ',' || split_part(p_name, ' ', 2) AS names FROM part")
def x17_captures(spark, sf):
    words = F.split("p_name", " ")
    text = F.concat(F.lit("{{x}} {"), words[0], F.lit("} {9a} {"), words[1], F.lit(":>8} { z }"))
    return t(spark, sf, "part").select("p_partkey", F.array_join(X.captures(text), ",").alias("names"))


@query("SELECT p_partkey, p_type || '::' || p_name AS key, length(p_name) >= 3 AS telling, octet_length(encode(p_name || '.rs')) >= 5 AS named, split_part(p_name, ' ', 2) AS item, '/a/' || p_name AS path, p_name || ' ' || p_type AS line FROM part")
def x2_names(spark, sf):
    name = F.col("p_name")
    return t(spark, sf, "part").select(
        "p_partkey", X.item_key(F.col("p_type"), name).alias("key"), X.keyable(name).alias("telling"), X.distinctive(F.concat(name, F.lit(".rs"))).alias("named"), X.clean_item(F.concat(F.lit("a::r#"), F.split(name, " ")[1], F.lit("<T>"))).alias("item"),
        F.concat(F.lit("/"), F.array_join(X.path_components(F.concat(F.lit("./a/../"), name)), "/")).alias("path"), X.snippet(F.concat(F.lit("x\n  "), name, F.lit(" \n\t"), F.col("p_type"), F.lit("\ny")), F.lit(2), F.lit(3)).alias("line"),
    )


@query("SELECT p_partkey, p_brand || ',' || p_type AS packages, p_size BETWEEN 5 AND 9 AS meets FROM part")
def x10_filter_packages(spark, sf):
    text = F.format_string("package(=%s) | (package( %s ) & test(x))", "p_brand", "p_type")
    return t(spark, sf, "part").select("p_partkey", F.array_join(X.filter_packages(text), ",").alias("packages"), X.overlaps(F.lit(5), F.lit(9), F.col("p_size"), F.col("p_size")).alias("meets"))
