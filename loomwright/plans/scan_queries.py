"""Queries of loose lines, profile folders, symbols, package metadata, map ages, manifests, answers, shadowed names,
discovery and path arguments, on analytical tables that stand in for these relations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import clean_owner, symbol_item
from ..sources import metadata, readers
from . import discovery, emission, evidence, history, judging, loose, manifests, mapping, references
from .queries import query, t

# Changed ranges and item spans of 40 files, by number of line.
_RANGES = "SELECT 'f' || (o_custkey % 40) AS path, (o_orderkey * 7) % 9000 + 1 AS a, (o_orderkey * 7) % 9000 + 1 + o_custkey % 25 AS b FROM orders WHERE o_orderkey % 11 = 0"
_SPANS = "SELECT 'f' || (p_partkey % 40) AS path, (p_partkey * 131) % 9000 + 1 AS start, (p_partkey * 131) % 9000 + 1 + p_size * 2 AS \"end\", CASE WHEN p_partkey % 9 = 0 THEN 'mod' ELSE 'fn' END AS kind FROM part"


def _line_ranges(spark, sf):
    at = F.col("o_orderkey") * 7 % 9000 + 1
    return t(spark, sf, "orders").filter("o_orderkey % 11 = 0").select(F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string")).alias("path"), at.alias("a"), (at + F.col("o_custkey") % 25).alias("b"))


def _line_spans(spark, sf):
    key = F.col("p_partkey")
    at = key * 131 % 9000 + 1
    return t(spark, sf, "part").select(F.concat(F.lit("f"), (key % 40).cast("string")).alias("path"), at.alias("start"), (at + F.col("p_size") * 2).alias("end"), F.when(key % 9 == 0, "mod").otherwise("fn").alias("kind"))


@query(f"""WITH r AS ({_RANGES}), s AS ({_SPANS}), l AS (SELECT DISTINCT path, unnest(range(a, b + 1)) AS line FROM r), c AS (SELECT DISTINCT path, unnest(range(start, "end" + 1)) AS line FROM s WHERE kind <> 'mod'),
u AS (SELECT path, line, line // 4096 AS k, line - row_number() OVER (PARTITION BY path, line // 4096 ORDER BY line) AS run FROM (FROM l EXCEPT FROM c))
SELECT path, min(line) AS a, max(line) AS b FROM u GROUP BY path, k, run""")
def f14_uncovered_lines(spark, sf):
    return loose.uncovered_lines(_line_ranges(spark, sf), _line_spans(spark, sf))


# Documents as source files: two changed ranges, two items, a private import, and their own lines.
_FILE = "source || CASE doc_id % 4 WHEN 0 THEN '/src/m' || doc_id || '.rs' WHEN 1 THEN '/tests/t' || doc_id || '.rs' WHEN 2 THEN '/src/d' || doc_id || '/mod.rs' ELSE '/src/deep/m' || doc_id || '.rs' END"
_LOOSE = f"""f AS (SELECT doc_id, source AS pkg, {_FILE} AS path, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, path, ls[n] AS text, n FROM (SELECT doc_id, path, ls, unnest(range(1, len(ls) + 1)) AS n FROM f)),
c AS (SELECT path, n, n BETWEEN 9 + doc_id % 3 AND 11 + doc_id % 4 AS private FROM l WHERE (n BETWEEN 1 + doc_id % 7 AND 4 + doc_id % 7 OR n BETWEEN 9 AND 9 + doc_id % 9)
  AND NOT (n BETWEEN 3 + doc_id % 5 AND 5 + doc_id % 11) AND NOT (doc_id % 2 = 0 AND n = 1) AND NOT regexp_matches(regexp_replace(text, '^\\s+', ''), '^(//|/\\*|\\*|$)')),
g AS (SELECT path, min(n) FILTER (NOT private) AS code_line, coalesce(bool_or(private), false) AS private_use FROM c GROUP BY path)"""


def _files(spark, sf):
    key, pkg = F.col("doc_id"), F.col("source")
    tail = F.when(key % 4 == 0, F.format_string("/src/m%d.rs", key)).when(key % 4 == 1, F.format_string("/tests/t%d.rs", key)).when(key % 4 == 2, F.format_string("/src/d%d/mod.rs", key)).otherwise(F.format_string("/src/deep/m%d.rs", key))
    return t(spark, sf, "documents").select("doc_id", pkg.alias("pkg"), F.concat(pkg, tail).alias("path"), "text")


def _loose(spark, sf):
    files, key = _files(spark, sf), F.col("doc_id")
    ranges = files.select("path", F.inline(F.array(F.struct((1 + key % 7).alias("a"), (4 + key % 7).alias("b")), F.struct(F.lit(9).cast("long").alias("a"), (9 + key % 9).alias("b")))))
    first = F.struct((3 + key % 5).alias("start"), (5 + key % 11).alias("end"), F.lit("fn").alias("kind"))
    items = files.select("path", F.inline(F.array(first, F.struct(F.lit(1).cast("long").alias("start"), F.when(key % 2 == 0, 1).otherwise(0).cast("long").alias("end"), F.lit("struct").alias("kind")), F.struct(F.lit(1).cast("long").alias("start"), F.lit(99).cast("long").alias("end"), F.lit("mod").alias("kind")))))
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")
    uses = files.select("path", (9 + key % 3).alias("start"), (11 + key % 4).alias("end"))
    return loose.loose_lines(ranges, items, lines, uses)


@query(f"WITH {_LOOSE} SELECT path, code_line, private_use FROM g")
def f14_loose_lines(spark, sf):
    return _loose(spark, sf)


@query(f"""WITH {_LOOSE}, m AS (SELECT {_FILE} AS file FROM documents WHERE doc_id % 3 = 0 UNION SELECT source || '/src/m' || doc_id || '/inner.rs' FROM documents WHERE doc_id % 5 = 0),
r AS (SELECT g.*, pkg, CASE WHEN regexp_matches(g.path, '/(tests/[^/]*|mod\\.rs)$') THEN regexp_replace(g.path, '/[^/]*$', '') ELSE regexp_replace(g.path, '\\.rs$', '') END AS scope FROM g JOIN f USING (path))
SELECT pkg, CASE WHEN pkg = 'src7' THEN path WHEN code_line IS NOT NULL THEN path || ':' || code_line ELSE path END AS item,
  CASE WHEN pkg = 'src7' THEN 'runs inside the compiler' WHEN code_line IS NOT NULL THEN 'code outside of all items' ELSE 'import in a file that the map has never seen' END AS why
FROM r WHERE pkg = 'src7' OR code_line IS NOT NULL OR NOT EXISTS (SELECT 1 FROM m WHERE file = path OR prefix(file, scope || '/'))
UNION ALL SELECT source, {_FILE}, 'does not parse' FROM documents WHERE doc_id % 50 = 0""")
def d8_loose_blind(spark, sf):
    files = _files(spark, sf)
    packages = files.select("pkg", F.col("pkg").alias("dir"), (F.col("pkg") == "src7").alias("proc_macro")).distinct()
    inner = files.filter("doc_id % 5 = 0").select(F.concat(F.col("pkg"), F.format_string("/src/m%d/inner.rs", F.col("doc_id"))).alias("file"))
    functions = files.filter("doc_id % 3 = 0").select(F.col("path").alias("file")).union(inner).distinct().withColumn("fid", F.xxhash64("file"))
    escalations = files.filter("doc_id % 50 < 2").select(F.col("path").alias("file"), F.when(F.col("doc_id") % 50 == 0, "whole").otherwise("changed").alias("kind"), "pkg", F.lit("does not parse").alias("why"))
    known = _loose(spark, sf).join(files.select("path", "pkg"), "path")
    return loose.judge_loose(known, packages, functions)[1].unionByName(loose.whole_blind(escalations))


_SYMBOLS = """SELECT p_partkey AS k, 'a' || p_partkey AS low, 'T' || (p_partkey % 50) AS typ, 'm' || p_size AS m FROM part"""


@query(f"""WITH s AS ({_SYMBOLS}) SELECT k, CASE k % 9 WHEN 0 THEN m WHEN 1 THEN typ || '::' || m WHEN 2 THEN typ || '::' || m WHEN 3 THEN low WHEN 4 THEN typ || '<b::c<d>>::' || m WHEN 5 THEN m WHEN 6 THEN '<' || typ || '>' WHEN 7 THEN typ || '::' || m ELSE '{{closure#' || k || '}}' END AS item FROM s""")
def x5_symbol_items(spark, sf):
    s = t(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.format_string("a%d", "p_partkey").alias("low"), F.format_string("T%d", F.col("p_partkey") % 50).alias("typ"), F.format_string("m%d", "p_size").alias("m"))
    text = lambda form: F.format_string(form.replace("L", "%1$s").replace("T", "%2$s").replace("M", "%3$s").replace("K", "%4$d"), "low", "typ", "m", "k")
    forms = ["crate::L::M", "f.rs;crate::L::T::M", "<&mut dyn crate::T<x::y> as core::Q<A::B<C>>>::M::<u8>", "crate::L::{closure#0}::T::M", "crate::T<b::c<d>>::M", "<impl Fn(x) -> crate::y<u8>>::L::M", "<T>", "<crate::T<fn(a) -> b::c>>::M", "{closure#K}"]
    symbol = F.element_at(F.array(*map(text, forms)), (F.col("k") % len(forms) + 1).cast("int"))
    return s.select("k", symbol_item(symbol).alias("item"))


@query("SELECT DISTINCT 't' || l_orderkey AS key, 's' || l_partkey AS symbol FROM lineitem WHERE l_orderkey % 3 = 0 AND l_suppkey % 4 > 0")
def s18_profiles(spark, sf):
    line = t(spark, sf, "lineitem").filter("l_orderkey % 3 = 0")
    path = F.format_string("file:/w/profiles/t%d/%d.proftext", "l_orderkey", "l_linenumber")
    record = F.format_string("s%d\n# Func Hash:\n77\n# Num Counters:\n2\n# Counter Values:\n%d\n9\n", "l_partkey", F.col("l_suppkey") % 4)
    return readers.executed_records(line.select(readers.folder_of(path).alias("key"), record.alias("value")), "key")


_REGIONS = """SELECT 's' || (p_partkey % 1500) AS symbol, 'q::T' || (p_size % 7) || '::m' || (p_partkey % 50) AS readable, CASE WHEN p_size % 5 = 0 THEN 'out/target/f.rs' WHEN p_size % 5 = 1 THEN 'else/f.rs' ELSE 'c/src/f' || (p_partkey % 30) || '.rs' END AS file,
p_partkey % 200 + 1 AS start, p_partkey % 200 + 6 AS "end", p_partkey AS seq, 'T' || (p_size % 7) || '::m' || (p_partkey % 50) AS plain FROM part"""
_MAP = f"""r AS ({_REGIONS}), o AS (SELECT * FROM r WHERE prefix(file, 'c/') QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq) = 1),
i AS (SELECT 'c/src/f' || (s_suppkey % 30) || '.rs' AS file, s_suppkey % 180 AS s, s_suppkey % 180 + 20 + s_suppkey % 9 AS e, CASE WHEN s_suppkey % 2 = 0 THEN 'O::' ELSE '' END || 'n' || (s_suppkey % 9) AS key, s_suppkey % 5 = 0 AS module, s_suppkey AS n FROM supplier),
j AS (SELECT o.*, i.key, i.s, i.e, coalesce(i.n IS NOT NULL AND NOT module, false) AS found FROM o LEFT JOIN i ON i.file = o.file AND o.start BETWEEN i.s AND i.e QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i.e - i.s, i.n DESC) = 1),
x AS (SELECT symbol, seq, file, CASE WHEN found THEN key ELSE plain END AS name, CASE WHEN found THEN s ELSE start END::INTEGER AS start, CASE WHEN found THEN e ELSE "end" END::INTEGER AS "end" FROM j),
f AS (SELECT * EXCLUDE (seq, symbol) FROM x QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY seq, symbol) = 1),
g AS (SELECT row_number() OVER (ORDER BY file, start, name) - 1 AS fid, file, name, start, "end" FROM f),
w AS (SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderpriority, 't' || o_orderkey) - 1 AS tid, o_orderkey FROM orders WHERE o_orderkey % 20 = 0)"""


def _map(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size") % 5
    file = F.when(size == 0, "out/target/f.rs").when(size == 1, "else/f.rs").otherwise(F.format_string("c/src/f%d.rs", key % 30))
    regions = t(spark, sf, "part").select(F.format_string("s%d", key % 1500).alias("symbol"), F.format_string("q::T%d::m%d", F.col("p_size") % 7, key % 50).alias("readable"), file.alias("file"), (key % 200 + 1).alias("start"), (key % 200 + 6).alias("end"), key.alias("seq"))
    s = F.col("s_suppkey")
    items = t(spark, sf, "supplier").select(F.format_string("c/src/f%d.rs", s % 30).alias("file"), F.format_string("n%d", s % 9).alias("name"), F.when(s % 2 == 0, "O").alias("owner"), F.when(s % 5 == 0, "mod").otherwise("fn").alias("kind"), (s % 180).alias("start"), (s % 180 + 20 + s % 9).alias("end"), s.alias("seq"))
    tests = t(spark, sf, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("package"), F.col("o_orderpriority").alias("binary_id"), F.format_string("t%d", "o_orderkey").alias("name"))
    executed = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.format_string("s%d", F.col("l_partkey") % 1500).alias("symbol"))
    packages = spark.createDataFrame([("c",), ("out",)], "dir string")
    return mapping.build_map(tests, executed, regions, items, packages, "out/target")


@query(f'WITH {_MAP} SELECT fid, file, name, start, "end" FROM g')
def d16_map_functions(spark, sf):
    return _map(spark, sf)[0]


@query(f"WITH {_MAP} SELECT DISTINCT tid, fid FROM w JOIN lineitem ON l_orderkey = o_orderkey JOIN x ON symbol = 's' || (l_partkey % 1500) JOIN g USING (file, name)")
def d16_map_hits(spark, sf):
    return _map(spark, sf)[2]


_HISTORY = """p AS (SELECT 'c' || c_custkey AS commit, CASE WHEN c_custkey % 400 <> 0 THEN 'c' || (c_custkey - 1) END AS parent FROM customer UNION ALL SELECT 'c' || c_custkey, 'c' || (c_custkey - 5) FROM customer WHERE c_custkey % 7 = 0),
m AS (SELECT n_nationkey AS map_id, 'c' || (n_nationkey * 37 + 5) AS commit, CASE WHEN n_nationkey % 5 = 0 THEN 'gone' ELSE 'c' || (n_nationkey * 37 + 60) END AS base, 'c' || (n_nationkey * 37 + CASE WHEN n_nationkey % 4 = 0 THEN 2 ELSE 90 END) AS head,
  CASE n_nationkey % 3 WHEN 0 THEN 'gate' WHEN 1 THEN 'must' ELSE 'boost' END AS requested, CASE WHEN n_nationkey % 2 = 0 THEN 50 ELSE 100 END AS max_age FROM nation)"""


@query(f"""WITH RECURSIVE {_HISTORY}, n AS (SELECT commit FROM p UNION SELECT parent FROM p WHERE parent IS NOT NULL), b AS (SELECT m.*, CASE WHEN base IN (SELECT commit FROM n) THEN base ELSE head END AS own FROM m),
r AS (SELECT DISTINCT unnest([commit, own, head]) AS start, start AS node FROM b UNION SELECT start, parent FROM r JOIN p ON commit = node WHERE parent IS NOT NULL),
a AS (SELECT b.*, CASE WHEN EXISTS (SELECT 1 FROM r WHERE start = head AND node = b.commit) THEN (SELECT count(*) FROM r WHERE start = own AND node NOT IN (SELECT q.node FROM r AS q WHERE q.start = b.commit)) END AS age FROM b),
s AS (SELECT *, CASE WHEN age IS NULL THEN 'built at ' || commit || ', which is not in the head''s history' WHEN age > max_age THEN age || CASE WHEN age = 1 THEN ' commit' ELSE ' commits' END || ' behind, at most ' || max_age || ' allowed' END AS stale FROM a)
SELECT map_id, age, stale, CASE WHEN stale IS NOT NULL AND requested <> 'boost' THEN 'boost' ELSE requested END AS used, CASE WHEN stale IS NOT NULL AND requested <> 'boost' THEN 'stale map (' || stale || '): ' || requested || ' → boost' END AS reason FROM s""")
def x22_map_ages(spark, sf):
    c, n = F.col("c_custkey"), F.col("n_nationkey")
    commit = lambda number: F.format_string("c%d", number)
    first = t(spark, sf, "customer").select(commit(c).alias("commit"), F.when(c % 400 != 0, commit(c - 1)).alias("parent"))
    parents = first.unionByName(t(spark, sf, "customer").filter("c_custkey % 7 = 0").select(commit(c).alias("commit"), commit(c - 5).alias("parent")))
    requested = F.when(n % 3 == 0, "gate").when(n % 3 == 1, "must").otherwise("boost")
    maps = t(spark, sf, "nation").select(n.alias("map_id"), commit(n * 37 + 5).alias("commit"), F.when(n % 5 == 0, "gone").otherwise(commit(n * 37 + 60)).alias("base"), commit(n * 37 + F.when(n % 4 == 0, 2).otherwise(90)).alias("head"), requested.alias("requested"), F.when(n % 2 == 0, 50).otherwise(100).alias("max_age"))
    return history.map_ages(maps, parents).select("map_id", "age", "stale", "used", "reason")


# Metadata documents of 60 customers each: packages, of which one in four is no member, and two dependencies of each.
_METADATA = """c AS (SELECT c_custkey AS k, c_custkey // 60 AS w, c_custkey % 4 <> 0 AS member FROM customer), e AS (SELECT c.w, d.k AS used, c.k AS user, c.member AND d.member AS members, c.k % 3 <> 0 OR d.k = c.k + 3 AS path FROM c JOIN c AS d ON d.w = c.w AND d.k IN (c.k + 3, c.k + 7))"""


def _metadata(spark, sf):
    k = F.col("c_custkey")
    name, ident = (lambda x: F.format_string("c%d", x)), (lambda x: F.format_string("i%d", x))
    place = F.when(k % 8 == 0, F.format_string("/vendor/c%d/Cargo.toml", k)).when(k % 60 == 1, "/w/Cargo.toml").otherwise(F.format_string("/w/crates/c%d/Cargo.toml", k))
    targets = F.array(F.struct(name(k).alias("name"), F.array(F.when(k % 5 == 0, "proc-macro").otherwise("lib")).alias("kind")), F.struct(F.format_string("b%d", k).alias("name"), F.array(F.when(k % 6 == 1, "bin").otherwise("test")).alias("kind")))
    dependencies = F.array(F.struct(name(k + 3).alias("name"), F.lit("/w/x").alias("path")), F.struct(name(k + 7).alias("name"), F.when(k % 3 != 0, "/w/y").alias("path")))
    package = F.struct(ident(k).alias("id"), name(k).alias("name"), place.alias("manifest_path"), F.when(k % 12 == 0, "registry").alias("source"), targets.alias("targets"), dependencies.alias("dependencies"))
    node = F.struct(ident(k).alias("id"), F.array(ident(k + 3), ident(k + 7)).alias("dependencies"))
    each = t(spark, sf, "customer").groupBy(F.floor(k / 60).alias("workspace")).agg(F.array_sort(F.collect_list(package)).alias("packages"), F.collect_list(F.when(k % 4 != 0, ident(k))).alias("workspace_members"), F.collect_list(node).alias("nodes"))
    document = F.struct("packages", "workspace_members", F.lit("/w").alias("workspace_root"), F.lit("/w/target").alias("target_directory"), F.struct("nodes").alias("resolve"))
    return metadata.parsed(each.select("workspace", F.to_json(document).alias("text")))


@query(f"WITH {_METADATA} SELECT w AS workspace, 'i' || k AS pkg, 'c' || k AS name, CASE WHEN k % 60 = 1 THEN '' ELSE 'crates/c' || k END AS dir, k % 5 = 0 AS proc_macro, CASE WHEN k % 6 = 1 THEN 'b' || k ELSE '' END AS bins FROM c WHERE member")
def s7_member_packages(spark, sf):
    return metadata.member_packages(_metadata(spark, sf)).withColumn("bins", F.array_join("bins", ","))


@query(f"WITH {_METADATA} SELECT w AS workspace, 'i' || used AS src, 'i' || user AS dst FROM e WHERE members AND path")
def s7_package_users(spark, sf):
    return metadata.package_users(_metadata(spark, sf))


@query(f"""WITH RECURSIVE {_METADATA}, r AS (SELECT w, k AS start, k AS node FROM c WHERE NOT member AND k % 12 <> 0 AND k % 8 <> 0 UNION SELECT r.w, start, user FROM r JOIN e ON e.w = r.w AND used = node)
SELECT r.w AS workspace, 'crates/c' || start AS dir, coalesce(string_agg('c' || node, ',' ORDER BY 'c' || node) FILTER (node <> start AND c.member), '') AS dependents FROM r JOIN c ON k = node GROUP BY r.w, start""")
def s8_path_dependencies(spark, sf):
    return metadata.path_dependencies(_metadata(spark, sf)).withColumn("dependents", F.array_join("dependents", ","))


# Manifests: one in nine is a root, every kind of change to them, by key.
_VERDICTS = """SELECT 'm' || p_partkey AS manifest, CASE WHEN p_partkey % 9 = 0 AND p_partkey % 2 = 0 THEN NULL ELSE p_partkey % 40 END AS pkg, p_partkey % 8 AS k,
CASE WHEN p_partkey % 9 = 0 THEN 'full' ELSE 'whole' END AS harsh, p_partkey % 9 = 0 AND p_partkey % 2 = 0 AS plain FROM part"""


@query(f"""WITH v AS ({_VERDICTS}) SELECT manifest, pkg, CASE WHEN k IN (0, 1) THEN 'ignore' WHEN k IN (2, 3) AND NOT plain THEN 'changed' ELSE harsh END AS verdict,
CASE k WHEN 0 THEN 'only versions of members changed' WHEN 1 THEN 'only versions of members changed' WHEN 2 THEN CASE WHEN plain THEN 'manifest changed: [dependencies.serde]' ELSE 'dependencies changed: [dependencies.serde]' END
WHEN 3 THEN CASE WHEN plain THEN 'manifest changed: [target.cfg(unix)]' ELSE 'dependencies changed: [target.cfg(unix).dev-dependencies.nix]' END WHEN 4 THEN 'manifest changed: [features.f], [profile.release]'
WHEN 5 THEN 'manifest added or deleted' WHEN 6 THEN 'manifest does not parse' ELSE 'manifest changed: [edition]' END AS why FROM v""")
def x20_manifest_verdicts(spark, sf):
    key = F.col("p_partkey")
    form = '{"package":{"name":"x","version":"%s"},"workspace":{"dependencies":{"own":{"path":"../own","version":"%s"}}},"dependencies":{"serde":{"version":"%s"},"alias":{"package":"own","path":"../own","version":"%s"}},"target":{"cfg(unix)":{"dev-dependencies":{"nix":"%s"}}},"profile":{"release":{"lto":%s}},"features":{"f":%s},"edition":%s}'
    old = F.format_string(form, *map(F.lit, ("1", "1", "1", "1", "1", "true", "[]", "2021")))
    k = key % 8
    if_ = lambda n, then, other: F.when(k == n, then).otherwise(other)
    new = F.format_string(form, if_(0, "2", "1"), if_(1, "3", "1"), if_(2, "4", "1"), if_(1, "5", "1"), if_(3, "6", "1"), if_(4, '{"deep":{"er":1}}', "true"), if_(4, '["a"]', "[]"), if_(7, "2024", "2021"))
    rows = t(spark, sf, "part").select(F.format_string("m%d", key).alias("manifest"), (key % 9 == 0).alias("root"), F.when((key % 9 != 0) | (key % 2 != 0), key % 40).alias("pkg"), old.alias("old"), F.when(k == 6, "{oops").when(k != 5, new).alias("new"))
    return manifests.manifest_verdicts(rows, spark.createDataFrame([("own",), ("x",)], "name string"))


_BATCHES = """SELECT l_orderkey AS batch, count(*) AS n, CASE WHEN l_orderkey % 7 = 0 THEN 'no response' WHEN l_orderkey % 7 = 1 OR (l_orderkey % 7 = 2 AND count(*) > 2) THEN 'answers missing' WHEN l_orderkey % 7 = 3 THEN 'response without answers' END AS failure FROM lineitem GROUP BY l_orderkey"""


def _responses(spark, sf):
    order, place = F.col("l_orderkey"), F.col("place")
    placed = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("q"))
    questions = placed.select(order.alias("batch"), F.posexplode("q").alias("place", "x")).select("batch", "place", F.concat_ws("-", F.col("batch").cast("string"), place.cast("string")).alias("qkey"))
    answer = lambda x, i: F.format_string('"t%d":{"score":%s}', F.when((order % 7 == 2) & (i == 2), 99).otherwise(i), F.when((order % 7 == 1) & (i == 0), '"high"').otherwise(F.format_string("0.%d5", i)))
    body = F.array_join(F.transform("q", answer), ",")
    text = F.when(order % 7 == 3, "{oops").otherwise(F.format_string('{"answers":{%s},"usage":{"input_tokens":%d,"output_tokens":3}}', body, F.size("q")))
    return placed.filter(order % 7 != 0).select(order.alias("batch"), text.alias("text")), questions


@query(f"WITH b AS ({_BATCHES}), q AS (SELECT l_orderkey AS batch, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS place FROM lineitem) SELECT batch || '-' || place AS qkey, CAST('0.' || place || '5' AS DOUBLE) AS score FROM q JOIN b USING (batch) WHERE failure IS NULL")
def x23_answers(spark, sf):
    return judging.parse_answers(*_responses(spark, sf))[0]


@query(f"WITH b AS ({_BATCHES}) SELECT batch, n::INTEGER AS asked, CASE WHEN failure IS NULL THEN n ELSE 0 END::BIGINT AS input_tokens, CASE WHEN failure IS NULL THEN 3 ELSE 0 END::BIGINT AS output_tokens, failure FROM b")
def x23_batches(spark, sf):
    return judging.parse_answers(*_responses(spark, sf))[1]


@query("""WITH r AS (SELECT l_orderkey AS node, CASE l_partkey % 3 WHEN 0 THEN 'method' ELSE 'plain' END AS ref_kind, CASE WHEN l_suppkey % 2 = 0 THEN 'v' ELSE 'V' END || (l_suppkey % 6) AS name, l_linenumber = 1 AS called FROM lineitem),
b AS (SELECT o_orderkey AS node, CASE WHEN o_custkey % 2 = 0 THEN 'v' ELSE 'V' END || (o_custkey % 6) AS name FROM orders)
SELECT DISTINCT node, ref_kind, name FROM r WHERE ref_kind = 'method' OR called OR NOT (prefix(name, 'v') AND EXISTS (SELECT 1 FROM b WHERE b.node = r.node AND b.name = r.name))""")
def f12_unshadowed(spark, sf):
    name = lambda c: F.concat(F.when(F.col(c) % 2 == 0, "v").otherwise("V"), (F.col(c) % 6).cast("string"))
    refs = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node"), F.when(F.col("l_partkey") % 3 == 0, "method").otherwise("plain").alias("ref_kind"), F.lit(None).cast("string").alias("qual"), name("l_suppkey").alias("name"), (F.col("l_linenumber") == 1).alias("called"))
    return evidence.unshadowed(refs, t(spark, sf, "orders").select(F.col("o_orderkey").alias("node"), name("o_custkey").alias("name"))).select("node", "ref_kind", "name")


@query(f"""WITH f AS (SELECT doc_id, source AS pkg, {_FILE} AS path FROM documents), s AS (SELECT f.*, CAST(substr(pkg, 4) AS INTEGER) % 3 AS depth FROM f WHERE CAST(substr(pkg, 4) AS INTEGER) % 4 <> 0),
u AS (SELECT DISTINCT pkg FROM s WHERE doc_id % 97 = 0), e AS (SELECT s.*, unnest(range(0, 1 + doc_id % 3)) AS seq FROM s WHERE doc_id % 97 <> 0)
SELECT row_number() OVER (ORDER BY depth, pkg, path, seq) AS position, pkg, depth, path AS file, seq, 't' || seq AS name, CASE WHEN doc_id % 5 = 0 AND seq * 5000 <= 7000 AND seq * 5000 + 3000 >= 5500 THEN 'changed' WHEN pkg = 'src5' OR pkg IN (FROM u) THEN 'package' END AS must FROM e""")
def d6_candidates(spark, sf):
    files, key = _files(spark, sf), F.col("doc_id")
    packages = files.select("pkg", F.col("pkg").alias("name"), F.col("pkg").alias("dir")).distinct()
    number = F.substring("pkg", 4, 9).cast("int")
    tests = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), key % 3)).alias("seq")).select("path", "seq", (F.col("seq") * 5_000).alias("start"), (F.col("seq") * 5_000 + 3_000).alias("end"), F.lit("m").alias("module"), F.format_string("t%d", "seq").alias("name"))
    ranges = files.filter(key % 5 == 0).select("path", F.lit(5_500).alias("a"), F.lit(7_000).alias("b"))
    whole = packages.filter("pkg = 'src5'").select("pkg")
    found, _ = discovery.candidate_tests(files, packages, packages.filter(number % 4 != 0).select("pkg", (number % 3).alias("hops")), tests, ranges, whole, files.filter(key % 97 == 0).select("path"))
    return found.select("position", "pkg", "depth", "file", "seq", "name", "must")


@query("""WITH k AS (SELECT 'f/p' || p_partkey || '.rs' AS path, CASE WHEN p_size % 5 <> 0 THEN p_size % 4 END AS lines, p_partkey % 3 = 0 AS changed, regexp_matches('f/p' || p_partkey || '.rs', '^f/p(4.*|1|2|3|5)\\.rs$') AS asked, p_partkey IN (1, 2, 3, 5) AS named FROM part)
SELECT path, CASE WHEN changed THEN 'added' ELSE 'modified' END AS status, CASE WHEN changed THEN '7-9' WHEN lines IS NULL THEN '' ELSE '1-' || greatest(lines, 1) END AS ranges FROM k WHERE (changed AND asked) OR (named AND NOT changed)
UNION ALL SELECT 'g/d/' || s_suppkey, 'added', '7-9' FROM supplier""")
def f3_restricted(spark, sf):
    place = lambda name, key: F.format_string(name, key)
    files = t(spark, sf, "part").select("p_partkey", place("f/p%d.rs", F.col("p_partkey")).alias("path"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 4).alias("lines"))
    paths = files.filter("p_partkey % 3 = 0").select("path").union(t(spark, sf, "supplier").select(place("g/d/%d", F.col("s_suppkey")))).union(t(spark, sf, "supplier").select(place("h/d/%d", F.col("s_suppkey"))))
    ranges = F.array(F.struct(F.lit(7).alias("a"), F.lit(9).alias("b")))
    changes = paths.select(F.lit(None).cast("string").alias("old_path"), F.col("path").alias("new_path"), F.lit("added").alias("status"), ranges.alias("old_ranges"), ranges.alias("new_ranges"))
    found = discovery.restrict(changes, ["./f/p1.rs", "f/p2.rs/", "f/p3.rs", "f/p4*.rs", "f/p5.rs", "g", "nowhere.rs", "f/p1.rs"], files)
    return found.select(F.col("new_path").alias("path"), "status", F.array_join(F.transform("new_ranges", lambda r: F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string"))), ",").alias("ranges"))


@query("""WITH o AS (SELECT 'data/d' || (p_partkey % 300) || '/f' || p_size AS file, p_partkey % 300 AS d, p_size FROM part WHERE p_size % 5 = 0), f AS (SELECT DISTINCT * FROM o),
n AS (SELECT DISTINCT file, s_suppkey % 10 AS pkg FROM f JOIN supplier ON s_suppkey % 300 = d AND p_size = 25)
SELECT 'full' AS mode, file, 'full' AS kind, CAST(NULL AS BIGINT) AS pkg FROM f UNION ALL SELECT 'ignore', file, 'ignored', NULL FROM f UNION ALL SELECT 'referenced', file, 'whole', pkg FROM n UNION ALL SELECT 'referenced', file, 'ignored', NULL FROM f WHERE file NOT IN (SELECT file FROM n)""")
def d3_outside_modes(spark, sf):
    files = t(spark, sf, "part").filter("p_size % 5 = 0").select(F.format_string("data/d%d/f%d", F.col("p_partkey") % 300, "p_size").alias("file"), F.lit(False).alias("gitlink")).distinct()
    literals = t(spark, sf, "supplier").select((F.col("s_suppkey") % 10).alias("pkg"), F.lit("a.rs").alias("path"), F.lit(3).alias("line"), F.format_string("see ../d%d/f25 here", F.col("s_suppkey") % 300).alias("text"))
    found = None
    for mode in ("full", "ignore", "referenced"):
        escalations, ignored = references.outside_paths(files, mode, literals)
        rows = escalations.select(F.lit(mode).alias("mode"), "file", "kind", "pkg").unionByName(ignored.select(F.lit(mode).alias("mode"), "file", F.lit("ignored").alias("kind"), F.lit(None).cast("long").alias("pkg")))
        found = rows if found is None else found.unionByName(rows)
    return found


_EMISSION = """c AS (SELECT c_nationkey AS pkg, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'm' || (c_custkey % 2) END AS module, 't' || (c_custkey % 20) AS name, c_custkey % 11 = 0 AS fresh, c_custkey % 5 = 0 OR c_custkey % 11 = 0 AS selected FROM customer),
r AS (SELECT n_nationkey AS pkg, n_name AS name, n_regionkey AS hops, n_nationkey % 6 = 0 AS whole FROM nation WHERE n_nationkey % 4 <> 1),
n AS (SELECT pkg, string_agg(DISTINCT c.name, '|' ORDER BY c.name) FILTER (selected) AS names, string_agg(DISTINCT c.name, '|' ORDER BY c.name) FILTER (fresh) AS changed FROM c GROUP BY pkg),
s AS (SELECT hops, r.name, CASE WHEN whole THEN 'package(=' || r.name || ')' ELSE 'package(=' || r.name || ') & test(/(^|::)(' || names || ')($|::)/)' END AS term, CASE WHEN NOT whole THEN 'package(=' || r.name || ') & test(/(^|::)(' || changed || ')($|::)/)' END AS changed
  FROM r LEFT JOIN n ON n.pkg = r.pkg WHERE whole OR names IS NOT NULL)"""


def _emission(spark, sf):
    key = F.col("c_custkey")
    candidates = t(spark, sf, "customer").select(F.col("c_nationkey").alias("pkg"), F.when(key % 3 == 0, "").otherwise(F.format_string("m%d", key % 2)).alias("module"), F.format_string("t%d", key % 20).alias("name"), F.when(key % 11 == 0, "changed").alias("must"), ((key % 5 == 0) | (key % 11 == 0)).alias("selected"))
    nation = t(spark, sf, "nation").select(F.col("n_nationkey").alias("pkg"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("hops"))
    return candidates, nation.filter("pkg % 4 <> 1").select("pkg", "hops"), nation.select("pkg", "name"), nation.filter("pkg % 6 = 0").select("pkg")


@query(f"WITH {_EMISSION} SELECT hops, name, term, changed FROM s")
def d14_package_terms(spark, sf):
    return emission.package_terms(*_emission(spark, sf))


@query(f"""WITH {_EMISSION}, a AS (SELECT string_agg('(' || term || ')', ' | ' ORDER BY hops, name) AS chosen, string_agg('(' || changed || ')', ' | ' ORDER BY hops, name) AS fresh, string_agg('-p ' || name, ' ' ORDER BY hops, name) AS ps FROM s)
SELECT '((' || chosen || ') & not (test(slow) | test(flaky)))' || coalesce(' | ' || fresh, '') || ' | (package(=extra) & test(x))' AS filter, 'cargo nextest run ' || ps || ' -p extra -E' AS command FROM a""")
def d14_filter_plan(spark, sf):
    plan = emission.filter_plan(emission.package_terms(*_emission(spark, sf)), ("test(slow)", "test(flaky)"), ("package(=extra) & test(x)",))
    return plan.select("filter", F.array_join(F.slice("command", 1, F.size("command") - 1), " ").alias("command"))


@query(f"""WITH {_EMISSION}, f AS (SELECT pkg, string_agg(DISTINCT CASE WHEN module = '' THEN name ELSE module || '::' || name END, ' ' ORDER BY CASE WHEN module = '' THEN name ELSE module || '::' || name END) AS tests FROM c WHERE selected GROUP BY pkg)
SELECT hops, r.name, 'cargo test -p ' || r.name || ' --quiet' || CASE WHEN whole OR r.name = 'NATION_3' THEN '' ELSE ' -- ' || tests END AS command FROM r LEFT JOIN f ON f.pkg = r.pkg WHERE whole OR r.name = 'NATION_3' OR tests IS NOT NULL
UNION ALL SELECT NULL, 'a b', 'cargo test -p ''a b'' --quiet'""")
def d14_package_commands(spark, sf):
    candidates, reached, packages, whole = _emission(spark, sf)
    commands = emission.package_commands(candidates, reached, packages, whole, ("package(=NATION_3)", "package(=a b) | package(=NATION_3)"), more=("--quiet",))
    return commands.select("hops", "name", emission.command_line(F.col("command")).alias("command"))


@query("SELECT o_orderkey, regexp_replace(regexp_replace(o_orderpriority, '^[0-9]-', ''), ' ', '_', 'g') AS owner FROM orders")
def x4_clean_owner(spark, sf):
    bare = F.regexp_replace(F.regexp_replace("o_orderpriority", "^[0-9]-", ""), " ", "_")
    forms = F.element_at(F.array(F.concat(F.lit("&'a mut x::"), bare), F.concat(F.lit("r#"), bare), F.concat(F.lit("dyn a::"), bare, F.lit("<b::c>"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return t(spark, sf, "orders").select("o_orderkey", clean_owner(forms).alias("owner"))


@query("""WITH l AS (SELECT l_orderkey AS diff_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey % 6, l_suppkey % 4 = 0) - 1 AS place, l_partkey AS p, l_suppkey % 6 AS k, l_suppkey % 4 = 0 AS sub FROM lineitem)
SELECT diff_id, place::INTEGER AS place, CASE WHEN k IN (0, 1) THEN NULL WHEN k = 3 THEN 'old/o' || p || '.rs' ELSE 'n/é' || place || '.rs' END AS old_path, CASE WHEN k <> 2 THEN 'n/é' || place || '.rs' END AS new_path,
  CASE k WHEN 0 THEN 'added' WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' ELSE 'modified' END AS status, CASE WHEN k = 5 THEN '' ELSE '3-4' END AS old_ranges, CASE WHEN k = 5 THEN '' ELSE (p % 50 + 1) || '-' || (p % 50 + 2) || ',90-90' END AS new_ranges, sub AS gitlink FROM l
UNION ALL SELECT o_orderkey, NULL, NULL, 'u/x' || o_custkey || '.rs', 'untracked', '', '1-' || greatest(o_custkey % 9, 1), false FROM orders WHERE o_orderkey % 5 = 0""")
def s3_changed_files(spark, sf):
    lines = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("p"), (F.col("l_suppkey") % 6).alias("k"), (F.col("l_suppkey") % 4 == 0).alias("sub")))).alias("q"))
    said = lambda before, n, after: F.concat(F.lit(before), F.coalesce(n.cast("string"), F.lit("null")), F.lit(after))
    name = lambda i: said("n/\\303\\251", i, ".rs")  # noqa: E731  quoted as a diff quotes it
    code = lambda k: F.element_at(F.array(*map(F.lit, ("A", "C75", "D", "R090", "M", "T"))), (k + 1).cast("int"))
    raw = lambda x, i: F.concat(F.lit(":100644 "), F.when(x["sub"], "160000").otherwise("100644"), F.lit(" aaa bbb "), code(x["k"]), F.when(x["k"].isin(1, 3), said("\told/o", x["p"], ".rs")).otherwise(""), F.lit('\t"'), name(i), F.lit('"\n'))
    hunks = lambda x: F.when(x["k"] == 5, "").otherwise(said("@@ -3,2 +", x["p"] % 50 + 1, ",2 @@ fn\n+--- a/x\n+++ b/y\n@@ -8,0 +90 @@\n"))
    heads = lambda x, i: F.concat(F.when(x["k"] == 3, said("--- a/old/o", x["p"], ".rs")).otherwise(F.concat(F.lit('--- "a/'), name(i), F.lit('"'))), F.when(x["k"] == 2, "\n+++ /dev/null\n").otherwise(F.concat(F.lit('\n+++ "b/'), name(i), F.lit('"\n'))))
    patch = lambda x, i: F.concat(F.lit("diff --git a/q b/q\n"), F.when(x["k"] == 5, "").otherwise(heads(x, i)), hunks(x))
    text = F.concat(F.array_join(F.transform("q", raw), ""), F.lit("\n"), F.array_join(F.transform("q", patch), ""))
    untracked = t(spark, sf, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("diff_id"), F.explode(F.array(F.format_string("u/x%d.rs", "o_custkey"), F.lit("u/y.txt"))).alias("path"), (F.col("o_custkey") % 9).cast("int").alias("lines"))
    show = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string"))), ",").alias(c)
    return readers.changed_files(lines.select(F.col("l_orderkey").alias("diff_id"), text.alias("text")), untracked).select("diff_id", "place", "old_path", "new_path", "status", show("old_ranges"), show("new_ranges"), "gitlink")
