"""Queries of the change-impact operators on analytical tables, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import graph, incidence, joins, ranking
from . import policy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("SELECT l_orderkey, count(DISTINCT l_partkey) AS n_hit FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7 GROUP BY l_orderkey")
def j13_incidence_hits(spark, sf):
    changed = t(spark, sf, "part").filter("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return incidence.hit_functions(t(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), changed, "l_orderkey", "l_partkey")


@query("""WITH h AS (SELECT l_orderkey, count(DISTINCT CASE WHEN p_size = 7 THEN l_partkey END) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT o_orderkey, n AS n_hit, coalesce(n = 0, false) AND o_orderpriority <> '1-URGENT' AS gated FROM orders LEFT JOIN h ON l_orderkey = o_orderkey""")
def d8_gate(spark, sf):
    changed = t(spark, sf, "part").filter("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    hits = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return incidence.gate(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), hits, changed, "o_orderkey", "l_partkey", F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "n_hit", "gated")


@query("SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events")
def w1_view_ranks(spark, sf):
    return ranking.view_ranks(t(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", F.col("value"), "event_id").drop("value")


@query("""SELECT event_id, event_type, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events)
WHERE r <= least(30, ceil(0.25 * c))""")
def w2_capped_topk(spark, sf):
    return ranking.capped_top(t(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", F.col("value"), "event_id", 30, 0.25).select("event_id", "event_type", "rank")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r * 2 <= 600")
def w3_budget(spark, sf):
    return ranking.within_budget(t(spark, sf, "documents").select("doc_id"), "doc_id", 2, 600)


_SUPPLIERS = "SELECT s_suppkey, s_acctbal, s_acctbal > 0 OR s_nationkey = 3 AS sel, s_nationkey = 3 AS forced FROM supplier"


def _suppliers(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", "s_acctbal", ((F.col("s_acctbal") > 0) | (F.col("s_nationkey") == 3)).alias("sel"), (F.col("s_nationkey") == 3).alias("forced"))


@query(f"""WITH s AS ({_SUPPLIERS}), r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey DESC) AS r FROM s WHERE sel AND NOT forced)
SELECT s.s_suppkey, sel AND NOT coalesce(r <= (SELECT count(*) FROM s WHERE sel) - 20, false) AS sel, coalesce(r <= (SELECT count(*) FROM s WHERE sel) - 20, false) AS capped FROM s LEFT JOIN r USING (s_suppkey)""")
def w4_max_cap(spark, sf):
    return ranking.max_cap(_suppliers(spark, sf), "sel", "forced", "s_acctbal", "s_suppkey", 20).select("s_suppkey", "sel", "capped")


@query(f"""WITH s AS ({_SUPPLIERS}), r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM s WHERE NOT sel), n AS (SELECT (SELECT count(*) FROM s WHERE sel) + 5 - (SELECT count(*) FROM s WHERE sel) AS n)
SELECT s.s_suppkey, sel OR coalesce(r <= n, false) AS sel, coalesce(r <= n, false) AS padded FROM s CROSS JOIN n LEFT JOIN r USING (s_suppkey)""")
def w5_min_pad(spark, sf):
    rows = _suppliers(spark, sf)
    return ranking.min_pad(rows, "sel", "s_acctbal", "s_suppkey", F.count_if("sel") + 5).select("s_suppkey", "sel", "padded")


@query("SELECT CAST(floor((r - 1) / 100) AS BIGINT) AS batch, count(*) AS n, min(conv_id) AS first_conv FROM (SELECT conv_id, row_number() OVER (ORDER BY conv_id, turn) AS r FROM conversations) GROUP BY 1")
def w7_batches(spark, sf):
    return ranking.batches(t(spark, sf, "conversations").select("conv_id", "turn"), 100, "conv_id", "turn").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_conv"))


_EDGES = "SELECT n_nationkey AS src, (7 * n_nationkey + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, (3 * n_nationkey + 1) % 25 FROM nation WHERE n_nationkey % 2 = 0"


def _edges(spark, sf):
    n = F.col("n_nationkey")
    nations = t(spark, sf, "nation")
    return nations.select(n.alias("src"), ((7 * n + 3) % 25).alias("dst")).union(nations.filter(n % 2 == 0).select(n, (3 * n + 1) % 25)).distinct()


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT 0 AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM r JOIN e ON src = node WHERE hops < 24) SELECT node, min(hops) AS hops FROM r GROUP BY node""")
def g1_reach(spark, sf):
    starts = t(spark, sf, "nation").filter("n_nationkey = 0").select(F.col("n_nationkey").alias("start"), F.col("n_nationkey").alias("node"))
    return graph.reach(starts, _edges(spark, sf)).select("node", "hops")


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT n_nationkey AS start, n_nationkey AS node, 0 AS hops FROM nation WHERE n_regionkey = 1 UNION SELECT start, dst, hops + 1 FROM r JOIN e ON src = node WHERE hops < 3) SELECT start, node, min(hops) AS hops FROM r GROUP BY start, node""")
def g3_attributed_reach(spark, sf):
    starts = t(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("start"), F.col("n_nationkey").alias("node"))
    return graph.reach(starts, _edges(spark, sf), 3)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), a AS (SELECT 0 AS node, 0 AS depth UNION SELECT src, depth + 1 FROM a JOIN e ON dst = node JOIN nation ON src = n_nationkey WHERE depth < 2 AND n_regionkey <> 2) SELECT node, min(depth) AS depth FROM a GROUP BY node""")
def g4_call_graph(spark, sf):
    nodes = t(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_regionkey") == 2).alias("is_test"))
    refs = _edges(spark, sf).select(F.col("src").alias("node"), F.col("dst").alias("target"))
    return graph.affected_by_level(nodes, refs, nodes.filter("node = 0").select("node"), 2)


_PATHS = "SELECT page_id, regexp_extract(url, '^[^/]*//[^/?#]*/([^?#]*)', 1) AS path FROM pages"


def _paths(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[^/]*//[^/?#]*/([^?#]*)", 1).alias("path"))


@query(f"""WITH p AS ({_PATHS}), d AS (SELECT * FROM (VALUES (0, ''), (1, 'en'), (2, 'e'), (3, 'de'), (4, 'fr')) AS v(pkg, dir))
SELECT page_id, pkg FROM (SELECT page_id, pkg, row_number() OVER (PARTITION BY page_id ORDER BY length(dir) DESC) AS k FROM p JOIN d ON dir = '' OR prefix(path, dir || '/')) WHERE k = 1""")
def j1_longest_prefix(spark, sf):
    dirs = spark.createDataFrame([(0, ""), (1, "en"), (2, "e"), (3, "de"), (4, "fr")], "pkg int, dir string")
    return joins.longest_prefix(_paths(spark, sf), dirs, "path", "dir", ["pkg"]).select("page_id", "pkg")


@query(f"SELECT page_id, regexp_full_match(path, 'en/[^/]*') OR regexp_full_match(path, '(.*/)?[^/]*[.]html') AS hit FROM ({_PATHS})")
def f1_glob_strict(spark, sf):
    return _paths(spark, sf).select("page_id", X.matches_any(F.col("path"), ["en/*", "**/*.html"], True).alias("hit"))


@query(f"SELECT page_id, regexp_full_match(path, 'e.*[05]') OR regexp_full_match(path, 'e.*[05]/.*') OR regexp_full_match(path, 'fr(/.*)?') AS hit FROM ({_PATHS})")
def f2_glob_loose(spark, sf):
    return _paths(spark, sf).select("page_id", X.matches_any(F.col("path"), ["e*[05]", "fr"], False).alias("hit"))


_LINES = "SELECT l_orderkey, l_linenumber, l_linenumber * 3 AS s, l_linenumber * 3 + CAST(l_quantity AS INTEGER) % 9 AS e, l_partkey FROM lineitem"


def _lines(spark, sf):
    n = F.col("l_linenumber")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (n * 3).alias("s"), (n * 3 + F.col("l_quantity").cast("int") % 9).alias("e"), "l_partkey")


@query(f"WITH l AS ({_LINES}) SELECT l_orderkey, l_linenumber FROM l WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 7 + 4 <= e AND s <= o_custkey % 7 + 6)")
def j2_overlap(spark, sf):
    ranges = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7 + 4).alias("a"), (F.col("o_custkey") % 7 + 6).alias("b"))
    return joins.interval_semi(_lines(spark, sf), ranges, "l_orderkey", "s", "e").select("l_orderkey", "l_linenumber")


@query(f"""WITH l AS ({_LINES}) SELECT o_orderkey AS l_orderkey, p AS point, l_linenumber AS item FROM (SELECT o_orderkey, o_custkey % 20 AS p, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY e - s, l_linenumber DESC) AS k
FROM orders JOIN l ON l_orderkey = o_orderkey AND o_custkey % 20 BETWEEN s AND e) WHERE k = 1""")
def j3_innermost(spark, sf):
    points = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 20).alias("point"))
    items = _lines(spark, sf).select("l_orderkey", "s", "e", F.col("l_linenumber").alias("seq"), F.col("l_linenumber").alias("item"))
    return joins.innermost(points, items, "l_orderkey", "point", "s", "e", "seq", "item")


@query("""WITH o AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 10 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 11 <> 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_mktsegment IS DISTINCT FROM n.c_mktsegment""")
def j7_snapshot_diff(spark, sf):
    rows = t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    new = rows.filter("c_custkey % 11 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    return joins.snapshot_diff(rows.filter("c_custkey % 10 <> 0"), new, ["c_custkey"], ["c_mktsegment", "c_nationkey"])


@query("""WITH p AS (SELECT DISTINCT p_brand, CASE WHEN p_size % 2 = 0 THEN p_type END AS p_type, CASE WHEN p_size % 3 = 0 THEN p_size END AS p_size FROM part WHERE p_size < 10)
SELECT p.p_brand, p.p_type AS want_type, p.p_size AS want_size, count(*) AS n FROM p JOIN part AS r ON p.p_brand = r.p_brand AND (p.p_type IS NULL OR p.p_type = r.p_type) AND (p.p_size IS NULL OR p.p_size = r.p_size) GROUP BY ALL""")
def j8_wildcard_equal(spark, sf):
    part = t(spark, sf, "part").select("p_brand", "p_type", "p_size")
    probes = part.filter("p_size < 10").select("p_brand", F.expr("CASE WHEN p_size % 2 = 0 THEN p_type END").alias("p_type"), F.expr("CASE WHEN p_size % 3 = 0 THEN p_size END").alias("p_size")).distinct()
    return joins.wildcard_equal(probes, part, "p_brand", ["p_type", "p_size"]).groupBy(F.col("p.p_brand"), F.col("p.p_type").alias("want_type"), F.col("p.p_size").alias("want_size")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS probe FROM part UNION SELECT p_name FROM part WHERE p_partkey % 5 = 0), r AS (SELECT DISTINCT p_name FROM part),
x AS (SELECT probe, p_name FROM p JOIN r ON p_name = probe) SELECT probe, p_name FROM x UNION ALL SELECT probe, p_name FROM p JOIN r ON prefix(p_name, probe || ' ') WHERE probe NOT IN (SELECT probe FROM x)""")
def j12_exact_else_prefix(spark, sf):
    part = t(spark, sf, "part")
    probes = part.select(F.split("p_name", " ")[0].alias("probe")).union(part.filter("p_partkey % 5 = 0").select("p_name")).distinct()
    return joins.exact_else_prefix(probes, part.select("p_name").distinct(), "probe", "p_name", " ")


@query(r"""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_./-]+')) AS token FROM benchmark)
SELECT item_id, token, n FROM w JOIN (VALUES ('the', 1), ('that', 2), ('anea.', 3), ('de', 4)) AS v(token, n) USING (token)""")
def j19_token_refs(spark, sf):
    targets = spark.createDataFrame([("the", 1), ("that", 2), ("anea.", 3), ("de", 4)], "token string, n int")
    return joins.token_references(t(spark, sf, "benchmark"), targets, "text", "token").select("item_id", "token", "n")


@query("SELECT doc_id, quality IS NOT NULL AS cached, quality FROM documents LEFT JOIN labels USING (doc_id)")
def j20_cache_split(spark, sf):
    hits, misses = joins.cache_split(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return hits.select("doc_id", F.lit(True).alias("cached"), "quality").unionByName(misses.select("doc_id", F.lit(False).alias("cached"), F.lit(None).cast("int").alias("quality")))


@query(f"""WITH p AS ({_PATHS}), d AS (SELECT * FROM (VALUES ('', 'root'), ('en', 'a'), ('es', 'b')) AS v(dir, owner))
SELECT owner, count(*) AS n FROM (SELECT page_id, max_by(owner, length(dir)) AS owner FROM p JOIN d ON dir = '' OR prefix(path, dir || '/') GROUP BY page_id) GROUP BY owner""")
def j25_nearest_directory(spark, sf):
    dirs = spark.createDataFrame([("", "root"), ("en", "a"), ("es", "b")], "dir string, owner string")
    return joins.longest_prefix(_paths(spark, sf), dirs, "path", "dir", ["owner"]).groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def s14_last_wins(spark, sf):
    return joins.last_wins(t(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("SELECT user_id, min(event_id) AS event_id, min_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def a10_first_wins(spark, sf):
    return joins.first_wins(t(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("""SELECT event_id, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN least(greatest(coalesce(a, b), coalesce(b, a)) + 0.2, 1.0) END AS score
FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN (event_id % 100) / 100.0::DOUBLE END AS a, CASE WHEN event_id % 4 <> 0 THEN (event_id % 37) / 37.0::DOUBLE END AS b FROM events)""")
def a3_score(spark, sf):
    i = F.col("event_id")
    return t(spark, sf, "events").select("event_id", X.view_score(F.when(i % 3 != 0, (i % 100) / 100.0), F.when(i % 4 != 0, (i % 37) / 37.0), F.lit(0.2)).alias("score"))


@query("SELECT p_brand, min(p_size) AS p_size, (SELECT string_agg(DISTINCT p_name, '|' ORDER BY p_name) FROM part AS q WHERE q.p_brand = p.p_brand AND q.p_size = min(p.p_size)) AS names FROM part AS p GROUP BY p_brand")
def a4_min_with_all(spark, sf):
    return joins.min_with_all(t(spark, sf, "part"), ["p_brand"], "p_size", "p_name").select("p_brand", "p_size", F.array_join("items", "|").alias("names"))


@query(f"SELECT count(DISTINCT l_orderkey) AS files, CAST(sum(e - s + 1) AS BIGINT) AS lines FROM ({_LINES})")
def a5_measure(spark, sf):
    from ..sources.readers import change_size

    return change_size(_lines(spark, sf).select(F.col("l_orderkey").alias("path"), F.col("s").alias("a"), F.col("e").alias("b")))


@query("SELECT o_custkey % 5 AS grp, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS names FROM orders GROUP BY 1")
def a12_grouped_names(spark, sf):
    return t(spark, sf, "orders").groupBy((F.col("o_custkey") % 5).alias("grp")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("names"))


@query("SELECT n_regionkey, 'package(=' || n_regionkey || ') & test(/(^|::)(' || string_agg(DISTINCT n_name, '|' ORDER BY n_name) || ')($|::)/)' AS term FROM nation GROUP BY n_regionkey")
def a13_names_term(spark, sf):
    rows = policy.plan_terms(t(spark, sf, "nation").withColumn("pkg", F.col("n_regionkey").cast("string")), "pkg", "n_name")
    return rows.select(F.col("pkg").cast("int").alias("n_regionkey"), "term")


@query("""SELECT p_brand, array_to_string(list_slice(l, 1, 5), ', ') || CASE WHEN len(l) > 5 THEN ' and ' || (len(l) - 5) || ' more' ELSE '' END AS causes FROM (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS l FROM part GROUP BY p_brand)""")
def a8_cause_sets(spark, sf):
    return t(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("l")).select("p_brand", X.and_more(F.col("l"), 5).alias("causes"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type""")
def a16_adjacent_distinct(spark, sf):
    return joins.adjacent_distinct(t(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


_FLAGS = """SELECT o_orderkey AS test_id, CASE WHEN o_orderkey % 17 = 0 THEN 'changed' END AS must, o_orderkey % 5 = 0 AS gated, CASE WHEN o_orderkey % 7 = 0 THEN 'Direct' END AS evidence_kind,
CASE o_orderkey % 11 WHEN 0 THEN 'dropped' WHEN 1 THEN 'uncached' ELSE 'kept' END AS screen, CASE o_orderkey % 13 WHEN 0 THEN 'failed' WHEN 1 THEN 'overbudget' ELSE 'judged' END AS judge,
CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 101) / 101.0::DOUBLE END AS names, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 89) / 89.0::DOUBLE END AS body FROM orders"""


def _flags(spark, sf):
    i = F.col("o_orderkey")
    rows = t(spark, sf, "orders").select(
        i.alias("test_id"), F.when(i % 17 == 0, "changed").alias("must"), (i % 5 == 0).alias("gated"), F.when(i % 7 == 0, "Direct").alias("evidence_kind"),
        F.when(i % 11 == 0, "dropped").when(i % 11 == 1, "uncached").otherwise("kept").alias("screen"), F.when(i % 13 == 0, "failed").when(i % 13 == 1, "overbudget").otherwise("judged").alias("judge"),
        F.when(i % 3 != 0, (i % 101) / 101.0).alias("names"), F.when(i % 4 != 0, (i % 89) / 89.0).alias("body"), F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("double").alias("group_score"),
    )
    return rows.withColumn("bonus", policy.bonus(policy.Settings(), False))


_DECIDED = f"""WITH f AS ({_FLAGS}), b AS (SELECT *, CASE WHEN must IS NOT NULL THEN 0.0 WHEN evidence_kind IS NOT NULL THEN 0.2 ELSE 0.0 END::DOUBLE AS bonus FROM f),
n AS (SELECT test_id, row_number() OVER (ORDER BY least(names + bonus, 1.0) DESC, test_id) AS rn, least(30, ceil(0.25 * count(*) OVER ())) AS cn FROM b WHERE names IS NOT NULL),
y AS (SELECT test_id, row_number() OVER (ORDER BY least(body + bonus, 1.0) DESC, test_id) AS rb, least(30, ceil(0.25 * count(*) OVER ())) AS cb FROM b WHERE body IS NOT NULL),
s AS (SELECT b.*, coalesce(rn <= cn, false) AS tn, coalesce(rb <= cb, false) AS tb, CASE WHEN names IS NOT NULL OR body IS NOT NULL THEN least(greatest(coalesce(names, body), coalesce(body, names)) + bonus, 1.0) END AS score FROM b LEFT JOIN n USING (test_id) LEFT JOIN y USING (test_id)),
d AS (SELECT test_id, CASE WHEN must IS NOT NULL THEN must WHEN gated THEN 'not-covered' WHEN screen = 'dropped' THEN 'screened-out' WHEN judge = 'overbudget' THEN 'unjudged' WHEN screen = 'uncached' THEN 'uncached' WHEN judge = 'failed' THEN 'judge-failed'
  ELSE coalesce(nullif(concat_ws(',', CASE WHEN tn THEN 'top-n:names' END, CASE WHEN tb THEN 'top-n:body' END, CASE WHEN score >= 0.85 THEN 'threshold' END), ''), 'below-cut') END AS reasons, must FROM s)
SELECT test_id, reasons, must IS NOT NULL OR reasons NOT IN ('not-covered', 'screened-out', 'below-cut', 'judge-failed') AS selected FROM d"""


@query(_DECIDED)
def d12_policy(spark, sf):
    return policy.decide(_flags(spark, sf)).select("test_id", F.array_join("reasons", ",").alias("reasons"), "selected")


@query(f"SELECT reasons, count(*) AS n, count(*) FILTER (selected) AS n_selected FROM ({_DECIDED}) GROUP BY reasons")
def a2_reason_counts(spark, sf):
    return d12_policy(spark, sf).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("n_selected"))


@query("SELECT o_orderkey, (o_orderstatus = 'O' AND o_orderpriority <> '5-LOW') OR o_orderkey % 9 = 0 AS run FROM orders")
def u5_filter_algebra(spark, sf):
    rows = t(spark, sf, "orders")
    return rows.select("o_orderkey", policy.keep_expression(F.col("o_orderstatus") == "O", F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey") % 9 == 0).alias("run"))


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_size = 24 EXCEPT SELECT p_name FROM part WHERE p_size = 8")
def u3_difference(spark, sf):
    part = t(spark, sf, "part")
    names = part.filter("p_size = 24").select(F.col("p_name").alias("name")).distinct()
    return names.join(part.filter("p_size = 8").select(F.col("p_name").alias("name")).distinct(), "name", "left_anti")


@query(r"SELECT c_custkey, sha256(encode(c_name) || '\x00'::BLOB || encode(c_mktsegment) || '\x00'::BLOB) AS key FROM customer")
def x7_cache_key(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", X.chained_sha(F.col("c_name"), F.col("c_mktsegment")).alias("key"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_full_match(p_name, '[A-Za-z0-9_./:=@%+,-]+') THEN p_name ELSE '''' || replace(p_name, '''', '''\''''') || '''' END AS word FROM part""")
def x9_shell_quote(spark, sf):
    return t(spark, sf, "part").select("p_partkey", X.shell_quote(F.col("p_name")).alias("word"))


@query("SELECT p_name AS name, CASE WHEN p_size > 25 THEN 'selected: ' ELSE 'skipped: ' END || p_brand || ', ' || p_type AS why FROM part WHERE contains(p_name, 'o')")
def f16_explain(spark, sf):
    rows = t(spark, sf, "part").select(F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("selected"), F.array("p_brand", "p_type").alias("reasons"))
    return policy.explain(rows, "name", "o")


@query("SELECT s_name || chr(9) || s_suppkey || chr(9) || s_nationkey AS value FROM supplier WHERE s_acctbal > 0")
def k2_list_lines(spark, sf):
    return policy.report_lines(t(spark, sf, "supplier").withColumn("selected", F.col("s_acctbal") > 0), "s_name", "s_suppkey", "s_nationkey")
