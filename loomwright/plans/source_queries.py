"""Queries of readers, names, bonuses and lock files on analytical tables, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..sources import readers
from . import coverage, judging, locks, policy
from .change_queries import _open
from .queries import _EDGES, _FLAGS, _edges, _flags, query, t


def _file_name(column="p_name"):
    return F.replace(column, F.lit(" "), F.lit("_"))


@query("""WITH p AS (SELECT p_partkey AS diff_id, replace(p_name, ' ', '_') || '.rs' AS path, p_size AS s FROM part)
SELECT diff_id, path, 'old' AS side, s::INTEGER AS a, (s + 1)::INTEGER AS b FROM p
UNION ALL SELECT diff_id, path, 'new', greatest(s - 1, 1)::INTEGER, greatest(s - 1, 1)::INTEGER FROM p
UNION ALL SELECT diff_id, path, 'new', (s + 10)::INTEGER, (s + 12)::INTEGER FROM p""")
def s4_change_ranges(spark, sf):
    """Each part is a diff of one file: two lines deleted, three lines added further down."""
    file, s = F.concat(_file_name(), F.lit(".rs")), F.col("p_size").cast("int")
    header = "diff --git a/%s b/%s\n--- a/%s\n+++ b/%s\n"
    hunks = "@@ -%d,2 +%d,0 @@ fn x\n-x\n--- a/y\n@@ -%d,0 +%d,3 @@\n+a\n+b\n+c\n"
    text = F.format_string(header + hunks, file, file, file, file, s, s - 1, s + 9, s + 10)
    return readers.change_ranges(t(spark, sf, "part").select(F.col("p_partkey").alias("diff_id"), text.alias("text")))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey % 90 AS s, l_suppkey % 90 + l_partkey % 50 AS e, l_linenumber % 2 AS f FROM lineitem),
w AS (SELECT l_orderkey, arg_min(f, l_linenumber) AS f FROM r GROUP BY l_orderkey)
SELECT l_orderkey AS symbol, CASE f WHEN 0 THEN 'a.rs' ELSE 'b.rs' END AS file, min(s)::BIGINT AS start, max(e)::BIGINT AS "end"
FROM r JOIN w USING (l_orderkey, f) GROUP BY l_orderkey, f""")
def s13_region_spans(spark, sf):
    """Orders are functions and their line items regions, in one of two files."""
    start = F.col("l_suppkey") % 90
    values = (start, F.lit(1), start + F.col("l_partkey") % 50, F.lit(1), F.lit(1), F.col("l_linenumber") % 2)
    region = F.array(*(v.cast("long") for v in values)).alias("region")
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("symbol"), "l_linenumber", region)
    lists = rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "region"))).alias("r"))
    regions = F.transform("r", lambda x: x["region"]).alias("regions")
    return readers.region_spans(lists.select("symbol", F.array(F.lit("a.rs"), F.lit("b.rs")).alias("files"), regions))


@query("""WITH p AS (SELECT p_partkey, p_size % 7 AS k, lower(p_type) AS dir, replace(p_name, ' ', '_') AS n FROM part)
SELECT p_partkey, CASE k WHEN 2 THEN n WHEN 5 THEN dir || '::' || n WHEN 6 THEN n || '::lib' ELSE '' END AS module FROM p""")
def x1_module_path(spark, sf):
    k, n = F.col("p_size") % 7, _file_name()
    file = F.when(k == 0, "src/lib.rs").when(k == 1, "src/main.rs").when(k == 2, F.concat(F.lit("src/"), n, F.lit("/mod.rs")))
    file = file.when(k == 3, F.concat(F.lit("tests/"), n, F.lit(".rs"))).when(k == 4, F.concat(F.lit("src/bin/"), n, F.lit(".rs")))
    file = file.when(k == 5, F.concat_ws("/", F.lit("src"), F.lower("p_type"), F.concat(n, F.lit(".rs"))))
    file = file.otherwise(F.concat(F.lit("src/"), n, F.lit("/lib.rs")))
    return t(spark, sf, "part").select("p_partkey", X.module_path(file).alias("module"))


@query("SELECT p_partkey, p_size % 4 >= 2 AS own FROM part")
def f15_own_source(spark, sf):
    k = F.col("p_size") % 4
    place = F.when(k == 0, "/home/u/.cargo/registry/").when(k == 1, "/rustc/1f/library/").when(k == 2, "crates/.cargo/").otherwise("src/")
    return t(spark, sf, "part").select("p_partkey", coverage.own_source(F.concat(place, _file_name())).alias("own"))


@query("SELECT o_orderkey AS position FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 5 <> 0")
def f17_open_candidates(spark, sf):
    return judging.open_candidates(_open(spark, sf)).select("position")


@query("""SELECT o_orderkey AS test_id, CASE WHEN o_orderkey % 17 = 0 THEN 0.0 WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 > 0 THEN 0.3
WHEN o_orderkey % 7 < 3 THEN 0.2 ELSE 0.0 END::DOUBLE AS bonus FROM orders""")
def d9_bonus(spark, sf):
    i = F.col("o_orderkey")
    kind = F.when(i % 7 == 0, "Direct").when(i % 7 == 1, "Helper").when(i % 7 == 2, "Transitive").when(i % 7 == 3, "Dependency")
    rows = t(spark, sf, "orders").select(
        i.alias("test_id"), F.when(i % 17 == 0, "changed").alias("must"),
        F.when(i % 3 != 0, i % 4).alias("n_hit"), kind.alias("evidence_kind"),
    )
    return rows.select("test_id", policy.bonus(policy.Settings(), True).alias("bonus"))


@query(f"""WITH f AS ({_FLAGS}),
b AS (SELECT *, CASE WHEN must IS NOT NULL THEN 0.0 WHEN evidence_kind IS NOT NULL THEN 0.2 ELSE 0.0 END::DOUBLE AS bonus FROM f)
SELECT test_id, round(greatest(CASE WHEN names IS NULL AND body IS NULL THEN 0.0
  ELSE least(greatest(coalesce(names, body), coalesce(body, names)) + bonus, 1.0) END, bonus), 9) AS key FROM b""")
def w6_order_key(spark, sf):
    return policy.decide(_flags(spark, sf)).select("test_id", F.round("key", 9).alias("key"))


# Two states of a lock file: nations are entries, every third of them a member, and the edges are dependencies.
@query(f"""WITH RECURSIVE e AS ({_EDGES}),
r AS (SELECT n_nationkey AS start, n_nationkey AS node FROM nation WHERE n_regionkey = 1 AND n_nationkey % 3 <> 0
  UNION SELECT start, dst FROM r JOIN e ON src = node),
h AS (SELECT DISTINCT m.n_name AS member, s.n_name || ' 1 → 2' AS what FROM r JOIN nation AS s ON s.n_nationkey = start
  JOIN nation AS m ON m.n_nationkey = node WHERE node % 3 = 0),
l AS (SELECT member, list_sort(list(what)) AS l FROM h GROUP BY member)
SELECT member, 'lock: ' || array_to_string(list_slice(l, 1, 5), ', ') || CASE WHEN len(l) > 5 THEN ' and ' || (len(l) - 5) || ' more' ELSE '' END AS why
FROM l""")
def x20_lock_causes(spark, sf):
    nations = t(spark, sf, "nation")
    named = _edges(spark, sf).join(nations.select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("used")), "src")
    deps = named.groupBy(F.col("dst").alias("n_nationkey")).agg(F.array_sort(F.collect_set("used")).alias("deps"))
    member, moved = F.col("n_nationkey") % 3 == 0, (F.col("n_regionkey") == 1) & (F.col("n_nationkey") % 3 != 0)
    rows = nations.join(deps, "n_nationkey", "left")

    def state(version):
        source = F.when(member, "").otherwise("registry").alias("source")
        listed = F.coalesce("deps", F.array().cast("array<string>")).alias("deps")
        return rows.select(F.col("n_name").alias("name"), version.alias("version"), source, F.lit("").alias("rest"), listed)

    members = nations.filter(member).select(F.col("n_name").alias("name"))
    return locks.lock_causes(state(F.lit("1")), state(F.when(moved, "2").otherwise("1")), members)
