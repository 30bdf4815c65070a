"""Operators on small hand-written change-impact relations."""

import gzip
import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from loomwright.functions import scalars as X
from loomwright.operators import graph, incidence, joins, ranking
from loomwright.plans import evidence, policy
from loomwright.sources import readers
from loomwright.streaming import answers


def listed(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_longest_prefix_takes_no_lookalike(spark):
    files = spark.createDataFrame([("crates/a/x.rs",), ("crates/ab/x.rs",), ("top.rs",), ("crates/a/in/y.rs",)], "path string")
    dirs = spark.createDataFrame([("", "root"), ("crates/a", "a"), ("crates/a/in", "in")], "dir string, pkg string")
    assert listed(joins.longest_prefix(files, dirs, "path", "dir", ["pkg"]), "path", "pkg") == [("crates/a/in/y.rs", "in"), ("crates/a/x.rs", "a"), ("crates/ab/x.rs", "root"), ("top.rs", "root")]


def test_reach_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src int, dst int")
    starts = spark.createDataFrame([(1, 1)], "start int, node int")
    assert listed(graph.reach(starts, edges), "node", "hops") == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert listed(graph.reach(starts, edges, 1), "node", "hops") == [(1, 0), (2, 1)]


def test_unknown_coverage_never_gates(spark):
    tests = spark.createDataFrame([(1,), (2,), (3,)], "tid int")
    hits = spark.createDataFrame([(2, 10), (3, 11), (3, 11)], "tid int, fid int")
    changed = spark.createDataFrame([(11,)], "fid int")
    assert listed(incidence.gate(tests, hits, changed, "tid", "fid", F.lit(False)).fillna(-1, ["n_hit"]), "tid", "n_hit", "gated") == [(1, -1, False), (2, 0, True), (3, 1, False)]


def test_innermost_takes_the_last_of_equal_spans(spark):
    points = spark.createDataFrame([("f", 5), ("f", 50)], "file string, line int")
    items = spark.createDataFrame([("f", 1, 9, 0, "outer"), ("f", 4, 6, 1, "first"), ("f", 4, 6, 2, "last")], "file string, s int, e int, seq int, item string")
    assert listed(joins.innermost(points, items, "file", "line", "s", "e", "seq", "item"), "line", "item") == [(5, "last")]


def test_nearest_scope(spark):
    refs = spark.createDataFrame([(1, "f", 2, "go"), (2, "f", 2, "far"), (3, "f", 0, "go")], "ref int, file string, scope int, name string")
    scopes = spark.createDataFrame([("f", 2, 2, 0), ("f", 2, 1, 1), ("f", 2, 0, 2), ("f", 0, 0, 0)], "file string, scope int, ancestor int, hops int")
    definitions = spark.createDataFrame([("f", 1, "go", 10), ("f", 0, "go", 11), ("f", 0, "far", 12)], "file string, scope int, name string, node int")
    assert listed(joins.nearest_scope(refs, scopes, definitions), "ref", "node") == [(1, 10), (2, 12), (3, 11)]


def test_evidence_kinds(spark):
    nodes = spark.createDataFrame([(1, "a", "f1", False), (2, "a", "f2", False), (3, "a", "t3", True), (4, "b", "t4", True), (5, "a", "t5", True)], "node int, file string, label string, is_test boolean")
    refs = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (5, 2)], "node int, target int")
    changed = spark.createDataFrame([(1,)], "node int")
    affected = graph.affected_by_level(nodes, refs, changed, 2)
    assert listed(affected, "node", "depth") == [(1, 0), (2, 1)]
    at = affected.join(nodes.select("node", "label", F.col("file").alias("there")), "node").withColumnRenamed("node", "target")
    hits = refs.join(at, "target").join(nodes.select("node", "file"), "node").select("node", "depth", "label", (F.col("file") == F.col("there")).alias("own"))
    found = {r["node"]: (r["kind"], r["symbols"]) for r in evidence.test_evidence(nodes, hits, 2).collect()}
    assert found == {3: ("Direct", ["f1"]), 4: ("Transitive", ["f2"]), 5: ("Helper", ["f2"])}


def test_diff_ranges(spark):
    text = 'diff --git a/x.rs b/x.rs\n--- a/x.rs\n+++ b/x.rs\n@@ -3,2 +3 @@\n@@ -9,3 +7,0 @@\ndiff --git "a/\\303\\244.rs" b/b.rs\n--- "a/\\303\\244.rs"\n+++ /dev/null\n@@ -1 +0,0 @@\n'
    found = readers.change_ranges(spark.createDataFrame([(1, text), (2, None)], "diff_id int, text string"))
    assert listed(found, "path", "side", "a", "b") == [("x.rs", "new", 3, 3), ("x.rs", "new", 7, 7), ("x.rs", "old", 3, 4), ("x.rs", "old", 9, 11), ("ä.rs", "new", 1, 1), ("ä.rs", "old", 1, 1)]


def test_answer_log_and_its_stream(spark, tmp_path):
    (tmp_path / "log.txt").write_text("a 0.5\nbroken\nb x\nb 0.1 0.2\na 0.75\nc 1\n")
    assert listed(readers.answer_log(spark, str(tmp_path / "log.txt")), "qkey", "score") == [("a", 0.75), ("c", 1.0)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a 0.5", "2024-01-01 00:00:00"), ("a 0.75", "2024-01-01 00:01:00"), ("bad", "2024-01-01 00:02:00")], "value string, at string").selectExpr("value", "timestamp(at) AS at").write.mode("overwrite").parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("value string, at timestamp").parquet(str(tmp_path / "in"))
    query = answers.latest(answers.parsed(lines)).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert listed(spark.table("latest"), "qkey", "score") == [("a", 0.75)]


def test_coverage_map(spark, tmp_path):
    whole = {"version": 1, "commit": "c", "functions": [{"file": "f", "name": "x", "start": 1, "end": 2}], "tests": [{"package": "p", "binary_id": "b", "name": "t", "functions": [0]}, {"package": "p", "binary_id": "b", "name": "u", "functions": []}]}
    with gzip.open(tmp_path / "map.json.gz", "wt") as f:
        f.write(json.dumps(whole))
    functions, tests, hits = readers.coverage_map(spark, str(tmp_path / "map.json.gz"))
    assert (functions.count(), listed(tests, "tid", "name"), listed(hits, "tid", "fid")) == (1, [(0, "t"), (1, "u")], [(0, 0)])


def test_profile_text(spark, tmp_path):
    record = lambda name, count: f"{name}\n# Func Hash:\n7\n# Num Counters:\n1\n# Counter Values:\n{count}\n"
    (tmp_path / "p.txt").write_text("\n".join([":ir\n" + record("f", 5), record("g", 0), "# head\n" + record("h", 9), "i\n1\n2\n3\n5\n", record("j", "x"), record("k", 1)]))
    assert listed(readers.executed_symbols(spark, str(tmp_path / "p.txt")), "symbol") == [("f",), ("k",)]


@pytest.mark.parametrize(("pattern", "path", "strict", "loose"), [("*.md", "a/b.md", False, True), ("**/*.md", "b.md", True, True), ("docs/**", "docs/x/y", True, True), ("a", "a/b", False, True), ("{a,b}/?.rs", "b/x.rs", True, True), ("[!a]x", "bx", True, True), ("src/a**", "src/ab/c.rs", False, True), ("src/**/c.rs", "src/a/b/c.rs", True, True), ("{a,b{c,d}}.rs", "bd.rs", True, True), (r"\*x", "*x", True, True), (r"\*x", "yx", False, False)])
def test_glob_dialects(spark, pattern, path, strict, loose):
    row = spark.range(1).select(X.matches_any(F.lit(path), [pattern], True).alias("s"), X.matches_any(F.lit(path), [pattern], False).alias("l")).first()
    assert (row["s"], row["l"]) == (strict, loose)


@pytest.mark.parametrize(("path", "module"), [("src/lib.rs", ""), ("src/a/mod.rs", "a"), ("src/a/b.rs", "a::b"), ("tests/x.rs", ""), ("src/bin/x.rs", ""), ("tests/x/y.rs", "y")])
def test_module_path(spark, path, module):
    assert spark.range(1).select(X.module_path(F.lit(path))).first()[0] == module


def candidates(spark):
    rows = [(1, "changed", False, None, "kept", "judged", 0.1, 0.1, None), (2, None, True, None, "kept", "judged", 0.99, None, None), (3, None, False, None, "dropped", "judged", None, None, 0.05), (4, None, False, "Direct", "kept", "judged", 0.7, 0.2, None), (5, None, False, None, "kept", "failed", None, None, None)]
    df = spark.createDataFrame(rows, "test_id int, must string, gated boolean, evidence_kind string, screen string, judge string, names double, body double, group_score double")
    return df.withColumn("n_hit", F.lit(None).cast("int")).withColumn("bonus", policy.bonus(policy.Settings(), False))


def test_policy_order_and_caps(spark):
    found = {r["test_id"]: (r["reasons"], r["selected"]) for r in policy.decide(candidates(spark), policy.Settings(top_n=1)).collect()}
    assert found[1] == (["changed"], True) and found[2] == (["not-covered"], False) and found[3] == (["screened-out"], False)
    assert found[4][1] and "threshold" in found[4][0] and found[5] == (["judge-failed"], False)
    capped = {r["test_id"]: r["selected"] for r in policy.decide(candidates(spark), policy.Settings(top_n=1, max_tests=1)).collect()}
    assert capped[1] and not capped[4]


def test_numbered_is_gapless(spark):
    rows = spark.range(1000).repartition(7)
    assert sorted(r["number"] for r in ranking.numbered(rows, "id").collect()) == list(range(1, 1001))


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "a int, b int")
    assert rows_of(joins.snapshot_diff(none, none, ["a"], ["b"]))[1] == []
    assert rows_of(ranking.capped_top(none, "a", F.col("b"), "b", 3, 0.5))[1] == []
    assert rows_of(graph.reach(none.toDF("start", "node"), none.toDF("src", "dst")))[1] == []
