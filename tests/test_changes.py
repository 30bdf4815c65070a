"""Plans of a change on small hand-written relations, one for each case that is easily lost."""

import json

import pytest
from pyspark.sql import functions as F

from loomwright.functions import scalars as X
from loomwright.operators import graph
from loomwright.plans import coverage, evidence, judging, locks, paths, policy, references
from loomwright.sources import readers
from loomwright.streaming import answers


def listed(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_policy_of_paths(spark):
    changes = [(1, "docs/a.md", "docs/a.md", "modified"), (2, "crates/a/x.rs", "crates/ab/x.rs", "renamed"), (3, ".cargo/config", None, "added"), (4, "crates/a/build.rs", None, "untracked"), (5, None, "crates/a/data.bin", "deleted"), (6, "Cargo.lock", "Cargo.lock", "modified"), (7, "crates/a/Cargo.toml", "crates/a/Cargo.toml", "modified"), (8, "proto/x", None, "added"), (9, "docs/rule.md", None, "added")]
    rows = spark.createDataFrame(changes, "change_id int, new_path string, old_path string, status string")
    packages = spark.createDataFrame([("a", "crates/a"), ("ab", "crates/ab")], "pkg string, dir string")
    rules = (paths.Rule(("docs/rule.md",), ("a",), exclusive=True), paths.Rule((".cargo/**",), ("ab",)))
    found = paths.path_policy(rows, packages, rules=rules)
    assert listed(found, "change_id", "path", "pkg", "policy", "new_side", "old_side") == sorted([
        (1, "docs/a.md", None, "ignored", True, True), (2, "crates/a/x.rs", "a", "source", True, False), (2, "crates/ab/x.rs", "ab", "source", False, True), (3, ".cargo/config", None, "full", True, False),
        (4, "crates/a/build.rs", "a", "whole", True, False), (5, "crates/a/data.bin", "a", "whole", False, True), (6, "Cargo.lock", None, "manifest", True, True), (7, "crates/a/Cargo.toml", "a", "manifest", True, True),
        (8, "proto/x", None, "outside", True, False), (9, "docs/rule.md", None, "rule", True, False),
    ], key=str)
    assert listed(paths.rule_packages(found, packages.withColumn("name", F.col("pkg")), rules), "pkg", "rule") == [("a", 0)]  # a path that forces a full run fires none
    assert listed(paths.full_run(found), "path", "why") == [(".cargo/config", "paths.full_run")]
    assert listed(paths.changed_packages(found), "pkg") == [("a",), ("ab",)]


def graph_of(spark):
    nodes = [(1, "a.rs", 0, "telling", None, False), (2, "a.rs", 0, "new", "T", False), (3, "b.rs", 0, "user", None, False), (4, "b.rs", 0, "t_far", None, True), (5, "a.rs", 0, "t_near", None, True), (6, "c.rs", 0, "t_new", None, True), (7, "b.rs", 0, "t_plain_new", None, True), (8, "b.rs", 0, "t_user", None, True)]
    refs = [(3, "plain", None, "telling"), (4, "plain", None, "telling"), (5, "plain", None, "telling"), (6, "last", "T", "new"), (7, "plain", None, "new"), (8, "plain", None, "user")]
    return spark.createDataFrame(nodes, "node long, file string, scope int, name string, owner string, is_test boolean"), spark.createDataFrame(refs, "node long, ref_kind string, qual string, name string")


def test_names_lead_to_changed_functions(spark):
    nodes, refs = graph_of(spark)
    scopes = spark.createDataFrame([(f, 0, 0, 0) for f in ("a.rs", "b.rs", "c.rs")], "file string, scope int, ancestor int, hops int")
    links = evidence.resolved(nodes, refs, scopes)
    assert listed(links, "node", "kind", "target", "owner", "name") == sorted([(3, "global", None, None, "telling"), (4, "global", None, None, "telling"), (5, "local", 1, None, None), (6, "qualified", None, "T", "new"), (8, "local", 3, None, None)], key=str)
    items = spark.createDataFrame([("a.rs", "telling", None), ("a.rs", "new", "T"), ("a.rs", "gone", None)], "file string, name string, owner string")
    changed = evidence.changed_nodes(items, nodes)
    assert listed(changed, "name", "node") == [("gone", None), ("new", 2), ("telling", 1)]
    found = evidence.test_evidence(nodes, evidence.causes(nodes, links, changed, 2), 2)
    assert listed(found, "node", "kind", "symbols") == [(4, "Direct", ["telling"]), (5, "Direct", ["telling"]), (6, "Direct", ["T::new"]), (8, "Helper", ["user"])]


def test_a_method_means_all_of_its_name_in_the_file(spark):
    nodes = spark.createDataFrame([(1, "a", 0, "go", "T", False), (2, "a", 0, "go", "U", False), (3, "b", 0, "go", "V", False), (4, "a", 0, "caller", None, False), (5, "b", 0, "far", None, False)], "node long, file string, scope int, name string, owner string, is_test boolean")
    refs = spark.createDataFrame([(4, "method", None, "go"), (5, "seg", None, "caller")], "node long, ref_kind string, qual string, name string")
    scopes = spark.createDataFrame([("a", 0, 0, 0), ("b", 0, 0, 0)], "file string, scope int, ancestor int, hops int")
    assert listed(evidence.resolved(nodes, refs, scopes), "node", "kind", "target", "name") == [(4, "local", 1, None), (4, "local", 2, None), (5, "global", None, "caller")]


def test_an_impl_is_blind_without_one_of_its_methods(spark):
    functions = spark.createDataFrame([(1, "old.rs", "f"), (2, "a.rs", "T::x"), (3, "a.rs", "T::y"), (4, "a.rs", "U::x")], "fid int, file string, name string")
    items = [(0, "a.rs", "old.rs", "f", None, "fn", None), (0, "a.rs", None, "T", None, "impl", ["x", "y"]), (0, "a.rs", None, "U", None, "impl", ["x", "y"]), (0, "a.rs", None, "E", None, "impl", []), (1, "p.rs", None, "f", None, "fn", None), (0, "a.rs", None, "C", None, "const", None), (0, "a.rs", None, "t", None, "test", None)]
    rows = spark.createDataFrame(items, "pkg int, path string, old_path string, name string, owner string, kind string, methods array<string>")
    packages = spark.createDataFrame([(0, False), (1, True)], "pkg int, proc_macro boolean")
    changed, blind = coverage.changed_functions(rows, functions, packages)
    assert listed(changed, "fid") == [(1,), (2,), (3,)]
    assert listed(blind, "item") == [("a.rs: C",), ("a.rs: E",), ("a.rs: U",), ("p.rs: f",)]
    assert [coverage.policy_used(p, age, 200) for p, age in (("gate", 3), ("gate", None), ("must", 201), ("boost", 999), ("off", None))] == ["gate", "boost", "boost", "boost", "off"]
    assert listed(spark.createDataFrame([("/rustc/abc/x.rs",), ("src/a.rs",)], "f string").select(coverage.own_source(F.col("f")).alias("own")), "own") == [(False,), (True,)]


def test_lock_differences(spark):
    schema = "name string, version string, source string, rest string, deps array<string>"
    old = [("app", "1.0", "", "", ["lib 1.0", "util"]), ("tool", "1.0", "", "", []), ("lib", "1.0", "reg", "sum1", ["deep"]), ("util", "3.0", "reg", "u", []), ("deep", "1.0", "reg", "d", []), ("lone", "1.0", "reg", "l", [])]
    new = [("app", "1.1", "", "", ["lib 1.0", "util"]), ("tool", "1.1", "", "", ["util 3.0 (reg)"]), ("lib", "1.0", "reg", "sum1", ["deep"]), ("util", "3.0", "reg", "u", []), ("deep", "2.0", "reg", "d", []), ("lone", "2.0", "reg", "l", [])]
    members = spark.createDataFrame([("app",), ("tool",)], "name string")
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    assert listed(locks.lock_causes(a, b, members), "member", "why") == [("app", "lock: deep 1.0 → 2.0"), ("tool", "lock: its own dependencies")]
    bumped = a.withColumn("version", F.when(F.col("source") == "", "9").otherwise(F.col("version")))
    assert listed(locks.lock_causes(a, bumped, members), "member") == []


def test_literals_name_files(spark):
    files = spark.createDataFrame([("proto/manifesto/evm.proto", False), ("migrations/0001.sql", False), ("vendor/sub", True), ("one", True), ("x/lib.rs", False)], "file string, gitlink boolean")
    texts = ["see evm.proto here", "../../migrations", "Write migrations", "../vendor/sub/inner/y", "one/z", "lib.rs", "a/manifesto/evm.proto", "vendor/sub"]
    literals = spark.createDataFrame([(n, "src/a.rs", 7, t) for n, t in enumerate(texts)] + [(0, "src/a.rs", 3, "evm.proto")], "pkg int, path string, line int, text string")
    found = references.named_files(literals, files)
    assert listed(found, "pkg", "file", "at") == [(0, "proto/manifesto/evm.proto", "src/a.rs:3"), (1, "migrations/0001.sql", "src/a.rs:7"), (3, "vendor/sub", "src/a.rs:7"), (4, "one", "src/a.rs:7"), (6, "proto/manifesto/evm.proto", "src/a.rs:7"), (7, "vendor/sub", "src/a.rs:7")]
    assert listed(references.unnamed_files(files, found), "file") == [("x/lib.rs",)]
    odd = spark.createDataFrame([("",), ("a b",), ("a\nb/",), ("x" * 600,), ("name_only",)], "t string")
    assert [r[0] for r in odd.select(references.literal_candidate(F.col("t"))).collect()] == [False, False, False, False, True]


def test_a_refused_batch_is_halved():
    asked = []

    def judge(batch):
        asked.append(len(batch))
        return None if len(batch) > 2 or batch == ["huge"] else [len(q) / 10 for q in batch]

    assert judging.halved(["a", "bb", "huge", "dddd", "e"], judge) == [0.1, 0.2, None, 0.4, 0.1] and asked[0] == 5
    assert judging.halved(["a", "b"], lambda b: [0.5]) == [None, None] and judging.halved([], judge) == []


def test_cached_answers_are_not_asked_again(spark, tmp_path):
    judge = judging.batched_judge(lambda batch: [0.25] * len(batch) if len(batch) < 3 else None, batch=4)
    questions = spark.createDataFrame([(f"k{n}", f"q{n}") for n in range(9)], "qkey string, question string")
    log = spark.createDataFrame([("k1", 0.75)], "qkey string, score double")
    found, fresh = judging.ask(questions, log, judge)
    assert found.count() == 9 and fresh.count() == 8 and found.filter("score = 0.75").count() == 1
    readers.append_answers(found, str(tmp_path / "log"))
    again, asked = judging.ask(questions, readers.answer_log(spark, str(tmp_path / "log")), judge)
    assert (again.count(), asked.count()) == (9, 0)
    assert judging.ask(questions, log, None)[0].count() == 1


def test_group_screening_and_budget(spark):
    rows = [(1, "f", "m", 0.0), (2, "f", "m", 0.0), (3, "f", "n", 0.0), (4, "g", "m", 0.2), (5, "g", "m", 0.0), (6, "h", "m", 0.0), (7, "h", "m", 0.0)]
    tests = spark.createDataFrame([(*r, None, False) for r in rows] + [(8, "z", "z", 0.0, "changed", False), (9, "z", "z", 0.0, None, True)], "position int, file string, module string, bonus double, must string, gated boolean")
    planned = judging.screening_plan(judging.test_groups(tests), 1)
    assert listed(planned, "file", "module", "screen") == [("f", "m", "ask"), ("f", "n", "single"), ("g", "m", "kept-evidence"), ("h", "m", "overbudget")]
    answers_ = spark.createDataFrame([("f", "m", 0.5)], "file string, module string, score double")
    judged = judging.judging_plan(tests, judging.screened(planned, answers_, 0.1), 6, 2)
    assert listed(judged, "position", "judge") == [(1, "ask"), (2, "ask"), (3, "overbudget"), (4, "overbudget"), (5, "overbudget"), (6, "notasked"), (7, "notasked")]
    assert listed(judging.screened(planned, answers_.limit(0), 0.1, cached_only=True).filter("file = 'f' AND module = 'm'"), "screen") == [("uncached",)]


def test_map_round_trip_and_version(spark, tmp_path):
    functions = spark.createDataFrame([("b", "g", 5, 9), ("a", "f", 1, 2)], "file string, name string, start int, end int")
    tests = spark.createDataFrame([("p", "b", "t"), ("p", "b", "idle")], "package string, binary_id string, name string")
    hits = spark.createDataFrame([("p", "b", "t", "b", "g", 5)], "package string, binary_id string, test string, file string, name string, start int")
    readers.write_coverage_map(functions, tests, hits, "c0ffee", str(tmp_path / "map"))
    f, t, h = readers.coverage_map(spark, str(tmp_path / "map"))
    assert listed(f, "fid", "name") == [(0, "f"), (1, "g")] and listed(t, "tid", "name") == [(0, "idle"), (1, "t")] and listed(h, "tid", "fid") == [(1, 1)]
    (tmp_path / "old.json").write_text(json.dumps({"version": 0, "functions": [], "tests": []}))
    with pytest.raises(Exception, match="not of version"):
        readers.coverage_map(spark, str(tmp_path / "old.json"))[0].collect()


def test_literal_index_and_refusals(spark, tmp_path):
    rows = spark.createDataFrame([("b1", 1, "x/y")], "blob string, line int, text string")
    for _ in range(2):
        readers.append_literals(rows, str(tmp_path / "index"))
    sources = spark.createDataFrame([(1, "a.rs", "b1"), (2, "b.rs", "b2")], "pkg int, path string, blob string")
    known, missing = references.indexed_literals(sources, readers.literal_index(spark, str(tmp_path / "index")))
    assert listed(known, "path", "text") == [("a.rs", "x/y")] and listed(missing, "path") == [("b.rs",)]
    readers.append_refusals(spark.createDataFrame([("body", "too large")], "body string, detail string"), str(tmp_path / "refused"))
    assert spark.read.parquet(str(tmp_path / "refused")).count() == 1


def test_regions_and_first_answers(spark):
    rows = spark.createDataFrame([("s", ["a", "b"], [[3, 1, 9, 1, 0, 1], [1, 1, 4, 1, 0, 0], [2, 1, 12, 1, 0, 1]])], "symbol string, files array<string>, regions array<array<bigint>>")
    assert listed(readers.region_spans(rows), "symbol", "file", "start", "end") == [("s", "b", 2, 12)]
    batch = spark.createDataFrame([("a", 0.5, "2024-01-01"), ("b", 0.1, "2024-01-01")], "qkey string, score double, at string").withColumn("at", F.to_timestamp("at"))
    assert answers.first_in_window(batch).columns == ["qkey", "score", "at"]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.test_key(F.lit("a::b"), F.lit("t é"))) == "a~3a~3ab~24t~20~c3~a9"
    long = one(X.test_key(F.lit("a" * 90), F.lit("b" * 95)))
    assert len(long) == 121 and long[:90] == "a" * 90
    assert one(X.parse_rfc3339(F.lit("bad"))) is None and str(one(X.parse_rfc3339(F.lit("2024-02-29T01:02:03Z")))) == "2024-02-29 01:02:03"
    assert one(X.captures(F.lit("{{no}} {yes} {w:>3} {1x}"))) == ["yes", "w"]
    assert one(X.counted(F.lit(1), "file")) == "1 file" and one(X.counted(F.lit(0), "file")) == "0 files"


def test_plans_have_no_single_partition_over_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 2).cast("string").alias("view"), F.col("id").alias("score"), "id")
    from loomwright.operators.ranking import max_cap, view_ranks

    for df in (view_ranks(rows, "view", F.col("score"), "id"), max_cap(rows.selectExpr("id", "score", "true AS sel", "id % 2 = 0 AS forced"), "sel", "forced", "score", "id", 600)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(view" not in plan and df.count() == 1000
    capped = max_cap(rows.selectExpr("id", "score", "true AS sel", "id % 2 = 0 AS forced"), "sel", "forced", "score", "id", 600)
    assert capped.filter("sel").count() == 600 and capped.filter("capped").agg(F.max("id")).first()[0] == 799


def test_dependents_leave_the_start_out(spark):
    users = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src int, dst int")
    found = graph.dependents_of(spark.createDataFrame([(1,)], "node int"), users, spark.createDataFrame([(1,), (3,)], "node int"))
    assert listed(found, "start", "node") == [(1, 3)]


def test_summary_counts_exclusive_picks(spark):
    rows = spark.createDataFrame([(["top-n:names", "threshold"], True), (["threshold"], True), (["top-n:body"], True), (["below-cut"], False)], "reasons array<string>, selected boolean").withColumns({"must": F.lit(None).cast("string"), "judge": F.lit("judged")})
    found = {r["layer"]: r["n"] for r in policy.summary(rows).collect()}
    assert (found["threshold"], found["only threshold"], found["top of a view"], found["only top of a view"], found["selected"]) == (2, 1, 2, 1, 3)
