"""Loose lines, profile folders, symbols, package metadata and map ages against plain versions and real files."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from loomwright.functions import scalars as X
from loomwright.operators import graph, intervals
from loomwright.plans import coverage, discovery, evidence, history, judging, loose, manifests, mapping, references
from loomwright.sources import metadata, readers


def listed(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# interval subtraction


@pytest.mark.parametrize("size", [4_096, 7, 1])
def test_subtraction_equals_sets(spark, size):
    rng = random.Random(size)
    some = lambda n, most: [(f"f{rng.randrange(4)}", (a := rng.randrange(-20, 200)), a + rng.randrange(-2, most)) for _ in range(n)]
    ranges, spans = [*some(60, 30), ("g", 3, 90), ("g", 3, 90)], [*some(40, 12), ("g", 10, 11), (None, 1, 99)]
    left = lambda k: {x for p, a, b in ranges if p == k for x in range(a, b + 1)} - {x for p, a, b in spans if p == k for x in range(a, b + 1)}
    found = intervals.subtract(spark.createDataFrame(ranges, "path string, a int, b int"), spark.createDataFrame(spans, "path string, start int, end int"), ["path"], size=size).collect()
    for k in ("f0", "f1", "f2", "f3", "g"):
        own = [(r["a"], r["b"]) for r in found if r["path"] == k]
        lines = [x for a, b in own for x in range(a, b + 1)]
        assert len(lines) == len(set(lines)) and set(lines) == left(k)
        assert not [1 for _, b in own for a, _ in own if a == b + 1 and a % size]  # neighbours only where stretches meet
    assert {r["path"] for r in found} <= {"f0", "f1", "f2", "f3", "g"}


def test_no_stretch_holds_a_whole_hot_file(spark):
    ranges = spark.range(0, 200_000, 10).select(F.lit("hot").alias("path"), F.col("id").alias("a"), (F.col("id") + 3).alias("b"))
    plan = intervals.subtract(ranges, ranges.filter("false").select("path", F.col("a").alias("start"), F.col("b").alias("end")), ["path"])._jdf.queryExecution().toString()
    assert "hashpartitioning(path" in plan and "_k" in plan.split("hashpartitioning(path", 1)[1][:40]


# loose lines


def test_loose_lines_of_files(spark):
    text = ["use a::b;", "", "pub use c;", "mod m {", "  use d;", "  // note", "  fn f() {}", "}", "/* x */", "#[attr]", "struct S;"]
    lines = spark.createDataFrame([("a.rs", n, x) for n, x in enumerate(text, 1)] + [("b.rs", 1, "use z;"), ("c.rs", 1, " * doc"), ("d.rs", 1, "\t")], "path string, line int, text string")
    items = spark.createDataFrame([("a.rs", 4, 8, "mod"), ("a.rs", 7, 7, "fn"), ("a.rs", 11, 11, "struct")], "path string, start int, end int, kind string")
    uses = spark.createDataFrame([("a.rs", 1, 1), ("a.rs", 5, 5), ("b.rs", 1, 1)], "path string, start int, end int")
    of = lambda *r: listed(loose.loose_lines(spark.createDataFrame(list(r), "path string, a int, b int"), items, lines, uses), "path", "code_line", "private_use")
    assert of(("a.rs", 1, 11), ("b.rs", 1, 5), ("c.rs", 1, 1), ("d.rs", 1, 1)) == [("a.rs", 3, True), ("b.rs", None, True)]
    assert of(("a.rs", 5, 7)) == [("a.rs", None, True)]  # a module holds nothing, its function does
    assert of(("a.rs", 9, 11), ("a.rs", 6, 6)) == [("a.rs", 10, False)]
    assert of(("a.rs", 11, 11), ("a.rs", 2, 2), ("zz.rs", 1, 4)) == []


def test_scope_directories(spark):
    cases = {("c/src/lib.rs", "c"): "c/src", ("c/src/m/mod.rs", "c"): "c/src/m", ("c/src/foo.rs", "c"): "c/src/foo", ("c/tests/t.rs", "c"): "c/tests", ("c/tests/d/t.rs", "c"): "c/tests/d/t", ("c/src/bin/x.rs", "c"): "c/src/bin", ("build.rs", ""): "", ("src/foo.rs", ""): "src/foo"}
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], "path string, pkg string, want string").withColumn("got", loose.scope_directory(F.col("path"), F.col("pkg")))
    assert rows.filter("got <> want OR got IS NULL").count() == 0


def test_a_private_import_changes_its_scope_or_is_blind(spark):
    packages = spark.createDataFrame([(1, "c", False), (2, "p", True)], "pkg int, dir string, proc_macro boolean")
    functions = spark.createDataFrame([(10, "c/src/foo.rs", "f"), (11, "c/src/foo/deep/x.rs", "g"), (12, "c/src/foobar.rs", "h"), (13, "c/src/other.rs", "i")], "fid int, file string, name string")
    rows = [("c/src/foo.rs", 1, None, True), ("c/src/new.rs", 1, None, True), ("c/src/z.rs", 1, 7, True), ("p/src/lib.rs", 2, None, True)]
    table = spark.createDataFrame(rows, "path string, pkg int, code_line long, private_use boolean")
    items = spark.createDataFrame([(1, "c/src/other.rs", None, "i", None, "fn", None), (1, "c/src/other.rs", None, "S", None, "struct", None)], "pkg int, path string, old_path string, name string, owner string, kind string, methods array<string>")
    whole = spark.createDataFrame([("c/x", "whole", 3, "does not parse"), ("c/y", "changed", 4, "y"), ("all", "whole", None, "z")], "file string, kind string, pkg int, why string")
    changed, blind = coverage.blind_spots(items, table, whole, functions, packages)
    assert listed(changed, "fid") == [(10,), (11,), (13,)]
    assert listed(blind, "pkg", "item") == [(1, "c/src/new.rs"), (1, "c/src/other.rs: S"), (1, "c/src/z.rs:7"), (2, "p/src/lib.rs"), (3, "c/x")]
    users = spark.createDataFrame([(3, 5), (4, 6)], "src int, dst int")
    assert listed(coverage.exempt_packages(blind, users), "pkg") == [(1,), (2,), (3,), (5,)]


def test_covered_names_drop_neighbours_only(spark):
    functions = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "c")], "fid int, name string")
    hits = spark.createDataFrame([(7, f) for f in (4, 2, 1, 3)] + [(8, 5), (9, 1), (9, 2)], "tid int, fid int")
    runs = spark.createDataFrame([("x", 7), ("x", 7), ("y", 8), ("z", 9), ("z", 8)], "test_id string, tid int")
    rows = spark.createDataFrame([(k, 1, None, None, None, None) for k in "xyzu"], "test_id string, pkg int, must string, evidence_kind string, evidence_n int, symbols array<string>")
    changed = functions.filter("fid < 5").select("fid")
    done = coverage.apply_coverage(rows, runs, hits, changed, functions, spark.createDataFrame([], "pkg int"), "gate")
    assert listed(done, "test_id", "covered", "n_hit", "gated", "evidence_n") == [("u", None, None, False, None), ("x", ["a", "b", "a"], 3, False, 3), ("y", [], 0, True, None), ("z", ["a"], 1, False, 1)]
    assert listed(done, "test_id", "symbols")[1:3] == [("x", ["a", "b", "a"]), ("y", None)]


# profiles and maps


def record(symbol, counter):
    return f":ir\n{symbol}\n# Func Hash:\n12\n# Num Counters:\n1\n# Counter Values:\n{counter}\n"


def test_from_a_profile_folder_to_a_map(spark, tmp_path):
    names = [("pkg", "pkg::it", "m::one"), ("pkg", "pkg::it", "m::two words"), ("aaa", "aaa", "zero"), ("pkg", "pkg", "silent")]
    keys = [r["k"] for r in spark.createDataFrame(names, "p string, b string, n string").select(X.test_key(F.col("b"), F.col("n")).alias("k")).collect()]
    profiles = [[("sym1", 1), ("sym2", 0)], [("sym1", 0), ("sym3", 4)], [("sym1", 9), ("far", 1)], None]
    for (package, binary, name), key, each in zip(names, keys, profiles):
        folder = tmp_path / "profiles" / key
        folder.mkdir(parents=True)
        (folder / "meta.json").write_text(json.dumps({"package": package, "binary_id": binary, "name": name, "binary": "/b"}, indent=1))
        if each is not None:
            (folder / "1.proftext").write_text("\n".join(record(*x) for x in each))
    (tmp_path / "profiles" / keys[0] / "2.proftext").write_text(record("sym2", 2))
    for broken, meta in (("x~1", "{oops"), ("x~2", "[]")):
        folder = tmp_path / "profiles" / broken
        folder.mkdir()
        (folder / "meta.json").write_text(meta)
        (folder / "1.proftext").write_text(record("sym1", 1))
    tests, executed = readers.profile_folder(spark, str(tmp_path / "profiles"))
    assert listed(tests, "key", "name") == sorted(zip(keys[:3], ("m::one", "m::two words", "zero")), key=repr)
    assert listed(executed, "key", "symbol") == sorted([(keys[0], "sym1"), (keys[0], "sym2"), (keys[1], "sym3"), (keys[2], "sym1"), (keys[2], "far")], key=repr)

    regions = [("sym1", "c::T::a", "c/src/x.rs", 5, 6, 0), ("sym1", "c::other", "c/src/y.rs", 1, 2, 1), ("sym2", "c::b::{closure#0}", "c/src/x.rs", 30, 31, 2), ("sym3", "c::b", "c/src/x.rs", 40, 41, 3), ("far", "z::z", "/lib/z.rs", 1, 1, 4), ("gen", "c::g", "c/target/g.rs", 1, 1, 5)]
    items = [("c/src/x.rs", "T", None, "impl", 1, 9, 0), ("c/src/x.rs", "a", "T", "fn", 4, 8, 1), ("c/src/x.rs", "m", None, "mod", 28, 50, 2)]
    functions, listed_tests, hits = mapping.build_map(tests, executed, spark.createDataFrame(regions, "symbol string, readable string, file string, start int, end int, seq int"), spark.createDataFrame(items, "file string, name string, owner string, kind string, start int, end int, seq int"), spark.createDataFrame([("c",)], "dir string"), "c/target")
    assert listed(functions, "fid", "file", "name", "start", "end") == [(0, "c/src/x.rs", "T::a", 4, 8), (1, "c/src/x.rs", "b", 30, 31)]
    assert listed(listed_tests, "tid", "package", "name") == [(0, "aaa", "zero"), (1, "pkg", "m::one"), (2, "pkg", "m::two words")]
    assert listed(hits, "tid", "fid") == [(0, 0), (1, 0), (1, 1), (2, 1)]

    named = hits.join(listed_tests.withColumnRenamed("name", "test"), "tid").join(functions, "fid").select("package", "binary_id", "test", "file", "name", "start")
    readers.write_coverage_map(functions, listed_tests, named, "abc", str(tmp_path / "map"))
    (part,) = (tmp_path / "map").glob("part-*.gz")
    whole = json.loads(gzip.decompress(part.read_bytes()))
    assert [t["functions"] for t in whole["tests"]] == [[0], [0, 1], [1]] and [f["name"] for f in whole["functions"]] == ["T::a", "b"]
    again = readers.coverage_map(spark, str(tmp_path / "map"))
    assert listed(again[2], "tid", "fid") == listed(hits, "tid", "fid")


def plain_segments(text):
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        if text[i] == "<":
            depth += 1
        elif text[i] == ">" and (i == 0 or text[i - 1] != "-"):
            depth -= 1
        elif text[i : i + 2] == "::" and depth == 0:
            out.append(text[start:i])
            start, i = i + 2, i + 1
        i += 1
    return [*out, text[start:]]


def test_segments_and_items_of_symbols(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices(["a", "::", ":", "<", ">", "->", " as ", "T", "{", ";"], k=rng.randrange(14))) for _ in range(400)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.path_segments(F.col("t")).alias("s")).collect()
    assert all(r["s"] == plain_segments(r["t"]) for r in found)
    cases = {"": "", "main": "main", "a::B::c": "B::c", "<a::B<u8> as x::Y<z::W>>::c": "B::c", "<&a::B>::c": "B::c", "<a::B>::d::c": "c", "f.c;a::b": "b", "a::Vec<T>::push": "Vec<T>::push", "a::b::<c::D>": "b", "<X>::y::<Z>::{closure#1}::w": "X::y", "{shim}::x": "{shim}::x", "<dyn a::Fn(b) -> c::D>::call": "D::call"}
    rows = spark.createDataFrame(list(cases.items()), "s string, want string").withColumn("got", X.symbol_item(F.col("s")))
    assert listed(rows.filter("NOT got <=> want"), "s", "got") == []
    owners = {"&'a mut x::T<u8>": "T", "r#type": "type", "a::r#B": "B", "dyn A": "A"}
    rows = spark.createDataFrame(list(owners.items()), "s string, want string").withColumn("got", X.clean_owner(F.col("s")))
    assert listed(rows.filter("NOT got <=> want"), "s", "got") == []


# package metadata


def test_metadata_documents(spark):
    package = lambda n, place, source=None, deps=(), kinds=("lib",): {"id": f"id {n}", "name": n, "manifest_path": place, "source": source, "targets": [{"name": f"{n}-{k}", "kind": [k]} for k in kinds], "dependencies": [{"name": d, "path": p} for d, p in deps]}
    packages = [package("app", "/w/Cargo.toml", deps=[("lib", "/w/lib"), ("app", "/w"), ("lib", None)], kinds=("lib", "bin")), package("lib", "/w/crates/lib/Cargo.toml", deps=[("mac", None)]), package("mac", "/w/mac/Cargo.toml", kinds=("proc-macro",)), package("side", "/w/vendor/side/Cargo.toml"), package("reg", "/home/r/Cargo.toml", "registry"), package("far", "/wide/Cargo.toml")]
    nodes = [{"id": "id lib", "dependencies": ["id reg"]}, {"id": "id reg", "dependencies": ["id side"]}, {"id": "id app", "dependencies": ["id lib"]}, {"id": "id mac", "dependencies": []}]
    whole = {"packages": packages, "workspace_members": ["id app", "id lib", "id mac"], "workspace_root": "/w", "target_directory": "/w/target", "resolve": {"nodes": nodes}}
    bare = whole | {"resolve": None, "packages": packages[:1], "workspace_members": ["id app"]}
    docs = metadata.parsed(spark.createDataFrame([(1, json.dumps(whole)), (2, json.dumps(bare))], "workspace int, text string"))
    assert listed(metadata.member_packages(docs), "workspace", "name", "dir", "proc_macro", "bins") == [(1, "app", "", False, ["app-bin"]), (1, "lib", "crates/lib", False, []), (1, "mac", "mac", True, []), (2, "app", "", False, ["app-bin"])]
    assert listed(metadata.package_users(docs), "workspace", "src", "dst") == [(1, "id lib", "id app")]
    assert listed(metadata.path_dependencies(docs), "workspace", "dir", "dependents") == [(1, "vendor/side", ["app", "lib"])]
    outside = metadata.parsed(spark.createDataFrame([(1, json.dumps(whole | {"workspace_members": ["id far"]}))], "workspace int, text string"))
    with pytest.raises(Exception, match="outside of the workspace"):
        metadata.member_packages(outside).collect()
    with pytest.raises(Exception, match="JSON|json|parse"):
        metadata.parsed(spark.createDataFrame([(1, "{oops")], "workspace int, text string")).collect()


# histories


def test_far_reach_of_chains_and_cycles(spark):
    edges = [(n, n + 1) for n in range(70)] + [(70, 60), (5, 65), (100, 101), (101, 100)]
    starts = spark.createDataFrame([(s, s) for s in (0, 58, 100, 999)], "start int, node int")
    table = spark.createDataFrame(edges, "src int, dst int")
    assert listed(graph.reach_far(starts, table), "start", "node") == listed(graph.reach(starts, table), "start", "node")


def test_ages_of_maps(spark):
    chain = [(f"c{n}", f"c{n - 1}" if n else None) for n in range(12)] + [("side", "c3"), ("c8", "side"), ("lost", None)]
    parents = spark.createDataFrame(chain, "commit string, parent string")
    maps = [("a", "c9", "c11", "c11", "gate", 5), ("b", "c9", "nowhere", "c11", "must", 1), ("c", "lost", "c11", "c11", "gate", 5), ("d", "c11", "c9", "c11", "gate", 0), ("e", "c7", "c9", "c11", "boost", 2), ("f", "c10", "c11", "c11", "must", 0)]
    found = history.map_ages(spark.createDataFrame(maps, "map_id string, commit string, base string, head string, requested string, max_age int"), parents)
    assert listed(found, "map_id", "age", "used") == [("a", 2, "gate"), ("b", 2, "boost"), ("c", None, "boost"), ("d", 0, "gate"), ("e", 3, "boost"), ("f", 1, "boost")]
    why = dict(listed(found, "map_id", "reason"))
    assert why["a"] is None and why["e"] is None and why["b"] == "stale map (2 commits behind, at most 1 allowed): must → boost" and why["f"].startswith("stale map (1 commit behind") and "not in the head's history" in why["c"]


# manifests


def test_leaves_of_variants(spark):
    text = '{"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}, "x": [1, {"y": 2}], "n": null, "s": "t", "o": {}}'
    found = manifests.leaves(spark.createDataFrame([(1, text), (2, "[1]"), (3, "{oops"), (4, None), (5, "{}")], "id int, text string"), ["id"])
    assert listed(found, "id", "keys", "value") == sorted([(1, ["a", "b", "c", "d", "e"], '{"f":1}'), (1, ["x"], '[1,{"y":2}]'), (1, ["n"], "null"), (1, ["s"], '"t"'), (1, ["o"], "{}")], key=repr)


def test_verdicts_of_manifests(spark):
    base = {"package": {"name": "p", "version": "1"}, "dependencies": {"lib": {"version": "1", "path": "../lib"}, "alias": {"package": "lib", "version": "1", "path": "../lib"}, "far": {"version": "1"}}, "target": {"cfg(unix)": {"dependencies": {"lib": {"version": "1", "path": "x"}}}}}

    def changed(*path, to=None):
        doc = json.loads(json.dumps(base))
        at = doc
        for k in path[:-1]:
            at = at.setdefault(k, {})
        if to is None:
            at.pop(path[-1])
        else:
            at[path[-1]] = to
        return json.dumps(doc)

    old = json.dumps(base)
    cases = {
        "same": (False, 1, old, old, "ignore", None), "bump": (False, 1, old, changed("package", "version", to="2"), "ignore", None), "member": (False, 1, old, changed("dependencies", "alias", "version", to="2"), "ignore", None),
        "target": (False, 1, old, changed("target", "cfg(unix)", "dependencies", "lib", "version"), "ignore", None), "moved": (False, 1, old, changed("dependencies", "lib", "path", to="../l"), "changed", "[dependencies.lib]"),
        "dep": (False, 1, old, changed("dependencies", "far", "version", to="2"), "changed", "[dependencies.far]"), "gone": (False, 1, old, changed("target"), "changed", "[target.cfg(unix).dependencies]"), "both": (False, 1, old, changed("edition", to="x"), "whole", "[edition]"),
        "pure": (True, None, old, changed("dependencies", "far", "version", to="2"), "full", "[dependencies.far]"), "rooted": (True, 3, old, changed("dependencies", "far", "version", to="2"), "changed", "[dependencies.far]"), "new": (True, 3, None, old, "full", "added"), "bad": (False, 1, old, "[", "whole", "parse"), "list": (False, 1, old, "[1]", "whole", "parse"),
    }
    rows = spark.createDataFrame([(k, *v[:4]) for k, v in cases.items()], "manifest string, root boolean, pkg int, old string, new string")
    found = {r["manifest"]: (r["verdict"], r["why"]) for r in manifests.manifest_verdicts(rows, spark.createDataFrame([("lib",), ("p",)], "name string")).collect()}
    assert {k: v[0] for k, v in found.items()} == {k: v[4] for k, v in cases.items()}
    assert all(v[5] is None or v[5] in found[k][1] for k, v in cases.items()), found


# answers, judges, shadowing, discovery, path arguments


def test_a_batch_answers_as_a_whole(spark):
    questions = spark.createDataFrame([(b, p, f"{b}{p}") for b in "abcdefg" for p in (0, 1)], "batch string, place int, qkey string")
    texts = [("a", '{"answers":{"t1":{"score":0.25},"t0":{"score":1}},"usage":{"input_tokens":7}}'), ("b", '{"answers":{"t0":{"score":0.5}},"usage":{"input_tokens":7}}'), ("c", "{oops"), ("d", '{"answers":{"t0":{"score":"0.5"},"t1":{"score":0.5}}}'), ("e", '{"answers":{"t0":{"score":0.5},"t1":{"score":0.5},"t2":{"score":9}}}'), ("f", "{}")]
    answers, batches = judging.parse_answers(spark.createDataFrame(texts, "batch string, text string"), questions)
    assert listed(answers, "qkey", "score") == [("a0", 1.0), ("a1", 0.25), ("e0", 0.5), ("e1", 0.5)]
    assert listed(batches, "batch", "asked", "input_tokens", "failure")[:4] == [("a", 2, 7, None), ("b", 2, 0, "answers missing"), ("c", 2, 0, "response without answers"), ("d", 2, 0, batches.filter("batch = 'd'").first()["failure"])]
    assert all(f for b, f in listed(batches, "batch", "failure") if b in "bcdfg")


def test_attempts_and_the_circuit_breaker():
    pauses, calls = [], []

    def judge(answers):
        def ask(batch):
            calls.append(list(batch))
            found = answers.pop(0)
            if isinstance(found, int):
                raise judging.Unavailable(found)
            return found

        return ask

    assert judging.retried(judge([503, 429, [1.0]]), sleep=pauses.append)(["q"]) == [1.0] and pauses == [0.5, 1.0]
    for statuses, n in (([503, 503, 503, [1.0]], 3), ([400, [1.0]], 1)):
        calls.clear()
        with pytest.raises(judging.Unavailable):
            judging.retried(judge(statuses), sleep=lambda s: None)(["q"])
        assert len(calls) == n
    calls.clear()
    asked = judging.breaking(judge([[0.5], 500, [0.7]]))
    assert [asked([k]) for k in "abc"] == [[0.5], [], []] and calls == [["a"], ["b"]]


def test_a_failing_judge_is_asked_once_a_task(spark):
    def ask(batch):
        if "q3" in batch:
            raise judging.Unavailable(500)
        return [0.5] * len(batch)

    questions = spark.createDataFrame([(f"k{n}", f"q{n}") for n in range(6)], "qkey string, question string").coalesce(1)
    assert listed(judging.batched_judge(ask, batch=2)(questions), "qkey") == [("k0",), ("k1",)]


def test_shadowed_names_fall_before_resolution(spark):
    refs = [(1, "plain", None, "len", False), (1, "plain", None, "len", False), (1, "plain", None, "call", True), (1, "plain", None, "call", False), (1, "plain", None, "Type", False), (1, "method", None, "len", False), (2, "plain", None, "len", None), (2, "plain", None, "free", False)]
    bound = spark.createDataFrame([(1, "len"), (1, "call"), (1, "Type"), (2, "other")], "node long, name string")
    kept = evidence.unshadowed(spark.createDataFrame(refs, "node long, ref_kind string, qual string, name string, called boolean"), bound)
    assert listed(kept, "node", "ref_kind", "name") == [(1, "method", "len"), (1, "plain", "Type"), (1, "plain", "call"), (2, "plain", "free"), (2, "plain", "len")]
    nodes = spark.createDataFrame([(1, "a", 0, "f", None, False), (2, "a", 0, "g", None, False), (3, "a", 0, "len", None, False), (4, "a", 0, "call", None, False)], "node long, file string, scope int, name string, owner string, is_test boolean")
    scopes = spark.createDataFrame([("a", 0, 0, 0)], "file string, scope int, ancestor int, hops int")
    assert listed(evidence.resolved(nodes, kept, scopes).filter("kind = 'local'"), "node", "target") == [(1, 4), (2, 3)]


def test_from_tests_and_reach_to_candidates(spark):
    files = spark.createDataFrame([(p,) for p in ("a/src/lib.rs", "a/src/bad.rs", "b/tests/t.rs", "b/benches/x.rs", "b/target/y.rs", "c/src/lib.rs", "d/src/lib.rs", "d/README.md")], "path string")
    packages = spark.createDataFrame([(1, "zeta", "a"), (2, "beta", "b"), (3, "gamma", "c"), (4, "delta", "d")], "pkg int, name string, dir string")
    tests = spark.createDataFrame([("d/src/lib.rs", 0, 1, 9000, "", "d0"), ("a/src/lib.rs", 0, 1, 5, "m", "a0"), ("a/src/lib.rs", 1, 6, 9, "m", "a1"), ("a/src/bad.rs", 0, 1, 2, "", "lost"), ("b/tests/t.rs", 0, 1, 2, "", "b0"), ("b/benches/x.rs", 0, 1, 2, "", "x"), ("c/src/lib.rs", 0, 1, 2, "", "c0")], "path string, seq int, start int, end int, module string, name string")
    ranges = spark.createDataFrame([("a/src/lib.rs", 9, 20), ("d/src/lib.rs", 8_500, 8_600), ("b/tests/t.rs", 3, 3)], "path string, a int, b int")
    reached = spark.createDataFrame([(1, 0), (2, 1), (4, 1)], "pkg int, hops int")
    whole, broken = spark.createDataFrame([(4,)], "pkg int"), spark.createDataFrame([("a/src/bad.rs",), ("c/src/lib.rs",)], "path string")
    found, more = discovery.candidate_tests(files, packages, reached, tests, ranges, whole, broken)
    assert listed(found, "position", "depth", "name", "must") == [(1, 0, "a0", "package"), (2, 0, "a1", "changed"), (3, 1, "b0", None), (4, 1, "d0", "changed")]
    assert listed(more, "pkg", "file") == [(1, "a/src/bad.rs")]


def test_path_arguments(spark):
    kind = "array<struct<a:int,b:int>>"
    changes = spark.createDataFrame([("x.rs", "x.rs", "modified", [(1, 2)], [(3, 4)], 5), ("old/y.rs", "new/y.rs", "renamed", [], [], 6), ("z.rs", None, "deleted", [(1, 1)], [], 7)], f"old_path string, new_path string, status string, old_ranges {kind}, new_ranges {kind}, extra int")
    files = spark.createDataFrame([("x.rs", 9), ("one.rs", 12), ("empty.rs", 0), ("pic.png", None), ("dir/f.rs", 3)], "path string, lines int")
    of = lambda *patterns: listed(discovery.restrict(changes, list(patterns), files).withColumn("r", F.col("new_ranges").cast("string")), "old_path", "new_path", "status", "r", "extra")
    assert of("x.rs", "./one.rs", "empty.rs", "pic.png", "none.rs", "dir") == [("empty.rs", "empty.rs", "modified", "[{1, 1}]", None), ("one.rs", "one.rs", "modified", "[{1, 12}]", None), ("pic.png", "pic.png", "modified", "[]", None), ("x.rs", "x.rs", "modified", "[{3, 4}]", 5)]
    assert [r[1] for r in of("old/")] == ["new/y.rs"] and [r[1] for r in of("*.rs")] == ["new/y.rs", "x.rs", None]
    assert of("dir/*.rs") == []


def test_outside_paths_by_mode(spark):
    files = spark.createDataFrame([("data/model.json", False), ("data/lost.json", False)], "file string, gitlink boolean")
    literals = spark.createDataFrame([(1, "b.rs", 3, "../data/model.json"), (1, "a.rs", 9, "model.json"), (2, "c.rs", 1, "x")], "pkg int, path string, line int, text string")
    modes = {m: references.outside_paths(files, m, literals) for m in ("full", "ignore", "referenced")}
    assert listed(modes["full"][0], "file", "kind", "pkg") == [("data/lost.json", "full", None), ("data/model.json", "full", None)] and modes["full"][1].count() == 0
    assert modes["ignore"][0].count() == 0 and listed(modes["ignore"][1], "file") == [("data/lost.json",), ("data/model.json",)]
    assert listed(modes["referenced"][0], "file", "kind", "pkg", "why") == [("data/model.json", "whole", 1, 'reads data/model.json ("model.json" at a.rs:9)')]
    assert listed(modes["referenced"][1], "file") == [("data/lost.json",)]
    with pytest.raises(ValueError):
        references.outside_paths(files, "some", literals)


# diffs


def test_files_of_a_diff(spark):
    text = "\n".join([
        ":100644 100644 a b M\tsrc/a.rs", ":000000 100644 0 b A\tnew.rs", ":100644 000000 a 0 D\tgone.rs", ":100644 100644 a b R093\told name.rs\tb\\t.rs", ':100644 100644 a b C75\tsrc/a.rs\t"q\\303\\251\\".rs"', ":160000 160000 a b M\tsub", ":100644 100644 a b M\tpic.png", "",
        "diff --git a/src/a.rs b/src/a.rs", "--- a/src/a.rs", "+++ b/src/a.rs", "@@ -1 +1,2 @@", "-x", "+--- a/no", ":100644 100644 a b M\tnot a raw line", "@@ -9,2 +0,0 @@", "diff --git a/gone.rs b/gone.rs", "--- a/gone.rs", "+++ /dev/null", "@@ -1,3 +0,0 @@",
        'diff --git "a/x" "b/x"', "--- a/src/a.rs", '+++ "b/q\\303\\251\\".rs"', "@@ -0,0 +5 @@",
    ])
    untracked = spark.createDataFrame([(1, "u.rs", 0), (1, "u.txt", 4), (2, "w.rs", 7)], "diff_id int, path string, lines int")
    found = readers.changed_files(spark.createDataFrame([(1, text), (2, ""), (3, None)], "diff_id int, text string"), untracked)
    show = lambda rs: [(r["a"], r["b"]) for r in rs]
    rows = {(r["diff_id"], r["place"], r["new_path"]): (r["old_path"], r["status"], show(r["old_ranges"]), show(r["new_ranges"]), r["gitlink"]) for r in found.collect()}
    assert rows == {
        (1, 0, "src/a.rs"): ("src/a.rs", "modified", [(1, 1), (9, 10)], [(1, 1), (1, 2)], False), (1, 1, "new.rs"): (None, "added", [], [], False), (1, 2, None): ("gone.rs", "deleted", [(1, 3)], [(1, 1)], False),
        (1, 3, "b\\t.rs"): ("old name.rs", "renamed", [], [], False), (1, 4, 'qé".rs'): (None, "added", [], [(5, 5)], False), (1, 5, "sub"): ("sub", "modified", [], [], True), (1, 6, "pic.png"): ("pic.png", "modified", [], [], False),
        (1, None, "u.rs"): (None, "untracked", [], [(1, 1)], False), (2, None, "w.rs"): (None, "untracked", [], [(1, 7)], False),
    }
    for broken in (":100644 100644 a b M", ":100644 100644 a b R100\tonly.rs"):
        with pytest.raises(Exception, match="can't be read"):
            readers.changed_files(spark.createDataFrame([(1, broken)], "diff_id int, text string")).collect()
