"""What must not grow with the input: broadcasts, pairs and walks that are more than the rows."""

import random

import pyarrow as pa

from loomwright.operators import graph
from loomwright.plans import evidence, history, locks, manifests, references
from loomwright.sources import metadata, readers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_and_versions_of_many_manifests_are_never_broadcast(spark):
    cells = spark.sql("SELECT * FROM VALUES ('m', 'a', 'x', '1'), ('m', 'b', null, '2'), ('n', 'a', '', '1') AS t(manifest, k1, k2, value)")  # small by its statistics
    other = spark.sql("SELECT * FROM VALUES ('m', 'a', 'x', '3'), ('m', 'b', 'y', '2'), ('n', 'a', '', '1'), (null, 'a', '', '1') AS t(manifest, k1, k2, value)")
    found = locks.differing_keys(cells, other, ["manifest"])
    assert "Broadcast" not in plan_of(found)
    assert [tuple(r) for r in found.collect()] == [("m", "[a.x], [b]")]
    leaves = spark.sql("""SELECT * FROM VALUES ('m', array('dependencies', 'own', 'version'), '"1"'), ('m', array('dependencies', 'own', 'path'), '"p"') AS t(manifest, keys, value)""")
    kept = manifests.without_member_versions(leaves, ["manifest"], spark.createDataFrame([("own",)], "name string"))
    assert "SortMergeJoin" in plan_of(kept).split("LeftOuter")[0].splitlines()[-1]
    assert [r["keys"][-1] for r in kept.collect()] == ["path"]


def test_a_method_is_one_link_however_many_have_its_name(spark):
    nodes = spark.range(60).selectExpr("id AS node", "'f' AS file", "0L AS scope", "'run' AS name", "IF(id < 50, concat('T', id % 2), null) AS owner", "id = 59 AS is_test")
    refs = spark.sql("SELECT * FROM VALUES (55L, 'method', null, 'run'), (55L, 'last', 'T0', 'run'), (56L, 'last', 'T1', 'run'), (59L, 'method', 'x', 'run'), (59L, 'method', 'y', 'run') AS t(node, ref_kind, qual, name)")
    scopes = spark.sql("SELECT 'f' AS file, 0L AS scope, 0L AS ancestor, 0 AS hops")
    links = evidence.linked(nodes, refs, scopes)
    assert sorted((r["node"], r["kind"], r["target"]) for r in links.collect()) == [(55, "local", 0), (55, "method", None), (56, "local", 1), (59, "method", None)]
    pairs = evidence.resolved(nodes, refs, scopes)
    assert "Broadcast" not in plan_of(pairs).split("SortMergeJoin")[0]
    assert sorted((r["node"], r["target"]) for r in pairs.collect()) == [(55, n) for n in range(50)] + [(56, 1)] + [(59, n) for n in range(50)]
    changed = evidence.changed_nodes(spark.sql("SELECT 'f' AS file, 'run' AS name, 'T1' AS owner"), nodes)
    for of in (None, nodes.filter("is_test")):
        found = evidence.causes(nodes, links, changed, 1, of)
        assert sorted((r["node"], r["depth"], r["label"], r["own"]) for r in found.collect() if r["node"] > 56) == [(59, 0, "T1::run", True)]


def test_dependents_of_many_packages_are_never_broadcast(spark):
    package = lambda i: f"named_struct('id', '{i}', 'name', 'n{i}', 'manifest_path', '/w/{i}/Cargo.toml', 'source', string(null), 'targets', array(named_struct('name', 't', 'kind', array('lib'))), 'dependencies', array(named_struct('name', 'x', 'path', 'p')))"
    users = "array(named_struct('id', 'b', 'dependencies', array('a')), named_struct('id', 'c', 'dependencies', array('b')))"
    docs = spark.sql(f"SELECT 1 AS workspace, array({package('a')}, {package('b')}, {package('c')}) AS packages, array('c') AS workspace_members, '/w' AS workspace_root, named_struct('nodes', {users}) AS resolve")
    found = metadata.path_dependencies(docs)
    assert "Broadcast" not in plan_of(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", ["nc"]), (1, "b", ["nc"])]


def test_steps_of_a_history_are_no_more_than_its_commits(spark, monkeypatch):
    written = []

    def counted_cut(df, cut=graph.cut):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted_cut)
    monkeypatch.setattr(history, "cut", counted_cut, raising=False)
    monkeypatch.setattr(graph, "BLOCK", 16, raising=False)
    history_of = [(n, n - 1) for n in range(1, 300)] + [(n, n - 5) for n in range(7, 300, 3)]
    parents = spark.createDataFrame(history_of, "commit int, parent int")
    maps = spark.createDataFrame([(1, 100, 290, 299, "gate", 5), (2, 299, 100, 290, "must", 5)], "map_id int, commit int, base int, head int, requested string, max_age int")
    found = history.map_ages(maps, parents)
    assert [(r["map_id"], r["age"]) for r in found.orderBy("map_id").collect()] == [(1, 190), (2, None)]
    assert max(written) <= len(history_of)


def test_chains_and_rings_lead_where_levels_lead(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 4, raising=False)
    draw = random.Random(3)
    sparse = [(draw.randrange(40), draw.randrange(40)) for _ in range(45)]  # with cycles
    merged = [(100 + n, 100 + n - 1) for n in range(1, 30)] + [(100 + n, 100 + draw.randrange(n)) for n in range(1, 30, 3)]
    rings = [(200, 201), (201, 202), (202, 200), (202, 203), (203, 204), (204, 203), (210, 210), (220, 221)]
    edges = spark.createDataFrame(sparse + merged + rings, "src int, dst int")
    starts = spark.createDataFrame([(f"s{n % 50}", n) for n in (*range(40), 129, 115, 200, 203, 210, 220, 221, 999)], "start string, node int")
    rows = lambda df: sorted((r["start"], r["node"]) for r in df.collect())
    assert rows(graph.reach_far(starts, edges)) == rows(graph.reach(starts, edges).select("start", "node").distinct())
    one = spark.createDataFrame([(1, 2)], "src int, dst int")
    assert sorted(tuple(r) for r in graph.chains(one).collect()) == [(1, 2, 1), (2, 2, 0)]


def test_pairs_of_one_blob_are_made_by_many_tasks(spark):
    sources = spark.createDataFrame([(d, "b" if d < 190 else None if d < 195 else "gone") for d in range(200)], "doc_id int, blob string")
    index = spark.createDataFrame([("b", n, f"t{n}") for n in range(30)], "blob string, line int, text string")
    known, missing = references.indexed_literals(sources, index)
    assert "Broadcast" not in plan_of(known)
    found = known.selectExpr("doc_id", "line", "spark_partition_id() AS task").collect()
    assert sorted((r["doc_id"], r["line"]) for r in found) == [(d, n) for d in range(190) for n in range(30)]
    assert len({r["task"] for r in found}) > 1
    assert sorted(r["doc_id"] for r in missing.collect()) == list(range(190, 200))


def test_pairs_of_a_blob_come_in_long_runs(spark):
    sources = spark.range(2000).selectExpr("id DIV 2 AS doc_id", "'b' AS blob", "IF(id % 4 < 2, NULL, 'x') AS path")  # each twice
    index = spark.createDataFrame([("b", n, f"https://example.org/{n}") for n in range(200)] + [("other", 1, "x")], "blob string, line int, text string")
    known = references.indexed_literals(sources, index)[0]
    assert known.columns == ["blob", "doc_id", "path", "line", "text"]
    assert known.selectExpr("count(*)", "count(DISTINCT doc_id, line)", "count(path)", "sum(doc_id)").first() == (400_000, 200_000, 200_000, 200 * 999_000)
    found = known.selectExpr("line", "spark_partition_id() AS task").collect()
    runs = sum(a != b for a, b in zip(found, found[1:]))
    assert runs < len(found) / 50
    assert len(set(found)) == 200  # each literal is of one task


def test_a_diff_is_read_once_and_its_files_are_not_shuffled(spark):
    section = "diff --git a/x b/x\n--- a/x\n+++ b/{0}\n@@ -{1} +{1},2 @@\n-x\n"
    text = ":100644 100644 a b M\tm.rs\n:100644 100644 a b M\tn.rs\n:100644 100644 a b M\tm.rs\n\n" + section.format("m.rs", 7) + "".join(section.format("n.rs", i) for i in (9, 10, 2))
    diffs = spark.createDataFrame([(1, text), (2, text), (None, text)], "diff_id long, text string")
    found = readers.changed_files(diffs)
    plan = plan_of(found)
    assert "Exchange" not in plan and "Join" not in plan and plan.count("MapIn") == 1
    rows = sorted((r["diff_id"] or 0, r["place"], r["new_path"], [tuple(x) for x in r["old_ranges"]], [tuple(x) for x in r["new_ranges"]]) for r in found.collect())
    m, n = ("m.rs", [(7, 7)], [(7, 8)]), ("n.rs", [(2, 2), (9, 9), (10, 10)], [(2, 3), (9, 10), (10, 11)])
    assert rows == [(k, place, *file) for k in (0, 1, 2) for place, file in enumerate((m, n, m))]
    many = spark.range(1, 2).selectExpr("id AS diff_id", "concat(array_join(transform(sequence(0, 44999), i -> concat(':100644 100644 a b M\\t', i, '.rs\\n')), ''), '\\ndiff --git a/q b/q\\n--- a/44998.rs\\n+++ b/44998.rs\\n@@ -3 +3 @@\\n') AS text")
    files = readers.changed_files(many)
    assert files.selectExpr("count(*)", "count(DISTINCT place, new_path)", "max(place)", "sum(IF(size(new_ranges) > 0, place, 0))").first() == (45_000, 45_000, 44_999, 44_998)


def test_texts_are_read_in_pieces_of_bounded_size(monkeypatch):
    monkeypatch.setattr(readers, "PIECE_BYTES", 10)
    texts = ["abc", None, "defghij", "k" * 40, "", "l"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts, pa.string())], ["key", "text"])
    found = [list(zip(keys.to_pylist(), part.to_pylist())) for keys, part in readers._pieces(iter([batch, batch.slice(6)]))]
    assert [x for piece in found for x in piece] == [(i, "\n" + (x or "")) for i, x in enumerate(texts)]
    assert len(found) == 3 and all(sum(len(x) for _, x in piece[1:]) <= 20 for piece in found)
