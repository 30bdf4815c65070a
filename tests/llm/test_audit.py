"""The filter audit against filters that are really applied one after another."""

import itertools
import re

from pyspark.sql import functions as F

from loomwright.llm import interaction

DOCS = [
    (1, "a " * 250, "x"), (2, "a " * 250, "x"), (3, "a " * 250, "y"), (4, " ".join(f"w{n}" for n in range(300)), None), (5, "ABC #", "x"), (6, "ABC #", "x"), (6, "ABC #", "x"),
    (7, None, "y"), (8, "", "y"), (None, "", ""), (None, "ABC #", "x"), (9, " ".join(f"W{n}&" for n in range(210)), "x"), (10, "X" + "y" * 49 + " z" * 200, "x"), (11, "Ü " * 199 + "a", "y"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, None), (5, None, 1), (6, 1, None), (6, 0, 1), (8, 1, 1), (None, 1, 1), (99, 1, 1)]


def brute_force(docs, labels):
    rows = []
    for key, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = key is not None and any(k is not None and k < key and (o or "") == t for k, o, _ in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        has = lambda i: key is not None and any(x[0] == key and x[i] == 1 for x in labels)  # noqa: B023, E731
        rows.append((part or "", fails, has(1), has(2)))
    out = []
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for n, f in enumerate(order, 1):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                total[f] += len(gone)
                failing = [r for r in mine if r[1][f]]
                steps.append((part, "".join(order), n, f, len(left), len(gone), len(failing) - len(gone), sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*s[:3], *s[4:], total[s[3]], s[3]) for s in steps]
    return sorted(out)


def test_equals_filters_applied_in_turn(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = interaction.op13_filter_audit(spark, str(tmp_path))
    assert found.columns[:10] == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == brute_force(DOCS, LABELS)


def test_each_state_is_visited_once(spark, monkeypatch):
    visited = []
    real = interaction._edges
    monkeypatch.setattr(interaction, "_edges", lambda rows, state, left: visited.append((state, "".join(left))) or real(rows, state, left))
    rows = spark.range(40).select((F.col("id") % 2).cast("string").alias("part"), "id", F.lit(True).alias("good"), F.lit(False).alias("toxic"))
    edges = interaction.walk(rows, {"p": F.col("id") % 3 == 0, "q": F.when(F.col("id") > 30, True), "r": F.col("id") < 5})
    assert sorted(visited) == [("", "pqr"), ("p", "qr"), ("pq", "r"), ("pr", "q"), ("q", "pr"), ("qr", "p"), ("r", "pq")]
    assert edges.count() == 2 * 3 * 4
    kept = {(r["state"], r["filter"]): r["kept"] for r in edges.filter("part = '0'").collect()}
    assert kept["pq", "r"] == kept["pr", "q"] == kept["qr", "p"] == len([n for n in range(0, 40, 2) if n % 3 and n <= 30 and n >= 5])
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().nonEmpty()


def test_very_long_texts_and_one_hot_key(spark):
    docs = spark.createDataFrame([(1, "a b " * 400_000, "s"), (2, "X" * 1_500_000, "s"), (3, "X" * 1_500_000, "s")], "doc_id long, text string, source string")
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") + 10).alias("doc_id"), F.when(F.col("id") % 2 == 0, "").otherwise("same text").alias("text"), F.lit("hot").alias("source"))
    labels = spark.createDataFrame([(7, 1, 1), (7, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r["part"]: r for r in interaction.by_order(interaction.walk(interaction.measured(docs.union(hot), labels), interaction.production_filters()), list("ABCDE")).filter("filter_order = 'EDCBA' AND step = 1").collect()}
    assert (rows["s"]["removed"], rows["s"]["kept"], rows["s"]["good_lost"]) == (1, 2, 0)
    assert rows["hot"]["removed"] == 10_000 and rows["hot"]["good_lost"] == 0  # the smallest id has both texts, and all its rows stay
