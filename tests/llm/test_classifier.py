"""The factorisation machine: its identity, its gradient, its sample and its held-out accuracy."""

import itertools

import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from loomwright.llm import factorisation as fm
from loomwright.llm.langid import held_out
from loomwright.llm.sampling import lowest_hashes
from loomwright.llm.tables import table


def machine(n, factors=3, seed=0):
    rng = np.random.default_rng(seed)
    return fm.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, factors)))


def pairwise(m, feature, value):
    linear = m.constant + sum(m.weight[f] * x for f, x in zip(feature, value))
    return linear + sum(m.factor[a] @ m.factor[b] * x * y for (a, x), (b, y) in itertools.combinations(zip(feature, value), 2))


def test_identity_equals_all_pairs():
    texts = [b"", b"a b c a", b"THE #cat! sat\n\nsat\nsat 99", "Ünï ünï".encode(), b"x " * 500]
    metadata = [np.array([0.0, 7.0, np.nan, -3.0, 1e12])]
    text, feature, value = fm.features(texts, metadata)
    m = machine(fm.width(1))
    found = m.logits(text, feature, value, len(texts))
    for k in range(len(texts)):
        own = text == k
        assert own.sum() >= len(fm.STATISTICS) + 1 and len(np.unique(feature[own])) == own.sum()
        assert np.isclose(found[k], pairwise(m, feature[own], value[own]))


def test_features_do_not_depend_on_neighbours():
    texts = [b"a b c a b c", b"", b"Z z z\nZ z z\n!!", b"one"] * 3
    whole = fm.features(texts, [])
    for k, t in enumerate(texts):
        alone = fm.features([t], [])
        own = whole[0] == k
        assert np.array_equal(whole[1][own], alone[1]) and np.allclose(whole[2][own], alone[2])


def test_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    n, factors = 9, 2
    p = rng.normal(size=(n + 1, 1 + factors))
    p[-1, 1:] = 0
    feature, value, begins = np.array([0, 3, 4, 1, 3]), rng.normal(size=5), np.array([0, 3, 5])
    label, weight = np.array([1.0, 0.0]), np.array([0.5, 2.0])

    def loss(q):
        m = fm.Machine(q[-1, 0], q[:-1, 0], q[:-1, 1:])
        used = np.unique(feature)
        y = np.array([pairwise(m, feature[a:b], value[a:b]) for a, b in zip(begins, begins[1:])])
        return float((weight * (np.logaddexp(0, y) - label * y)).sum() + fm.DECAY / 2 * (q[used] ** 2).sum())

    _, h = fm.train_pass(p, np.zeros_like(p), (begins, feature, value, label, weight), factors)
    # the first of the steps adds the gradient's square; repeat it alone
    steps, fm.LEAST_STEPS = fm.LEAST_STEPS, 1
    try:
        _, h = fm.train_pass(p, np.zeros_like(p), (begins, feature, value, label, weight), factors)
    finally:
        fm.LEAST_STEPS = steps
    for i, j in itertools.product(range(n + 1), range(1 + factors)):
        if i == n and j:
            continue
        e = np.zeros_like(p)
        e[i, j] = 1e-5
        assert np.isclose(h[i, j], ((loss(p + e) - loss(p - e)) / 2e-5) ** 2, rtol=1e-4, atol=1e-9)


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    m = fm.fit(docs.drop("lang", "source"), labels.filter(~held_out(F.col("doc_id"))))
    rows = fm.score(docs, m).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= fm.THRESHOLD for g in good]) > 0.98 and np.mean([b < fm.THRESHOLD for b in bad]) > 0.5


def test_odd_labels_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "s"), (1, "a b", 5, "s"), (None, "c", None, None), (3, None, 1, "t")], "doc_id long, text string, n_chars int, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (3, 1), (None, 0), (1, None), (1, 7), (99, 0)], "doc_id long, quality int")
    for labels, want in ((none, 0.5), (one, 0.6)):  # the label without a document counts in the shares of the classes
        scored = fm.score(docs, fm.fit(docs, labels))
        assert sorted(scored.columns) == ["doc_id", "n_chars", "score", "text"]
        assert [round(r["score"], 6) for r in scored.collect()] == [want] * 4
    two = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    first, second = (fm.score(docs.select("doc_id", "text"), fm.fit(docs.repartition(n), two, metadata=())) for n in (1, 3))
    a, b = (sorted((r["doc_id"] or 0, r["score"]) for r in x.collect()) for x in (first, second))
    assert a == b and a[1][1] == a[2][1] > 0.5 > a[3][1]


def test_sample_is_bounded_and_keeps_rare_labels(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") == 77, 2).when(F.col("id") % 10 == 0, 0).otherwise(1).alias("y"))
    counts = {r["y"]: r["count"] for r in lowest_hashes(rows, "y", ["id"], 500).groupBy("y").count().collect()}
    assert counts[2] == 1 and all(400 < counts[c] < 600 for c in (0, 1))
    assert lowest_hashes(rows, "y", ["id"], 1).groupBy("y").count().count() == 3


def test_op12_shape(spark):
    found = fm.op12_quality_classifier(spark, SMALL)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.collect())


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "a b " * 400_000), (2, "x" * 1_500_000), (3, "\n" * 1_000_000), (4, "é# " * 300_000), (5, " ")], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(1, 6)], "doc_id long, quality int")
    scored = fm.score(docs, fm.fit(docs, labels, metadata=()))
    assert [0 <= r["score"] <= 1 for r in scored.collect()] == [True] * 5
