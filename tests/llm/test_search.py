"""Lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import rows_of

from loomwright.llm import lexical


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms_of(text):
    return re.findall(lexical.TERM, lower(text))


def brute_force(docs, items, top=10):
    counts = [(key, Counter(terms_of(t))) for key, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms_of(text))
    out = []
    for item, query in asked.items():
        scored = []
        for (key, c), n in zip(counts, sizes):
            score = 0
            for t, r in query.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += r * w * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, rank, None if x[1] else x[2], -x[0]) for rank, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(map(repr, out))


def texts(rng, n):
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3_000)] + ["Ünï", "日本", "a" * 200, "a" * 199 + "b", "x.y", "A-b"]
    return [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 200]))) for _ in range(n)]


@pytest.mark.parametrize("bound", [lexical.MOST_BYTES, 600])
def test_equals_brute_force(spark, monkeypatch, bound):
    rng = random.Random(3)
    docs = [(k // 2, t) for k, t in enumerate(texts(rng, 700))] + [(None, "w1 w2 w3"), (5, None), (6, ""), (7, "w1 " * 3_000), (2**60, "w1 w2"), (-4, "w1 w2")]
    items = [(k % 31, t) for k, t in enumerate(texts(rng, 40))] + [(None, "w1 w1 w1 w2"), (90, None), (91, "nowhere"), (92, "a" * 200)]
    found = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string"), most_bytes=bound)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, found.collect()))) == brute_force(docs, items)


def test_small_blocks_and_groups_change_nothing():
    rng = np.random.default_rng(1)
    n, terms = 700, 40
    sizes = rng.integers(1, n, terms)
    docs = [np.sort(rng.choice(n, s, replace=False)) for s in sizes]
    values = [rng.integers(1, 2**33, s) for s in sizes]
    bits = np.array([int(v.max()).bit_length() for v in values])
    block = lexical.Block(n, np.arange(terms) * 3, sizes, bits, np.concatenate(docs).astype("<u2").tobytes(), b"".join(lexical.slices_of(v, b) for v, b in zip(values, bits.tolist())))
    queries = [(np.sort(rng.choice(130, rng.integers(0, 30), replace=False)), None) for _ in range(150)]
    queries = [(t, rng.integers(1, 9, len(t))) for t, _ in queries]
    for k in (1, 10, 699, 5_000):
        found = {q: list(zip(p.tolist(), s.tolist())) for q, p, s in lexical.best_of(block, queries, k)}
        for q, (asked, often) in enumerate(queries):
            total = np.zeros(n, dtype=np.int64)
            for t, r in zip(asked.tolist(), often.tolist()):
                if t % 3 == 0 and t // 3 < terms:
                    total[docs[t // 3]] += r * values[t // 3]
            want = [(int(d), int(total[d])) for d in np.lexsort((np.arange(n), -total))[:k] if total[d]]
            assert sorted(found.get(q, []), key=lambda x: (-x[1], x[0])) == want


def test_ties_go_to_the_lowest_ids(spark):
    docs = spark.createDataFrame([(k, "same words") for k in range(99, -1, -1)] + [(500, "other")], "doc_id long, text string").repartition(7)
    found = lexical.rank(docs, spark.createDataFrame([(1, "same")], "item_id long, text string"))
    assert [(r["rank"], r["doc_id"]) for r in found.orderBy("rank").collect()] == [(k + 1, k) for k in range(10)]


def test_words_are_compared_when_hashes_meet(monkeypatch):
    monkeypatch.setattr(lexical, "words", lambda texts, breaks: _one_hash(*lexical_words(texts, breaks)))
    block = lexical._Open(lexical.Vocabulary(["aa", "b"]))
    list(block.add([1, 2], [b"aa b c", b"c d aa aa"]))
    row = block.close().to_pylist()[0]
    assert (row["terms"], row["sizes"], row["docs"], row["tf"]) == ([0, 1], [2, 1], [0, 1, 0], [1, 2, 1])


lexical_words = lexical.words


def _one_hash(doc, hashes, starts, ends, data):
    return doc, hashes * np.uint64(0), starts, ends, data


def test_string_ids_of_items_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 3), (2, "b", "y", 4)], "doc_id long, text string, item string, score int")
    items = spark.createDataFrame([("i", "b", 0), (None, "a", 1)], "item_id string, text string, rank int")
    assert rows_of(lexical.rank(docs, items).select("item_id", "rank", "doc_id"))[1] == [("1", "None", "1"), ("1", "i", "2"), ("2", "i", "1")]


def test_very_long_texts_and_words(spark):
    docs = [(1, "word " * 300_000 + "rare"), (2, "x" * 1_500_000), (3, "rare \x00 rare"), (4, "RARE-rare_rare"), (5, "é" * 700_000)]
    items = [(1, "rare"), (2, "x" * 1_500_000), (3, "word " * 50_000), (4, "é" * 700_000)]
    found = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert sorted(map(repr, map(tuple, found.collect()))) == brute_force(docs, items)
