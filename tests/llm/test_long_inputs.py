"""Very long runs of letters and of key-like characters, and rare classes in samples."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import langid, quality, secrets

PIECES = ["▁", "a", "b", "ab", "▁ab", "aba", "bab", "abab"]


def plain_sum(word, lattice, probability):
    """The forward sum with Python numbers, scaled at each place."""
    t, logs = langid.SPACE + word, [0.0]
    for j in range(1, len(t) + 1):
        terms = [logs[i] + math.log(probability[number]) for i in range(max(0, j - lattice.longest), j) if (number := lattice.ids.get(t[i:j], 1 if j - i == 1 else 0))]
        top = max(terms)
        logs.append(top + math.log(sum(math.exp(x - top) for x in terms)))
    return logs[-1]


def test_long_words_are_summed_whole():
    lattice = langid.Lattice(PIECES)
    probability = np.random.default_rng(4).dirichlet(np.ones(len(PIECES) + 2), size=2).T
    probability[0] = 0
    for word in ("ab" * 150, "ba" * 40 + "z" + "abab" * 20, "a" * 3_000, "ab"):
        found = langid.word_likelihoods([word, word], lattice, probability)
        assert np.allclose(found, [[plain_sum(word, lattice, probability[:, k]) for k in range(2)]] * 2)
    halves = langid.word_likelihoods(["ab" * 75], lattice, probability)[0]
    assert not np.allclose(langid.word_likelihoods(["ab" * 150], lattice, probability)[0], 2 * halves)


def test_expected_counts_equal_enumeration():
    lattice = langid.Lattice(PIECES)
    probability = np.random.default_rng(5).dirichlet(np.ones(len(PIECES) + 2), size=1).T
    probability[0] = 0

    def ways(t):
        if not t:
            yield ()
        for k in range(1, len(t) + 1):
            if number := lattice.ids.get(t[:k], 1 if k == 1 else 0):
                yield from ((number, *rest) for rest in ways(t[k:]))

    words, times = ["abab", "ba", "zab"], np.array([2.0, 1.0, 3.0])
    want, total = np.zeros(len(probability)), 0.0
    for w, n in zip(words, times):
        each = [(s, math.prod(probability[p, 0] for p in s)) for s in ways(langid.SPACE + w)]
        whole = sum(x for _, x in each)
        total += n * math.log(whole)
        for s, x in each:
            for p in s:
                want[p] += n * x / whole
    found, likelihood = langid.expected_counts(words, times, lattice, probability)
    assert np.allclose(found, want) and np.isclose(likelihood, total)


def test_long_words_are_not_kept():
    model = langid.Model(["x"], langid.Lattice(PIECES), np.full((len(PIECES) + 2, 1), 0.1), np.array([-2.0]))
    texts = [b"ab ba " + b"ab" * 100, b"ba", b"ab" * 100]
    once, again = model.predict(texts), model.predict(texts)
    assert once == again and set(model.cache) == {"ab", "ba"}


RUNS = ["a1.", "/a1", "k=", "ab:", "1.", "1-", "a1@", "A1_", "ab1=", "a.b@", "//a1:", "e1+", "aB3/", "0:", "x1@a1.", "=1", "ab"]


@pytest.mark.parametrize("kind", RUNS)
def test_a_run_of_a_megabyte(spark, kind):
    long = F.repeat(F.lit(kind), 1_000_000 // len(kind))
    texts = spark.range(1).select(F.lit(1).alias("doc_id"), F.concat(F.lit("x "), F.lit("x1@" if "." in kind else ""), long, F.lit("com1 password= Zx81kqPw55LmTr90 y")).alias("text"))
    found = secrets.with_features(secrets.candidates(texts), ["password"]).select("candidate", secrets.harmless(F.col("candidate")).alias("h"), secrets.shaped(F.col("candidate")).alias("s"), "transitions")
    assert found.filter(F.col("candidate") == "Zx81kqPw55LmTr90").count() == 1
    assert found.filter(F.col("h").isNull() | F.col("s").isNull() | F.col("transitions").isNull()).count() == 0


def test_rare_bad_labels_are_sampled(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 300 == 0, F.repeat(F.lit("# "), 60)).otherwise(F.repeat(F.lit("word "), 60)).alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 300 == 0, 0).otherwise(1).alias("quality"))
    rules = quality.fit(docs, labels, fit_rows=30, min_cover=0.0, min_precision=0.5)
    kept = docs.transform(quality.text_statistics).filter(quality.verdict(rules)[0])
    assert kept.count() == 2_990 and kept.filter(F.col("doc_id") % 300 == 0).count() == 0


def plain_values(text):
    """Assigned values by Python's own regular expressions."""
    words, out = re.findall(r"[^\x20\x09-\x0D]+", text), []
    key = lambda name: bool(set(re.split(r"[_.-]+", re.sub("([a-z])([A-Z])", r"\1_\2", re.sub("[^A-Za-z_.-]", "", name)).lower())) & set(secrets.KEYWORDS))
    for at, w in enumerate(words):
        before = " ".join(x[-64:] for x in words[max(0, at - 2) : at])
        pairs = [(m[2], m[3]) for m in re.finditer(secrets.PAIR, w)]
        name, value = re.search(secrets.ASSIGNED, before), re.match("[\"'`\\\\]*+(" + secrets.VALUE + ")", w)
        if at and re.search("[=:]>?[\"'`\\\\]*$", words[at - 1][-8:]) and value or re.search("[=:]", w) and value and name:
            pairs.append((name[1] if name else "", value[1]))
        out += [(at, v) for n, v in pairs if len(w) >= 8 and key(n) and not (re.search(secrets.CANDIDATE, v) and re.search("[0-9]", v))]
    return sorted(out)


def test_values_of_keywords_are_candidates(spark):
    texts = ["password = correcthorsebatterystaple", "api_key = AbCdEfGhIjKlMnOpQrStUvWx", "password = p@ss!w0rd#Zz$19xQ", 'x {"clientSecret":"no-digits!here"} y', "DB_PASSWORD='semi#colon%value'; next", "key: tiny", "monkey = notasecretvalue", "passwordless = alsonotone", "token=0123456789abcdef", "password :\n\"quoted~value~~\"", "auth", ""]
    found = secrets.assigned_values(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = sorted((r["key"], r["candidate"]) for r in found.collect())
    assert got == [(0, "correcthorsebatterystaple"), (1, "AbCdEfGhIjKlMnOpQrStUvWx"), (2, "p@ss!w0rd#Zz$19xQ"), (3, "no-digits!here"), (4, "semi#colon%value"), (9, "quoted~value~~")]
    features = {r["key"]: (r["after_keyword"], r["after_equals"]) for r in secrets.with_features(found, []).collect()}
    assert set(features.values()) == {(1.0, 1.0)}
    rng = random.Random(9)
    bits = ["password", "api_key", "x", "=", ":", '"', " ", ",", "abcdefgh", "p@ss!w0rd#", "Token", "0123456789ab", "'", "longlettersvalue", ";"]
    rows = [(n, "".join(rng.choices(bits, k=rng.randrange(14)))) for n in range(500)]
    found = sorted((r["key"], r["at"], r["candidate"]) for r in secrets.assigned_values(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == sorted((n, *x) for n, t in rows for x in plain_values(t)) and found


@pytest.mark.parametrize("kind", ["a_", "a=", "key=", "k:'", "password=aaaaaaaa,", "=", "a.b-"])
def test_a_megabyte_of_assignments(spark, kind):
    long = F.repeat(F.lit(kind), 1_000_000 // len(kind))
    texts = spark.range(1).select(F.lit(1).alias("doc_id"), F.concat(long, F.lit(" password = correcthorsebatterystaple")).alias("text"))
    assert secrets.assigned_values(texts).filter("candidate = 'correcthorsebatterystaple'").count() >= 1
