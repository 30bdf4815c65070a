"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x: its words hashed into buckets (damped counts of length 1), one bin of each structure statistic, and
one bin of each metadata column. Its logit is a constant, plus a weight for each feature, plus for each pair of features
the product of their low-rank vectors. The sum over all pairs is half of the squared sum less the sum of squares in each factor, so a
document costs time in proportion to its features, not their pairs.

The fit takes a bounded sample of labelled rows: those of the lowest hashes of each class, weighted back to the classes' shares
in all labels. It is dealt by hash into ``SHARDS`` packed rows; in each round every shard goes over its rows with Adagrad from
the same parameters in its own task, and the results are averaged (iterative parameter mixing). Only parameters reach the
driver. Features that no sampled row has stay 0. Scoring is one map-only pass over whole texts.

Defined cases: a null or empty text has no words, and its statistics' bins decide; a null metadata value has its own bin; labels other
than 0 and 1, of null keys, or without a document are not learned from; of rows that share a key and a label one is
learned from, that of the lowest text hash; with one class only the score is that of the smoothed class shares, without
labels 0.5; repeated rows are scored alike; an empty table gives an empty result. An input column named as the score is
replaced, all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import held_out
from .sampling import lowest_hashes
from .storage import materialise
from .tables import table
from .wordhash import LOWER, SPACES, chunks, grams, mix, words

#: The fit takes about so many labelled rows of each class.
FIT_ROWS = 20_000
BUCKET_BITS = 14
FACTORS = 8
SHARDS = 8
ROUNDS = 6
BATCH = 32
#: A round makes at least so many steps in a shard, going over its rows again where they are few.
LEAST_STEPS = 120
RATE = 0.1
DECAY = 1e-4
THRESHOLD = 0.3
#: Metadata columns that the query reads.
METADATA = ("n_chars",)

_SHARES = np.array([1e-9, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.11, 0.16, 0.22, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
STATISTICS = ("words", "lines", "word_length", "symbols", "uppers", "digits", "marks", "stops", "wide", "distinct", "repeated", "duplicate_lines")
BINS = 32


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_CLASSES = {"symbols": _class("#*$%&|<>{}[]\\^~=+@"), "uppers": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _class("0123456789"), "marks": _class("!?"), "stops": _class(".,;:"), "wide": (np.arange(256) >= 0x80).astype(np.int64)}


def width(metadata: int) -> int:
    """Features with so many metadata columns."""
    return (1 << BUCKET_BITS) + BINS * (len(STATISTICS) + metadata)


def _repeats(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Values of each text that an earlier one of the same text equals."""
    keyed = np.sort(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)), kind="stable")
    again = np.flatnonzero(keyed[1:] == keyed[:-1]) + 1
    return np.bincount(doc[order[again]], minlength=n)


def _log_bin(x: np.ndarray, step: float = 2.0) -> np.ndarray:
    return np.minimum(np.floor(step * np.log2(1.0 + np.maximum(x, 0))), BINS - 2).astype(np.int64)


def features(texts: list[bytes], metadata: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of each feature that is not 0, by text."""
    n = len(texts)
    doc, hashes, starts, ends, data = words([t.translate(LOWER) for t in texts], SPACES)
    n_words = np.bincount(doc, minlength=n)
    pairs, count = np.unique(doc.astype(np.int64) << BUCKET_BITS | (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
    owner, value = pairs >> BUCKET_BITS, np.log1p(count)
    value /= np.sqrt(np.maximum(np.bincount(owner, value * value, minlength=n), 1e-12))[owner]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    chars = np.maximum(np.bincount(doc, ends - starts, minlength=n).astype(np.int64), 1)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    each = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    lines, line_repeats = (np.array([f(x) for x in each], dtype=np.int64) for f in (len, lambda x: len(x) - len(set(x))))
    triples = grams(hashes, 3)
    inside = doc[: len(triples)] == doc[2:] if len(triples) else np.zeros(0, dtype=bool)
    share = lambda x, of: np.searchsorted(_SHARES, x / np.maximum(of, 1), side="right")
    bins = {"words": _log_bin(n_words), "lines": _log_bin(lines), "word_length": np.minimum(2 * chars // np.maximum(n_words, 1), BINS - 2)}
    for name, kind in _CLASSES.items():
        total = np.concatenate([[0], np.cumsum(kind[raw])])
        bins[name] = share(total[bounds[1:]] - total[bounds[:-1]], chars)
    bins |= {"distinct": share(_repeats(doc, hashes, n), n_words), "repeated": share(_repeats(doc[: len(triples)][inside], triples[inside], n), n_words), "duplicate_lines": share(line_repeats, lines)}
    columns = [bins[name] for name in STATISTICS] + [np.where(np.isnan(m), BINS - 1, _log_bin(np.nan_to_num(m))) for m in metadata]
    fixed = np.stack([(1 << BUCKET_BITS) + BINS * k + b for k, b in enumerate(columns)], axis=1)
    text = np.concatenate([owner, np.repeat(np.arange(n), len(columns))])
    feature = np.concatenate([pairs & ((1 << BUCKET_BITS) - 1), fixed.ravel()])
    all_values = np.concatenate([value, np.full(fixed.size, 1 / np.sqrt(len(columns)))])
    order = np.argsort(text, kind="stable")
    return text[order], feature[order], all_values[order]


@dataclass(frozen=True)
class Machine:
    constant: float
    weight: np.ndarray  # feature
    factor: np.ndarray  # feature, factor
    columns: tuple[str, ...] = METADATA

    def logits(self, text: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """By the sum-of-squares identity; the features of a text stand together."""
        out = self.constant + np.bincount(text, self.weight[feature] * value, minlength=n)
        if len(text):
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            vx = self.factor[feature] * value[:, None]
            out[text[first]] += 0.5 * (np.add.reduceat(vx, first) ** 2 - np.add.reduceat(vx * vx, first)).sum(axis=1)
        return out


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def train_pass(parameters: np.ndarray, squares: np.ndarray, examples: tuple[np.ndarray, ...], factors: int) -> tuple[np.ndarray, np.ndarray]:
    """Adagrad over (begins, feature, value, label, weight of each text); parameters by feature: weight and
    factors, the constant behind the last feature. ``squares`` are the gradients' squares so far."""
    begins, feature, value, label, importance = examples
    p, h = parameters.copy(), squares.copy()
    batches = list(range(0, len(label), BATCH))
    for at in batches * max(1, -(-LEAST_STEPS // max(1, len(batches)))):
        lo, hi = begins[at], begins[min(at + BATCH, len(label))]
        f, x = feature[lo:hi], value[lo:hi]
        own = begins[at : min(at + BATCH, len(label)) + 1] - lo
        text = np.repeat(np.arange(len(own) - 1), np.diff(own))
        vx = p[f, 1:] * x[:, None]
        sums = np.add.reduceat(vx, own[:-1])
        logit = p[-1, 0] + np.bincount(text, p[f, 0] * x, minlength=len(own) - 1) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, own[:-1])).sum(axis=1)
        error = (probability(logit) - label[at : at + BATCH]) * importance[at : at + BATCH]
        each = np.concatenate([(error[text] * x)[:, None], (error[text] * x)[:, None] * (sums[text] - vx)], axis=1)
        used, place = np.unique(f, return_inverse=True)
        order = np.argsort(place, kind="stable")
        gradient = np.add.reduceat(each[order], np.searchsorted(place[order], np.arange(len(used)))) + DECAY * p[used]
        h[used] += gradient**2
        p[used] -= RATE * gradient / np.sqrt(h[used] + 1e-8)
        g = error.sum()
        h[-1, 0] += g * g
        p[-1, 0] -= RATE * g / np.sqrt(h[-1, 0] + 1e-8)
    return p, h


def examples_of(docs: DataFrame, labels: DataFrame, key: str, text: str, label_key: str, label: str, metadata: tuple[str, ...], fit_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(packed rows by shard, labels of each class): a row has the features, labels and weights of its sampled texts."""
    usable = labels.select(F.col(label_key).alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)").distinct()
    total = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = lowest_hashes(usable, "y", ["k"], fit_rows)
    own = docs.select(F.col(key).alias("own"), F.struct(F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metadata))).alias("row"))
    one = own.join(F.broadcast(sample), F.col("own") == F.col("k")).groupBy("k", "y").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    rows = one.select(F.pmod(F.xxhash64("k", F.lit("shard")), F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64("k", F.lit("order")).alias("place"), F.col("y"), "row.*")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                owner, feature, value = features(texts, [part.column(4 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(metadata))])
                cut = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
                packed = [[x[a:b].tobytes() for a, b in zip(cut, cut[1:])] for x in (feature.astype("<i4"), value.astype("<f4"))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(x, pa.binary()) for x in packed)], names=["shard", "place", "y", "feature", "value"])

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("place", "ascending"), ("y", "ascending")])
        feature, value = (group[c].to_pylist() for c in ("feature", "value"))
        sizes = np.array([len(x) // 4 for x in feature], dtype="<i8")
        return pa.table({"shard": [group["shard"][0].as_py()], "sizes": [sizes.tobytes()], "feature": [b"".join(feature)], "value": [b"".join(value)], "y": [group["y"].to_numpy().astype("<i4").tobytes()]}, schema=pa.schema([("shard", pa.int32()), ("sizes", pa.binary()), ("feature", pa.binary()), ("value", pa.binary()), ("y", pa.binary())]))

    read_rows = rows.mapInArrow(read, "shard int, place long, y int, feature binary, value binary")
    return materialise(read_rows.groupBy("shard").applyInArrow(pack, "shard int, sizes binary, feature binary, value binary, y binary"), "fm-examples"), total


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "quality", metadata: tuple[str, ...] = METADATA, fit_rows: int = FIT_ROWS, factors: int = FACTORS, rounds: int = ROUNDS) -> Machine:
    """A machine for the probability of label 1."""
    n = width(len(metadata))
    examples, total = examples_of(docs, labels, key, text, label_key, label, metadata, fit_rows)
    taken = {0: 0, 1: 0}
    for r in examples.select("y").toLocalIterator():
        y = np.frombuffer(r["y"], dtype="<i4")
        taken = {c: taken[c] + int((y == c).sum()) for c in taken}
    bias = float(np.log((total.get(1, 0) + 1) / (total.get(0, 0) + 1)))
    machine = Machine(bias, np.zeros(n), np.zeros((n, factors)), metadata)
    if not taken[0] or not taken[1]:
        return machine
    share = {c: total[c] / sum(total.values()) * sum(taken.values()) / taken[c] for c in taken}
    p = np.zeros((n + 1, 1 + factors))
    p[:-1, 1:] = np.random.default_rng(7).normal(0, 0.05, (n, factors))
    p[-1, 0] = bias
    h = np.zeros_like(p)
    for _ in range(rounds):
        shared = examples.sparkSession.sparkContext.broadcast((p, h))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for r in batch.to_pylist():
                    y = np.frombuffer(r["y"], dtype="<i4")
                    begins = np.concatenate([[0], np.cumsum(np.frombuffer(r["sizes"], dtype="<i8"))])
                    weight = np.where(y == 1, share[1], share[0])
                    both = train_pass(*shared.value, (begins, np.frombuffer(r["feature"], dtype="<i4"), np.frombuffer(r["value"], dtype="<f4").astype(float), y.astype(float), weight), factors)
                    yield pa.RecordBatch.from_arrays([pa.array([r["shard"]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in both)], names=["shard", "p", "h"])

        results = sorted(examples.select("shard", "sizes", "feature", "value", "y").mapInArrow(run, "shard int, p binary, h binary").collect(), key=lambda r: r["shard"])
        p, h = (np.mean([np.frombuffer(r[c]).reshape(p.shape) for r in results], axis=0) for c in ("p", "h"))
        shared.unpersist()
    seen = (h[:-1, :1] > 0).astype(float)
    return replace(machine, constant=float(p[-1, 0]), weight=p[:-1, 0] * seen[:, 0], factor=p[:-1, 1:] * seen)


def score(docs: DataFrame, machine: Machine, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.select(*(c for c in docs.columns if c in (text, *machine.columns) or c != into))
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != into), T.StructField(into, T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for part, texts in chunks(batch, text):
                metadata = [part.column(part.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in machine.columns]
                found = probability(machine.logits(*features(texts, metadata), len(texts)))
                kept = [k for k, name in enumerate(part.schema.names) if name != into]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(found, pa.float64())], names=[*(part.schema.names[k] for k in kept), into])

    return docs.mapInArrow(predict, schema)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *METADATA)
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
