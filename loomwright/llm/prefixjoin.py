"""Where windows occur in texts, as a join on their rarest shingles, in two passes over the texts at any number of windows.

1. The shingles of all windows are counted over all texts. A sieve of bounded size (a Bloom filter of two bits) keeps
   nearly all other shingles of the texts from being counted, and each task adds up before the shuffle.
2. A window with a shingle that no text has can occur nowhere and is dropped; of the others the rarest shingle is the prefix.
3. Texts send each place where a prefix may stand, with as many words around it as a window can take, to be joined with the
   windows of that prefix. What the text has before and behind the place bounds the windows that fit; words are compared.

A prefix with more than one in ``HOT_PARTS`` of all places is hot: its places are dealt to shares in turn and its windows are
copied to each, so there are fewer than twice ``HOT_PARTS`` shares. The driver gets the sieve's 64 MB and counts, and the hot
prefixes and texts by the rule above. Hashes only choose places: prefixes that share a hash cost places, never a result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import HOT_PARTS, spread_join
from .storage import materialise
from .wordhash import chunks, grams, words

#: Bits of a sieve for each code, and at most: 2**28 bits are 32 MB in each task, and 64 MB of numbered words on their way
#: to the driver. Beyond 8 million codes more than one in 250 of the other shingles pass; at 80 million it is one in five.
SIEVE_BITS = 32
MAX_SIEVE_BITS = 1 << 28
#: Distinct shingles that a task adds up before it sends them on.
HELD_CODES = 1 << 20


class Sieve:
    """Codes that may be in a set; all that are pass."""

    def __init__(self, bits: int, places: np.ndarray, values: np.ndarray):
        self.bits = bits
        self.field = np.zeros(bits // 64, dtype=np.uint64)
        self.field[places] = values.view(np.uint64)

    def has(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones(len(codes), dtype=bool)
        for shift in (0, 32):
            bit = (codes >> np.uint64(shift)) & np.uint64(self.bits - 1)
            out &= (self.field[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out


def sieve_of(codes: DataFrame) -> Sieve:
    """The sieve of the column ``code``, whose bits are set on the executors."""
    bits = min(MAX_SIEVE_BITS, max(64, 1 << (SIEVE_BITS * codes.count()).bit_length()))
    ends = F.array(F.col("code"), F.shiftrightunsigned("code", 32))
    bit = codes.select(F.explode(ends).alias("bit")).select(F.col("bit").bitwiseAND(F.lit(bits - 1)).alias("bit"))
    field = bit.groupBy(F.shiftright("bit", 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("value"))
    found = field.toArrow()
    return Sieve(bits, found["place"].to_numpy(), found["value"].to_numpy())


def coded(windows: DataFrame, shingle: int, split: Callable[[bytes], bytes]) -> DataFrame:
    """``windows`` (window, items) with the ``codes`` of their shingles by offset and their ``length`` in words."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "window"):
                doc, hashes, *_ = words([split(t) for t in texts])
                begins = np.searchsorted(doc, np.arange(len(texts) + 1))
                codes = [grams(hashes[lo:hi], min(shingle, hi - lo)).view(np.int64) for lo, hi in zip(begins, begins[1:])]
                columns = [part.column(0), part.column(1), pa.array(codes, pa.list_(pa.int64())), pa.array(np.diff(begins).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["window", "items", "codes", "length"])

    return windows.select("window", "items").mapInArrow(code, "window binary, items array<string>, codes array<long>, length int")


def places(texts: list[bytes], sieve: Sieve, sizes: list[int], split: Callable[[bytes], bytes]):  # noqa: ANN201
    """(size, codes, places) for each size of shingles, of those that pass the sieve; and the words of the texts."""
    found = words([split(t) for t in texts])
    doc, hashes = found[:2]
    out = []
    for k in sizes:
        codes = grams(hashes, k)
        if len(codes):
            at = np.flatnonzero((doc[: len(codes)] == doc[k - 1 :]) & sieve.has(codes))
            out.append((k, codes[at].view(np.int64), at))
    return out, found


def occurrences(texts: DataFrame, text: str, sieve: Sieve, sizes: list[int], split: Callable[[bytes], bytes]) -> DataFrame:
    """(code, n): how often each code that passes the sieve stands in all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(sieve)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], names=["code", "n"])

        for batch in batches:
            for _, part in chunks(batch, text):
                for _, more, _ in places(part, shared.value, sizes, split)[0]:
                    codes, place = np.unique(np.concatenate([codes, more]), return_inverse=True)
                    sums = np.bincount(place, weights=np.concatenate([sums, np.ones(len(more), dtype=np.int64)]), minlength=len(codes)).astype(np.int64)
                    if len(codes) > HELD_CODES:
                        yield sent()
                        codes, sums = codes[:0], sums[:0]
        yield sent()

    return texts.select(text).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def prefixes(texts: DataFrame, text: str, windows: DataFrame, shingle: int, split: Callable[[bytes], bytes]) -> DataFrame:
    """(window, items, length, code, at, n) of the windows that can occur, as a written table: the code of the rarest
    shingle, its offset, and how often it stands in all texts. Of equally rare ones it is the first."""
    rows = materialise(coded(windows, shingle, split), "coded-windows")
    shingles = rows.select("window", "items", "length", F.size("codes").alias("size"), F.posexplode("codes").alias("at", "code"))
    known = materialise(shingles.groupBy("code").agg(F.count(F.lit(1)).alias("members")), "window-shingles")
    counts = occurrences(texts, text, sieve_of(known), shingle_sizes(rows, shingle), split)
    counted = spread_join(shingles, materialise(known.join(counts, "code"), "shingle-counts"), ["code"])
    same = {c: F.any_value(c).alias(c) for c in ("items", "length", "size")}
    best = counted.groupBy("window").agg(*same.values(), F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "at", "code")).alias("best"))
    return materialise(best.filter("found = size").select("window", "items", "length", "best.code", "best.at", "best.n"), "window-prefixes")


def shingle_sizes(windows: DataFrame, shingle: int) -> list[int]:
    return sorted(r[0] for r in windows.select(F.least("length", F.lit(shingle))).distinct().collect())


def shares_of(n: str, total: int):  # noqa: ANN201
    """Shares of a key with ``n`` of ``total`` rows: one, or for a hot key so many that none has a ``HOT_PARTS``th of them."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) * HOT_PARTS / F.lit(max(1, total)))).cast("int")


def occurring(texts: DataFrame, key: str, text: str, found: DataFrame, shingle: int, longest: int, split: Callable[[bytes], bytes]) -> DataFrame:
    """(key, start, end, items), each once: where windows of ``found`` (from ``prefixes``) stand in texts, in words."""
    codes = materialise(found.groupBy("code").agg(F.any_value("n").alias("n")), "prefix-codes")
    total = codes.agg(F.sum("n")).first()[0] or 0
    hot = {r["code"]: r["shares"] for r in codes.select("code", shares_of("n", total).alias("shares")).filter("shares > 1").collect()}
    shared = texts.sparkSession.sparkContext.broadcast((sieve_of(codes), hot))
    sizes = shingle_sizes(found, shingle)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, hot = shared.value
        turn: dict[int, int] = defaultdict(int)
        for batch in batches:
            for part, raw in chunks(batch, text):
                passing, (doc, _, starts, ends, data) = places(raw, sieve, sizes, split)
                begins = np.searchsorted(doc, np.arange(len(raw) + 1))
                for k, codes, at in passing:
                    lo, hi = begins[doc[at]], begins[doc[at] + 1]
                    first = np.maximum(lo, at - (longest - k)) if k == shingle else at
                    last = np.minimum(hi, at + longest) if k == shingle else at + k
                    context = [b" ".join(data[a:b].split()) for a, b in zip(starts[first].tolist(), ends[last - 1].tolist())]
                    share = np.zeros(len(at), dtype=np.int32)
                    for n, c in enumerate(codes.tolist()) if hot else ():
                        if c in hot:
                            share[n] = turn[c] % hot[c]
                            turn[c] += 1
                    columns = [pa.array(codes), pa.array(share), part.column(0).take(pa.array(doc[at])), pa.array(at - lo), pa.array((at - first).astype(np.int32)), pa.array(context, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["code", "share", "key", "place", "before", "context"])

    sent = texts.select(F.col(key).alias("key"), F.col(text).alias(text)).mapInArrow(send, "code long, share int, key binary, place long, before int, context string")
    dealt = found.withColumn("share", F.explode(F.sequence(F.lit(0), shares_of("n", total) - 1)))
    here = F.array_join(F.slice(F.split("context", " "), F.col("before") - F.col("at") + 1, F.col("length")), " ")
    stands = F.when(F.col("before") >= F.col("at"), here == F.col("window").cast("string"))
    start = F.col("place") - F.col("at")
    return sent.join(dealt, ["code", "share"]).filter(stands).select("key", start.alias("start"), (start + F.col("length")).alias("end"), "items").distinct()
