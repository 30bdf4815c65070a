"""Ranked lexical search over a bit-sliced impact index.

A term's impact on a document is a whole number: its weight by rarity, times how often it stands there, damped and
set against the document's length. Documents lie in blocks of at most ``BLOCK``, in the order of their keys; a block keeps for each
term the places of its documents and one bitmap for each bit of their impacts. An item's scores in a block are the sums of its
terms' slices, added bit by bit with a carry for all documents and many items at once. The best k are found from the most
significant slice down: documents with the bit are certain while they are fewer than k, else they alone stay in question.

Blocks are made where documents are read, so no text is shuffled, no term is hot and a long text is one row of its block.
The index holds the terms that are asked for; statistics cover all documents. Items are dealt into parts whose terms take
``MOST_BYTES`` at most on average, and each part reads the texts once. Each task keeps k rows of an item over all of its
blocks; these meet in two rounds, so no round brings more than some thousand tasks' rows together.

Defined cases: a null or empty text has no terms, and its document is in no result; rows that share an item id, null
included, are one item with all their terms; an item without terms or hits has no rows; a document without a key stands
behind all others of its score; rows that repeat a key are ranked each for itself; empty tables give an empty result.
Other columns are never read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialise
from .tables import integer_key, table
from .wordhash import LOWER, chunks, same_words, words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes between terms: those below 0x80 that are no letter or digit.
BREAKS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
TOP = 10
#: Documents in a block, and postings beyond which a block is closed earlier.
BLOCK = 8_192
MOST_POSTINGS = 1 << 21
#: Terms of a part of the items, with 16 bytes more for each: the size of what is broadcast.
MOST_BYTES = 32 << 20
#: Items that are added up together, and terms of theirs whose slices are laid out at once.
ITEMS_AT_ONCE = 64
TERMS_AT_ONCE = 1_024
#: Groups of an item's rows in the first of the two rounds.
SALTS = 512

POSTINGS = "keys array<long>, n array<long>, terms array<int>, sizes array<int>, docs array<int>, tf array<int>, n_docs long, n_terms long"
INDEX = "keys array<long>, terms array<int>, sizes array<int>, bits array<int>, docs binary, slices binary"


class Vocabulary:
    """Terms by number; a word is found by its hash and then compared byte by byte."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(t.encode() for t in terms)
        _, hashes, starts, ends, self.data = words([b" ".join(self.terms)], BREAKS)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.starts, self.ends = hashes[self.order], starts[self.order], ends[self.order]
        clash = len(np.unique(hashes)) < len(hashes)
        self.exact = {t: n for n, t in enumerate(self.terms)} if clash else None

    def numbers(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: bytes) -> np.ndarray:
        """The number of each word, -1 for words that are no term."""
        if self.exact is not None:
            return np.array([self.exact.get(data[a:b], -1) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.int64)
        out = np.full(len(hashes), -1, dtype=np.int64)
        if not len(self.hashes):
            return out
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        some = np.flatnonzero(self.hashes[place] == hashes)
        at = place[some]
        same = same_words(data, starts[some], ends[some], self.data, self.starts[at], self.ends[at])
        out[some[same]] = self.order[at[same]]
        return out


class _Open:
    """A block that documents are added to."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.keys: list[int | None] = []
        self.n: list[np.ndarray] = []
        self.found: list[np.ndarray] = []
        self.postings = 0

    def add(self, keys: list[int | None], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Add documents; gives blocks that are full."""
        for at in range(0, len(texts), 512):
            if len(self.keys) + 512 > BLOCK or self.postings > MOST_POSTINGS:
                yield self.close()
            self._add(keys[at : at + 512], [t.translate(LOWER) for t in texts[at : at + 512]])

    def _add(self, keys: list[int | None], texts: list[bytes]) -> None:
        doc, hashes, starts, ends, data = words(texts, BREAKS)
        term = self.vocabulary.numbers(hashes, starts, ends, data)
        pairs, tf = np.unique((doc[term >= 0] + len(self.keys)) + term[term >= 0] * BLOCK, return_counts=True)
        self.found.append(np.stack([pairs // BLOCK, pairs % BLOCK, tf]))
        self.postings += len(pairs)
        self.n.append(np.bincount(doc, minlength=len(texts)))
        self.keys += keys

    def close(self) -> pa.RecordBatch:
        """The block as one row, its documents by key and its postings by term."""
        order = sorted(range(len(self.keys)), key=lambda k: (self.keys[k] is None, self.keys[k] or 0))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        term, doc, tf = np.concatenate(self.found, axis=1)
        doc = place[doc]
        by = np.lexsort((doc, term))
        terms, sizes = np.unique(term, return_counts=True)
        n = np.concatenate(self.n)[order]
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        row = [one([self.keys[k] for k in order], pa.int64()), one(n, pa.int64()), one(terms, pa.int32()), one(sizes, pa.int32()), one(doc[by], pa.int32()), one(tf[by], pa.int32()), pa.array([np.count_nonzero(n)], pa.int64()), pa.array([n.sum()], pa.int64())]
        self.clear()
        return pa.RecordBatch.from_arrays(row, names=["keys", "n", "terms", "sizes", "docs", "tf", "n_docs", "n_terms"])


def _postings(docs: DataFrame, key: str, text: str, vocabulary) -> DataFrame:  # noqa: ANN001
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Open(vocabulary.value)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                yield from block.add(part.column(0).to_pylist(), texts)
        if block.keys:
            yield block.close()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(read, POSTINGS)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """A term's weight by the number of documents that hold it."""
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int, length_share: int = 75) -> np.ndarray:
    """Whole-number impacts of terms that stand tf times in documents of n terms."""
    m = 100 - length_share + (length_share * n * n_docs) // max(1, n_terms)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def slices_of(values: np.ndarray, bits: int) -> bytes:
    """Bitmaps of the values' bits, the least significant first, each over as many bytes as it needs."""
    return np.packbits((values[None, :] >> np.arange(bits)[:, None]) & 1, axis=1, bitorder="little").tobytes()


@dataclass
class Index:
    blocks: DataFrame
    vocabulary: Vocabulary
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> Index:
    """Index of all documents for the terms that are to be asked for (a bounded list)."""
    integer_key(docs, key)
    spark = docs.sparkSession
    vocabulary = Vocabulary(terms)
    postings = materialise(_postings(docs, key, text, spark.sparkContext.broadcast(vocabulary)), "lexical-postings")
    n_docs, n_terms = (x or 0 for x in postings.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    held = postings.select(F.inline(F.arrays_zip("terms", "sizes"))).groupBy("terms").agg(F.sum("sizes").alias("df")).toArrow()
    df = np.zeros(len(vocabulary.terms), dtype=np.int64)
    df[held["terms"].to_numpy()] = held["df"].to_numpy()
    shared = spark.sparkContext.broadcast(weights(df, n_docs))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n, terms, sizes, docs, tf = (batch.column(c)[r].values.to_numpy().astype(np.int64) for c in range(1, 6))
                value = impacts(shared.value[np.repeat(terms, sizes)], tf, n[docs], n_docs, n_terms)
                ends = np.cumsum(sizes)
                most = np.maximum.reduceat(value, ends - sizes) if len(terms) else value
                bits = [int(x).bit_length() for x in most]
                slices = b"".join(slices_of(value[a:b], k) for a, b, k in zip((ends - sizes).tolist(), ends.tolist(), bits))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), batch.column(2).slice(r, 1), batch.column(3).slice(r, 1), pa.array([bits], pa.list_(pa.int32())), pa.array([docs.astype("<u2").tobytes()], pa.binary()), pa.array([slices], pa.binary())], names=["keys", "terms", "sizes", "bits", "docs", "slices"])

    return Index(materialise(postings.select("keys", "n", "terms", "sizes", "docs", "tf").mapInArrow(cut, INDEX), "lexical-index"), vocabulary, n_docs, n_terms)


class Block:
    """A block of the index, with its slices laid out over all its documents as they are asked for."""

    def __init__(self, n: int, terms: np.ndarray, sizes: np.ndarray, bits: np.ndarray, docs: bytes, slices: bytes):
        self.n, self.terms, self.sizes, self.bits = n, terms, sizes, bits
        self.words = -(-n // 64)
        self.docs, self.slices = np.frombuffer(docs, dtype="<u2"), np.frombuffer(slices, dtype=np.uint8)
        self.ends = np.cumsum(sizes)
        length = bits * (-(-sizes // 8))
        self.cut = np.concatenate([[0], np.cumsum(length)])

    def lay_out(self, places: np.ndarray, bits: int) -> np.ndarray:
        """[place, bit, word]: the slices of terms of the block."""
        out = np.zeros((len(places), bits, self.words), dtype=np.uint64)
        for row, p in enumerate(places.tolist()):
            size, k = int(self.sizes[p]), int(self.bits[p])
            packed = self.slices[self.cut[p] : self.cut[p + 1]].reshape(k, -1)
            docs = self.docs[self.ends[p] - size : self.ends[p]].astype(np.int64)
            values = np.unpackbits(packed, axis=1, count=size, bitorder="little")
            if size * 16 > self.n:
                wide = np.zeros((k, 64 * self.words), dtype=np.uint8)
                wide[:, docs] = values
                out[row, :k] = np.packbits(wide, axis=1, bitorder="little").view("<u8")
            else:
                bit, at = np.nonzero(values)
                np.bitwise_or.at(out[row], (bit, docs[at] >> 6), np.uint64(1) << (docs[at] & 63).astype(np.uint64))
        return out


def carry_add(total: np.ndarray, slices: np.ndarray, shift: int = 0) -> None:
    """Add the numbers in ``slices`` times 2**shift to those in ``total``; both have a bit for each first index."""
    carry = np.zeros_like(total[0])
    for i in range(shift, len(total)):
        x = total[i].copy()
        if i - shift < len(slices):
            y = slices[i - shift]
            total[i] = x ^ y ^ carry
            carry = (x & y) | (carry & (x ^ y))
        else:
            if not carry.any():
                return
            total[i] = x ^ carry
            carry &= x


def descend(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each second index, bitmaps of the documents that are among the k highest and of those that tie for the rest."""
    certain, open_ = np.zeros_like(total[0]), np.bitwise_or.reduce(total, axis=0)
    for bit in total[::-1]:
        higher = certain | (open_ & bit)
        few = (np.bitwise_count(higher).sum(axis=-1) < k)[:, None]
        certain, open_ = np.where(few, higher, certain), np.where(few, open_ & ~bit, open_ & bit)
    return certain, open_


def _set_bits(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


Query = tuple[np.ndarray, np.ndarray]  # numbers of terms, how often each is asked


def best_of(block: Block, queries: list[Query], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places of its k best documents, their scores) for each query that has one."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    for number, (terms, repeats) in enumerate(queries):
        place = np.minimum(np.searchsorted(block.terms, terms), max(0, len(block.terms) - 1))
        some = (block.terms[place] == terms) & (block.bits[place] > 0) if len(block.terms) else np.zeros(len(terms), dtype=bool)
        if some.any():
            held.append((number, place[some], repeats[some]))
    held.sort(key=lambda h: len(h[1]))
    for at in range(0, len(held), ITEMS_AT_ONCE):
        group = held[at : at + ITEMS_AT_ONCE]
        most = max(sum(int(r) * (2 ** int(b) - 1) for r, b in zip(repeats, block.bits[place])) for _, place, repeats in group)
        total = np.zeros((most.bit_length(), len(group), block.words), dtype=np.uint64)
        steps = len(group[-1][1])
        width = max(1, TERMS_AT_ONCE // len(group))
        for first in range(0, steps, width):
            used = np.unique(np.concatenate([place[first : first + width] for _, place, _ in group]))
            laid = block.lay_out(used, int(block.bits[used].max(initial=1)))
            for step in range(first, min(steps, first + width)):
                rows = [g for g, (_, place, _) in enumerate(group) if len(place) > step]
                begin = rows[0]  # groups are sorted by length, so these are the last ones
                slices = laid[np.searchsorted(used, [group[g][1][step] for g in rows])].transpose(1, 0, 2)
                often = np.array([group[g][2][step] for g in rows])
                for shift in range(int(often.max()).bit_length()):
                    mask = np.where((often >> shift) & 1 == 1, ~np.uint64(0), np.uint64(0))[None, :, None]
                    carry_add(total[:, begin:], slices & mask, shift)
        certain, tied = descend(total, k)
        for g, (number, _, _) in enumerate(group):
            sure = _set_bits(certain[g])
            places = np.concatenate([sure, _set_bits(tied[g])[: k - len(sure)]])
            bits = (total[:, g, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
            yield number, places, (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(axis=0)


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, terms: term and how often) for each item that has a term."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select(F.col(item).alias("item"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    return each.groupBy("item", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("terms"))


def search_index(index: Index, items: list[tuple[object, list[tuple[str, int]]]], kind: pa.DataType, name: str, top: int = TOP) -> DataFrame:
    """(item, doc_id, score, salt): each task's best rows of each of some items. ``items``: ids with terms and counts."""
    number = {t: n for n, t in enumerate(index.vocabulary.terms)}
    queries = []
    for _, terms in items:
        asked = sorted((number[t.encode()], n) for t, n in terms)
        queries.append((np.array([x[0] for x in asked], dtype=np.int64), np.array([x[1] for x in asked], dtype=np.int64)))
    shared = index.blocks.sparkSession.sparkContext.broadcast((queries, [i for i, _ in items]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids = shared.value
        best: dict[int, list[tuple[int, bool, int]]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                keys = batch.column(0)[r].values
                terms, sizes, bits = (batch.column(c)[r].values.to_numpy().astype(np.int64) for c in (1, 2, 3))
                block = Block(len(keys), terms, sizes, bits, batch.column(4)[r].as_py(), batch.column(5)[r].as_py())
                for q, places, scores in best_of(block, queries, top):
                    own = keys.take(pa.array(places)).to_pylist()
                    rows = [(-s, k is None, k or 0) for s, k in zip(scores.tolist(), own)]
                    best[q] = heapq.nsmallest(top, best.get(q, []) + rows)
        flat = [(q, row) for q, rows in sorted(best.items()) for row in rows]
        yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q, _ in flat], kind), pa.array([None if r[1] else r[2] for _, r in flat], pa.int64()), pa.array([-r[0] for _, r in flat], pa.int64())], names=[name, "doc_id", "score"])

    return index.blocks.mapInArrow(search, f"`{name}` {index_type(kind)}, doc_id long, score long")


def index_type(kind: pa.DataType) -> str:
    """Spark's name of the type of an item's id."""
    return "string" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[kind.bit_width]


def rank(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(item, rank, doc_id, score): the documents with the highest scores above 0 of each item."""
    asked = materialise(item_terms(items, item, item_text), "lexical-items")
    size = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["term"]) + 16))).first()[0] or 0
    parts = max(1, math.ceil(size / most_bytes))
    found = None
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).toArrow()
        some = [(i, [(t["term"], t["n"]) for t in terms]) for i, terms in zip(rows["item"].to_pylist(), rows["terms"].to_pylist())]
        index = build_index(docs, sorted({t for _, terms in some for t, _ in terms}), key, text)
        one = search_index(index, some, rows["item"].type, "item", top)
        found = one if found is None else found.unionByName(one)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item), "rank", F.col("doc_id").alias(key), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT item_id, term, count(*) AS r
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
g AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS all_terms FROM d WHERE len(ts) > 0),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY row, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term),
i AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // all_terms))) AS impact FROM p JOIN w USING (term), g),
s AS (SELECT item_id, row, doc_id, CAST(sum(r * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
