"""Benchmark decontamination by a prefix-filtered containment join.

Each benchmark item is cut into windows of consecutive words (an item with fewer words is one window). The shingles of
the windows are ordered by rarity, counted over all documents; since a window must be contained whole, its necessary
prefix is its single rarest shingle. Document shingles are joined with these prefixes; the length and position bounds
leave only windows that fit into the document where the shingle stands, and the words are then compared exactly.

Up to ``MAX_BLOCK`` windows are compiled to one block that is broadcast, and the documents stream through it in two map-only
passes, so no document is shuffled and no passage is hot. Of more windows, those that can occur are found in one pass
(``prefixjoin``). If they fit into a block, one more pass searches them; else places and windows are joined by shuffle, and
the documents with what stands in equal texts. Hot prefixes and hot texts are dealt to shares.

Defined cases: a null or empty text has no words; a null item id counts as the empty string; item rows with the same
id are one item; equal windows of several items count for all of them; rows that repeat a key are judged each by
its own text; empty tables give no hits or no rows. Other columns are kept if asked for, never read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefixjoin import occurring, prefixes, shares_of
from .storage import materialise
from .tables import free_name, table
from .wordhash import chunks

#: Windows in a block: 50,000 of 10 words each were measured to take 27 MB as a broadcast, and the counts of their
#: some 400,000 shingles come to the driver.
MAX_BLOCK = 50_000
SHINGLE = 3
WINDOW = 10

#: A-Z to a-z; digits, letters and bytes from 0x80 stay; all other bytes become spaces.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
_RESULT = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Block:
    """A set of windows, compiled: word ids, and for each shingle length the codes and where they stand."""

    def __init__(self, windows: list[bytes], items: list[list[str]]):
        split = [w.split() for w in windows]
        self.vocabulary: dict[bytes, int] = {}
        self.items = items
        self.windows = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for ws in split]
        self.lengths = np.array([len(w) for w in self.windows], dtype=np.int64)
        at: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # shingle length: (code, window, offset)
        for n, w in enumerate(self.windows):
            k = min(SHINGLE, len(w))
            at[k] += [(c, n, o) for o, c in enumerate(self.codes(w, k).tolist())]
        self.places = {k: np.array(v, dtype=np.int64) for k, v in at.items()}
        self.shingles = {k: np.unique(v[:, 0]) for k, v in self.places.items()}
        self.flat = np.concatenate(self.windows) if self.windows else np.zeros(0, dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)

    def codes(self, ids: np.ndarray, k: int) -> np.ndarray:
        """An exact number for each k consecutive words; -1 if one is not in the block's vocabulary."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        out, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for j in range(k):
            out = out * len(self.vocabulary) + ids[j : j + n]
            known &= ids[j : j + n] >= 0
        return np.where(known, out, -1)

    def choose(self, rarity: dict[tuple[int, int], int]) -> None:
        """Keep the rarest shingle of each window (of equally rare ones, that of the smallest code)."""
        self.prefix = {}
        for k, v in self.places.items():
            seen = np.array([rarity.get((k, c), 0) for c in v[:, 0].tolist()], dtype=np.int64)
            order = np.lexsort((v[:, 2], v[:, 0], seen, v[:, 1]))
            first = order[np.concatenate([[True], np.diff(v[order, 1]) != 0])]
            chosen = v[first][np.argsort(v[first][:, 0], kind="stable")]
            codes, begins = np.unique(chosen[:, 0], return_index=True)
            self.prefix[k] = (codes, np.append(begins, len(chosen)), chosen[:, 1], chosen[:, 2])
        del self.places

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word ids with a -1 behind each text, begin of each text, words of each text)."""
        ids: list[int] = []
        counts = []
        get = self.vocabulary.get
        for t in texts:
            ws = words_of(t)
            counts.append(len(ws))
            ids += [get(w, -1) for w in ws]
            ids.append(-1)
        n = np.array(counts, dtype=np.int64)
        return np.array(ids, dtype=np.int64), np.cumsum(n + 1) - (n + 1), n

    def count(self, texts: list[bytes], into: dict[int, np.ndarray]) -> None:
        """Add for each shingle the number of texts that have it."""
        ids, begins, _ = self.read(texts)
        for k, known in self.shingles.items():
            codes = self.codes(ids, k)
            place = np.searchsorted(known, codes)
            hit = np.flatnonzero((codes >= 0) & (known[np.minimum(place, len(known) - 1)] == codes))
            text = np.searchsorted(begins, hit, side="right") - 1
            pairs = np.unique(text * len(known) + place[hit])
            np.add.at(into[k], pairs % len(known), 1)

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """Words of each text, and (text, window, first word, end) of each occurrence of a window."""
        ids, begins, counts = self.read(texts)
        found: list[tuple[int, int, int, int]] = []
        for k, (codes, rows, window, offset) in self.prefix.items():
            mine = self.codes(ids, k)
            place = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            hit = np.flatnonzero((mine >= 0) & (codes[place] == mine))
            lo, n = rows[place[hit]], rows[place[hit] + 1] - rows[place[hit]]
            at = np.repeat(hit, n)
            row = np.repeat(lo, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            w, start = window[row], at - offset[row]
            text = np.searchsorted(begins, at, side="right") - 1
            fits = (start >= begins[text]) & (start + self.lengths[w] <= begins[text] + counts[text])
            w, start, text = w[fits], start[fits], text[fits]
            for length in np.unique(self.lengths[w]):
                some = np.flatnonzero(self.lengths[w] == length)
                run = np.arange(length)
                same = (ids[start[some][:, None] + run] == self.flat[self.begins[w[some]][:, None] + run]).all(axis=1)
                some = some[same]
                first = start[some] - begins[text[some]]
                found += zip(text[some].tolist(), w[some].tolist(), first.tolist(), (first + length).tolist())
        return counts, found


def item_windows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(window, items): each distinct window, its words joined by spaces, and the ids of its items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ws = words_of(t or b"")
                rows += [(i, b" ".join(ws[n : n + size])) for n in range(max(1, len(ws) - size + 1)) if ws]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["item", "window"])

    ids = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return ids.mapInArrow(cut, "item string, window binary").groupBy("window").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_block: int = MAX_BLOCK, into: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, spans (merged word ranges that are hit: start, end, start,
    ...) and items (ids of items with occurring windows, sorted as strings)."""
    windows = materialise(item_windows(benchmark, item, item_text, window), "windows")
    texts = docs.select(F.col(text).alias("text"))
    if windows.count() <= max_block:
        block = _compiled(windows.orderBy("window").collect())
        block.choose(_rarity(texts, block))
        return _search(docs, text, into, block)
    found = prefixes(texts, "text", windows, SHINGLE, lambda t: t.translate(_WORD_BYTES))
    if found.count() <= max_block:
        rows = found.orderBy("window").collect()
        block = _compiled(rows)
        block.choose({(k, c): -1 for k, v in block.places.items() for c, n, o in v.tolist() if o == rows[n]["at"]})
        return _search(docs, text, into, block)
    return _joined(docs, text, into, found, window)


def _compiled(rows: list) -> Block:
    return Block([bytes(r["window"]) for r in rows], [r["items"] for r in rows])


def _rarity(texts: DataFrame, block: Block) -> dict[tuple[int, int], int]:
    """Documents that have each of the block's shingles; each task adds up before the shuffle."""
    if not block.shingles:
        return {}
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        sums = {k: np.zeros(len(v), dtype=np.int64) for k, v in block.shingles.items()}
        for batch in batches:
            for _, part in chunks(batch, "text"):
                block.count(part, sums)
        for k, v in sums.items():
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(block.shingles[k][some]), pa.array(v[some])], names=["k", "code", "n"])

    sums = texts.mapInArrow(count, "k long, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n"))
    return {(r["k"], r["code"]): r["n"] for r in sums.collect()}


def _result(n_words: list[int], spans: dict[int, list[tuple[int, int]]], items: dict[int, set[str]]) -> pa.Array:
    rows = [{"n_words": c, "spans": _merged(spans[n]) if n in spans else [], "items": sorted(items[n]) if n in items else []} for n, c in enumerate(n_words)]
    return pa.array(rows, _RESULT)


def _search(docs: DataFrame, text: str, into: str, block: Block) -> DataFrame:
    """One pass over the documents with a block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for part, texts in chunks(batch, text):
                counts, found = block.find(texts)
                spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
                items: dict[int, set[str]] = defaultdict(set)
                for n, w, start, end in found:
                    spans[n].append((start, end))
                    items[n].update(block.items[w])
                yield part.append_column(pa.field(into, _RESULT), _result(counts.tolist(), spans, items))

    return docs.mapInArrow(search, T.StructType([*docs.schema.fields, T.StructField(into, RESULT)]))


def _joined(docs: DataFrame, text: str, into: str, found: DataFrame, window: int) -> DataFrame:
    """The documents joined with what stands in their texts; equal texts are one key, dealt to shares by their other
    columns if many rows have them."""
    key, share, spans, items = (free_name(docs.withColumn(into, F.lit(None)), x) for x in ("text_key", "text_share", "text_spans", "text_items"))
    keyed = docs.withColumn(key, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    hits = materialise(occurring(keyed, key, text, found, SHINGLE, window, lambda t: t.translate(_WORD_BYTES)), "occurrences")
    copies = keyed.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    hot = materialise(copies.select("key", shares_of("n", docs.count()).alias("shares")).filter("shares > 1"), "hot-texts")
    where = hits.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias(spans))
    named = hits.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(F.collect_set("item").alias(items))
    each = where.join(named, "key").join(F.broadcast(hot), "key", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
    each = each.select(F.col("key").alias(key), F.col("share").alias(share), spans, items)
    few = F.broadcast(hot.select(F.col("key").alias(key), F.col("shares").alias(share)))
    spread = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, T.AtomicType)))
    dealt = keyed.join(few, key, "left").withColumn(share, F.coalesce(F.pmod(spread, F.col(share)), F.lit(0)).cast("int"))
    rows = dealt.join(each, [key, share], "left").select(*(F.col(f"`{c}`") for c in docs.columns), spans, items)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, text):
                spans = {n: [(x["start"], x["end"]) for x in v] for n, v in enumerate(part.column(part.num_columns - 2).to_pylist()) if v}
                items = {n: set(v) for n, v in enumerate(part.column(part.num_columns - 1).to_pylist()) if v}
                found = _result([len(words_of(t)) for t in texts], spans, items)
                yield part.select(list(range(part.num_columns - 2))).append_column(pa.field(into, _RESULT), found)

    return rows.mapInArrow(finish, T.StructType([*docs.schema.fields, T.StructField(into, RESULT)]))


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def n_hit(result: str):  # noqa: ANN201
    """Words in the spans of a result column."""
    spans = F.col(f"{result}.spans")
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The rows of ``docs`` in which no window of a benchmark item occurs, unchanged."""
    name = free_name(docs, "contamination")
    return contamination(docs, benchmark, into=name, **options).filter(F.size(f"{name}.items") == 0).drop(name)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = contamination(docs, table(spark, sf_dir, "benchmark"), into="x")
    return x.select("doc_id", F.col("x.n_words").alias("n_words"), n_hit("x").alias("n_hit"), F.size("x.items").cast("long").alias("n_items"), F.sha2(F.array_join("x.items", ","), 256).alias("items_sha256"), (n_hit("x") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT row, n, unnest(range(1, len(ws) - n + 2)) AS p, ws FROM w, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n),
o AS (SELECT row, p, d.n, item FROM (SELECT row, n, p, array_to_string(ws[p : p + n - 1], ' ') AS win FROM d) AS d JOIN i ON d.n = i.n AND d.win = i.win),
h AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + n)) AS q FROM o) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM o) GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (row) LEFT JOIN t USING (row)
"""
