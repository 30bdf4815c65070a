"""Substring deduplication with repeated-phrase automata.

A window of consecutive words is removed from a document if the same words also start in a document with a smaller id.

1. Candidates: every window is named by its smallest phrase hash (a phrase is ``PHRASE`` words), so equal windows
   have equal names and only about one word in twenty gives a row. Names that two documents share recur.
2. Confirmation: the stretches of text under recurring names are cut out, and their windows are counted by name and 80
   bits of BLAKE2b of their words, joined by single spaces. A window of two documents is confirmed, with the first that
   has it.
3. Automata: the phrases of confirmed windows are sharded by the document they first stand in, so a copy meets few
   shards; a document of many windows is dealt to several. Each shard compiles an Aho-Corasick automaton over word
   numbers; the stretches stream through the shards that hold their phrases, every occurrence is located, and the windows
   around it are compared with the confirmed ones.
4. The located windows are merged and taken out of their documents.

Stretches and documents meet in shuffles; names of a hot passage, of which there can be only few, are broadcast to the
rows that have them, so no task gets all of them. A shard holds about ``SHARD_WINDOWS`` windows, and a shard that many
documents need is dealt to as many copies as its words ask for. Nothing else is broadcast or collected but counts.

Words are runs without space, tab and the other ASCII line blanks. 64-bit hashes of words and phrases only lead to
candidates; that two windows are equal is decided by the digest of all their bytes. Names have 48 bits, as they only deal
windows, and shuffles carry many.

Defined cases: a null text has no words; texts shorter than a window stay whole; a null id is neither smaller nor larger
than any other, so such a row stays whole; rows that repeat an id are judged each by its own text and do not remove each
other; a key that is no integer is refused with a TypeError; an empty table gives an empty result. Other columns are
never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import spread_join
from .storage import materialise
from .tables import integer_key, table
from .wordhash import chunks, digests, grams, sliding_min, words

WINDOW = 50
PHRASE = 8
#: Confirmed windows in a shard (some 40 MB with its automaton), and words of the stretches in a copy of a shard.
SHARD_WINDOWS = 500_000
COPY_WORDS = 4_000_000


def _names(hashes: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """The smallest phrase hash of each window."""
    return sliding_min(_phrases(hashes, phrase), window - phrase + 1)


def _phrases(hashes: np.ndarray, phrase: int) -> np.ndarray:
    return grams(hashes, phrase) >> np.uint64(16)


def _texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Slices of a batch with (begin of each row's words, hashes, word starts, word ends, bytes)."""
    for part, texts in chunks(batch, column, 2 << 20):
        doc, hashes, starts, ends, data = words(texts)
        yield part, np.searchsorted(doc, np.arange(len(texts) + 1)), hashes, starts, ends, data


def recurring_names(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(id, names): the window names of each document that another document has too."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, begins, hashes, *_ in _texts(batch):
                ids, found, rows = part.column(0).to_numpy(zero_copy_only=False), [], []
                for n in np.flatnonzero(np.diff(begins) >= window):
                    mine = np.unique(_names(hashes[begins[n] : begins[n + 1]], window, phrase))
                    found.append(mine)
                    rows.append(np.full(len(mine), ids[n], dtype=np.int64))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(rows))], names=["name", "id"])

    each = materialise(docs.filter("id IS NOT NULL").select("id", "text").mapInArrow(names, "name long, id long"), "names")
    seen = each.groupBy("name").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("members"))
    both = materialise(seen.filter("first < last").select("name", "members"), "recurring")
    return spread_join(each, both, ["name"]).groupBy("id").agg(F.collect_set("name").alias("names"))


def stretches(docs: DataFrame, recurring: DataFrame, window: int, phrase: int) -> DataFrame:
    """(id, text_key, start, text): the merged words of the windows with recurring names."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, begins, hashes, starts, ends, data in _texts(batch):
                out = []
                ids, keys, lists = part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3)
                for n in np.flatnonzero(np.diff(begins) >= window):
                    lo, hi = begins[n], begins[n + 1]
                    known = np.array(lists[int(n)].as_py(), dtype=np.int64).view(np.uint64)
                    at = np.flatnonzero(np.isin(_names(hashes[lo:hi], window, phrase), known))
                    for run in np.split(at, np.flatnonzero(np.diff(at) > window) + 1):
                        if len(run):
                            first, last = lo + run[0], lo + run[-1] + window - 1
                            out.append((ids[n], keys[n], int(run[0]), data[starts[first] : ends[last]]))
                if out:
                    i, k, s, t = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(t, pa.binary()).cast(pa.string())], names=["id", "text_key", "start", "text"])

    return docs.join(recurring, "id").select("id", "text", "text_key", "names").mapInArrow(cut, "id long, text_key long, start long, text string")


def confirmed_windows(pieces: DataFrame, window: int, phrase: int) -> DataFrame:
    """(name, hash, hash2, first): windows that two documents have, with the smallest id; a task adds up its own."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, begins, hashes, starts, ends, data in _texts(batch):
                ids = part.column(0).to_numpy()
                name, seen, who = [], [], []
                for n in range(part.num_rows):
                    lo, hi = begins[n], begins[n + 1]
                    name.append(_names(hashes[lo:hi], window, phrase))
                    seen.append(window_digests(starts[lo:hi], ends[lo:hi], data, window))
                    who.append(np.full(len(name[-1]), ids[n]))
                name, who, hash, hash2 = map(np.concatenate, (name, who, *zip(*seen)))
                order = np.lexsort((who, hash2, hash, name))
                name, who, hash, hash2 = (x[order] for x in (name, who, hash, hash2))
                new = np.concatenate([[True], (np.diff(name) != 0) | (np.diff(hash) != 0) | (np.diff(hash2) != 0)])[: len(name)]
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(name)) - 1
                columns = [name[begin].view(np.int64), hash[begin], hash2[begin], who[begin], who[last[: len(begin)]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "hash", "hash2", "low", "high"])

    each = pieces.select("id", "text").mapInArrow(runs, "name long, hash long, hash2 short, low long, high long")
    return each.groupBy("name", "hash", "hash2").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first < last").drop("last")


def window_digests(starts: np.ndarray, ends: np.ndarray, data: bytes, window: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The digest of each window of a text's words (or those at some places), whatever stands between the words."""
    joined = b" ".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist()))
    stop = np.cumsum(ends - starts + 1) - 1
    begin = stop - (ends - starts)
    at = np.arange(max(0, len(starts) - window + 1)) if at is None else at
    return digests(joined, begin[at], stop[at + window - 1])


def phrases(pieces: DataFrame, window: int, phrase: int) -> DataFrame:
    """(id, text_key, start, n_words, name, phrase): the naming phrases of each stretch as word numbers."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, begins, hashes, *_ in _texts(batch):
                rows, names, numbers = [], [], []
                for n in range(part.num_rows):
                    mine = hashes[begins[n] : begins[n + 1]]
                    each, at = np.unique(_phrases(mine, phrase), return_index=True)
                    used = np.isin(each, _names(mine, window, phrase))
                    rows.append(np.full(int(used.sum()), n))
                    names.append(each[used])
                    numbers.append((mine[at[used][:, None] + np.arange(phrase)] >> np.uint64(33)).astype(np.int32).ravel())
                take = pa.array(np.concatenate(rows))
                numbers = np.concatenate(numbers)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(numbers) + 1, phrase), pa.int32()), pa.array(numbers))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(np.diff(begins)).take(take), pa.array(np.concatenate(names).view(np.int64)), lists], names=["id", "text_key", "start", "n_words", "name", "phrase"])

    return pieces.mapInArrow(find, "id long, text_key long, start long, n_words long, name long, phrase array<int>")


class Shard:
    """An automaton over phrases, and the confirmed windows around them."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.ready = False

    def add_phrases(self, names: list[int], numbers: list[list[int]]) -> None:
        for name, number in zip(names, numbers):
            key = tuple(number)
            if self.automaton.exists(key):
                self.automaton.get(key).append(name)
            else:
                self.automaton.add_word(key, [name])

    def add_windows(self, hashes: np.ndarray, hashes2: np.ndarray, firsts: np.ndarray) -> None:
        self.rows.append((hashes, hashes2, firsts))

    def compile(self) -> None:
        if not self.ready:
            self.automaton.make_automaton()
            hashes, hashes2, firsts = map(np.concatenate, zip(*self.rows)) if self.rows else (np.zeros(0, np.int64),) * 3
            order = np.lexsort((hashes2, hashes))
            self.hashes, self.hashes2, self.firsts, self.rows, self.ready = hashes[order], hashes2[order], firsts[order], [], True

    def first_of(self, hash: np.ndarray, hash2: np.ndarray) -> np.ndarray:
        """The first document of each window, the largest number where it is not confirmed."""
        out = np.full(len(hash), np.iinfo(np.int64).max)
        place = np.searchsorted(self.hashes, hash)
        left = np.arange(len(hash))
        while len(left):  # once more only where two windows share the first half of their digests
            left = left[place[left] < len(self.hashes)]
            left = left[self.hashes[place[left]] == hash[left]]
            same = self.hashes2[place[left]] == hash2[left]
            out[left[same]] = self.firsts[place[left[same]]]
            left = left[~same]
            place[left] += 1
        return out

    def locate(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: bytes, id: int, window: int, phrase: int) -> list[int]:
        """Word ranges [start, end, ...] of confirmed windows whose first document is before ``id``."""
        found: set[int] = set()
        for _, names in self.automaton.iter(tuple((hashes >> np.uint64(33)).tolist())):
            found.update(names)
        if not found or not len(self.hashes):
            return []
        name = _names(hashes, window, phrase).view(np.int64)
        at = np.flatnonzero(np.isin(name, np.fromiter(found, dtype=np.int64, count=len(found))))
        at = at[self.first_of(*window_digests(starts, ends, data, window, at)) < id]
        out: list[int] = []
        for run in np.split(at, np.flatnonzero(np.diff(at) > window) + 1):
            if len(run):
                out += [int(run[0]), int(run[-1]) + window]
        return out


def occurrences(pieces: DataFrame, confirmed: DataFrame, shard_windows: int, window: int, phrase: int) -> DataFrame:
    """(id, text_key, spans): word ranges of each document to remove, from the automata of the shards."""
    n_shards = max(1, math.ceil(confirmed.count() / shard_windows))
    names = confirmed.groupBy("name").agg(F.min("first").alias("home"), F.count(F.lit(1)).alias("n"))
    deals = names.groupBy("home").agg(F.ceil(F.sum("n") / shard_windows).alias("deals"))
    shard = F.pmod(F.xxhash64("home", F.pmod(F.xxhash64("name"), F.col("deals"))), F.lit(n_shards)).cast("int")
    homes = names.join(deals, "home").select("name", "home", shard.alias("shard"))
    found = materialise(phrases(pieces, window, phrase), "phrases")
    counts = found.groupBy("name").agg(F.count(F.lit(1)).alias("members"))
    homes = materialise(homes.join(counts, "name"), "homes")
    each = spread_join(found, homes, ["name"])
    routed = materialise(each.filter("id > home").groupBy("id", "text_key", "start", "shard").agg(F.first("n_words").alias("n_words")), "routed")
    size = [F.ceil(F.sum("n_words") / COPY_WORDS).cast("int").alias("copies"), F.count(F.lit(1)).alias("members")]
    copies = materialise(routed.groupBy("shard").agg(*size), "copies")
    dealt = spread_join(routed.drop("n_words"), copies, ["shard"]).withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.col("copies")))
    named = copies.drop("members").join(homes.groupBy("shard").agg(F.count(F.lit(1)).alias("members")), "shard")
    homes = materialise(spread_join(homes.select("name", "shard"), materialise(named, "named"), ["shard"]), "homes")
    unit = lambda salt: F.concat_ws("/", "shard", salt)
    every = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")
    empty = {"id": "long", "text_key": "long", "start": "long", "name": "long", "hash": "long", "hash2": "short", "phrase": "array<int>", "text": "string"}
    shape = lambda df, kind: df.select("unit", F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()))
    seeds = found.groupBy("name").agg(F.first("phrase").alias("phrase")).join(homes, "name").select("*", every).withColumn("unit", unit("salt"))
    windows = confirmed.join(homes, "name").select("*", every).withColumn("unit", unit("salt")).withColumnRenamed("first", "id").drop("name")
    hay = pieces.join(dealt.withColumn("unit", unit("salt")), ["id", "text_key", "start"])
    rows = shape(seeds, 0).unionByName(shape(windows, 1)).unionByName(shape(hay, 2)).repartition("unit").sortWithinPartitions("unit", "kind")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard = None, Shard()
        for batch in batches:
            units, kinds = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
            change = np.flatnonzero((units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *change], [*change, len(units)]):
                if hi <= lo:
                    continue
                part, kind = batch.slice(lo, hi - lo), kinds[lo]
                if units[lo] != current:
                    current, shard = units[lo], Shard()
                if kind == 0:
                    shard.add_phrases(part.column("name").to_pylist(), part.column("phrase").to_pylist())
                elif kind == 1:
                    shard.add_windows(*(part.column(c).to_numpy() for c in ("hash", "hash2", "id")))
                else:
                    shard.compile()
                    yield from search(part, shard)

    def search(batch: pa.RecordBatch, shard: Shard) -> Iterator[pa.RecordBatch]:
        for part, begins, hashes, starts, ends, data in _texts(batch):
            ids, out = part.column("id").to_pylist(), []
            shift = part.column("start").to_pylist()
            for n, (lo, hi) in enumerate(zip(begins, begins[1:])):
                spans = shard.locate(hashes[lo:hi], starts[lo:hi], ends[lo:hi], data, ids[n], window, phrase)
                out.append([x + shift[n] for x in spans])
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_key"), pa.array(out, pa.list_(pa.int64()))], names=["id", "text_key", "spans"])

    located = rows.mapInArrow(stream, "id long, text_key long, spans array<long>").filter(F.size("spans") > 0)
    return located.groupBy("id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """(key, n_words, n_removed, kept): each document's words without those under windows that an earlier document
    has, joined by single spaces. Windows are judged on the input."""
    integer_key(docs, key)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    pieces = materialise(stretches(rows, recurring_names(rows, window, phrase), window, phrase), "stretches")
    confirmed = materialise(confirmed_windows(pieces, window, phrase), "windows")
    marked = rows.join(occurrences(pieces, confirmed, shard_windows, window, phrase), ["id", "text_key"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                counts, removed, kept = [], [], []
                for t, spans in zip(texts, part.column("spans").to_pylist()):
                    ws = t.split()  # of bytes: at the same blanks
                    counts.append(len(ws))
                    if spans:
                        keep = np.ones(len(ws), dtype=bool)
                        for lo, hi in zip(spans[::2], spans[1::2]):
                            keep[lo:hi] = False
                        ws = [ws[n] for n in np.flatnonzero(keep)]
                    removed.append(counts[-1] - len(ws))
                    kept.append(b" ".join(ws))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[key, "n_words", "n_removed", "kept"])

    return marked.select("id", "text", "spans").mapInArrow(cut, f"`{key}` long, n_words long, n_removed long, kept string")


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT row, doc_id, i, sha256(array_to_string(ws[i : i + 49], ' ')) AS win FROM (SELECT row, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT win, min(doc_id) AS first FROM p GROUP BY win),
h AS (SELECT DISTINCT row, unnest(range(i, i + 50)) AS q FROM p JOIN f USING (win) WHERE first < doc_id),
k AS (SELECT w.row, count(*) FILTER (h.q IS NOT NULL) AS n_removed, string_agg(x.word, ' ' ORDER BY x.q) FILTER (h.q IS NULL) AS kept
  FROM w, LATERAL (SELECT unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q) AS x LEFT JOIN h ON h.row = w.row AND h.q = x.q GROUP BY w.row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (row)
"""
