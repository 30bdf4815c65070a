"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum over all
of its segmentations into pieces, by the forward algorithm; a text's likelihood is the product over its words. Piece
probabilities are fitted by expectation maximisation (expected piece counts over all segmentations) on word counts of
a bounded sample of labelled rows. The vocabulary's file is a parameter; nothing of it is in the repository.

Words are runs of letters of any length, in lower case. The forward sum of a word looks back over the longest piece only, so
a text of any kind costs time in proportion to its length. The fit leaves out runs of more than ``FIT_LETTERS``. Scoring is
one map-only pass over whole texts; a task keeps a bounded cache of the likelihoods of words of up to that length.

A score is the posterior of the language among those learned, times how typical the text is of it: 1 if a letter of the
text is on average as likely as in the learned rows of that language or up to ``SLACK`` nats less, and falling
exponentially beyond. A short text counts as having ``PRIOR_LETTERS`` typical letters more.

Defined cases: a null text, or one without letters, is ``und`` with score 0; with no labelled rows everything is
``und``; rows with a null language are not learned from; a null key counts as the empty string in the split; repeated
rows are predicted alike; an empty table gives an empty result. Input columns named as the two results are replaced, all
other columns stay as they are.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import lowest_hashes
from .tables import table
from .wordhash import chunks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The fit takes about so many labelled rows of each language, chosen by a hash of the key.
FIT_ROWS = 1_500
ROUNDS = 2
SMOOTHING = 0.1
CACHE_WORDS = 300_000
SPACE = "▁"
#: Multiplier of the hashes that pieces are looked up by.
_BASE = np.uint64(0x9E3779B97F4A7C15)
UNDETERMINED = "und"
FIT_LETTERS = 64
_LETTERS = re.compile(r"[^\W\d_]+")
#: See the score above.
SLACK = 0.7
PRIOR_LETTERS = 50


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def load_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = (model.id_to_piece(n) for n in range(model.get_piece_size()) if not (model.is_control(n) or model.is_unknown(n) or model.is_byte(n)))
    return sorted({p for p in known if p == p.lower() and _LETTERS.fullmatch(p.removeprefix(SPACE) or "a")})


class Lattice:
    """Piece ids of all substrings of words: id 0 is no piece, id 1 an unknown character, then the pieces.

    Substrings are looked up by 64-bit polynomial hashes, for many words at once; one that no piece begins with is not
    made longer.
    """

    def __init__(self, pieces: list[str]):
        self.ids = {p: n + 2 for n, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        begins: dict[int, int] = {0: 0}
        for p, number in self.ids.items():
            h = 1
            for k, c in enumerate(p, 1):
                h = (h * int(_BASE) + ord(c) + 1) % 2**64
                begins[h] = number if k == len(p) else begins.get(h, 0)
        self.keys = np.array(sorted(begins), dtype=np.uint64)
        self.values = np.array([begins[h] for h in self.keys.tolist()], dtype=np.int32)

    def edges(self, words: list[str]) -> np.ndarray:
        """ids[word, begin, length - 1] for words of one length (with the mark in front)."""
        n = len(words[0]) + 1
        width = min(n, self.longest)
        codes = np.frombuffer("".join(SPACE + w for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        out = np.zeros((len(codes), width), dtype=np.int32)
        start, room = np.arange(len(codes)), np.tile(np.arange(n, 0, -1), len(words))
        h = np.ones(len(codes), dtype=np.uint64)
        for k in range(width):
            inside = room > k
            start, room, h = start[inside], room[inside], h[inside] * _BASE + codes[start[inside] + k]
            place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            known = self.keys[place] == h
            start, room, h = start[known], room[known], h[known]
            out[start, k] = self.values[place[known]]
        out[:, 0] = np.maximum(out[:, 0], 1)
        return out.reshape(len(words), n, width)


def forward(edges: np.ndarray, probability: np.ndarray) -> Iterator[np.ndarray]:
    """Logarithms of the sums over all segmentations up to each place [word, language], one place after another."""
    count, n, width = edges.shape
    recent = np.full((width, count, probability.shape[1]), -np.inf)  # of the last places, the latest first
    recent[0] = 0.0
    yield recent[0].copy()
    for j in range(1, n + 1):
        most = min(j, width)
        ending = edges[:, np.arange(j - 1, j - most - 1, -1), np.arange(most)]  # pieces of 1, 2, ... letters that end here
        total = (np.exp(recent[:most] - recent[0]) * probability[ending.T]).sum(axis=0)
        now = recent[0] + np.log(total)
        recent[1:] = recent[:-1].copy()
        recent[0] = now
        yield now


def word_likelihoods(words: list[str], lattice: Lattice, probability: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language."""
    out = np.zeros((len(words), probability.shape[1]))
    for some in _by_length(words):
        for now in forward(lattice.edges([words[n] for n in some]), probability):
            pass
        out[some] = now
    return out


def expected_counts(words: list[str], counts: np.ndarray, lattice: Lattice, probability: np.ndarray) -> tuple[np.ndarray, float]:
    """(expected uses of each piece over all segmentations, log-likelihood of all words); probability has one language."""
    out, total = np.zeros(len(probability)), 0.0
    for some in _by_length(words):
        edges = lattice.edges([words[n] for n in some])
        logs = list(forward(edges, probability))
        total += float(logs[-1][:, 0] @ counts[some])
        _, n, width = edges.shape
        back = [None] * n + [np.zeros_like(logs[0])]
        for i in range(n - 1, -1, -1):
            terms = [np.log(np.maximum(probability[edges[:, i, j - i - 1]], 1e-300)) + back[j] for j in range(i + 1, min(n, i + width) + 1)]
            back[i] = functools.reduce(np.logaddexp, terms)
        for i in range(n):
            for j in range(i + 1, min(n, i + width) + 1):
                piece = edges[:, i, j - i - 1]
                use = np.exp(logs[i] + np.log(np.maximum(probability[piece], 1e-300)) + back[j] - logs[-1])[:, 0]
                np.add.at(out, piece, np.where(piece > 0, use * counts[some], 0.0))
    return out, total


def _by_length(words: list[str], most: int = 4_000) -> Iterator[np.ndarray]:
    """Places of words of equal length, so many characters at a time that arrays stay small."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(group):
            step = max(1, most * 8 // (int(lengths[group[0]]) + 1))
            yield from (group[n : n + step] for n in range(0, len(group), step))


@dataclass
class Model:
    languages: list[str]
    lattice: Lattice
    probability: np.ndarray  # piece id, language
    typical: np.ndarray  # mean log-likelihood of a letter in the learned rows of each language
    cache: dict[str, int] = field(default_factory=dict)
    known: list[np.ndarray] = field(default_factory=list)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        n = len(self.languages)
        words: list[str] = []
        counts, letters = [], []
        for t in texts:
            ws = words_of(t.decode(errors="replace"))
            counts.append(len(ws))
            letters.append(sum(map(len, ws)))
            words += ws
        if not n or not words:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if self.known and len(self.known[0]) > CACHE_WORDS:
            self.cache.clear()
            self.known.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in self.cache]
        if fresh:
            base = len(self.known[0]) if self.known else 0
            self.cache.update((w, base + k) for k, w in enumerate(fresh))
            self.known.append(word_likelihoods(fresh, self.lattice, self.probability))
            self.known[:] = [np.concatenate(self.known)]
        each = self.known[0][np.fromiter(map(self.cache.__getitem__, words), dtype=np.int64, count=len(words))]
        for w in fresh:
            if len(w) > FIT_LETTERS:  # a long run seldom comes again
                del self.cache[w]
        ends = np.cumsum(counts)
        total = np.concatenate([np.zeros((1, n)), np.cumsum(each, axis=0)])
        likelihood = total[ends] - total[ends - counts]
        share = np.exp(likelihood - likelihood.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        row = np.arange(len(texts))
        mean = (likelihood[row, best] + PRIOR_LETTERS * self.typical[best]) / (np.array(letters) + PRIOR_LETTERS)
        score = share[row, best] * np.exp(np.minimum(0.0, mean - self.typical[best] + SLACK))
        return [self.languages[b] if c else UNDETERMINED for b, c in zip(best, counts)], np.where(np.array(counts) > 0, score, 0.0).tolist()


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """Fit on about ``fit_rows`` of the rows of each language, chosen by a hash of the key; each language adds a column
    to the model, so they are taken to be few."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sample = lowest_hashes(rows, "lang", ["key"], fit_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                for w in words_of(text):
                    if len(w) <= FIT_LETTERS:
                        found[lang, w] = found.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    words = sample.select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    pieces = load_pieces(vocabulary)
    lattice = Lattice(pieces)
    probability = np.full((len(pieces) + 2, len(languages)), 1.0 / (len(pieces) + 1))
    probability[0] = 0.0
    typical = np.zeros(len(languages))
    letters = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum(F.length("word") * F.col("n")).alias("n")).collect()}
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((lattice, probability, languages))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, probability, languages = shared.value
            sums, likelihood = np.zeros_like(probability), np.zeros(len(languages))
            for batch in batches:
                lang, word, n = (np.array(c.to_pylist(), dtype=object) for c in batch.columns)
                for k, name in enumerate(languages):
                    some = np.flatnonzero(lang == name)
                    if len(some):
                        uses, total = expected_counts(word[some].tolist(), n[some].astype(np.float64), lattice, probability[:, k : k + 1])
                        sums[:, k] += uses
                        likelihood[k] += total
            sums[0] = likelihood  # no piece has the number 0
            piece, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(sums[piece, k])], names=["piece", "lang", "n"])

        counts = np.zeros_like(probability)
        for r in words.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():
            counts[r["piece"], r["lang"]] = r["n"]
        typical = np.array([counts[0, k] / letters[name] for k, name in enumerate(languages)])
        counts[0] = 0.0
        probability = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * (len(pieces) + 1))
        probability[0] = 0.0
    words.unpersist()
    return Model(languages, lattice, probability, typical)


def identify(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns, the language and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*(c for c in docs.columns if c == text or c not in (lang_pred, score)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, texts in chunks(batch, text):
                langs, scores = model.predict(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, lang_pred, score])

    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
