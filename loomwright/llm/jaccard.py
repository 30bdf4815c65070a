"""N-gram Jaccard join with several global token orders.

A document's set is its distinct shingles of ``SHINGLE`` words. Two sets that are similar enough share a token in their
prefixes under every global order of all tokens, so candidates must do so under several orders before any text is read.

1. The first order is rarity, counted over all documents on a hashed share of the token universe (which comes before
   the rest; a set with too few such tokens goes on in hash order, so its prefix is always whole). A token that only
   one set has cannot be shared, so most sets drop out here. Documents with the same words in lower case are one class.
2. The second order is rarity over the whole universe, counted over the classes that are left. Classes that share a
   prefix token, with fitting lengths and positions, are candidates. In rounds of stars every class is held against the
   leader that most of its tokens name, found by aggregation: no pairs inside a group. Classes that are linked by then
   need no more pairs among themselves; a last round takes all candidates across components, and a token that gives many
   is salted into shares of about ``SHARE_PAIRS`` pairs.
3. The further orders (``ORDERS``) are hash orders. Each class keeps its prefixes under them as a column; candidates
   whose prefixes have nothing in common under one of them fall before their texts are joined.
4. What is left is verified on the whole texts: shingles are compared as words.
5. Components grow by minimum labels with pointer jumping, in written tables.

Tokens are 64-bit hashes that only find candidates, and a set's size counts its shingles as words. Classes are told apart
by 128 bits of BLAKE2b of their words; the first order carries half of it and is skipped if two classes of one size share
that half. A hot class or token is never brought to one task whole. Nothing is broadcast or collected but counts and the
few hot classes of ``spread_join``.

Defined cases: a null or empty text has an empty set and is linked with nothing (its own component); with fewer words
than a shingle the whole sequence is one token; equal texts, repeated rows and repeated ids are members of one class; a
null id is never a component's id unless all its rows have none; a key that is no integer is refused with a TypeError; an
empty table gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .skew import spread_join
from .storage import materialise
from .tables import free_name, integer_key, table
from .wordhash import LOWER, chunks, distinct_grams, exact_ids, grams, mix, words

SHINGLE = 5
PERCENT = 75
#: Hashed share of the token universe whose rarity is counted first; above 1 - PERCENT / 100.
COUNTED = 0.3
#: Hash orders that candidates must also pass before verification.
ORDERS = 1
STAR_ROUNDS = 2
#: A token with more rows than this in a task is passed on as it streams, with this as its count.
LONG_RUN = 1 << 20
#: Candidate pairs of a token in one task.
SHARE_PAIRS = 1 << 20


def word_hashes(texts: list[bytes], exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in lower case, begin of each text's); with ``exact`` no two words share a number."""
    doc, hashes, starts, ends, data = words([t.translate(LOWER) for t in texts])
    return exact_ids(hashes, starts, ends, data) if exact else hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def token_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct token hashes of each text."""
    hashes, begins = word_hashes(texts)
    return [np.unique(grams(hashes[lo:hi], min(shingle, hi - lo))) if hi > lo else hashes[:0] for lo, hi in zip(begins, begins[1:])]


def signatures(texts: list[bytes]) -> np.ndarray:
    """128 bits of BLAKE2b of each text's words in lower case, as two signed numbers in a row."""
    each = (hashlib.blake2b(b" ".join(t.translate(LOWER).split()), digest_size=16).digest() for t in texts)
    return np.frombuffer(b"".join(each), dtype="<i8").reshape(-1, 2)


def _order(tokens: np.ndarray, number: int) -> np.ndarray:
    return mix(tokens ^ mix(np.array([number * 0x9E37 + 0xD1B5], dtype=np.uint64)))


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which one must be shared with any set that is similar enough."""
    return n + percent * n // -100 + 1


def row_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, row_key, text_key, n, sig, sig2) of each row of (id, row_key, text_key, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text", 2 << 20):
                ids, begins = word_hashes(texts, exact=True)
                n = [len(distinct_grams(ids[lo:hi], min(shingle, hi - lo))[0]) if hi > lo else 0 for lo, hi in zip(begins, begins[1:])]
                sig = signatures(texts)
                columns = [part.column(0), part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(sig[:, 0]), pa.array(sig[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "row_key", "text_key", "n", "sig", "sig2"])

    return docs.mapInArrow(sets, "id long, row_key long, text_key long, n long, sig long, sig2 long")


def counted_tokens(docs: DataFrame, shingle: int, percent: int, counted: float) -> DataFrame:
    """(token, sig, n, m, tail): the tokens of each set in the counted share (m of them), and, with ``tail``, as many of
    the others in hash order as its prefix still needs. ``docs`` has texts, and perhaps their ``sig``; without it sig is
    half of the text's signature and a task sends equal ones once."""
    limit = np.uint64(int(min(counted, 0.999) * 2**64))
    named = "sig" in docs.columns

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part, texts in chunks(batch, "text", 2 << 20):
                out: list[tuple[np.ndarray, int, int, int, int]] = []
                sigs = part.column(1).to_pylist() if named else signatures(texts)[:, 0].tolist()
                if not named:
                    new = {sig: n for n, sig in reversed(list(enumerate(sigs))) if sig not in seen}
                    if len(seen) < 100_000:
                        seen.update(new)
                    sigs, texts = list(new), [texts[n] for n in new.values()]
                for sig, mine in zip(sigs, token_sets(texts, shingle)):
                    n = len(mine)
                    if not n:
                        continue
                    place = _order(mine, 0)
                    first = mine if counted >= 1 else mine[place < limit]
                    out.append((first, sig, n, len(first), 0))
                    if (more := prefix_length(n, percent) - len(first)) > 0:
                        rest = mine[np.argsort(place, kind="stable")[len(first) : len(first) + more]]
                        out.append((rest, sig, n, len(first), 1))
                if out:
                    sizes = [len(x[0]) for x in out]
                    column = lambda k: pa.array(np.repeat(np.array([x[k] for x in out], dtype=np.int64), sizes))  # noqa: E731, B023
                    columns = [pa.array(np.concatenate([x[0] for x in out]).view(np.int64)), column(1), column(2).cast(pa.int32()), column(3).cast(pa.int32()), column(4).cast(pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names=["token", "sig", "n", "m", "tail"])

    return docs.select("text", *["sig"] * named).mapInArrow(tokens, "token long, sig long, n int, m int, tail boolean")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """``tokens`` that two sets have, each once for a set, with the number of sets as ``df``; sorted runs stream."""
    names = ["token", "sig", "n", "m", "tail", "df"]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        long_run = None

        def emit(t: pa.Table, df: np.ndarray) -> Iterator[pa.RecordBatch]:
            token, sig = t["token"].to_numpy(), t["sig"].to_numpy()
            once = np.concatenate([[True], (np.diff(token) != 0) | (np.diff(sig) != 0)])[: len(token)]
            yield from t.append_column("df", pa.array(df)).filter(pa.array(once & (df > 1))).to_batches()

        def finished(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if t.num_rows:
                token, sig = t["token"].to_numpy(), t["sig"].to_numpy()
                first = np.concatenate([[True], np.diff(token) != 0])
                new = first | np.concatenate([[True], np.diff(sig) != 0])
                run = np.cumsum(first) - 1
                df = np.bincount(run, weights=new).astype(np.int64)[run]
                if long_run is not None:
                    df[token == long_run] = LONG_RUN
                yield from emit(t, df)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            token = held["token"].to_numpy()
            begin = int(np.searchsorted(token, token[-1]))
            yield from finished(held.slice(0, begin))
            held = held.slice(begin)
            if held.num_rows > LONG_RUN:
                long_run = int(token[-1])
                yield from emit(held, np.full(held.num_rows, LONG_RUN))
                held = None
        if held is not None:
            yield from finished(held)

    sorted_runs = tokens.repartition("token").sortWithinPartitions("token", "sig")
    return sorted_runs.mapInArrow(shared, "token long, sig long, n int, m int, tail boolean, df long").select(*names)


def rare_prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """(token, sig, n, alone, pos): the shared tokens in each set's prefix under the order of rarity, their places in
    that order, and how many tokens of the set stand first because no other set has them."""
    own = Window.partitionBy("sig", "n")
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    rows = shared.withColumns({"alone": F.col("m") - F.count_if(~F.col("tail")).over(own), "rank": F.row_number().over(own.orderBy("tail", "df", "token"))})
    rows = rows.withColumn("pos", F.when(F.col("tail"), F.col("m")).otherwise(F.col("alone") + F.col("rank") - 1).cast("int"))
    return rows.filter(F.col("tail") | (F.col("pos") < length)).select("token", "sig", "n", F.col("alone").cast("int").alias("alone"), "pos")


def fitting(prefixes: DataFrame, percent: int) -> DataFrame:
    """(sig, n): the classes that can have a partner by the places of their shared tokens.

    With r = 1 - pos / n, lengths n and c n fit only if c <= k r - 1 for the one side and 1 / c <= k r - 1 for the other
    (k = 1 + 100 / percent), so the product of both sides' k r - 1 is 1 at least.
    """
    k = 1 + 100 / percent
    room = (k * (1 - F.col("pos") / F.col("n")) - 1).alias("room")
    rows = prefixes.select("token", "sig", "n", room)
    ends = {f"{side}_{c}": getattr(F, side)(c) for side in ("min", "max") for c in ("sig", "n")}
    best = rows.groupBy("token").agg(F.max("room").alias("best"), *(v.alias(k) for k, v in ends.items())).filter("min_sig != max_sig OR min_n != max_n")
    return rows.join(best.select("token", "best"), "token").filter(F.col("room") * F.col("best") >= 1 - 1e-9).select("sig", "n").distinct()


def fits(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Lengths, and the tokens from the shared one on, allow enough in common."""
    short, long = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    most = F.least(a["n"] - a["pos"], b["n"] - b["pos"])
    return (100 * short >= percent * long) & ((100 + percent) * most >= percent * (short + long))


def star_pairs(prefixes: DataFrame, labels: DataFrame, number: int, percent: int) -> DataFrame:
    """(a, b): each class with the leader that most of its prefix tokens name, if not yet of one component."""
    rows = prefixes.join(labels, "sig")
    first = F.col("alone") / F.col("n") if number == 0 else F.lit(0.0)  # those with the least of their own are near to most
    leader = F.min_by(F.struct("sig", "n", "pos", "label"), F.struct(first, F.xxhash64("sig", F.lit(number))))
    leaders = rows.groupBy("token").agg(leader.alias("to"))
    ends = lambda x: {k: F.col(f"{x}{k}") for k in ("n", "pos")}
    named = rows.join(leaders, "token").filter((F.col("label") != F.col("to.label")) & fits(ends(""), ends("to."), percent))
    votes = named.groupBy("sig", F.col("to.sig").alias("to")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("sig").agg(F.max_by("to", F.struct("votes", "to")).alias("to"))
    return best.select(F.least("sig", "to").alias("a"), F.greatest("sig", "to").alias("b")).distinct()


def crossing_pairs(prefixes: DataFrame, labels: DataFrame, percent: int, share_pairs: int = SHARE_PAIRS) -> DataFrame:
    """(a, b): all candidates of different components. Of two such classes one at least is outside the largest component
    among a token's classes, so only those outside are held against all: they are copied to each of the token's shares,
    and all are dealt to the shares by hash, so that a share compares about ``share_pairs`` pairs."""
    rows = prefixes.join(labels, "sig")
    parts = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("size"))
    sizes = parts.groupBy("token").agg(F.max_by("label", F.struct("size", "label")).alias("major"), F.sum("size").alias("all"), F.max("size").alias("most"))
    shares = F.ceil(F.col("all") * (F.col("all") - F.col("most")) / share_pairs).cast("int").alias("shares")
    mixed = rows.join(sizes.filter("all > most").select("token", "major", shares), "token")
    outside = mixed.filter("label != major").select("token", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.struct("sig", "n", "pos", "label").alias("x"))
    dealt = mixed.withColumn("share", F.pmod(F.xxhash64("sig"), F.col("shares")).cast("int"))
    ends = lambda x: {k: F.col(f"{x}{k}") for k in ("n", "pos")}
    crossing = outside.join(dealt, ["token", "share"]).filter((F.col("label") != F.col("x.label")) & fits(ends(""), ends("x."), percent))
    return crossing.select(F.least("sig", "x.sig").alias("a"), F.greatest("sig", "x.sig").alias("b")).distinct()


def with_orders(texts: DataFrame, shingle: int, percent: int, orders: int) -> DataFrame:
    """``texts`` (text, sig, sig2) with a number for each as ``sig``, and ``orders``: its prefixes under the hash
    orders, of each token 32 bits."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text", 2 << 20):
                out = []
                for mine in token_sets(texts, shingle):
                    length = prefix_length(len(mine), percent)
                    best = [np.sort(_order(mine, k))[:length] for k in range(1, orders + 1)]
                    out.append([(x >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in best])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["text", "half", "sig2", "orders"])

    found = texts.select("text", "sig", "sig2").mapInArrow(find, "text string, half long, sig2 long, orders array<array<int>>")
    return found.withColumn("sig", F.monotonically_increasing_id())


def common(x: np.ndarray, y: np.ndarray, shingle: int) -> tuple[int, int, int]:
    """(tokens of both, tokens of x, tokens of y) from exact word numbers."""
    k = [min(shingle, len(x)), min(shingle, len(y))]
    (hx, px), (hy, py) = distinct_grams(x, k[0]), distinct_grams(y, k[1])
    if k[0] != k[1] or not k[0]:
        return 0, len(hx), len(hy)
    run = np.arange(k[0])
    both, ix, iy = np.intersect1d(hx, hy, return_indices=True)
    if (np.diff(hx) != 0).all() and (np.diff(hy) != 0).all() and (x[px[ix][:, None] + run] == y[py[iy][:, None] + run]).all():
        return len(both), len(hx), len(hy)
    sets = [set(map(tuple, z[p[:, None] + run].tolist())) for z, p in ((x, px), (y, py))]
    return len(sets[0] & sets[1]), len(sets[0]), len(sets[1])


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the hash orders of ``texts`` (sig, text, orders) and then the comparison of the whole
    sets, shingle by shingle."""
    side = lambda name, what: texts.select(F.col("sig").alias(name), F.col(what).alias(f"{name}_{what}"))
    meet = F.forall(F.arrays_zip("a_orders", "b_orders"), lambda z: F.arrays_overlap(z["a_orders"], z["b_orders"]))
    passing = pairs.join(side("a", "orders"), "a").join(side("b", "orders"), "b").filter(meet).select("a", "b")
    sides = passing.join(side("a", "text"), "a").join(side("b", "text"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, left in chunks(batch, "a_text", 1 << 20):
                right = part.column(part.schema.get_field_index("b_text")).cast(pa.binary()).to_pylist()
                ids, begins = word_hashes(left + right, exact=True)
                texts = [ids[lo:hi] for lo, hi in zip(begins, begins[1:])]
                counts = (common(x, y, shingle) for x, y in zip(texts, texts[len(left) :]))
                keep = [both > 0 and 100 * both >= percent * (n + m - both) for both, n, m in counts]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sides.select("a", "b", "a_text", "b_text").mapInArrow(verify, "a long, b long")


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (sig, label) after links (a, b): the smallest label of each component."""
    of = lambda name, to: labels.select(F.col("sig").alias(name), F.col("label").alias(to))
    edges = links.join(of("a", "x"), "a").join(of("b", "y"), "b").filter("x != y").select("x", "y")
    edges = materialise(edges.union(edges.select("y", "x")).distinct(), "edges")
    roots = edges.select(F.col("x").alias("v")).distinct().withColumn("r", F.col("v"))
    while True:
        near = edges.join(roots.select(F.col("v").alias("y"), "r"), "y").groupBy("x").agg(F.min("r").alias("near"))
        low = roots.join(near, F.col("v") == F.col("x")).select("v", "r", F.least("r", "near").alias("low"))
        jump = low.join(roots.select(F.col("v").alias("low"), F.col("r").alias("beyond")), "low")
        moved = materialise(jump.select("v", F.col("r").alias("old"), F.least("low", "beyond").alias("r")), "roots")
        roots = moved.select("v", "r")
        if moved.filter("old != r").isEmpty():
            break
    return labels.join(roots.withColumnsRenamed({"v": "label", "r": "root"}), "label", "left").select("sig", F.coalesce("root", "label").alias("label"))


def _keyed(docs: DataFrame, key: str, text: str) -> dict[str, Column]:
    """A row's key (its own, or of its text if null) and its text's."""
    shown = F.coalesce(F.col(text), F.lit(""))
    return {"row_key": F.coalesce(F.col(key).cast("long"), F.xxhash64(shown)), "text_key": F.xxhash64(shown)}


def linked_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, counted: float = COUNTED, orders: int = ORDERS, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(id, row_key, text_key, n, component_id, winner) of each row; winner: the keys of the component's first row."""
    integer_key(docs, key)
    rows = docs.select(F.col(key).cast("long").alias("id"), *(v.alias(k) for k, v in _keyed(docs, key, text).items()), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sets = materialise(row_sets(rows, shingle), "sets")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "row_key", "text_key")).alias("winner")
    classes = materialise(sets.filter("n > 0").groupBy("sig", "sig2", "n").agg(F.min("id").alias("least"), first, F.count(F.lit(1)).alias("members")), "classes")
    rare = lambda of, share, name: materialise(rare_prefixes(shared_tokens(counted_tokens(of, shingle, percent, share)), percent), name)
    left = classes
    if classes.groupBy("sig", "n").count().filter("count > 1").isEmpty():
        left = classes.join(fitting(rare(rows.select("text"), counted, "first-prefixes"), percent), ["sig", "n"])
    wanted = left.select("winner.row_key", "winner.text_key", "sig", "sig2")
    texts = rows.select("row_key", "text_key", "text").join(wanted, ["row_key", "text_key"]).dropDuplicates(["sig", "sig2"])
    texts = materialise(with_orders(texts, shingle, percent, orders), "texts")
    prefixes = rare(texts.select("text", "sig"), 1.0, "prefixes")
    labels = materialise(prefixes.select("sig").distinct().withColumn("label", F.col("sig")), "labels")
    for number in range(star_rounds + 1):
        pairs = star_pairs(prefixes, labels, number, percent) if number < star_rounds else crossing_pairs(prefixes, labels, percent)
        links = materialise(verified(pairs, texts, shingle, percent), "links")
        if not links.isEmpty():
            labels = materialise(joined_labels(labels, links), "labels")
    named = labels.join(texts.select("sig", F.col("half"), "sig2"), "sig").select(F.col("half").alias("sig"), "sig2", "label").join(classes, ["sig", "sig2"])
    components = named.groupBy("label").agg(F.min("least").alias("component_id"), F.min("winner").alias("first"))
    linked = named.join(components, "label").select("sig", "sig2", "component_id", "first")
    found = classes.join(linked, ["sig", "sig2"], "left").select("sig", "sig2", "members", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("first", "winner").alias("winner"))
    worded = spread_join(sets.filter("n > 0"), materialise(found, "components"), ["sig", "sig2"]).drop("sig", "sig2")
    alone = sets.filter("n = 0").select("id", "row_key", "text_key", "n", F.col("id").alias("component_id"), F.struct(F.col("id").isNull().alias("unnamed"), "row_key", "text_key").alias("winner"))
    return worded.unionByName(alone)


def similar_components(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:  # noqa: ANN003
    """(key, n_shingles, component_id) of each row: its set's size, and the smallest key that links lead to."""
    return linked_rows(docs, key, **options).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """The rows of ``docs`` that come first in their component, once each; rows without words all stay. Of rows with one
    key and text the first by their other columns (as JSON) stays."""
    row_key, text_key, once = (free_name(docs, x) for x in ("row_key", "text_key", "once"))
    found = linked_rows(docs, key, text, **options).filter("n > 0")
    lost = found.filter("row_key != winner.row_key OR text_key != winner.text_key").select(F.col("row_key").alias(row_key), F.col("text_key").alias(text_key)).distinct()
    keys = _keyed(docs, key, text)
    rows = docs.withColumns({row_key: keys["row_key"], text_key: keys["text_key"]}).join(lost, [row_key, text_key], "left_anti")
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(c) for c in docs.columns if c not in (key, text))))
    number = F.row_number().over(Window.partitionBy(row_key, text_key).orderBy(rest))
    worded = F.length(F.translate(F.coalesce(F.col(text), F.lit("")), "\x20\x09\x0a\x0b\x0c\x0d", "")) > 0
    return rows.withColumn(once, number).filter(~worded | (F.col(once) == 1)).select(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n AS p ON p.doc_id = a.doc_id JOIN n AS q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM w JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id, n.n
"""
