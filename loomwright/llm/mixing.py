"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a mean repetition rate, target rows over actual rows. A uniform number hashed from the seed and the
document's key is put through the inverse of the Poisson distribution with that mean; the document is exploded by
the resulting count. All copies are dealt to partitions by the leading bits of a hashed order key and sorted by it, so the
partitions hold them in one global order. Counts cover all rows.

A rate above ``PIECE`` is split into equal Poisson parts that are drawn from separate hashes and added, so the
distribution's table never underflows and stays short. The table of rates is broadcast while the number of sources is
below a bound; with more, it is joined on the source salted by the key's hash.

Defined cases: a null source is a source of its own with the default weight; a null key hashes as the empty string;
rows with the same key get the same count; a weight of 0 drops its source; an empty table, or weights that are all
0, give an empty result; an input column that is named as a result column is replaced, all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let
from .tables import free_name, table

PIECE = 500.0
#: A source's table has at most about 810 doubles, so the broadcast stays under about 13 MB.
MAX_BROADCAST_SOURCES = 2_000
SALTS = 64


def _uniform(*parts: Column | str) -> Column:
    """52 hashed bits as a double in [0, 1)."""
    text = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_table(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... to where the rest is below 2**-53."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def grow(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.array_append(s["all"], s["c"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, grow)["all"]


def source_rates(docs: DataFrame, source: str, weights: dict[str, float], default_weight: float, target_rows: int | None) -> DataFrame:
    """(_source, _parts, _table) for each source: into how many Poisson parts its rate is split and their table."""
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("_source") == name, F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("w", weight)
    whole = counts.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    target = F.col("all_n").cast("double") if target_rows is None else F.lit(float(target_rows))
    rates = counts.crossJoin(F.broadcast(whole)).filter(F.col("w") > 0).withColumn("rate", F.col("w") / F.col("all_w") * target / F.col("n"))
    rates = rates.withColumn("_parts", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
    return rates.select("_source", "_parts", poisson_table(F.col("rate") / F.col("_parts")).alias("_table"))


def mix_sources(docs: DataFrame, weights: dict[str, float], key: str = "doc_id", source: str = "source", default_weight: float = 1.0, target_rows: int | None = None, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` by their counts, in a global hashed order, with copy (from 1), n_copies, shuffle_key."""
    rates = source_rates(docs, source, weights, default_weight, target_rows)
    kept = [c for c in docs.columns if c not in ("copy", "n_copies", "shuffle_key")]
    keyed, salt = free_name(docs, "key"), free_name(docs, "salt")
    rows = docs.select(*kept, F.coalesce(F.col(key).cast("string"), F.lit("")).alias(keyed))
    own = {c: free_name(docs, c) for c in ("_source", "_parts", "_table", "_salt")}
    rates = rates.withColumnsRenamed(own)
    same = F.col(source).eqNullSafe(F.col(own["_source"]))
    if docs.select(source).distinct().limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        rated = rows.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn(own["_salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = rows.withColumn(salt, F.pmod(F.hash(keyed), F.lit(SALTS))).join(salted, same & (F.col(salt) == F.col(own["_salt"])))
    draw = lambda i: let(_uniform(F.lit(seed), i.cast("string"), F.col(keyed)), lambda u: F.size(F.filter(own["_table"], lambda c: c <= u)))
    drawn = rated.withColumn("n_copies", F.aggregate(F.sequence(F.lit(1), F.col(own["_parts"])), F.lit(0), lambda n, i: n + draw(i)))
    copies = drawn.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    ordered = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col(keyed), F.col("copy").cast("string"))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long")
    return ordered.select(*kept, "copy", "n_copies", "shuffle_key").repartitionById(parts, F.floor(place * parts / F.lit(2**32)).cast("int")).sortWithinPartitions("shuffle_key")


#: Target weights of the query and the pipeline; other sources have weight 1.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5}


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, WEIGHTS)


OP8_SQL = """
WITH RECURSIVE s AS (
  SELECT source, count(*) AS n, CASE source WHEN 'src0' THEN 2.0::DOUBLE WHEN 'src1' THEN 3.0::DOUBLE WHEN 'src2' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM s) * CAST((SELECT sum(n) FROM s) AS DOUBLE) / n AS rate FROM s),
c AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / CAST(k + 1 AS DOUBLE), c + p * rate / CAST(k + 1 AS DOUBLE) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
u AS (SELECT doc_id, source, text, CAST(CAST('0x' || substr(md5('mix:1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
d AS (SELECT u.doc_id, u.source, u.text, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.c <= u.u) AS n_copies FROM u)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, CAST(n_copies AS INTEGER) AS n_copies,
  md5('mix:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM d)
"""
