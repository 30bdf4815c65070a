"""Sets of whole-number intervals by key, as one sweep over their ends; no key's intervals need to fit into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a key that are swept together. An interval is cut at its multiples, so it gives a row for each.
STRETCH = 4_096


def stretches(start: Column, end: Column, size: int = STRETCH) -> Column:
    """The numbers of the stretches that an interval has a part in; none if it is empty."""
    return F.when(start <= end, F.sequence(F.floor(start / size), F.floor(end / size)))


def _ends(rows: DataFrame, on: list[str], start: str, end: str, size: int, mark: Column) -> DataFrame:
    """(on, stretch, at, ...): +1 where a part of an interval begins and -1 behind its end."""
    parts = rows.select(*on, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e")).withColumn("_k", F.explode(stretches(F.col("_s"), F.col("_e"), size)))
    lo, hi = F.greatest("_s", F.col("_k") * size), F.least("_e", F.col("_k") * size + size - 1)
    each = F.inline(F.array(F.struct(lo.alias("_at"), F.lit(1).alias("_n")), F.struct((hi + 1).alias("_at"), F.lit(-1).alias("_n"))))
    return parts.select(*on, "_k", each).select(*on, "_k", "_at", F.when(mark, F.col("_n")).otherwise(0).alias("_in"), F.when(mark, 0).otherwise(F.col("_n")).alias("_out"))


def subtract(ranges: DataFrame, spans: DataFrame, on: list[str], a: str = "a", b: str = "b", start: str = "start", end: str = "end", size: int = STRETCH) -> DataFrame:
    """(on, a, b): what no span of the same key covers of the ranges, as disjoint intervals, cut at multiples of ``size``.

    Both sides' ends are added up by place before they are swept, so repeated intervals cost one row; null bounds and
    empty intervals have no part.
    """
    both = _ends(ranges, on, a, b, size, F.lit(True)).unionByName(_ends(spans, on, start, end, size, F.lit(False)))
    places = both.groupBy(*on, "_k", "_at").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    sweep = Window.partitionBy(*on, "_k").orderBy("_at")
    so_far = sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = places.select(*on, "_k", F.col("_at").alias(a), (F.lead("_at").over(sweep) - 1).alias(b), F.sum("_in").over(so_far).alias("_in"), F.sum("_out").over(so_far).alias("_out"))
    bare = rows.withColumn("_bare", (F.col("_in") > 0) & (F.col("_out") == 0) & F.col(b).isNotNull())
    first = bare.withColumn("_first", F.col("_bare") & ~F.coalesce(F.lag("_bare").over(Window.partitionBy(*on, "_k").orderBy(a)), F.lit(False)))
    runs = first.withColumn("_run", F.count_if("_first").over(Window.partitionBy(*on, "_k").orderBy(a).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.filter("_bare").groupBy(*on, "_k", "_run").agg(F.min(a).alias(a), F.max(b).alias(b)).select(*on, a, b)


def holding(points: DataFrame, spans: DataFrame, on: list[str], point: str, start: str, end: str, size: int = STRETCH) -> DataFrame:
    """``points`` that a span of the same key holds, once each."""
    parts = spans.select(*on, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"), F.explode(stretches(F.col(start), F.col(end), size)).alias("_k"))
    rows = points.withColumn("_k", F.floor(F.col(point) / size))
    return rows.join(parts, (F.col(point) >= F.col("_s")) & (F.col(point) <= F.col("_e")) & (rows["_k"] == parts["_k"]) & _same(rows, parts, on), "left_semi").drop("_k")


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    out = F.lit(True)
    for c in on:
        out = out & (left[c] == right[c])
    return out


def meeting(rows: DataFrame, ranges: DataFrame, on: list[str], key: list[str], start: str, end: str, a: str = "a", b: str = "b", size: int = STRETCH) -> DataFrame:
    """(on, key): the rows whose [start, end] meets a range of the same ``on``, which with ``key`` names a row. They meet by
    stretch, so a key with most of the ranges is many tasks'."""
    parts = rows.select(*on, *key, F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(stretches(F.col(start), F.col(end), size)).alias("_k"))
    other = ranges.select(*on, F.col(a).alias("_a"), F.col(b).alias("_b"), F.explode(stretches(F.col(a), F.col(b), size)).alias("_k")).distinct()
    return parts.join(other, (F.col("_a") <= F.col("_e")) & (F.col("_s") <= F.col("_b")) & (parts["_k"] == other["_k"]) & _same(parts, other, on), "left_semi").select(*on, *key).distinct()
