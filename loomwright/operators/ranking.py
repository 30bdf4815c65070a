"""Ranks, capped top lists, budgets and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def view_ranks(rows: DataFrame, view: str, score: Column, position: str) -> DataFrame:
    """``rows`` with unique ranks in each view: by score downwards, then position. A view of any size is dealt by ranges."""
    return numbered(rows, score.desc(), F.col(position), within=view).withColumn("rank", F.col("number").cast("int")).drop("number")


def capped_top(rows: DataFrame, view: str, score: Column, position: str, top_n: int, top_fraction: float) -> DataFrame:
    """The best of each view: ``top_n`` at most, and at most the fraction of the view's rows, rounded up.

    The literal bound beside the counted one lets Spark cut each group before the exchange.
    """
    counts = rows.groupBy(view).agg(F.least(F.lit(top_n), F.ceil(F.lit(top_fraction) * F.count(F.lit(1)))).alias("cap"))
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy(view).orderBy(score.desc(), F.col(position)))).filter(F.col("rank") <= top_n)
    return best.join(counts, view).filter("rank <= cap").drop("cap")


def within_budget(rows: DataFrame, position: str, cost: int, budget: int) -> DataFrame:
    """The first rows whose equal costs fit the budget; a row is taken whole or not. A budget of any size is dealt by ranges."""
    return numbered(rows, position).filter(F.col("number") <= budget // cost).drop("number")


def numbered(rows: DataFrame, *order: str | Column, within: str | None = None) -> DataFrame:
    """``rows`` with number from 1 in a global order, or in that of each group ``within``: ranges are counted, and rows
    numbered inside their range, so no group is one task's."""
    group = F.lit(0) if within is None else F.col(within)
    ranged = cut(rows.withColumn("_group", group).repartitionByRange("_group", *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = ranged.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part", "_group").orderBy(*order))
    joined = ranged.withColumn("_row", inside).join(starts, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.select(*rows.columns, (F.col("_start") + F.col("_row")).cast("long").alias("number"))


def batches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """``rows`` with batch from 0: so many rows in order at a time."""
    return numbered(rows, *order).withColumn("batch", F.floor((F.col("number") - 1) / size).cast("long"))


def max_cap(rows: DataFrame, selected: str, forced: str, key: str, position: str, most: int) -> DataFrame:
    """``rows`` with selected cut down to ``most``: lowest keys go first, of equal keys later positions; forced rows stay."""
    open_ = F.col(selected) & ~F.col(forced)
    over = rows.agg((F.count_if(selected) - most).alias("_over"))  # one row
    return _first(rows, open_, over, "capped", F.col(key), F.col(position).desc()).withColumn(selected, F.col(selected) & ~F.col("capped"))


def min_pad(rows: DataFrame, selected: str, key: str, position: str, least: int | Column) -> DataFrame:
    """``rows`` with selected filled up to ``least`` (a number, or an aggregate of the rows): highest keys first, of equal keys earlier positions."""
    short = rows.agg((least - F.count_if(selected)).alias("_over"))  # one row
    return _first(rows, ~F.col(selected), short, "padded", F.col(key).desc(), F.col(position)).withColumn(selected, F.col(selected) | F.col("padded"))


def _first(rows: DataFrame, some: Column, bound: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with a flag on the first of ``some`` in an order, as many as the one row of ``bound`` says."""
    known = F.coalesce(some, F.lit(False))
    flagged = numbered(rows.filter(known), *order).crossJoin(F.broadcast(bound)).withColumn(name, F.col("number") <= F.col("_over"))
    return flagged.drop("number", "_over").unionByName(rows.filter(~known).withColumn(name, F.lit(False)))
