"""Which tests a change can touch, by a table of what each test executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_functions(hits: DataFrame, changed: DataFrame, test: str, function: str) -> DataFrame:
    """(test, n_hit): changed functions that each test executed; tests without any are absent."""
    near = hits.join(changed.select(function).distinct(), function, "left_semi")
    return near.groupBy(test).agg(F.count_distinct(function).alias("n_hit"))


def gate(tests: DataFrame, hits: DataFrame, changed: DataFrame, test: str, function: str, exempt: Column) -> DataFrame:
    """``tests`` with n_hit and gated. Null: coverage is unknown, which never gates; 0: known and not touched."""
    known = hits.groupBy(test).agg(F.lit(0).alias("_none"))
    found = hit_functions(hits, changed, test, function)
    rows = tests.join(known, test, "left").join(found, test, "left").withColumn("n_hit", F.coalesce("n_hit", "_none").cast("long")).drop("_none")
    return rows.withColumn("gated", F.coalesce(F.col("n_hit") == 0, F.lit(False)) & ~exempt)
