"""Bounded samples of labelled rows, the same at every size and on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free_name


def lowest_hashes(rows: DataFrame, label: str, place: list[str | Column], most: int) -> DataFrame:
    """About ``most`` rows of each label that is not null, those of the lowest 63-bit hashes of their place; all of a label
    that has no more. The row of a label's lowest hash is always in, so no label that a row has is lost. The labels are
    taken to be few, since their bounds are broadcast."""
    h, count, least, limit = (free_name(rows, c) for c in ("h", "count", "least", "limit"))
    hashed = rows.filter(F.col(label).isNotNull()).withColumn(h, F.shiftrightunsigned(F.xxhash64(*place), 1))
    bounds = hashed.groupBy(label).agg(F.count(F.lit(1)).alias(count), F.min(h).alias(least))
    share = F.when(F.col(count) <= most, F.lit(2**63 - 1)).otherwise((F.lit(float(2**63 - 1024)) * most / F.col(count)).cast("long"))
    bounds = bounds.select(label, F.greatest(F.col(least), share).alias(limit))
    return hashed.join(F.broadcast(bounds), label).filter(F.col(h) <= F.col(limit)).select(*rows.columns)
