"""A join that no hot key brings to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot; so there are fewer hot keys than this, and they are broadcast.
HOT_PARTS = 2_000


def spread_join(rows: DataFrame, unique: DataFrame, on: list[str], members: str = "members", hot_parts: int = HOT_PARTS) -> DataFrame:
    """``rows`` joined with ``unique``, which has each key once and, as ``members``, how many of the rows have it.

    Rows of hot keys meet them where they are; only the others are shuffled by key. ``members`` is dropped.
    """
    total = unique.agg(F.sum(members)).first()[0] or 0
    hot = F.col(members) > total / hot_parts
    few = F.broadcast(unique.filter(hot).drop(members))
    cold = rows.join(few.select(*on), on, "left_anti").join(unique.filter(~hot).drop(members), on)
    return rows.join(few, on).unionByName(cold)
