"""A stream of judge answers: the last answer of each question holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(lines: DataFrame) -> DataFrame:
    """(qkey, score, at) from (value, at): ``key score`` lines, malformed ones skipped."""
    parts = lines.select(F.split("value", " ", 2).alias("p"), "at").filter(F.size("p") == 2)
    return parts.select(F.col("p")[0].alias("qkey"), F.expr("try_cast(p[1] AS double)").alias("score"), "at").filter("score IS NOT NULL")


def latest(answers: DataFrame) -> DataFrame:
    """(qkey, score) with the last ``at``; as a stream, in complete or update mode."""
    return answers.groupBy("qkey").agg(F.max_by("score", "at").alias("score"))


def first_in_window(answers: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Answers without repeats of a key inside the watermark's delay."""
    return answers.withWatermark("at", delay).dropDuplicatesWithinWatermark(["qkey"])
