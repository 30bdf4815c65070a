"""Reading of the tables that the queries of this subpackage use, and names and keys of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def integer_key(df: DataFrame, key: str) -> None:
    """Refuse a key that is not a whole number, before anything runs."""
    if not isinstance(df.schema[key].dataType, (T.IntegralType, T.NullType)):
        raise TypeError(f"{key} must be an integer column, not {df.schema[key].dataType.simpleString()}; number the rows first")
