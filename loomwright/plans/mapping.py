"""A coverage map from profile folders: executed symbols, the regions of objects, and the items of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import item_key, symbol_item
from ..operators.joins import first_wins, innermost, longest_prefix
from ..operators.ranking import numbered
from .coverage import executed_functions


def symbol_items(regions: DataFrame, items: DataFrame, packages: DataFrame, target: str | None = None) -> DataFrame:
    """(symbol, seq, file, key, start, end): what each symbol of the workspace stands for.

    regions(symbol, readable, file, start, end, seq): the first by seq counts for each symbol among those whose file lies in a
    package (packages(dir)) and not under ``target``. It stands for the innermost of items(file, name, owner, kind, start,
    end, seq) around its first line, unless that is a module; else for what its readable name says, over its own lines.
    """
    own = longest_prefix(regions.filter(F.lit(True) if target is None else ~F.col("file").startswith(f"{target}/")), packages.select("dir"), "file", "dir", ["dir"])
    first = first_wins(own.filter("dir IS NOT NULL").drop("dir"), ["symbol"], "seq")
    shaped = items.withColumn("item", F.struct("name", "owner", "kind", "start", "end"))
    around = innermost(first, shaped.select("file", F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("seq").alias("_seq"), "item"), "file", "start", "_start", "_end", "_seq", "item")
    rows = first.join(around, ["file", "start"], "left")
    found = F.col("item").isNotNull() & (F.col("item.kind") != "mod")
    side = lambda name: F.when(found, F.col(f"item.{name}")).otherwise(F.col(name)).cast("int").alias(name)
    key = F.when(found, item_key(F.col("item.owner"), F.col("item.name"))).otherwise(symbol_item(F.col("readable")))
    return rows.select("symbol", "seq", "file", key.alias("key"), side("start"), side("end"))


def build_map(tests: DataFrame, executed: DataFrame, regions: DataFrame, items: DataFrame, packages: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions (fid, file, name, start, end), tests (tid, package, binary_id, name), hits (tid, fid)) from
    tests(key, package, binary_id, name) and executed(key, symbol); see ``symbol_items`` for the rest.

    One function stands for each file and key, with the span of the first symbol that has it. Functions are numbered from 0
    by (file, start, name), tests by (package, binary, name).
    """
    found = symbol_items(regions, items, packages, target)
    spans = first_wins(found.select("file", "key", "start", "end", F.struct("seq", "symbol").alias("seq")), ["file", "key"], "seq")
    functions = numbered(spans.select("file", F.col("key").alias("name"), "start", "end"), "file", "start", "name").select((F.col("number") - 1).alias("fid"), "file", "name", "start", "end")
    listed = numbered(tests, "package", "binary_id", "name", "key").select((F.col("number") - 1).alias("tid"), "key", "package", "binary_id", "name")
    symbols = executed.join(listed.select("tid", "key"), "key").select("tid", "symbol")
    return functions, listed.drop("key"), executed_functions(symbols, found, functions)
