"""From a change and its reach to candidate tests: path arguments, sources of the reached packages, and their tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import matches_any
from ..operators.intervals import meeting
from ..operators.ranking import numbered
from .paths import package_files


def restrict(changes: DataFrame, patterns: list[str], files: DataFrame) -> DataFrame:
    """``changes`` (old_path, new_path, status, old_ranges, new_ranges) below paths, directories or globs that were asked for.

    A pattern without wildcards that is an existing file of files(path, lines) without a change is added as changed over all
    of its lines, one at least; a binary file (lines is null) has no ranges.
    """
    named = [p.removeprefix("./").rstrip("/") for p in patterns]
    globs = [g for p in named for g in (p, f"{p}/**")]
    below = lambda path: F.coalesce(matches_any(F.col(path), globs, False), F.lit(False))
    kept = changes.filter(below("new_path") | below("old_path"))
    plain = files.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(named) if not set(p) & set("*?[{")], "path string")
    new = files.join(F.broadcast(plain), "path", "left_semi").join(kept.select(F.col("new_path").alias("path")), "path", "left_anti")
    kind = changes.schema["new_ranges"].dataType.simpleString()
    whole = F.when(F.col("lines").isNotNull(), F.array(F.struct(F.lit(1).alias("a"), F.greatest(F.col("lines"), F.lit(1)).alias("b")))).otherwise(F.array()).cast(kind)
    return kept.unionByName(new.select(F.col("path").alias("old_path"), F.col("path").alias("new_path"), F.lit("modified").alias("status"), whole.alias("old_ranges"), whole.alias("new_ranges")), allowMissingColumns=True)


def candidate_tests(files: DataFrame, packages: DataFrame, reached: DataFrame, tests: DataFrame, ranges: DataFrame, whole: DataFrame, unparsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, whole packages (pkg, file, why)) of the packages that a change reaches.

    files(path); packages(pkg, name, dir); reached(pkg, hops); tests(path, seq, start, end, module, name), seq numbering a
    file's tests; ranges(path, a, b) of the new side; whole(pkg) run whole; unparsed(path) can't be read, so that their packages
    run whole too. A candidate has position (from 1, by hops, package name, path and seq), pkg, depth, the test, and must:
    changed if its lines meet a range, else package if its package runs whole; the columns of later layers are empty.
    """
    sources = package_files(files.select("path"), packages.select("pkg", "dir")).join(reached.select("pkg", F.col("hops").alias("depth")), "pkg").join(packages.select("pkg", F.col("name").alias("package")), "pkg")
    broken = sources.join(unparsed.select("path").distinct(), "path", "left_semi").select("pkg", F.col("path").alias("file"), F.lit("does not parse").alias("why"))
    rows = sources.join(unparsed.select("path").distinct(), "path", "left_anti").join(tests, "path")
    touched = meeting(rows.select("path", "seq", "start", "end"), ranges, ["path"], ["seq"], "start", "end").withColumn("_changed", F.lit(True))
    forced = whole.select("pkg").union(broken.select("pkg")).distinct().withColumn("_whole", F.lit(True))
    marked = rows.join(touched, ["path", "seq"], "left").join(forced, "pkg", "left")
    must = F.when(F.col("_changed"), "changed").when(F.col("_whole"), "package")
    placed = numbered(marked.withColumn("must", must), "depth", "package", "path", "seq").withColumnRenamed("number", "position")
    none = lambda kind: F.lit(None).cast(kind)
    later = {"evidence_kind": none("string"), "evidence_n": none("int"), "symbols": none("array<string>"), "covered": none("array<string>"), "n_hit": none("int"), "gated": F.lit(False), "bonus": F.lit(0.0)}
    return placed.select("position", "pkg", "depth", F.col("path").alias("file"), "seq", "start", "end", "module", "name", "must", *(c.alias(k) for k, c in later.items())), broken
