"""Changed lines that no item holds: what they are, and what coverage can say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import holding, subtract
from ..operators.joins import ancestors

#: How lines begin that are no code (fixed values).
COMMENTS = ("//", "/*", "*")
ROOT_FILES = ("lib.rs", "main.rs", "mod.rs", "build.rs")


def uncovered_lines(ranges: DataFrame, items: DataFrame) -> DataFrame:
    """(path, a, b): changed lines (path, a, b) outside of all items (path, start, end, kind). A module holds nothing itself."""
    return subtract(ranges, items.filter("kind <> 'mod'"), ["path"])


def code_line(text: Column) -> Column:
    """Whether a line is neither blank nor a comment."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (trimmed != "") & ~F.coalesce(*(F.when(trimmed.startswith(c), True) for c in COMMENTS), F.lit(False))


def loose_lines(ranges: DataFrame, items: DataFrame, lines: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, code_line, private_use): for each file with loose changed lines of code, the first that is not of a private
    import (null if there is none), and whether one is.

    ranges(path, a, b) on the new side; items(path, start, end, kind); lines(path, line, text); uses(path, start, end) are
    the private imports. A line that the file doesn't have is no code.
    """
    each = uncovered_lines(ranges, items).select("path", F.explode(F.sequence("a", "b")).alias("line"))
    text = lines.select("path", F.col("line").cast("long").alias("line"), "text")
    code = each.join(text, ["path", "line"]).filter(code_line(F.col("text"))).select("path", "line")
    private = holding(code, uses, ["path"], "line", "start", "end").withColumn("private", F.lit(True))
    rows = code.join(private, ["path", "line"], "left")
    return rows.groupBy("path").agg(F.min(F.when(F.col("private").isNull(), F.col("line"))).alias("code_line"), F.coalesce(F.max("private"), F.lit(False)).alias("private_use"))


def scope_directory(path: Column, package: Column) -> Column:
    """The directory whose files a private import in ``path`` can reach: its own for the root of a crate or module, else
    the one beside the file that has its name."""
    inner = F.when(package == "", path).when(path.startswith(F.concat(package, F.lit("/"))), F.substring(path, F.length(package) + 2, F.length(path))).otherwise(path)
    parts = F.split(inner, "/")
    n, first = F.size(parts), F.get(parts, F.lit(0))
    root = F.element_at(parts, -1).isin(*ROOT_FILES) | ((n == 2) & first.isin("tests", "benches", "examples")) | ((n == 3) & (first == "src") & (F.get(parts, F.lit(1)) == "bin"))
    return F.when(root, F.regexp_replace(path, "/?[^/]*$", "")).otherwise(F.regexp_replace(path, r"(\.rs)+$", ""))


def functions_in_scope(files: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, fid): functions(fid, file) in each of files(path, directory) itself or below its directory. Paths are taken
    apart, so both cases are joins on equality."""
    below = functions.select("fid", F.explode(F.array_distinct(ancestors(F.col("file")))).alias("directory"))
    own = files.select("path", F.col("path").alias("file")).join(functions.select("fid", "file"), "file").select("path", "fid")
    return own.union(files.select("path", "directory").join(below, "directory").select("path", "fid")).distinct()


def judge_loose(loose: DataFrame, packages: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions (fid), blind (pkg, item, why)) of loose(path, pkg, code_line, private_use).

    packages(pkg, dir, proc_macro); functions(fid, file). A private import changes the functions of its scope; it is blind
    if the map has none of them. Any other loose line of code is blind.
    """
    rows = loose.join(packages.select("pkg", "dir", "proc_macro"), "pkg")
    told = F.when(F.col("proc_macro"), F.struct(F.col("path").alias("item"), F.lit("runs inside the compiler").alias("why")))
    told = told.when(F.col("code_line").isNotNull(), F.struct(F.concat_ws(":", "path", F.col("code_line").cast("string")).alias("item"), F.lit("code outside of all items").alias("why")))
    rows = rows.withColumn("told", told)
    imports = rows.filter("told IS NULL AND private_use").select("pkg", "path", scope_directory(F.col("path"), F.col("dir")).alias("directory"))
    found = functions_in_scope(imports.select("path", "directory").distinct(), functions)
    lost = imports.join(found.select("path").distinct(), "path", "left_anti").select("pkg", F.col("path").alias("item"), F.lit("import in a file that the map has never seen").alias("why"))
    return found.select("fid").distinct(), rows.filter("told IS NOT NULL").select("pkg", "told.item", "told.why").unionByName(lost)


def whole_blind(escalations: DataFrame) -> DataFrame:
    """(pkg, item, why): packages that run whole, from escalations(file, kind, pkg, why), as blind changes: coverage can't
    rule out tests in them."""
    return escalations.filter("kind = 'whole' AND pkg IS NOT NULL").select("pkg", F.col("file").alias("item"), "why")
