"""Readers of the tables that change-impact analysis starts from."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPE = re.compile(rb"\\([0-3][0-7]{2}|.)", re.S)
ESCAPED = {b"n": b"\n", b"t": b"\t"} | {b"%03o" % code: bytes([code]) for code in range(256)}


def unescape(bare: str) -> str:
    """The text of a quoted path without its quotes."""
    if "\\" not in bare:
        return bare
    parts = ESCAPE.split(bare.encode())
    parts[1::2] = [ESCAPED.get(code, code) for code in parts[1::2]]
    return b"".join(parts).decode(errors="replace")


def unquote(path: str) -> str:
    """Undo C-style quoting of a path in a diff."""
    return unescape(path.strip('"')) if path.startswith('"') else path


def side(text: str, prefix: str) -> str | None:
    """The path of a ``---`` or ``+++`` line; none for /dev/null."""
    text = text.rstrip("\t")
    if text == "/dev/null":
        return None
    if not text.startswith('"'):
        return text.removeprefix(prefix)
    bare = text.strip('"')
    return unescape(bare.removeprefix(prefix)) if bare.startswith(prefix) else unescape(bare).removeprefix(prefix)


HUNK = re.compile(r"\n@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", re.ASCII)
HUNK_REST = r"^(?P<a>\d+)(?:,(?P<b>\d+))? \+(?P<c>\d+)(?:,(?P<d>\d+))? @@"
PIECE_BYTES = 8 << 20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(keys, texts), each text behind a line break, of some megabytes of text or one text."""
    for batch in batches:
        texts = batch.column(1).fill_null("")
        part = pc.binary_length(texts).to_numpy().cumsum(dtype="int64") // PIECE_BYTES
        starts = np.unique(part, return_index=True)[1]
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.column(0)[start:end], pc.binary_join_element_wise("", texts[start:end], "\n")


def _split(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """What stands before the first mark, the parts behind each, and of which text these are."""
    parts = pc.split_pattern(texts, mark)
    offsets = parts.offsets.to_numpy()
    behind = np.ones(len(parts.values), bool)
    behind[offsets[:-1]] = False
    return parts.values.take(pa.array(offsets[:-1])), parts.values.filter(pa.array(behind)), np.repeat(np.arange(len(texts)), np.diff(offsets) - 1)


def _each(texts: pa.Array, change: Callable[[str], str | None]) -> pa.Array:
    """The texts changed by a function, which sees equal ones once."""
    found = texts.dictionary_encode()
    return pa.array([change(x) for x in found.dictionary.to_pylist()], pa.string()).take(found.indices)


def _numbers(texts: pa.Array) -> np.ndarray:
    return pc.if_else(pc.equal(texts, ""), "1", texts).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _patch_ranges(sections: pa.Array) -> tuple[np.ndarray, pa.Array, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(section, path, old ranges, new ranges) of each hunk of files' sections; an old range without lines ends before it begins.

    A section's header goes up to its first hunk; the last line of a side holds. A section without a path has no hunks.
    """
    headers, rests, section = _split(sections, "\n@@ -")
    hunks = pc.extract_regex(rests, HUNK_REST)
    known = hunks.is_valid().to_numpy(zero_copy_only=False)
    if not known.all():  # no hunk, so the header can go on behind it
        headers = headers.to_pylist()
        for at in np.unique(section[~known]):
            headers[at] = HUNK.split(sections[int(at)].as_py(), 1)[0]
        headers = pa.array(headers, pa.string())
    named = lambda mark, prefix: _each(pc.struct_field(pc.extract_regex(headers, rf"(?s)^.*\n{mark} (?P<path>[^\n]*)"), 0), lambda x: None if x is None else side(x, prefix) or None)
    paths = pc.coalesce(named(r"\+\+\+", "b/"), named("---", "a/"))
    known &= paths.is_valid().to_numpy(zero_copy_only=False)[section]
    section, hunks = section[known], hunks.filter(pa.array(known))
    a, b, c, d = (_numbers(pc.struct_field(hunks, i)) for i in range(4))
    first = np.where(d == 0, np.maximum(c, 1), c)
    return section, paths.take(pa.array(section)), (a, a + b - 1), (first, first + np.maximum(d, 1) - 1)


def change_ranges(diffs: DataFrame, key: str = "diff_id", text: str = "text") -> DataFrame:
    """(key, path, side, a, b): inclusive line ranges of zero-context diffs, one diff text for each row.

    A pure deletion marks one line on the new side, line 1 at least. A diff's files are found by its headers only.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _pieces(batches):
            _, sections, row = _split(texts, "\ndiff --git ")
            section, paths, *both = _patch_ranges(sections)
            for of, (a, b) in zip(("old", "new"), both):
                own = pa.array(np.flatnonzero(a <= b))
                ends = [pa.array(x, pa.int64()).take(own).cast(pa.int32()) for x in (a, b)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[section])).take(own), paths.take(own), pa.array([of] * len(own), pa.string()), *ends], [key, "path", "side", "a", "b"])

    kind = diffs.schema[key].dataType.simpleString()
    return diffs.select(key, text).mapInArrow(parse, f"{key} {kind}, path string, side string, a int, b int")


RAW = r"^:(?P<old_mode>\d+) (?P<new_mode>\d+) \S+ \S+ (?P<code>[A-Z])\d*\t(?P<first>[^\t]+)(?:\t(?P<second>[^\t]+))?$"
STATUS = {"A": "added", "C": "added", "D": "deleted", "R": "renamed"}
SUBMODULE = "160000"
RANGES = "array<struct<a:int,b:int>>"
FLUSH_ROWS = 20_000


def _raw_files(heads: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array, pa.Array]:
    """(head, old path, new path, status, gitlink) of the raw lines that diffs begin with."""
    _, lines, row = _split(heads, "\n")
    raw = pc.starts_with(lines, ":")
    lines, row = lines.filter(raw), row[raw.to_numpy(zero_copy_only=False)]
    old_mode, new_mode, code, first, second = pc.extract_regex(lines, RAW).flatten()
    two = pc.is_in(code, pa.array(["R", "C"]))
    wrong = lines.filter(pc.or_(code.is_null(), pc.and_(two, pc.equal(second, "")).fill_null(True)))
    if len(wrong):
        raise ValueError(f"raw line of a diff can't be read: {wrong[0]}")
    none = pa.scalar(None, pa.string())
    old = pc.if_else(pc.is_in(code, pa.array(["A", "C"])), none, _each(first, unquote))
    new = pc.if_else(pc.equal(code, "D"), none, _each(pc.if_else(two, second, first), unquote))
    return row, old, new, _each(code, lambda x: STATUS.get(x, "modified")), pc.or_(pc.equal(old_mode, SUBMODULE), pc.equal(new_mode, SUBMODULE))


def _ranges_of(wanted: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The ranges of each wanted owner, in order."""
    order = np.lexsort((b, a, owner))
    order = order[a[order] <= b[order]]
    from_, to = (np.searchsorted(owner[order], wanted, of) for of in ("left", "right"))
    ends = np.concatenate([[0], np.cumsum(to - from_)])
    at = order[np.repeat(from_ - ends[:-1], to - from_) + np.arange(ends[-1])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x[at], pa.int64()).cast(pa.int32()) for x in (a, b)], ["a", "b"]))


def changed_files(diffs: DataFrame, untracked: DataFrame | None = None, key: str = "diff_id", text: str = "text") -> DataFrame:
    """(key, place, old_path, new_path, status, old_ranges, new_ranges, gitlink): the files of diffs that begin with raw lines
    and go on with a zero-context patch, one diff text for each row, place numbering a diff's files from 0.

    Status is added (copies too), deleted, renamed or modified; a file that the patch says nothing of (binary, or only its
    mode) has no ranges. A raw line that can't be read fails the job. ``untracked`` (key, path, lines) are source files that the
    history doesn't know: they come behind the others, without a place, changed over all of their lines, one at least.
    A text has all of its files and ranges, so each is read once and nothing is shuffled.
    """
    names = [key, "place", "old_path", "new_path", "status", "old_ranges", "new_ranges", "gitlink"]
    kinds = [diffs.schema[key].dataType.simpleString(), "int", "string", "string", "string", RANGES, RANGES, "boolean"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _pieces(batches):
            heads, sections, section_row = _split(texts, "\ndiff --git ")
            row, old, new, status, gitlink = _raw_files(heads)
            section, paths, *both = _patch_ranges(sections)
            found = pa.concat_arrays([pc.coalesce(new, old), paths]).dictionary_encode()
            owner = np.concatenate([row, section_row[section]]) * len(found.dictionary) + found.indices.to_numpy()
            ranges = [_ranges_of(owner[: len(row)], owner[len(row) :], *one) for one in both]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            files = pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(place, pa.int32()), old, new, status, *ranges, gitlink], names)
            yield from (files.slice(at, FLUSH_ROWS) for at in range(0, len(row), FLUSH_ROWS))

    out = diffs.select(key, text).mapInArrow(parse, ", ".join(map(" ".join, zip(names, kinds))))
    if untracked is None:
        return out
    none = F.array().cast(RANGES)
    whole = F.array(F.struct(F.lit(1).alias("a"), F.greatest("lines", F.lit(1)).alias("b"))).cast(RANGES)
    own = untracked.filter(F.col("path").endswith(".rs")).select(key, F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("old_path"), F.col("path").alias("new_path"), F.lit("untracked").alias("status"), none.alias("old_ranges"), whole.alias("new_ranges"), F.lit(False).alias("gitlink"))
    return out.unionByName(own)


def change_size(ranges: DataFrame) -> DataFrame:
    """(files, lines) of a change: lines of both sides."""
    return ranges.agg(F.count_distinct("path").alias("files"), F.coalesce(F.sum(F.col("b") - F.col("a") + 1), F.lit(0)).alias("lines"))


def answer_log(spark: SparkSession, path: str) -> DataFrame:
    """(qkey, score): ``key score`` lines; malformed lines are skipped, of equal keys the last line holds: that of the file
    that was written last (of files of one moment, the last by name), and in it the last."""
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    files = spark.read.text(path).select("value", place.alias("line_no"))
    parts = files.select(F.split("value", " ", 2).alias("p"), "line_no").filter(F.size("p") == 2)
    rows = parts.select(F.col("p")[0].alias("qkey"), F.expr("try_cast(p[1] AS double)").alias("score"), "line_no").filter("score IS NOT NULL")
    return rows.groupBy("qkey").agg(F.max_by("score", "line_no").alias("score"))


COVERAGE = "version int, commit string, functions array<struct<file:string,name:string,start:int,end:int>>, tests array<struct<package:string,binary_id:string,name:string,functions:array<int>>>"


MAP_VERSION = 1


def coverage_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions, tests, hits) of a JSON coverage map, gzipped or not. A map of another version fails the job that
    reads it."""
    whole = spark.read.schema(COVERAGE).json(path)
    wrong = F.raise_error(F.concat(F.lit(f"coverage map is not of version {MAP_VERSION}: "), F.coalesce(F.col("version").cast("string"), F.lit("none"))))
    whole = whole.filter(F.when(F.col("version") == MAP_VERSION, True).otherwise(wrong.cast("boolean")))
    functions = whole.select(F.posexplode("functions").alias("fid", "f")).select("fid", "f.*")
    tests = whole.select(F.posexplode("tests").alias("tid", "t"))
    return functions, tests.select("tid", "t.package", "t.binary_id", "t.name"), tests.select("tid", F.explode("t.functions").alias("fid"))


def executed_records(records: DataFrame, *keep: str) -> DataFrame:
    """(keep, symbol): the distinct symbols of profile records (value) whose entry counter is above 0.

    A record that begins with a comment is left out; the first counter stands on the line behind the marker. Lines that
    begin with a colon don't count.
    """
    rows = records.select(*keep, F.filter(F.split("value", "\n"), lambda s: ~s.startswith(":") & (s != "")).alias("l"))
    marker = F.array_position("l", "# Counter Values:").cast("int")  # from 1; 0 is none
    counter = F.when(marker > 0, F.get("l", marker).try_cast("bigint"))
    first = F.get("l", F.lit(0))
    return rows.filter(~first.startswith("#") & (counter > 0)).select(*keep, first.alias("symbol")).distinct()


def executed_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(symbol) of profile text whose entry counter is above 0; records stand between blank lines."""
    return executed_records(spark.read.text(path, lineSep="\n\n"))


def folder_of(path: Column) -> Column:
    """The name of the folder that a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


#: How a test's folder names it, and the profiles beside it.
META, PROFILES = "meta.json", "*.proftext"


def profile_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tests (key, package, binary_id, name), executed (key, symbol)) of a folder with one folder for each test that ran.

    A test's folder, named by its key, holds ``meta.json`` and the texts of its profiles; a symbol is executed if any of
    them has it. A test without profiles, or whose names can't be read, is in neither table. Profiles are cut at blank
    lines, so a large one is read by several tasks.
    """
    deep = spark.read.option("recursiveFileLookup", True)
    named = deep.option("pathGlobFilter", META).option("multiLine", True).schema("package string, binary_id string, name string").json(path)
    tests = named.select(folder_of(F.col("_metadata.file_path")).alias("key"), "package", "binary_id", "name").filter("binary_id IS NOT NULL AND name IS NOT NULL")
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", PROFILES).text(path, lineSep="\n\n")
    records = texts.select(folder_of(F.col("_metadata.file_path")).alias("key"), "value")
    return tests.join(records.select("key").distinct(), "key", "left_semi"), executed_records(records, "key").join(tests.select("key"), "key", "left_semi")


def region_spans(functions: DataFrame) -> DataFrame:
    """(symbol, file, start, end) from (symbol, files, regions): the lines of the first region's file."""
    first = F.get(F.get("regions", F.lit(0)), F.lit(5)).cast("int")
    own = F.filter("regions", lambda r: F.get(r, F.lit(5)) == F.get(F.get("regions", F.lit(0)), F.lit(5)))
    return functions.select("symbol", F.get("files", first).alias("file"), F.array_min(F.transform(own, lambda r: F.get(r, F.lit(0)))).alias("start"), F.array_max(F.transform(own, lambda r: F.get(r, F.lit(2)))).alias("end"))


def write_coverage_map(functions: DataFrame, tests: DataFrame, hits: DataFrame, commit: str, path: str) -> None:
    """Write functions(file, name, start, end), tests(package, binary_id, name) and hits(test's three columns, file, name,
    start) as one gzipped JSON map, numbered in order of (file, start, name) and (package, binary, name).

    The map is one nested document, so this ends in one row; maps that are shared between jobs should stay tables.
    """
    from ..operators.ranking import numbered

    key = ["package", "binary_id", "test"]
    f = numbered(functions.select("file", "name", "start", "end").distinct(), "file", "start", "name", "end").withColumn("fid", (F.col("number") - 1).cast("int"))
    t = tests.select("package", "binary_id", F.col("name").alias("test")).distinct()
    own = hits.join(f, ["file", "name", "start"]).groupBy(*key).agg(F.array_sort(F.collect_set("fid")).alias("functions"))
    rows = t.join(own, key, "left").select("package", "binary_id", F.col("test").alias("name"), F.coalesce("functions", F.array().cast("array<int>")).alias("functions"))
    listed = lambda df, item, by: df.agg(F.array_sort(F.collect_list(F.struct(*by, item.alias("item")))).alias("x")).select(F.transform("x", lambda x: x["item"]).alias("x"))
    fs = listed(f, F.struct("file", "name", "start", "end"), ["fid"]).withColumnRenamed("x", "functions")
    ts = listed(rows, F.struct("package", "binary_id", "name", "functions"), ["package", "binary_id", "name"]).withColumnRenamed("x", "tests")
    whole = fs.crossJoin(F.broadcast(ts)).select(F.lit(MAP_VERSION).alias("version"), F.lit(commit).alias("commit"), "functions", "tests")
    whole.write.mode("overwrite").option("compression", "gzip").json(path)


def append_answers(answers: DataFrame, path: str) -> None:
    """Append answers(qkey, score) to a log that ``answer_log`` reads; answers without a score are not written."""
    lines = answers.filter(F.col("score").isNotNull() & F.col("qkey").isNotNull()).select(F.concat_ws(" ", "qkey", F.col("score").cast("string")))
    lines.write.mode("append").text(path)


def literal_index(spark: SparkSession, path: str) -> DataFrame:
    """(blob, line, text) of an index of string literals; a blob that has been written twice counts once."""
    return spark.read.schema("blob string, line int, text string").parquet(path).distinct()


def append_literals(literals: DataFrame, path: str) -> None:
    """Add (blob, line, text) to an index of literals."""
    literals.select("blob", F.col("line").cast("int").alias("line"), "text").write.mode("append").parquet(path)


def append_refusals(refusals: DataFrame, path: str) -> None:
    """Remember (body, detail) of requests that were refused for their size, by the hash of their body."""
    refusals.select(F.sha2("body", 256).alias("body_sha"), "detail").write.mode("append").parquet(path)
