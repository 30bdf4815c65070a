"""Joins of change-impact analysis as equi-joins: prefixes, intervals, fallbacks, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import STRETCH, stretches


def ancestors(path: Column) -> Column:
    """All directories above a path, from the root (an empty name) down."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def longest_prefix(files: DataFrame, dirs: DataFrame, path: str, dir: str, keep: list[str]) -> DataFrame:
    """``files`` with the columns ``keep`` of the deepest directory that holds each path; null if there is none.

    Paths are taken apart into their directories, so the join is on equality and a look-alike prefix never matches.
    """
    steps = files.select(F.col(path).alias("_path")).distinct().select("_path", F.explode(F.array_distinct(ancestors(F.col("_path")))).alias("_dir"))
    found = steps.join(dirs.select(F.col(dir).alias("_dir"), F.struct(*keep).alias("_own")), "_dir")
    best = found.groupBy("_path").agg(F.max_by("_own", F.length("_dir")).alias("_own"))
    return files.join(best, files[path] == best["_path"], "left").select(*files.columns, *(F.col(f"_own.{k}").alias(k) for k in keep))


def interval_semi(rows: DataFrame, ranges: DataFrame, on: str, start: str, end: str, a: str = "a", b: str = "b") -> DataFrame:
    """``rows`` whose [start, end] meets a range of the same key."""
    r = ranges.select(F.col(on).alias("_on"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    return rows.join(r, (rows[on] == r["_on"]) & (r["_a"] <= rows[end]) & (rows[start] <= r["_b"]), "left_semi")


def innermost(points: DataFrame, items: DataFrame, on: str, point: str, start: str, end: str, seq: str, item: str) -> DataFrame:
    """(on, point, item): the smallest item of the same key around each point; of equal spans the last listed. Points meet
    items by stretch, so a key with most of them is many tasks'."""
    spans = items.select(F.col(on).alias("_on"), start, end, seq, item, F.explode(stretches(F.col(start), F.col(end))).alias("_stretch"))
    placed = points.select(on, point).distinct().withColumn("_k", F.floor(F.col(point) / STRETCH))
    around = placed.join(spans, (F.col(on) == F.col("_on")) & (F.col("_k") == F.col("_stretch")) & F.col(point).between(F.col(start), F.col(end)))
    return around.groupBy(on, point).agg(F.min_by(item, F.struct(F.col(end) - F.col(start), -F.col(seq))).alias(item))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): rows that were added, removed or changed between two snapshots."""
    packed = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    both = packed(old, "_old").join(packed(new, "_new"), keys, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*keys, "change")


def wildcard_equal(probes: DataFrame, rows: DataFrame, first: str, rest: list[str]) -> DataFrame:
    """Probes joined with rows of the same first column; further columns must agree where the probe has them."""
    cond = F.col(f"p.{first}") == F.col(f"r.{first}")
    for c in rest:
        cond = cond & (F.col(f"p.{c}").isNull() | (F.col(f"p.{c}") == F.col(f"r.{c}")))
    return probes.alias("p").join(rows.alias("r"), cond)


def exact_else_prefix(probes: DataFrame, rows: DataFrame, probe: str, name: str, separator: str) -> DataFrame:
    """(probe, name): equal names, or, only for probes without one, names that begin with probe + separator.

    A name is taken apart at each separator, so the prefix case is an equi-join too.
    """
    exact = probes.join(rows, F.col(probe) == F.col(name)).select(probe, name)
    without = probes.join(exact.select(probe).distinct(), probe, "left_anti")
    parts = F.split(name, f"\\Q{separator}\\E")
    heads = rows.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), separator))).alias("_head"))
    return exact.unionByName(without.join(heads.filter(F.col("_head") != F.col(name)), F.col(probe) == F.col("_head")).select(probe, name))


def token_references(texts: DataFrame, targets: DataFrame, text: str, token: str) -> DataFrame:
    """``texts`` joined with ``targets`` on each distinct word between characters that paths do not have."""
    words = texts.withColumn(token, F.explode(F.array_distinct(F.filter(F.split(text, r"[^A-Za-z0-9_./-]+"), lambda w: w != ""))))
    return words.join(targets, token)


def cache_split(questions: DataFrame, answers: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their answers, misses)."""
    return questions.join(answers, key), questions.join(answers.select(key).distinct(), key, "left_anti")


def last_wins(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value with the largest order of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest order of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest))


def nearest_scope(refs: DataFrame, scopes: DataFrame, definitions: DataFrame) -> DataFrame:
    """(ref, node): names resolved in their own scope or the nearest one around it.

    refs(ref, file, scope, name); scopes(file, scope, ancestor, hops), reflexive; definitions(file, scope, name, node).
    """
    steps = refs.join(scopes, ["file", "scope"]).select("ref", "file", F.col("ancestor").alias("scope"), "hops", "name")
    return steps.join(definitions, ["file", "scope", "name"]).groupBy("ref").agg(F.min_by("node", F.struct("hops", "node")).alias("node"))


def min_with_all(rows: DataFrame, keys: list[str], depth: str, item: str) -> DataFrame:
    """(keys, depth, items): the smallest depth of each key with all items at it, sorted."""
    lists = rows.groupBy(*keys, depth).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return lists.groupBy(*keys).agg(F.min(depth).alias(depth), F.min_by("items", depth).alias("items"))


def adjacent_distinct(rows: DataFrame, keys: list[str], order: str, item: str) -> DataFrame:
    """``rows`` without those whose item equals the one before it in its key's order."""
    before = F.lag(item).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.col(item)) | F.col("_before").isNull()).drop("_before")
