"""Differences of lock files and manifests, as tables: what changed, and which members it reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import and_more
from ..operators.graph import cut, dependents_of
from ..operators.joins import snapshot_diff, wildcard_equal

KEY = ["name", "version", "source"]


def differing_keys(old: DataFrame, new: DataFrame, of: list[str], most: int = 6) -> DataFrame:
    """(of, keys): the keys whose values differ between two documents, as ``[k1]`` or ``[k1.k2]``, so many at most.

    old and new(of, k1, k2, value): k2 is null for a value that is no table. A key that is a table on one side only
    differs as a whole. Both sides are grouped, never joined, so nothing of them can be broadcast.
    """
    sided = lambda df, side: df.select(*of, "k1", F.coalesce("k2", F.lit("")).alias("k2"), F.col("k2").isNotNull().alias("table"), F.lit(side).alias("side"), F.struct("value").alias("v"))
    rows = sided(old, "old").unionByName(sided(new, "new")).na.drop(subset=[*of, "k1"])
    on = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    each = rows.groupBy(*of, "k1", "k2").agg(on("old", "v").alias("old"), on("new", "v").alias("new"), on("old", "table").alias("a"), on("new", "table").alias("b"))
    changed = F.array_sort(F.collect_set(F.when(~F.col("old").eqNullSafe(F.col("new")), F.col("k2"))))
    keys = each.groupBy(*of, "k1").agg((F.max("a") & F.max("b")).alias("deep"), changed.alias("changed")).filter(F.size("changed") > 0)
    deep = F.transform("changed", lambda k2: F.concat(F.lit("["), F.col("k1"), F.lit("."), k2, F.lit("]")))
    labels = F.when(F.col("deep"), deep).otherwise(F.array(F.concat(F.lit("["), F.col("k1"), F.lit("]"))))
    lists = keys.select(*of, labels.alias("labels")).groupBy(*of).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("keys"))
    return lists.select(*of, and_more(F.col("keys"), most).alias("keys"))


def changed_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, version, source, side): entries (key, rest, deps) that are gone or different (old), new or different (new)."""
    diff = snapshot_diff(old, new, KEY, ["rest", "deps"])
    sides = F.when(F.col("change") == "added", F.array(F.lit("new"))).when(F.col("change") == "removed", F.array(F.lit("old"))).otherwise(F.array(F.lit("old"), F.lit("new")))
    return diff.select(*KEY, F.explode(sides).alias("side"))


def entry_users(entries: DataFrame) -> DataFrame:
    """(src, dst): keys as structs, dst depends on src. A dependency reads ``name [version [(source)]]``."""
    each = entries.select(F.struct(*KEY).alias("dst"), F.explode("deps").alias("dep")).select("dst", F.split("dep", " ", 3).alias("d"))
    part = lambda n: F.get("d", F.lit(n))
    probes = each.select("dst", part(0).alias("name"), part(1).alias("version"), F.regexp_replace(part(2), r"^\(|\)$", "").alias("source"))
    found = wildcard_equal(probes, entries.select(*KEY), "name", ["version", "source"])
    return found.select(F.struct(*(F.col(f"r.{c}").alias(c) for c in KEY)).alias("src"), F.col("p.dst").alias("dst")).distinct()


def version_text(old: Column, new: Column) -> Column:
    """What became of the versions of a package, from two sorted arrays."""
    a, b = F.array_join(old, "/"), F.array_join(new, "/")
    return F.when(F.size(old) == 0, F.concat(b, F.lit(" (added)"))).when(F.size(new) == 0, F.concat(a, F.lit(" (removed)"))).when(a == b, F.concat(b, F.lit(" (checksum or dependencies)"))).otherwise(F.concat(a, F.lit(" → "), b))


def version_sets(changed: DataFrame) -> DataFrame:
    """(name, what): the versions of each changed package before and after; changed(name, version, side)."""
    of = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col("version"))))
    return changed.groupBy("name").agg(of("old").alias("old"), of("new").alias("new")).select("name", F.concat_ws(" ", "name", version_text(F.col("old"), F.col("new"))).alias("what"))


def lock_causes(old: DataFrame, new: DataFrame, members: DataFrame, most: int = 5) -> DataFrame:
    """(member, why): the workspace members that a changed lock file reaches, and by what. A member's own version alone is
    no change; a member is an entry without source whose name is in members(name).
    """
    mine = members.select("name").distinct()
    listed = F.col("source") == ""
    quiet = lambda df: df.join(mine.withColumn("_m", F.lit(True)), "name", "left").withColumn("version", F.when(F.col("_m") & listed, "").otherwise(F.col("version"))).drop("_m")
    old, new = quiet(old), quiet(new)
    changed = changed_entries(old, new)
    ours = changed.filter(listed).join(mine, "name", "left_semi")
    theirs = cut(changed.join(ours.select(*KEY).distinct(), KEY, "left_anti"))  # read by three plans
    keys = mine.select(F.struct("name", F.lit("").alias("version"), F.lit("").alias("source")).alias("node"))
    hits = ours.select(F.col("name").alias("member"), F.lit("its own dependencies").alias("what"))
    names = version_sets(theirs)
    sided = lambda side, key: F.struct(side.alias("side"), key.alias("key"))
    users = [entry_users(e).select(sided(F.lit(s), F.col("src")).alias("src"), sided(F.lit(s), F.col("dst")).alias("dst")) for s, e in (("old", old), ("new", new))]
    starts = theirs.select(sided(F.col("side"), F.struct(*KEY)).alias("node"))
    ends = keys.select(F.explode(F.array(*(sided(F.lit(s), F.col("node")) for s in ("old", "new")))).alias("node"))
    found = dependents_of(starts, cut(users[0].unionByName(users[1])), ends)  # both sides in one walk
    hits = hits.unionByName(found.select(F.col("node.key.name").alias("member"), F.col("start.key.name").alias("name")).join(names, "name").select("member", "what"))
    lists = hits.groupBy("member").agg(F.array_sort(F.collect_set("what")).alias("what"))
    return lists.select("member", F.concat(F.lit("lock: "), and_more(F.col("what"), most)).alias("why"))
