"""What each changed path means: the path policy, rules, package edges and the packages a change reaches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import matches_any
from ..operators.graph import reach, with_whole
from ..operators.joins import ancestors, longest_prefix
from .policy import Settings


@dataclass(frozen=True)
class Rule:
    """A path that matches starts the rule's packages; an exclusive rule replaces all other handling of the path."""

    paths: tuple[str, ...]
    packages: tuple[str, ...] = ()
    reach: bool = True
    exclusive: bool = False
    full: bool = False


#: Files that describe packages (fixed values).
MANIFEST, LOCK = "Cargo.toml", "Cargo.lock"


def sides(changes: DataFrame) -> DataFrame:
    """``changes`` (change_id, old_path, new_path, status) with a row for each distinct path; old_side and new_side say
    which sides have it, the old one only if the change had a file there before."""
    paths = F.array_distinct(F.array_compact(F.array("new_path", "old_path")))
    rows = changes.withColumn("path", F.explode(paths))
    new = F.coalesce(F.col("path") == F.col("new_path"), F.lit(False))
    old = F.coalesce(F.col("path") == F.col("old_path"), F.lit(False)) & ~F.col("status").isin("added", "untracked")
    return rows.withColumns({"new_side": new, "old_side": old})


def fired_rules(path: Column, rules: tuple[Rule, ...]) -> Column:
    """The numbers of the rules that a path matches."""
    each = [F.when(matches_any(path, list(r.paths), True), F.lit(n)) for n, r in enumerate(rules)]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<int>")


def path_policy(changes: DataFrame, packages: DataFrame, settings: Settings = Settings(), rules: tuple[Rule, ...] = (), whole_package: bool = True) -> DataFrame:
    """``sides`` of the changes with rules, pkg, rel (the path in its package) and policy, the first that applies:

    full (everything runs), rule (an exclusive rule), ignored, manifest, outside (of all packages), whole (the package
    runs whole), source (items are compared), changed. ``packages`` (pkg, dir).
    """
    path = F.col("path")
    rows = longest_prefix(sides(changes).withColumn("rules", fired_rules(path, rules)), packages, "path", "dir", ["pkg", "dir"])
    rel = F.when(F.col("dir") == "", path).otherwise(F.substr(path, F.length("dir") + 2))
    exclusive = [n for n, r in enumerate(rules) if r.exclusive]
    by_rule = F.arrays_overlap("rules", F.array(*map(F.lit, exclusive))) if exclusive else F.lit(False)
    policy = (
        F.when(matches_any(path, list(settings.full_run), True), "full")
        .when(by_rule, "rule")
        .when(matches_any(path, list(settings.ignore), True), "ignored")
        .when(path.isin(MANIFEST, LOCK) | (F.col("rel") == MANIFEST), "manifest")
        .when(F.col("pkg").isNull(), "outside")
        .when(F.col("rel") == "build.rs", "whole")
        .when(path.endswith(".rs"), "source")
        .otherwise("whole" if whole_package else "changed")
    )
    return rows.withColumn("rel", rel).withColumn("policy", policy).drop("dir")


def rule_packages(policed: DataFrame, packages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(pkg, rule, reach): packages that fired rules run whole. Paths that force a full run fire none."""
    fired = policed.filter("policy <> 'full'").select(F.explode("rules").alias("rule")).distinct()
    named = [(n, p, r.reach) for n, r in enumerate(rules) for p in r.packages]
    known = policed.sparkSession.createDataFrame(named, "rule int, name string, reach boolean")
    return fired.join(F.broadcast(known), "rule").join(packages.select("pkg", "name"), "name").select("pkg", "rule", "reach")


def changed_packages(policed: DataFrame, *others: DataFrame) -> DataFrame:
    """(pkg): packages of whole, source and changed paths, and those of other tables with a column pkg."""
    own = policed.filter(F.col("policy").isin("whole", "source", "changed")).select("pkg")
    for other in others:
        own = own.unionByName(other.select("pkg"))
    return own.filter("pkg IS NOT NULL").distinct()


def full_run(policed: DataFrame, rules: tuple[Rule, ...] = ()) -> DataFrame:
    """(path, why): the paths that make everything run."""
    full = [n for n, r in enumerate(rules) if r.full]
    by_rule = F.arrays_overlap("rules", F.array(*map(F.lit, full))) if full else F.lit(False)
    why = F.when(F.col("policy") == "full", "paths.full_run").when(by_rule, "rule")
    return policed.select("path", why.alias("why")).filter("why IS NOT NULL").distinct()


def reached_packages(changed: DataFrame, seeds: DataFrame, whole: DataFrame, users: DataFrame, limit: int = 0) -> DataFrame:
    """(pkg, hops): what the changed packages and the rules' seeds reach through ``users`` (src, dst), and the packages
    that run whole at 0 hops."""
    extra = seeds.select("pkg").distinct().join(changed, "pkg", "left_anti")
    starts = changed.unionByName(extra).select(F.lit(0).alias("start"), F.col("pkg").alias("node"))
    found = with_whole(reach(starts, users, limit), whole.select(F.col("pkg").alias("node")))
    return found.withColumnRenamed("node", "pkg")


def by_name(names: DataFrame, packages: DataFrame, name: str) -> DataFrame:
    """``names`` with pkg, the first package of each name."""
    first = packages.groupBy(F.col("name").alias("_name")).agg(F.min("pkg").alias("pkg"))
    return names.join(first, F.col(name) == F.col("_name")).drop("_name")


def package_edges(dependencies: DataFrame, packages: DataFrame) -> DataFrame:
    """(src, dst): dst uses src, from dependencies(pkg, dep_name, path): only those with a path, none on itself, once."""
    used = by_name(dependencies.filter("path IS NOT NULL").withColumnRenamed("pkg", "dst"), packages, "dep_name")
    return used.select(F.col("pkg").alias("src"), "dst").filter("src <> dst").distinct()


def ranges_of(files: DataFrame, ranges: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ranges, those of the same path in order; an empty list if there are none."""
    own = ranges.groupBy(F.col("path").alias("_path")).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("ranges"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    return files.join(own, F.col(path) == F.col("_path"), "left").withColumn("ranges", F.coalesce(F.col("ranges").cast("array<struct<a:int,b:int>>"), none)).drop("_path")


def package_files(files: DataFrame, packages: DataFrame, all_targets: bool = False, suffix: str = ".rs") -> DataFrame:
    """``files`` (path) with pkg, of those that may hold a package's sources: of the deepest package around them, not below
    a directory target, and benches and examples only with ``all_targets``."""
    owned = longest_prefix(files.filter(F.col("path").endswith(suffix)), packages, "path", "dir", ["pkg", "dir"]).filter("pkg IS NOT NULL")
    rel = F.split(F.when(F.col("dir") == "", F.col("path")).otherwise(F.substr("path", F.length("dir") + 2)), "/")
    kept = ~F.array_contains(rel, "target")
    if not all_targets:
        kept = kept & ~((F.size(rel) > 1) & F.get(rel, F.lit(0)).isin("benches", "examples"))
    return owned.filter(kept).drop("dir")


def under(rows: DataFrame, dirs: DataFrame, path: str, dir: str) -> DataFrame:
    """``rows`` joined with the ``dirs`` that are their path or a directory above it."""
    steps = F.explode(F.array_distinct(F.concat(F.array(F.col(path)), ancestors(F.col(path)))))
    return rows.withColumn("_step", steps).join(dirs, F.col("_step") == F.col(dir)).drop("_step")
