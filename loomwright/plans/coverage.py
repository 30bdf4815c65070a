"""The coverage layer: changed functions, what coverage can't see, and tests that are gated, forced or marked by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import reach
from .loose import judge_loose, whole_blind

#: Sources that are not of the workspace (fixed values).
FOREIGN = r"/rustc/|/\.cargo/registry/|/\.cargo/git/|/\.rustup/|/lib/rustlib/"


def function_of(probes: DataFrame, functions: DataFrame) -> DataFrame:
    """``probes`` (path, old_path, key) with fid: the function of the key in the new path, else in the old one."""
    one = functions.groupBy("file", "name").agg(F.min("fid").alias("fid"))
    side = lambda path, name: one.select(F.col("file").alias(path), F.col("name").alias("key"), F.col("fid").alias(name))
    rows = probes.join(side("path", "_new"), ["path", "key"], "left").join(side("old_path", "_old"), ["old_path", "key"], "left")
    return rows.withColumn("fid", F.coalesce("_new", "_old")).drop("_new", "_old")


def changed_functions(items: DataFrame, functions: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions (fid), blind (pkg, item, why)): the changed items that coverage knows, and those it can't judge.

    items(pkg, path, old_path, name, owner, kind, methods), kind one of fn, const fn, impl, test, mod or any other word;
    packages(pkg, proc_macro). The header of an impl stands for all of its methods; one that the map doesn't have makes it
    blind.
    """
    own = items.join(packages.select("pkg", "proc_macro"), "pkg").filter("kind NOT IN ('test', 'mod')").withColumn("item", F.struct("pkg", "path", "old_path", "owner", "name", "kind", "methods"))
    key = F.concat_ws("::", "owner", "name")
    keys = F.when(F.col("kind") == "fn", F.array(key)).when(F.col("kind") == "impl", F.transform("methods", lambda m: F.concat_ws("::", F.col("name"), m)))
    label = F.concat(F.col("path"), F.lit(": "), key)
    why = F.when(F.col("proc_macro"), "runs inside the compiler").when(F.col("kind") == "const fn", "may run at compile time")
    why = why.when((F.col("kind") == "impl") & (F.coalesce(F.size("methods"), F.lit(0)) <= 0), "impl without methods").when(~F.col("kind").isin("fn", "impl"), "no body for coverage to see")
    rows = own.withColumns({"why": why, "label": label})
    found = function_of(rows.filter("why IS NULL").select("item", "pkg", "label", "path", "old_path", F.explode(keys).alias("key")), functions)
    known = found.groupBy("item").agg(F.first("pkg").alias("pkg"), F.first("label").alias("label"), F.count_if(F.col("fid").isNull()).alias("lost"), F.collect_set("fid").alias("fids"))
    blind = rows.filter("why IS NOT NULL").select("pkg", F.col("label").alias("item"), "why")
    blind = blind.unionByName(known.filter("lost > 0").select("pkg", F.col("label").alias("item"), F.lit("not in the map").alias("why")))
    return known.filter("lost = 0").select(F.explode("fids").alias("fid")).distinct(), blind


def blind_spots(items: DataFrame, loose: DataFrame, escalations: DataFrame, functions: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions (fid), blind (pkg, item, why)) of a whole change: its items, its loose lines and the packages that run
    whole. See ``changed_functions``, ``loose.judge_loose`` and ``loose.whole_blind``."""
    by_item, unseen = changed_functions(items, functions, packages)
    by_import, outside = judge_loose(loose, packages, functions)
    blind = unseen.unionByName(outside).unionByName(whole_blind(escalations))
    return by_item.unionByName(by_import).distinct(), blind


def exempt_packages(blind: DataFrame, users: DataFrame) -> DataFrame:
    """(pkg): packages in which nothing is gated: those with blind changes and all that use them."""
    starts = blind.select(F.lit(0).alias("start"), F.col("pkg").alias("node")).distinct()
    return reach(starts, users).select(F.col("node").alias("pkg")).distinct()


def policy_used(requested: str, age: int | None, max_age: int) -> str:
    """The policy of a map so many commits old (none: unknown): a stale map only boosts."""
    stale = age is None or age > max_age
    return "boost" if stale and requested in ("gate", "must") else requested


def covered_names(runs: DataFrame, hits: DataFrame, changed: DataFrame, functions: DataFrame) -> DataFrame:
    """(test_id, covered): the names of the changed functions that each test touches, in the order of the functions, without
    those equal to the one before them. Tests that touch none are absent.

    The changed functions bound a test's list; they meet the hits before anything is grouped.
    """
    named = changed.select("fid").distinct().join(functions.select("fid", "name"), "fid")
    touched = runs.select("test_id", "tid").distinct().join(hits.select("tid", "fid").join(named, "fid"), "tid")
    lists = touched.groupBy("test_id").agg(F.array_sort(F.collect_set(F.struct("fid", "name"))).alias("x"))
    return lists.select("test_id", F.transform(F.filter("x", lambda x, i: (i == 0) | (x["name"] != F.get("x", i - 1)["name"])), lambda x: x["name"]).alias("covered"))


def apply_coverage(candidates: DataFrame, runs: DataFrame, hits: DataFrame, changed: DataFrame, functions: DataFrame, exempt: DataFrame, used: str) -> DataFrame:
    """``candidates`` (test_id, pkg, must, evidence_kind, evidence_n, symbols) with covered, n_hit and gated, and must and
    evidence changed by coverage.

    runs(test_id, tid): tests of the map that a candidate stands for, none if coverage is unknown; hits(tid, fid);
    changed(fid); functions(fid, name). covered: the names that ``covered_names`` lists, n_hit how many; null if coverage is
    unknown, none if the test is known to touch nothing. Evidence by coverage has them as its symbols. ``used``: gate leaves out tests that are known to touch nothing, unless something forces them, they have
    any evidence or their package is exempt; must forces tests that touch something; under all policies touching is evidence
    where there is none.
    """
    touched = covered_names(runs, hits, changed, functions)
    known = runs.select("test_id").distinct().withColumn("_known", F.array().cast("array<string>"))
    rows = candidates.join(known, "test_id", "left").join(touched, "test_id", "left").withColumn("covered", F.coalesce("covered", "_known")).drop("_known")
    rows = rows.withColumn("n_hit", F.when(F.col("covered").isNotNull(), F.size("covered")))
    rows = rows.join(exempt.select("pkg").distinct().withColumn("_exempt", F.lit(True)), "pkg", "left")
    free = F.col("must").isNull() & F.col("evidence_kind").isNull()
    gated = F.lit(used == "gate") & (F.col("n_hit") == 0) & free & F.col("_exempt").isNull()
    covers = (F.col("n_hit") > 0) & F.col("must").isNull()
    fresh = F.col("evidence_kind").isNull() & covers
    kind = F.when(fresh, "Covered").otherwise(F.col("evidence_kind"))
    number = F.when(fresh, F.col("n_hit")).otherwise(F.col("evidence_n"))
    symbols = F.when(fresh, F.col("covered")).otherwise(F.col("symbols"))
    must = F.when(F.lit(used == "must") & covers, "covered").otherwise(F.col("must"))
    return rows.select(*(c for c in candidates.columns if c not in ("must", "evidence_kind", "evidence_n", "symbols")), "covered", "n_hit", F.coalesce(gated, F.lit(False)).alias("gated"), must.alias("must"), kind.alias("evidence_kind"), number.alias("evidence_n"), symbols.alias("symbols"))


def map_counts(functions: DataFrame, tests: DataFrame, hits: DataFrame) -> DataFrame:
    """One row about a map: its files, functions, packages, tests, tests without any function, and hits."""
    f = functions.agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("functions"))
    t = tests.join(hits.select("tid").distinct().withColumn("_any", F.lit(1)), "tid", "left")
    t = t.agg(F.count_distinct("package").alias("packages"), F.count(F.lit(1)).alias("tests"), F.count_if(F.col("_any").isNull()).alias("tests_without"))
    return f.crossJoin(t).crossJoin(hits.agg(F.count(F.lit(1)).alias("hits")))  # one row each


def own_source(file: Column) -> Column:
    """Whether a source file is of the workspace."""
    return ~file.rlike(FOREIGN)


def executed_functions(symbols: DataFrame, items: DataFrame, functions: DataFrame) -> DataFrame:
    """(tid, fid): what tests executed. symbols(tid, symbol); items(symbol, file, key, seq), of which the first counts for
    each symbol; functions(fid, file, name), of which one counts for each file and name: the one of the lowest fid."""
    first = items.groupBy("symbol").agg(F.min_by(F.struct("file", "key"), "seq").alias("x")).select("symbol", "x.file", F.col("x.key").alias("name"))
    one = functions.groupBy("file", "name").agg(F.min("fid").alias("fid"))
    table = first.join(one, ["file", "name"]).select("symbol", "fid")
    return symbols.select("tid", "symbol").distinct().join(table, "symbol").select("tid", "fid").distinct()
