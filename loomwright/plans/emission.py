"""What to run: one filter expression, or one command for each package, from the selected candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import filter_packages, names_term, shell_quote

#: Beginnings of the commands of both runners (fixed values).
FILTERED, PLAIN = ("cargo", "nextest", "run"), ("cargo", "test")


def _words(*each: str | Column) -> Column:
    return F.array(*(F.lit(w) if isinstance(w, str) else w for w in each)).cast("array<string>")


def package_terms(candidates: DataFrame, reached: DataFrame, packages: DataFrame, whole: DataFrame) -> DataFrame:
    """(hops, name, term, changed): for each package with something to run, the term of its filter and that of its tests that
    changed themselves (null if none). A package that runs whole is named alone, and has no term of changed tests.

    candidates(pkg, name, must, selected); reached(pkg, hops); packages(pkg, name); whole(pkg).
    """
    of = lambda some: F.collect_set(F.when(some, F.col("name")))
    tests = candidates.groupBy("pkg").agg(of(F.col("selected")).alias("tests"), of(F.col("must") == "changed").alias("fresh"))
    rows = reached.join(packages.select("pkg", "name"), "pkg").join(tests, "pkg", "left").join(whole.select("pkg").distinct().withColumn("_whole", F.lit(True)), "pkg", "left")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    own = F.when(F.col("_whole"), F.concat(F.lit("package(="), "name", F.lit(")"))).when(some("tests"), names_term(F.col("name"), F.col("tests")))
    fresh = F.when(F.col("_whole").isNull() & some("fresh"), names_term(F.col("name"), F.col("fresh")))
    return rows.select("hops", "name", own.alias("term"), fresh.alias("changed")).filter("term IS NOT NULL")


def filter_plan(terms: DataFrame, never: tuple[str, ...] = (), extras: tuple[str, ...] = (), full: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """(filter, command): one row with the filter expression and the command of the runner that takes one; null where there is
    nothing to narrow, or nothing to run.

    terms as of ``package_terms``, joined by (hops, name). Tests of ``never`` are left out, except those that changed; ``extras``
    are filters that are always added. If everything runs, only ``never`` narrows. The command names the packages of the terms
    and of the extras, or the workspace if an extra names none. The result is one expression, so it is one row; a term for
    each package is all that it gathers.
    """
    either = " | ".join(never)
    if full:
        text = F.lit(f"all() & not ({either})" if never else None).cast("string")
        command = F.concat(_words(*FILTERED, "--workspace"), _words("-E", text) if never else _words(), _words(*more))
        return terms.agg(F.lit(0)).select(text.alias("filter"), command.alias("command"))
    one = terms.agg(F.array_sort(F.collect_list(F.struct("hops", "name", "term", "changed"))).alias("t"))
    wrap = lambda c: F.concat(F.lit("("), c, F.lit(")"))
    chosen = F.array_join(F.transform("t", lambda x: wrap(x["term"])), " | ")
    fresh = F.transform(F.filter("t", lambda x: x["changed"].isNotNull()), lambda x: wrap(x["changed"]))
    own = F.when(F.size("t") == 0, _words()).when(F.lit(not never), F.array(chosen)).otherwise(F.concat(F.array(F.concat(F.lit("(("), chosen, F.lit(f") & not ({either}))"))), fresh))
    parts = F.concat(own, _words(*(f"({e})" for e in extras)))
    named = [filter_packages(F.lit(e)) for e in extras]
    everywhere = F.coalesce(*(F.when(F.size(n) == 0, True) for n in named), F.lit(False))
    packages = F.array_distinct(F.concat(F.transform("t", lambda x: x["name"]), *named))
    which = F.when(everywhere, _words("--workspace")).otherwise(F.flatten(F.transform(packages, lambda p: F.array(F.lit("-p"), p))))
    text = F.when(F.size(parts) > 0, F.array_join(parts, " | "))
    return one.select(text.alias("filter"), which.alias("_which")).select("filter", F.when(F.col("filter").isNotNull(), F.concat(_words(*FILTERED), "_which", _words("-E", F.col("filter")), _words(*more))).alias("command"))


def package_commands(candidates: DataFrame, reached: DataFrame, packages: DataFrame, whole: DataFrame, extras: tuple[str, ...] = (), full: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """(hops, name, command): the commands of the runner that takes names instead of a filter, one for each package.

    A package that runs whole, or that an extra names, has no names behind it; else the full names of its selected tests,
    candidates(pkg, module, name, selected), follow ``--``. Packages that only an extra names have null hops and run last.
    If everything runs there is one command, of null name.
    """
    if full:
        none = lambda kind: F.lit(None).cast(kind)
        return packages.agg(F.lit(0)).select(none(reached.schema["hops"].dataType).alias("hops"), none("string").alias("name"), _words(*PLAIN, "--workspace", *more).alias("command"))
    test = F.when(F.coalesce("module", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws("::", "module", "name"))
    tests = candidates.filter("selected").groupBy("pkg").agg(F.array_sort(F.collect_set(test)).alias("tests"))
    every = F.flatten(F.array(F.array().cast("array<string>"), *(filter_packages(F.lit(e)) for e in extras)))
    rows = reached.join(packages.select("pkg", "name"), "pkg").join(tests, "pkg", "left").join(whole.select("pkg").distinct().withColumn("_whole", F.lit(True)), "pkg", "left")
    all_of_it = F.col("_whole").isNotNull() | F.array_contains(every, F.col("name"))
    own = rows.filter(all_of_it | F.col("tests").isNotNull()).select("hops", "name", F.when(~all_of_it, F.col("tests")).alias("tests"))
    named = packages.agg(F.lit(0)).select(F.explode(F.array_distinct(every)).alias("name")).join(own.select("name"), "name", "left_anti")
    both = own.unionByName(named.select(F.lit(None).cast(reached.schema["hops"].dataType).alias("hops"), "name", F.lit(None).cast("array<string>").alias("tests")))
    behind = F.when(F.col("tests").isNotNull(), F.concat(_words("--"), "tests")).otherwise(_words())
    return both.select("hops", "name", F.concat(_words(*PLAIN, "-p", F.col("name"), *more), behind).alias("command"))


def runner_notes(spark, never: tuple[str, ...], extras: tuple[str, ...]) -> DataFrame:  # noqa: ANN001
    """(note): what the runner without filters can't express of the settings."""
    rows = spark.createDataFrame([(n, e) for n, e in enumerate(extras)], "place int, expression string")
    lost = rows.filter(F.size(filter_packages(F.col("expression"))) == 0).select(F.concat(F.lit("no runner without filters can express: "), "expression").alias("note"))
    quiet = spark.createDataFrame([(f"a runner without filters ignores: {', '.join(never)}",)] if never else [], "note string")
    return quiet.unionByName(lost)


def command_line(command: Column) -> Column:
    """A command as one line of a shell."""
    return F.array_join(F.transform(command, shell_quote), " ")
