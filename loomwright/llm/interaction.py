"""Audit of how filters interact, by depth-first execution of the trie of their orders.

Every order of the filters is a path from the root. What survives a prefix does not depend on the prefix's order, so prefixes with
the same filters are one state: 2**k states stand for the k! orders. The walk goes depth first; at a state the survivors
are a persisted DataFrame, one aggregation applies each filter that is left to them and counts by part what it removes, and
each state that has not been visited yet is entered with the survivors of that filter. A state is visited once, and at most k
DataFrames are persisted at a time. Texts are read once: what the filters test is measured for each document, with the
first key of each text, found by its SHA-256 over the whole table, and written as a table that all survivors go back to.

Counts are tables by part, never on the driver; parts with many rows are added up before the shuffle, and rows of a text
that many documents share meet the text's first key where they are. The orders' rows are looked up from a part's edges.

Defined cases: a null text is empty, a null part the empty string; documents without a key are never copies and make none;
a document has a label if any row of its key has it, and none without a key; rows that repeat a key count each; an empty
table gives an empty result, empty labels give zeros. Other columns are never read.
"""

from __future__ import annotations

import functools
import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import SPACES, let
from .skew import spread_join
from .storage import materialise
from .tables import table

COUNTS = ("kept", "removed", "good_lost", "toxic_lost")


def production_filters() -> dict[str, Column]:
    """Filters by name (one letter each): the condition on which a document fails, over the columns of ``measured``."""
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_upper") > 2 * F.col("n_chars"),
        "D": F.col("marked"),
        "E": F.col("copy"),
    }


def measured(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", label_key: str = "doc_id") -> DataFrame:
    """(part, n_words, n_distinct, n_upper, n_chars, marked, copy, good, toxic) for each document, as a written table."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = let(F.array_remove(F.split(t, SPACES), ""), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), t.alias("t"), words.alias("w"))
    upper = F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    each = materialise(rows.select("key", "part", F.unhex(F.sha2("t", 256)).alias("digest"), F.col("w.n").cast("long").alias("n_words"), F.col("w.d").cast("long").alias("n_distinct"), upper.cast("long").alias("n_upper"), F.length("t").cast("long").alias("n_chars"), F.col("t").rlike("[#$%&*|]").alias("marked")), "audit-measures")
    first = each.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("members"))
    known = spread_join(each, first, ["digest"]).withColumn("copy", F.coalesce(F.col("key") > F.col("first"), F.lit(False))).drop("digest", "first")
    marks = labels.filter(F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    own = [c for c in known.columns if c != "key"]
    labelled = known.filter(F.col("key").isNotNull()).join(marks, "key", "left").select(*own, flag("good"), flag("toxic"))
    without = known.filter(F.col("key").isNull()).select(*own, F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return materialise(labelled.unionByName(without), "audit-survivors")


def _edges(survivors: DataFrame, state: str, left: dict[str, Column]) -> DataFrame:
    """(part, state, filter, counts): what each filter that is left does to the survivors of a state."""
    fails = {name: F.coalesce(c, F.lit(False)) for name, c in left.items()}
    sums = {"n": F.count(F.lit(1))}
    for name, c in fails.items():
        sums |= {f"removed_{name}": F.count_if(c), f"good_{name}": F.count_if(c & F.col("good")), f"toxic_{name}": F.count_if(c & F.col("toxic"))}
    counted = survivors.groupBy("part").agg(*(c.alias(name) for name, c in sums.items()))
    each = [F.struct(F.lit(state).alias("state"), F.lit(name).alias("filter"), (F.col("n") - F.col(f"removed_{name}")).alias("kept"), F.col(f"removed_{name}").alias("removed"), F.col(f"good_{name}").alias("good_lost"), F.col(f"toxic_{name}").alias("toxic_lost")) for name in fails]
    return counted.select("part", F.inline(F.array(*each)))


def walk(survivors: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """(part, state, filter, counts) of every edge of the trie; a state is the sorted names of the filters before it."""
    found: dict[str, DataFrame] = {}

    def visit(state: str, rows: DataFrame) -> None:
        left = {name: c for name, c in filters.items() if name not in state}
        inner = len(left) > 1
        if inner:
            rows.persist()
        found[state] = materialise(_edges(rows, state, left), "audit-edges")
        for name, fails in left.items() if inner else ():
            below = "".join(sorted(state + name))
            if below not in found:
                visit(below, rows.filter(~F.coalesce(fails, F.lit(False))))
        if inner:
            rows.unpersist()

    if filters:
        visit("", survivors)
    return functools.reduce(DataFrame.unionByName, found.values())


def by_order(edges: DataFrame, filters: list[str]) -> DataFrame:
    """A row for each part, order of the filters and step, looked up among the part's edges."""
    steps = [{"filter_order": "".join(o), "step": k + 1, "filter": f, "state": "".join(sorted(o[:k])), "others": "".join(sorted(set(filters) - {f}))} for o in itertools.permutations(filters) for k, f in enumerate(o)]
    literal = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, filter string, state string, others string>>")
    name = lambda state, f: F.concat_ws(">", state, f)
    looked_up = edges.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(name(F.col("state"), F.col("filter")), F.struct(*COUNTS)))).alias("edges"))
    rows = looked_up.select("part", "edges", F.inline(literal))
    at = lambda state, count: F.coalesce(F.col("edges")[name(state, F.col("filter"))][count], F.lit(0))  # noqa: E731  no edge: nothing of the part survives
    here = {c: at(F.col("state"), c) for c in COUNTS}
    redundant, alone = at(F.lit(""), "removed") - here["removed"], at(F.col("others"), "removed")
    out = rows.select("part", "filter_order", "step", "filter", *(v.alias(c) for c, v in here.items()), redundant.alias("redundant"), alone.alias("unique_fails"))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = production_filters()
    survivors = measured(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    audit = by_order(walk(survivors, filters), list(filters))
    return audit.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley", "filter")


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
f AS (SELECT part, doc_id, CAST(len(ws) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS fails FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter,
    CAST(contains(left(filter_order, step - 1), 'A') AS INTEGER) + 2 * CAST(contains(left(filter_order, step - 1), 'B') AS INTEGER) + 4 * CAST(contains(left(filter_order, step - 1), 'C') AS INTEGER)
      + 8 * CAST(contains(left(filter_order, step - 1), 'D') AS INTEGER) + 16 * CAST(contains(left(filter_order, step - 1), 'E') AS INTEGER) AS prefix, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit
  FROM o, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
k AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter,
    coalesce(sum(n) FILTER (fails & (prefix | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & prefix = 0 AND fails & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (fails & prefix > 0 AND fails & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails & prefix = 0 AND fails & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails & prefix = 0 AND fails & bit > 0), 0) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley, filter
FROM k
"""
