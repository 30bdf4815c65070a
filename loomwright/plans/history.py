"""How old a coverage map is: its commit's place in the history, from a table of commits and their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import counted
from ..operators.graph import chains, covers, cut


def map_ages(maps: DataFrame, parents: DataFrame) -> DataFrame:
    """``maps`` (map_id, commit, base, head, requested, max_age) with age, stale, used and reason.

    parents(commit, parent). The age is how many commits lie in the history of the base (the head, if the base is no commit
    of the table) and not in that of the map's commit; it is null if the commit is not in the head's history. Such a map and
    one older than max_age are stale: stale says why, and gate and must are used as boost.
    """
    known = parents.select(F.col("commit").alias("base")).union(parents.select("parent")).join(maps.select("base").distinct(), "base", "left_semi").distinct()
    based = maps.join(known.withColumn("_known", F.lit(True)), "base", "left").withColumn("_base", F.when(F.col("_known"), F.col("base")).otherwise(F.col("head"))).drop("_known")
    starts = based.select(F.explode(F.array_distinct(F.array("commit", "_base", "head"))).alias("node")).filter("node IS NOT NULL").distinct()
    edges = parents.filter("parent IS NOT NULL").select(F.col("commit").alias("src"), F.col("parent").alias("dst"))
    places = cut(chains(edges))
    own = cut(covers(starts.select(F.col("node").alias("start"), "node"), edges, places))
    at = starts.join(places.hint("merge"), "node", "left").select(F.col("node").alias("commit"), F.coalesce("chain", "node").alias("chain"), F.coalesce("pos", F.lit(0)).alias("pos"))
    asked = based.filter("head IS NOT NULL").select("head", "commit").distinct().join(at, "commit")
    held = asked.join(own.select(F.col("start").alias("head"), "chain", F.col("pos").alias("_upto")), ["head", "chain"]).filter("pos <= _upto").select("head", "commit", F.lit(True).alias("_held"))
    rows = based.join(held, ["head", "commit"], "left")
    pairs = rows.filter("_held").select("commit", "_base").distinct()
    newer = pairs.join(own, F.col("_base") == F.col("start")).select("commit", "_base", "chain", "pos")
    older = own.select(F.col("start").alias("commit"), "chain", F.col("pos").alias("_old"))
    more = F.greatest(F.col("pos") - F.coalesce("_old", F.lit(-1)), F.lit(0))
    counts = newer.join(older, ["commit", "chain"], "left").groupBy("commit", "_base").agg(F.sum(more).alias("_age"))
    rows = rows.join(counts, ["commit", "_base"], "left").withColumn("age", F.when(F.col("_held"), F.coalesce("_age", F.lit(0))))
    stale = F.when(F.col("age").isNull(), F.concat(F.lit("built at "), F.substring("commit", 1, 12), F.lit(", which is not in the head's history")))
    stale = stale.when(F.col("age") > F.col("max_age"), F.concat(counted(F.col("age"), "commit"), F.lit(" behind, at most "), F.col("max_age").cast("string"), F.lit(" allowed")))
    lowered = stale.isNotNull() & F.col("requested").isin("gate", "must")
    reason = F.when(lowered, F.concat(F.lit("stale map ("), stale, F.lit("): "), F.col("requested"), F.lit(" → boost")))
    return rows.select(*maps.columns, "age", stale.alias("stale"), F.when(lowered, "boost").otherwise(F.col("requested")).alias("used"), reason.alias("reason"))
