"""Reach over a graph, level by level, with lineage cut in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets its own, a cluster is refused."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomwright-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` behind a reliable checkpoint in the session's folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def reach(starts: DataFrame, edges: DataFrame, limit: int = 0) -> DataFrame:
    """(start, node, hops): all nodes that each start leads to, with the fewest hops.

    starts(start, node); edges(src, dst). ``limit`` 0 is no limit. Only the last level is joined with the edges, and each
    level is written once.
    """
    seen = level = cut(starts.select("start", "node").distinct().withColumn("hops", F.lit(0)))
    hops = 0
    while not limit or hops < limit:
        hops += 1
        far = level.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        level = cut(far.join(seen.hint("merge"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


#: Positions of a chain that are one key of a join.
BLOCK = 1024


def chains(edges: DataFrame) -> DataFrame:
    """(node, chain, pos) of all nodes of edges(src, dst): each lies on one chain and leads to all of its chain with a lower pos.

    A node is linked with one of its targets, by preference one that few lead to, and a target with one node. Links are
    followed by pointers that double, so a chain of n nodes takes about log2(n) rounds, each of at most a row for each node. The
    nodes of a ring of links all lead to each other and have one pos, the ring's size less 1.
    """
    edges = cut(edges.select("src", "dst").distinct())
    into, out = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("_in")), edges.groupBy("src").agg(F.count(F.lit(1)).alias("_out"))
    asked = edges.join(into.hint("merge"), "dst").groupBy("src").agg(F.min(F.struct("_in", "dst"))["dst"].alias("dst"))
    links = asked.join(out.hint("merge"), "src").groupBy("dst").agg(F.min(F.struct("_out", "src"))["src"].alias("node")).select("node", F.col("dst").alias("at"))
    going = cut(links.withColumns({"hops": F.lit(1).cast("long"), "low": F.least("node", "at")}))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    ended = cut(nodes.join(going.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("at"), F.lit(0).cast("long").alias("hops"), F.col("node").alias("low")))
    left, most = going.count(), 1
    every = left
    while left and most <= every:  # what goes on after more steps than there are links is in rings
        most *= 2
        to = going.withColumn("_ended", F.lit(False)).unionByName(ended.withColumn("_ended", F.lit(True))).toDF("at", "_at", "_hops", "_low", "_ended")
        moved = cut(going.join(to.hint("merge"), "at").select("node", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.least("low", "_low").alias("low"), "_ended"))
        ended = ended.unionByName(moved.filter("_ended").drop("_ended"))  # a part for each round, each written once
        going = moved.filter("NOT _ended").drop("_ended")
        left = going.count()
    placed = ended.select("node", F.col("at").alias("chain"), F.col("hops").alias("pos"))
    if not left:
        return placed
    rings = going.groupBy("low").agg((F.count(F.lit(1)) - 1).alias("pos"))
    return placed.unionByName(going.join(rings, "low").select("node", F.col("low").alias("chain"), "pos"))


def covers(starts: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """(start, chain, pos): each start leads to the nodes of each chain up to a position, and to no others.

    starts(start, node); edges(src, dst); places are the ``chains`` of the edges. A round goes over all edges that leave what
    the last one reached of each chain, so there are as many as changes of chains on the way, and never more than levels.
    A start that no edge has is a chain of its own.
    """
    at = lambda side: places.toDF(side, f"_{side}", f"{side}_pos").hint("merge")
    block = lambda pos: F.floor(pos / BLOCK).alias("block")
    leave = edges.join(at("src"), "src").join(at("dst"), "dst").filter("_src != _dst OR dst_pos > src_pos").groupBy(F.col("_src").alias("chain"), "src_pos", "_dst").agg(F.max("dst_pos").alias("dst_pos"))
    leave = cut(leave.withColumn("block", block(F.col("src_pos"))))
    own = starts.select("start", "node").join(places.hint("merge"), "node", "left")
    first = own.groupBy("start", F.coalesce("chain", "node").alias("chain")).agg(F.max(F.coalesce("pos", F.lit(0))).alias("pos"))
    seen = fresh = cut(first.withColumn("after", F.lit(-1).cast("long")))
    while not fresh.isEmpty():
        known = seen.groupBy("start", "chain").agg(F.max("pos").alias("_known"))
        ranges = fresh.withColumn("block", F.explode(F.sequence(block(F.col("after") + 1), block(F.col("pos")))))
        far = ranges.join(leave, ["chain", "block"]).filter("src_pos > after AND src_pos <= pos").groupBy("start", F.col("_dst").alias("chain")).agg(F.max("dst_pos").alias("pos"))
        after = F.coalesce("_known", F.lit(-1).cast("long"))
        fresh = cut(far.join(known.hint("merge"), ["start", "chain"], "left").filter(F.col("pos") > after).select("start", "chain", "pos", after.alias("after")))
        seen = seen.unionByName(fresh)
    return seen.groupBy("start", "chain").agg(F.max("pos").alias("pos"))


def reach_far(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node): all nodes that each start leads to, itself included, for long thin graphs such as histories.

    It has a row for each pair; ``covers`` has the same by chains, for graphs of which a start reaches much.
    """
    places = cut(chains(edges))
    own = covers(starts, edges, places).withColumnRenamed("pos", "_upto")
    reached = own.join(places.hint("merge"), "chain").filter("pos <= _upto").select("start", "node")
    return reached.unionByName(starts.select("start", "node")).distinct()


def with_whole(reached: DataFrame, whole: DataFrame) -> DataFrame:
    """(node, hops): what was reached, and the nodes of ``whole`` that were not, at 0 hops."""
    near = reached.groupBy("node").agg(F.min("hops").alias("hops"))
    return near.unionByName(whole.select("node").distinct().join(near, "node", "left_anti").withColumn("hops", F.lit(0)))


def dependents_of(starts: DataFrame, users: DataFrame, members: DataFrame) -> DataFrame:
    """(start, node): members that use each start, directly or through any nodes; the start itself is left out.

    starts(node); users(src, dst): dst uses src; members(node).
    """
    found = reach(starts.select(F.col("node").alias("start"), "node"), users).filter("start != node").select("start", "node")
    return found.join(members.select("node").distinct().hint("merge"), "node", "left_semi")


def affected_by_level(nodes: DataFrame, refs: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes that refer to changed ones within ``depth`` levels, all of a level at once.

    nodes(node, is_test); refs(node, target); changed(node). Tests are never affected themselves; one level always runs.
    """
    found = cut(changed.select("node").distinct().withColumn("depth", F.lit(0)))
    plain = nodes.filter("NOT is_test").select("node")
    for level in range(1, max(1, depth) + 1):
        near = refs.join(found.select(F.col("node").alias("target")), "target").select("node").distinct()
        new = cut(near.join(plain, "node").join(found, "node", "left_anti").withColumn("depth", F.lit(level)))
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found
