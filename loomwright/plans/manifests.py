"""What a changed package manifest asks for, from its two sides as JSON documents (variants)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import cut
from .locks import differing_keys

#: Tables of dependencies in a manifest (fixed values).
DEPENDENCY_TABLES = ("dependencies", "dev-dependencies", "build-dependencies", "dev_dependencies", "build_dependencies")
#: Levels that are taken apart; what lies deeper is compared as one value.
LEVELS = 5


def leaves(documents: DataFrame, of: list[str], text: str = "text", levels: int = LEVELS) -> DataFrame:
    """(of, keys, value): the values of JSON objects that are no objects themselves (or are empty), as JSON, with the keys on
    the way to them. Each level is one map-only step over variants; texts that are no objects have none."""
    rows = documents.select(*of, F.array().cast("array<string>").alias("keys"), F.try_parse_json(text).alias("v"))
    for _ in range(levels):
        fields = F.expr("try_cast(v AS MAP<STRING, VARIANT>)")
        each = rows.select(*of, "keys", "v", F.explode_outer(F.when(F.size(fields) > 0, fields)).alias("key", "inner"))
        deeper = F.col("key").isNotNull()
        rows = each.select(*of, F.when(deeper, F.array_append("keys", F.col("key"))).otherwise(F.col("keys")).alias("keys"), F.when(deeper, F.col("inner")).otherwise(F.col("v")).alias("v"))
    return rows.filter(F.size("keys") > 0).select(*of, "keys", F.to_json("v").alias("value"))


def _key(n: int | Column) -> Column:
    return F.get("keys", F.lit(n) if isinstance(n, int) else n)


def _table_at(shared: bool) -> Column:
    """The place of the key of a dependency table above a leaf; ``shared``: also that of the whole workspace."""
    place = F.when(_key(0).isin(*DEPENDENCY_TABLES), 0).when((_key(0) == "target") & _key(2).isin(*DEPENDENCY_TABLES), 2)
    return place.when((_key(0) == "workspace") & (_key(1) == "dependencies"), 1) if shared else place


def without_member_versions(rows: DataFrame, of: list[str], members: DataFrame) -> DataFrame:
    """``rows`` of ``leaves`` without the versions of members(name): the package's own, the workspace's, and those of
    dependencies that name a member by path."""
    own = (F.concat_ws(".", "keys").isin("package.version", "workspace.package.version")) & F.forall("keys", lambda k: ~k.contains("."))
    placed = rows.filter(~own).withColumn("_at", _table_at(True)).withColumn("_dep", F.when(F.size("keys") > F.col("_at") + 2, F.slice("keys", 1, F.col("_at") + 2)))
    field = _key(F.col("_at") + 2)
    named = F.when((field == "package") & F.col("value").startswith('"'), F.substring("value", 2, F.length("value") - 2))
    deps = placed.filter("_dep IS NOT NULL").groupBy(*of, "_dep").agg(F.max(field == "path").alias("_path"), F.max(named).alias("_real"))
    real = deps.filter("_path").select(*of, "_dep", F.coalesce("_real", F.element_at("_dep", -1)).alias("name"))
    ours = real.join(members.select("name").distinct(), "name", "left_semi").select(*of, "_dep", F.lit(True).alias("_ours"))
    joined = placed.join(ours.hint("merge"), [*of, "_dep"], "left")  # as many as the manifests, however small their files seem
    version = F.col("_ours") & (field == "version") & (F.size("keys") == F.col("_at") + 3)
    return joined.filter(~F.coalesce(version, F.lit(False))).select(*rows.columns)


def manifest_verdicts(manifests: DataFrame, members: DataFrame) -> DataFrame:
    """(manifest, verdict, pkg, why) of manifests(manifest, root, pkg, old, new) with members(name).

    ignore: only members' versions differ; changed: only the package's dependencies; full: anything else of the root, or a
    root that was added, deleted or can't be read; whole: the same of a member's manifest. The root may be a package as well
    (pkg); where it isn't one its dependency tables are like any other.
    """
    sides = manifests.select("manifest", "root", "pkg", F.inline(F.array(F.struct(F.lit("old").alias("side"), F.col("old").alias("text")), F.struct(F.lit("new").alias("side"), F.col("new").alias("text")))))
    sides = sides.repartition("manifest")  # a small file of many manifests is parsed by many tasks
    split = ~F.col("root") | F.col("pkg").isNotNull()
    taken_apart = cut(leaves(sides.withColumn("split", split), ["manifest", "side", "split"]))  # read twice, and dear
    rows = without_member_versions(taken_apart, ["manifest", "side", "split"], members)
    place = F.when(F.col("split"), _table_at(False))
    placed = rows.withColumn("_at", F.coalesce(place, F.lit(0))).withColumn("dependency", place.isNotNull())
    first = F.when(F.col("dependency") & (F.col("_at") == 2), F.concat_ws(".", F.slice("keys", 1, 3))).otherwise(_key(0))
    cells = placed.select("manifest", "side", "dependency", first.alias("k1"), _key(F.col("_at") + 1).alias("k2"), F.struct(F.slice("keys", F.col("_at") + 3, F.greatest(F.size("keys") - F.col("_at") - 2, F.lit(0))).alias("rest"), "value").alias("leaf"))
    packed = cut(cells.groupBy("manifest", "side", "dependency", "k1", "k2").agg(F.to_json(F.array_sort(F.collect_list("leaf"))).alias("value")))
    side = lambda name: packed.filter(F.col("side") == name).drop("side")
    found = differing_keys(side("old"), side("new"), ["manifest", "dependency"])
    told = found.groupBy("manifest").agg(F.max(F.when(F.col("dependency"), F.col("keys"))).alias("deps"), F.max(F.when(~F.col("dependency"), F.col("keys"))).alias("rest"))
    read = lambda c: F.expr(f"try_cast(try_parse_json({c}) AS MAP<STRING, VARIANT>)").isNotNull()
    rows = manifests.join(told.hint("merge"), "manifest", "left")
    harsh = F.when(F.col("root"), "full").otherwise("whole")
    verdict = F.when(F.col("old").isNull() | F.col("new").isNull(), F.struct(harsh.alias("verdict"), F.lit("manifest added or deleted").alias("why")))
    verdict = verdict.when(~read("old") | ~read("new"), F.struct(harsh.alias("verdict"), F.lit("manifest does not parse").alias("why")))
    verdict = verdict.when(F.col("rest").isNotNull(), F.struct(harsh.alias("verdict"), F.concat(F.lit("manifest changed: "), "rest").alias("why")))
    verdict = verdict.when(F.col("deps").isNotNull(), F.struct(F.lit("changed").alias("verdict"), F.concat(F.lit("dependencies changed: "), "deps").alias("why")))
    verdict = verdict.otherwise(F.struct(F.lit("ignore").alias("verdict"), F.lit("only versions of members changed").alias("why")))
    return rows.withColumn("_v", verdict).select("manifest", "_v.verdict", "pkg", "_v.why")
