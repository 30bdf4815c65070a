"""Package graphs from the metadata documents of build tools: nested JSON to tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import cut, dependents_of

DOCUMENT = """packages array<struct<id:string,name:string,manifest_path:string,source:string,targets:array<struct<name:string,kind:array<string>>>,
dependencies:array<struct<name:string,path:string>>>>, workspace_members array<string>, workspace_root string, target_directory string, resolve struct<nodes:array<struct<id:string,dependencies:array<string>>>>"""


def parsed(documents: DataFrame, workspace: str = "workspace", text: str = "text") -> DataFrame:
    """(workspace, and the document's fields) of JSON texts, one for each workspace; a text that isn't JSON fails."""
    return documents.select(F.col(workspace).alias("workspace"), F.from_json(text, DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("workspace", "d.*")


def relative_directory(manifest: Column, root: Column) -> Column:
    """The directory of a manifest below the root (empty: the root itself); null outside of it."""
    above = F.regexp_replace(manifest, "/?[^/]*$", "")
    base = F.regexp_replace(root, "/+$", "")
    return F.when(above == base, "").when(above.startswith(F.concat(base, F.lit("/"))), F.substring(above, F.length(base) + 2, F.length(above)))


def _packages(documents: DataFrame) -> DataFrame:
    rows = documents.select("workspace", "workspace_root", "workspace_members", F.posexplode("packages").alias("place", "p"))
    return rows.select("workspace", "place", "p.*", F.coalesce(F.array_contains("workspace_members", F.col("p.id")), F.lit(False)).alias("member"), relative_directory(F.col("p.manifest_path"), F.col("workspace_root")).alias("dir"))


def member_packages(documents: DataFrame) -> DataFrame:
    """(workspace, pkg, name, dir, proc_macro, bins) of each member, pkg being its id. A member outside of the workspace's
    root fails the job."""
    kinds = lambda kind: F.filter("targets", lambda t: F.array_contains(t["kind"], kind))
    rows = _packages(documents).filter("member")
    outside = F.raise_error(F.concat(F.lit("package outside of the workspace: "), F.col("name"))).cast("string")
    return rows.select("workspace", F.col("id").alias("pkg"), "name", F.coalesce("dir", outside).alias("dir"), (F.coalesce(F.size(kinds("proc-macro")), F.lit(0)) > 0).alias("proc_macro"), F.coalesce(F.transform(kinds("bin"), lambda t: t["name"]), F.array().cast("array<string>")).alias("bins"))


def package_users(documents: DataFrame) -> DataFrame:
    """(workspace, src, dst): dst depends on src by a path, both members; of members that share a name the last listed is
    meant. A package doesn't use itself."""
    members = _packages(documents).filter("member")
    named = members.groupBy("workspace", "name").agg(F.max_by("id", "place").alias("src"))
    wanted = members.select("workspace", F.col("id").alias("dst"), F.explode("dependencies").alias("d")).filter("d.path IS NOT NULL").select("workspace", "dst", F.col("d.name").alias("name"))
    return wanted.join(named, ["workspace", "name"]).filter("src <> dst").select("workspace", "src", "dst").distinct()


def path_dependencies(documents: DataFrame) -> DataFrame:
    """(workspace, dir, dependents): packages of the workspace's folder that are no members, with the names of the members that
    use them directly or through any package, sorted; from documents whose resolve part is filled."""
    packages = cut(_packages(documents).select("workspace", "id", "name", "member", "source", "dir"))  # the documents are parsed once
    node = F.struct("workspace", F.col("id").alias("id"))
    named = packages.select(node.alias("node"), "name", "member")
    loose = packages.filter("source IS NULL AND NOT member AND dir IS NOT NULL").select(node.alias("node"), "dir")
    each = documents.select("workspace", F.explode("resolve.nodes").alias("n")).select("workspace", F.col("n.id").alias("user"), F.explode("n.dependencies").alias("used"))
    at = lambda name: F.struct("workspace", F.col(name).alias("id"))
    edges = cut(each.select(at("used").alias("src"), at("user").alias("dst")).distinct())  # every level reads them
    found = dependents_of(loose.select("node"), edges.hint("merge"), named.filter("member").select("node")).join(named.select("node", "name").hint("merge"), "node")
    lists = found.groupBy(F.col("start").alias("node")).agg(F.array_sort(F.collect_set("name")).alias("dependents"))
    return loose.join(lists.hint("merge"), "node", "left").select("node.workspace", "dir", F.coalesce("dependents", F.array().cast("array<string>")).alias("dependents"))
