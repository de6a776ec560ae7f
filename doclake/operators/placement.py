"""Where documents go: names that don't collide within a directory, paths and breadcrumbs.

Names depend on siblings only, so they are settled per directory first, in enumeration order: the first to come keeps the
clean name, later ones carry their id. Paths are then put together from the root by tree contraction, at any depth.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.functions.naming import base_name, id_prefix
from doclake.operators.hierarchy import contract
from doclake.session import cut

CONTAINERS = ("folder", "db")
ORPHANS = "_orphans"
_BEFORE_ALL = -(1 << 31)


def claim_names(siblings: pd.DataFrame) -> pd.DataFrame:
    """Names of one directory's possibly colliding nodes in order of ``ord``: who comes later to a name that is taken gets
    its id, and where that is taken too a number."""
    taken: set[str] = set()
    names = []
    rows = siblings.sort_values(["ord", "id"])
    for base, forced, suffix in zip(rows["base"], rows["forced"], rows["suffix"], strict=True):
        name = base if forced or base.lower() not in taken else base + suffix
        plain, n = name, 2
        while name.lower() in taken:
            name, n = f"{plain}-{n}", n + 1
        taken.add(name.lower())
        names.append(name)
    return rows.assign(name=names)[["platform", "id", "name"]]


def sibling_names(docs: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``docs`` (platform, id, parent, title, ord) with ``name``, unique within (platform, parent) without regard to case,
    also beside the names ``taken`` there (platform, parent, name).

    The plain rule is one window per directory. Only where a name it gives is given twice (an id-suffixed name that is
    another's title, or equal id prefixes) are the nodes whose names share a stem gone through one by one.
    """
    base, forced = base_name(F.col("title"), F.col("id"))
    d = docs.withColumns({"base": base, "forced": forced, "suffix": F.concat(F.lit("-"), id_prefix(F.col("id")))})
    if taken is not None:
        no_id = F.lit(None).cast(docs.schema["id"].dataType)
        seeds = taken.select("platform", "parent", F.col("name").alias("base")).distinct().select("platform", "parent", no_id.alias("id"), "base", F.lit(True).alias("forced"), F.lit("").alias("suffix"), F.lit(_BEFORE_ALL).cast(docs.schema["ord"].dataType).alias("ord"))
        d = d.unionByName(seeds, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("platform", "parent", F.lower("base")).orderBy("ord", "id"))
    d = d.withColumn("name", F.when(F.col("forced") | (first == 1), F.col("base")).otherwise(F.concat("base", "suffix")))
    d = d.withColumn("stem", F.regexp_replace(F.lower("base"), r"(-[^-]{1,8})?(-\d+)*$", ""))
    clash = d.groupBy("platform", "parent", "stem", F.lower("name").alias("low")).agg(F.count("*").alias("n")).where("n > 1").select("platform", "parent", "stem").distinct()
    keys = ["platform", "parent", "stem"]
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    plain = d.alias("d").join(clash.alias("c"), same, "left_anti")
    folded = d.alias("d").join(clash.alias("c"), same, "left_semi").groupBy(*keys).applyInPandas(claim_names, "platform string, id string, name string")
    again = d.drop("name").join(folded, ["platform", "id"])
    extra = ["base", "forced", "suffix", "stem"]
    return plain.where("id IS NOT NULL").drop(*extra).unionByName(again.drop(*extra))


def place(docs: DataFrame) -> DataFrame:
    """Placement of ``docs`` (platform, id, parent_id, type, title, ord): name, dir flag, path, breadcrumb, depth.

    Of an id that comes twice the last ``ord`` holds. Roots have no parent; children of parents that aren't there live in
    a folder ``_orphans`` of their platform. A node with children or of a container type is a directory and, unless a
    container, has its body in a README.md there. What sits in or under a loop of parents is placed nowhere.
    """
    last = docs.groupBy("platform", "id").agg(F.max_by(F.struct("parent_id", "type", "title", "ord"), "ord").alias("d")).select("platform", "id", "d.*")
    last = last.withColumn("title", F.coalesce("title", F.lit("")))
    there = last.select(F.col("platform").alias("_pl"), F.col("id").alias("_id"))
    up = last.join(there, (F.col("platform") == F.col("_pl")) & (F.col("parent_id") == F.col("_id")), "left")
    folder = F.concat(F.col("platform"), F.lit(f":{ORPHANS}"))
    up = up.withColumn("parent", F.when(F.col("parent_id").isNull() | (F.col("parent_id") == ""), F.lit(None)).when(F.col("_id").isNull(), folder).otherwise(F.col("parent_id"))).drop("_pl", "_id")
    homes = up.where(F.col("parent") == folder).select("platform").distinct()
    homes = homes.select("platform", folder.alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("folder").alias("type"), F.lit(ORPHANS).alias("title"), F.lit(1 << 40).cast("bigint").alias("ord"), F.lit(None).cast("string").alias("parent"), F.lit(ORPHANS).alias("name"))
    named = sibling_names(up.withColumn("ord", F.col("ord").cast("bigint"))).unionByName(homes)
    parents = named.where("parent IS NOT NULL").select(F.col("platform").alias("_pl"), F.col("parent").alias("_id")).distinct()
    nodes = named.join(parents, (F.col("platform") == F.col("_pl")) & (F.col("id") == F.col("_id")), "left")
    nodes = nodes.withColumn("is_dir", F.col("_id").isNotNull() | F.col("type").isin(*CONTAINERS)).withColumn("has_body", ~F.col("type").isin(*CONTAINERS)).drop("_pl", "_id")
    nodes = cut(nodes, "named")
    tree = contract(nodes.select(F.col("platform").alias("src"), F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), F.struct("name", "title").alias("step")), paths=True, label="step")
    placed = nodes.join(tree.where("root_id <> ''").select(F.col("src").alias("_pl"), F.col("node_id").alias("_id"), "path", "depth"), (F.col("platform") == F.col("_pl")) & (F.col("id") == F.col("_id")))
    where = F.concat_ws("/", F.col("platform"), F.array_join(F.transform("path", lambda s: s["name"]), "/"))
    crumbs = F.filter(F.transform(F.slice("path", 1, F.size("path") - 1), lambda s: s["title"]), lambda t: t != "")
    return placed.select(
        "platform", "id", "parent_id", "type", "title", "name", "is_dir", "has_body", "depth",
        F.when(F.col("is_dir"), where).alias("dir_path"),
        F.when(~F.col("is_dir"), F.concat(where, F.lit(".md"))).when(F.col("has_body"), F.concat(where, F.lit("/README.md"))).alias("body_path"),
        F.array_join(crumbs, " / ").alias("breadcrumb"),
    )


def on_loops(docs: DataFrame) -> DataFrame:
    """(platform, id) of the nodes that no root reaches."""
    tree = contract(docs.select(F.col("platform").alias("src"), F.col("id").alias("node_id"), F.nullif("parent_id", F.lit("")).alias("parent_id")))
    return tree.where("root_id = ''").select(F.col("src").alias("platform"), F.col("node_id").alias("id"))


def preorder_key(path: Column) -> Column:
    """Sorts paths segment by segment, a shorter one first."""
    return F.split(path, "/")
