"""Incremental rounds: where new documents go beside what is there, and which databases to read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.functions.text import container_dir
from doclake.operators.hierarchy import contract
from doclake.operators.placement import CONTAINERS, ORPHANS, sibling_names
from doclake.session import cut

LIVE = ("active", "pending_assets")


def place_new(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, dir, name, path) of documents (platform, id, parent_id, type, title, ord) that the ledger (platform, id, parent_id,
    type, local_path, status) hasn't placed, beside what it has.

    A document goes below its parent if the chain of parents from there leads to a root over live ledger rows and other
    new documents (a leaf becomes a directory), to the platform's directory when it has no parent, else under ``_orphans``.
    Names that are taken there in any case keep their owner: the newcomer gets its id, and a number where that is taken
    too; so do later ones of several newcomers, by ``ord``, then id. No path comes out twice.
    """
    live = ledger.where(F.col("status").isin(*LIVE) & (F.coalesce("local_path", F.lit("")) != ""))
    fresh = docs.join(live.select("id"), "id", "left_anti").withColumn("parent_id", F.nullif("parent_id", F.lit("")))
    # Where each chain ends: at a node without a parent, or at one whose parent isn't there.
    ends = live.select("platform", "id", F.nullif("parent_id", F.lit("")).alias("parent_id")).unionByName(fresh.select("platform", "id", "parent_id"))
    tree = contract(ends.select(F.col("platform").alias("src"), F.col("id").alias("node_id"), "parent_id")).where("root_id <> ''")
    tops = ends.where("parent_id IS NULL").select(F.col("platform").alias("_tp"), F.col("id").alias("_top"))
    whole = tree.join(tops, (F.col("src") == F.col("_tp")) & (F.col("root_id") == F.col("_top")), "left_semi").select(F.col("src").alias("_pl"), F.col("node_id").alias("_id"))
    own = live.select(F.col("platform").alias("_opl"), F.col("id").alias("_oid"), F.regexp_replace(container_dir(F.col("local_path")), r"\.md$", "").alias("_dir"))
    at = lambda pl, id_: (F.col("platform") == F.col(pl)) & (F.col("parent_id") == F.col(id_))
    j = fresh.join(whole, at("_pl", "_id"), "left").join(own, at("_opl", "_oid"), "left")
    fits = F.col("parent_id").isNull() | F.col("_id").isNotNull()
    # The directory by its path where the ledger has it, by the new parent's id where it hasn't.
    known = F.when(~fits, F.concat("platform", F.lit(f"/{ORPHANS}"))).when(F.col("parent_id").isNull(), F.col("platform")).otherwise(F.col("_dir"))
    j = cut(j.select("platform", "id", "type", "title", "ord", known.alias("_known"), F.when(fits & known.isNull(), F.col("parent_id")).alias("_above")), "newcomers")
    parent = F.coalesce(F.concat(F.lit("/"), "_known"), "_above")
    slot = F.regexp_replace(container_dir(F.col("local_path")), r"\.md$", "")
    taken = live.select("platform", F.concat(F.lit("/"), F.regexp_extract(slot, r"^(.*)/[^/]*$", 1)).alias("parent"), F.regexp_extract(slot, r"([^/]*)$", 1).alias("name"))
    wanted = j.withColumn("parent", parent)
    taken = taken.join(wanted.select("platform", "parent").distinct(), ["platform", "parent"], "left_semi")
    named = cut(sibling_names(wanted.withColumn("ord", F.col("ord").cast("bigint")), taken), "newcomers-named")
    # From the directory that the ledger knows down: the names of the new ones on the way.
    chain = contract(named.select(F.col("platform").alias("src"), F.col("id").alias("node_id"), F.col("_above").alias("parent_id"), F.struct("name", "_known").alias("step")), paths=True, label="step")
    placed = named.join(chain.where("root_id <> ''").select(F.col("src").alias("_pl"), F.col("node_id").alias("_id"), F.col("path").alias("steps")), (F.col("platform") == F.col("_pl")) & (F.col("id") == F.col("_id")))
    above = F.transform(F.slice("steps", 1, F.size("steps") - 1), lambda s: s["name"])
    where = F.array_join(F.concat(F.array(F.col("steps")[0]["_known"]), above), "/")
    parents = named.select(F.col("platform").alias("_ppl"), F.col("_above").alias("_pid")).where("_pid IS NOT NULL").distinct()
    held = placed.withColumn("dir", where).join(parents, (F.col("platform") == F.col("_ppl")) & (F.col("id") == F.col("_pid")), "left")
    place = F.concat("dir", F.lit("/"), "name")
    path = F.when(F.col("type").isin(*CONTAINERS), place).when(F.col("_pid").isNotNull(), F.concat(place, F.lit("/README.md"))).otherwise(F.concat(place, F.lit(".md")))
    return held.select("id", "dir", "name", path.alias("path"))


def new_directories(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, old_path, new_path) of ledger leaves that gain their first child in ``docs``."""
    leaves = ledger.where(F.col("status").isin(*LIVE) & F.col("local_path").endswith(".md") & ~F.col("local_path").endswith("/README.md"))
    parents = docs.select(F.col("parent_id").alias("id")).where("id IS NOT NULL").distinct()
    return leaves.join(parents, "id", "left_semi").select("id", F.col("local_path").alias("old_path"), F.regexp_replace("local_path", r"\.md$", "/README.md").alias("new_path"))


def dirty_databases(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id) of databases to read again: those enumerated, and those of enumerated rows that are enumerated or live."""
    dbs = docs.where("type = 'db'").select("id")
    of_rows = docs.where("type = 'db_row'").select(F.col("parent_id").alias("id")).distinct()
    known = ledger.where("status = 'active' AND type = 'db'").select("id").unionByName(dbs)
    return dbs.unionByName(of_rows.join(known, "id", "left_semi")).distinct()
