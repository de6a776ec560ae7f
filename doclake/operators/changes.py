"""Change data capture: an inventory against the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GUARD = 0.8


def classify(inventory: DataFrame, ledger: DataFrame, full: bool = False) -> DataFrame:
    """Outcome per id of ``inventory`` and ``ledger`` (id, platform, path, edited, hash; ledger also status).

    ``added``: not in the ledger. ``skipped``: active with the same edit time, or the same hash. ``updated``: otherwise,
    also for an id that is back from the trash. ``gone``: active in the ledger and not in the inventory. Other ledger rows
    don't come out. ``moved`` tells whether a known, untrashed document has a new path. With ``full`` nothing is skipped.
    """
    new = inventory.select("id", "platform", F.col("path").alias("new_path"), F.col("edited").alias("new_edited"), F.col("hash").alias("new_hash"), F.lit(True).alias("_new"))
    old = ledger.select(F.col("id").alias("old_id"), F.col("platform").alias("old_platform"), F.col("path").alias("old_path"), F.col("edited").alias("old_edited"), F.col("hash").alias("old_hash"), "status")
    j = new.join(old, F.col("id") == F.col("old_id"), "full")
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    same_time = active & (F.coalesce("new_edited", F.lit("")) != "") & F.col("new_edited").eqNullSafe(F.col("old_edited"))
    same_hash = active & F.col("new_hash").isNotNull() & F.col("new_hash").eqNullSafe(F.col("old_hash"))
    outcome = (
        F.when(F.col("_new").isNull(), F.when(active, "gone"))
        .when(F.col("old_id").isNull(), "added")
        .when(F.lit(not full) & (same_time | same_hash), "skipped")
        .otherwise("updated")
    )
    moved = F.col("_new").isNotNull() & F.col("old_id").isNotNull() & (F.coalesce("status", F.lit("")) != "trashed") & (F.coalesce("old_path", F.lit("")) != "") & ~F.col("old_path").eqNullSafe(F.col("new_path"))
    return j.select(F.coalesce("id", "old_id").alias("id"), F.coalesce("platform", "old_platform").alias("platform"), outcome.alias("outcome"), moved.alias("moved"), "old_path", "new_path").where("outcome IS NOT NULL")


def guarded_deletes(inventory: DataFrame, ledger: DataFrame) -> DataFrame:
    """(platform, id, path) to be trashed: active in the ledger, not enumerated, on platforms whose enumeration isn't
    suspiciously short (under 80 % of what is active)."""
    active = ledger.where("status = 'active'")
    n_active = active.groupBy("platform").agg(F.count("*").alias("n_active"))
    n_seen = inventory.groupBy("platform").agg(F.count("*").alias("n_seen"))
    ok = n_active.join(n_seen, "platform", "left").where(F.coalesce("n_seen", F.lit(0)) >= F.col("n_active") * GUARD).select("platform")
    gone = active.join(inventory.select("id"), "id", "left_anti")
    return gone.join(F.broadcast(ok), "platform", "left_semi").select("platform", "id", "path")


def chain_moves(moves: DataFrame) -> DataFrame:
    """(id, old_path, new_path) over several rounds of ``moves`` (seq, id, old_path, new_path): first old, last new."""
    return moves.groupBy("id").agg(F.min_by("old_path", "seq").alias("old_path"), F.max_by("new_path", "seq").alias("new_path"))


def deepest_first(df: DataFrame, path: str) -> DataFrame:
    """``df`` in the order in which paths are deleted: by bytes, the longest first; null last."""
    return df.orderBy(F.desc_nulls_last(F.octet_length(path)), F.col(path))


def shallow_first(df: DataFrame, path: str) -> DataFrame:
    """``df`` in the order in which paths are made: by depth; null last."""
    return df.orderBy(F.asc_nulls_last(F.size(F.split(path, "/"))), F.col(path))
