"""The ledger: snapshots merged by key, inserts that don't overwrite, purges, checks.

A ledger table is an immutable snapshot; each function takes one and gives the next. Where a key comes several times in
what is merged in, the row with the greatest ``seq`` holds (ties: the greatest row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key, without ``seq``. Aggregated before it is shuffled, so a key with many rows costs no more."""
    rest = [c for c in rows.columns if c not in (*keys, seq)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key, or added. Rows with a null key only add."""
    new = last_per_key(new, keys, seq) if seq else new
    return new.select(*old.columns).unionByName(old.join(new.select(*keys), keys, "left_anti"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with those rows of ``new`` whose key it hasn't; of equal keys in ``new`` one row."""
    fresh = new.select(*old.columns).dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh)


def upsert_alias(aliases: DataFrame, new: DataFrame, seq: str) -> DataFrame:
    """Aliases with the new ones; the last holds; empty aliases and targets are passed over."""
    good = new.where((F.coalesce("alias", F.lit("")) != "") & (F.coalesce("doc_id", F.lit("")) != ""))
    return upsert(aliases, good, ["alias"], seq)


def mark(rows: DataFrame, keys: DataFrame, on: str, **values: Column) -> DataFrame:
    """``rows`` with the columns ``values`` set where their key is among ``keys``."""
    hit = keys.select(F.col(on).alias("_k")).distinct()
    j = rows.join(hit, F.col(on) == F.col("_k"), "left")
    return j.withColumns({c: F.when(F.col("_k").isNotNull(), v).otherwise(F.col(c)) for c, v in values.items()}).drop("_k")


def purge_trashed(docs: DataFrame, before: str) -> DataFrame:
    """``docs`` without the trashed ones last synced before ``before`` (RFC 3339 text); unknown sync times stay."""
    return docs.where(~((F.coalesce("status", F.lit("")) == "trashed") & (F.coalesce("synced_at", F.lit("~")) < before)))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness, with their counts; null keys don't count."""
    known = rows
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
