"""The ledger of assets (remote_key, sha256, local_path, status): what is known, what is fetched, what waits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("remote_key", "sha256", "local_path", "status")


def _key(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col(name).alias("remote_key")).where("remote_key IS NOT NULL").distinct()


def register(assets: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """``assets`` with those of ``keys`` it hasn't, as pending; known ones stay as they are, also when done."""
    fresh = _key(keys, key).join(assets.select("remote_key"), "remote_key", "left_anti")
    none = F.lit(None).cast("string")
    return assets.select(*COLUMNS).unionByName(fresh.select("remote_key", none.alias("sha256"), none.alias("local_path"), F.lit("pending").alias("status")))


def mark_done(assets: DataFrame, done: DataFrame) -> DataFrame:
    """``assets`` with what was fetched (``done``: key, sha256, path): digest, path and status ``done``; unknown keys are added.
    Of several rows of a key the greatest holds."""
    got = done.where("key IS NOT NULL").groupBy(F.col("key").alias("_k")).agg(F.max(F.struct("sha256", "path")).alias("_d"))
    j = assets.select(*COLUMNS).join(got, F.col("remote_key") == F.col("_k"), "full")
    hit = F.col("_k").isNotNull()
    pick = lambda new, old: F.when(hit, new).otherwise(F.col(old)).alias(old)
    return j.select(F.coalesce("remote_key", "_k").alias("remote_key"), pick(F.col("_d.sha256"), "sha256"), pick(F.col("_d.path"), "local_path"), pick(F.lit("done"), "status"))


def mark_pending(assets: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """``assets`` with ``keys`` pending (again); digest and path that were known stay; unknown keys are added."""
    hit = _key(keys, key).withColumnRenamed("remote_key", "_k")
    j = assets.select(*COLUMNS).join(hit, F.col("remote_key") == F.col("_k"), "full")
    return j.select(F.coalesce("remote_key", "_k").alias("remote_key"), "sha256", "local_path", F.when(F.col("_k").isNotNull(), "pending").otherwise(F.col("status")).alias("status"))


def reusable(assets: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(remote_key) of the assets that needn't be fetched: done, with a path, and the file there when ``files`` (path) tells."""
    have = assets.where("status = 'done' AND coalesce(local_path, '') <> ''")
    if files is not None:
        have = have.join(files.select(F.col("path").alias("local_path")).distinct(), "local_path", "left_semi")
    return have.select("remote_key").distinct()


def settle(assets: DataFrame, refs: DataFrame, fetched: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(next ledger, outcomes) of a round that met ``refs`` (id, key) and fetched ``fetched`` (key, sha256, path).

    Outcomes are (id, key, outcome) per distinct asset of a document: ``reused`` without fetching, ``downloaded``, else
    ``pending``. What isn't there counts as pending in the ledger, whatever it was.
    """
    one = refs.where("id IS NOT NULL AND key IS NOT NULL").select("id", "key").distinct()
    have = reusable(assets, files).select(F.col("remote_key").alias("_have"))
    got = fetched.select(F.col("key").alias("_got")).where("_got IS NOT NULL").distinct()
    j = one.join(have, F.col("key") == F.col("_have"), "left").join(got, F.col("key") == F.col("_got"), "left")
    outcomes = j.select("id", "key", F.when(F.col("_have").isNotNull(), "reused").when(F.col("_got").isNotNull(), "downloaded").otherwise("pending").alias("outcome"))
    asked = outcomes.groupBy("key").agg(F.min("outcome").alias("outcome"))
    known = register(assets, asked)
    done = fetched.join(asked.where("outcome = 'downloaded'").select("key"), "key", "left_semi")
    return mark_pending(mark_done(known, done), asked.where("outcome = 'pending'")), outcomes


def statuses_after(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, status) of the documents of a round: ``pending_assets`` while an asset of theirs waits, else ``active``."""
    waiting = outcomes.where("outcome = 'pending'").select(F.col("id").alias("_w")).distinct()
    return docs.join(waiting, F.col("id") == F.col("_w"), "left").select("id", F.when(F.col("_w").isNotNull(), "pending_assets").otherwise("active").alias("status"))
