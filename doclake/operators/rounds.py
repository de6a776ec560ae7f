"""A whole round: inventory and bodies in, the next ledger and what changed out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.operators import changes, ledger, placement
from doclake.session import cut


@dataclass
class Round:
    """What a round gives; DataFrames are lazy but for ``placed``, which is written down."""

    placed: DataFrame
    outcomes: DataFrame
    deletes: DataFrame
    documents: DataFrame
    links: DataFrame
    aliases: DataFrame
    stats: DataFrame


def run_round(inventory: DataFrame, bodies: DataFrame, old: dict[str, DataFrame], now: str, full: bool = False) -> Round:
    """One full round over ``inventory`` (:data:`doclake.sources.inventory.REMOTE_DOC`) and ``bodies`` (id, body).

    ``old``: ``documents`` (id, platform, type, parent_id, title, local_path, remote_edited, content_hash, synced_at, status),
    ``links`` (from_id, to_id), ``aliases`` (alias, doc_id). The hash is of the raw body; a body that is missing has none.
    Documents that are gone are marked trashed unless the enumeration is suspiciously short.
    """
    from doclake.operators.rewrite import url_tokens
    from doclake.sources.inventory import last_delivery

    docs = last_delivery(inventory)
    placed = cut(placement.place(docs.select("platform", "id", "parent_id", "type", "title", "ord")), "placed")
    hashed = bodies.select("id", F.sha2("body", 256).alias("hash"))
    path = F.coalesce("body_path", "dir_path")
    new = placed.join(docs.select("platform", "id", F.col("edited_at").alias("edited")), ["platform", "id"], "left").join(hashed, "id", "left").withColumn("path", path)
    led = old["documents"]
    seen = led.select("id", "platform", F.col("local_path").alias("path"), F.col("remote_edited").alias("edited"), F.col("content_hash").alias("hash"), "status")
    outcomes = changes.classify(new.select("id", "platform", "path", "edited", "hash"), seen, full)
    deletes = changes.guarded_deletes(new.select("id", "platform"), seen)
    rows = new.select(
        "id", "platform", "type", "parent_id", "title", F.col("path").alias("local_path"), F.col("edited").alias("remote_edited"),
        F.col("hash").alias("content_hash"), F.lit(now).alias("synced_at"), F.lit("active").alias("status"),
    )
    merged = ledger.upsert(led.select(*rows.columns), rows, ["id"])
    documents = ledger.mark(merged, deletes, "id", status=F.lit("trashed"), synced_at=F.lit(now))
    found = bodies.select(F.col("id").alias("from_id"), F.explode(url_tokens(F.col("body"))).alias("u")).select("from_id", F.col("u.token").alias("to_id"))
    links = ledger.insert_ignore(old["links"], found, ["from_id", "to_id"])
    alias = docs.select(F.col("alt_id").alias("alias"), F.col("id").alias("doc_id"), F.col("ord").alias("seq"))
    aliases = ledger.upsert_alias(old["aliases"], alias, "seq")
    stats = outcomes.groupBy("platform").agg(*(F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("added", "updated", "skipped", "gone")), F.count(F.when(F.col("moved"), 1)).alias("moved"))
    return Round(placed, outcomes, deletes, documents, links, aliases, stats)


def run_record(before: DataFrame, stats: DataFrame, started: str, finished: str, mode: str) -> DataFrame:
    """``before`` (id, platform, started_at, finished_at, checkpoint, stats) with one more record per platform of ``stats``;
    its stats as JSON; ids go on from the greatest."""
    top = before.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    counts = [c for c in stats.columns if c != "platform"]
    # There are a handful of platforms: numbering them in one task is bounded.
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("platform"))
    rows = stats.withColumn("nth", nth).select(
        (F.lit(top) + F.col("nth")).cast("bigint").alias("id"), "platform", F.lit(started).alias("started_at"), F.lit(finished).alias("finished_at"), F.lit("").alias("checkpoint"),
        F.to_json(F.struct(F.lit(mode).alias("mode"), *counts)).alias("stats"),
    )
    return before.select(*rows.columns).unionByName(rows)
