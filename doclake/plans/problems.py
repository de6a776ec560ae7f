"""Queries p1 to p5: the general problems of a large document pipeline, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.functions.ids import canonical_id
from doclake.operators import hierarchy as H
from doclake.operators import orphans as O
from doclake.operators import shred as S
from doclake.operators import snapshot_diff as D
from doclake.operators import timezones as Z
from doclake.session import ship, spread, table


def _raw_records(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    rows = table(spark, d, "query_rows").select(F.lit("query_rows").alias("src"), "raw_id", F.col("properties").alias("text"))
    cells = table(spark, d, "bitable_records").select(F.lit("bitable_records").alias("src"), "raw_id", F.col("fields").alias("text"))
    return spread(rows.unionByName(cells))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every inner object and array member of the raw records, with the one around it."""
    return S.nodes(_raw_records(spark, d), ["src", "raw_id"], "text")


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """The related flat tables of the raw records."""
    return S.tables(_raw_records(spark, d), ["src", "raw_id"], "text")


_TIMES = (("notion_objects", "last_edited_time"), ("feishu_metas", "latest_modify_time"), ("drive_files", "modified_time"))


def _times(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    parts = [table(spark, d, t).select(F.lit(t).alias("src"), "rec_id", "space_id", F.col(c).alias("time_text")) for t, c in _TIMES]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    spaces = table(spark, d, "spaces").select("space_id", "tz", "date_order")
    return Z.to_utc(rows.join(spaces, "space_id", "left"), F.col("time_text"), F.col("tz"), F.col("date_order"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The instant of each record whose time text means exactly one."""
    return _times(spark, d).where("utc_us IS NOT NULL").select("src", "rec_id", "utc_us")


def p2_cases(spark: SparkSession, d: str) -> DataFrame:
    """How the time texts of each table came out."""
    return _times(spark, d).groupBy("src", "time_case").agg(F.count("*").alias("n"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    links, ledger = table(spark, d, "links"), table(spark, d, "ledger_documents")
    ends = [
        links.select(F.lit(f"links.{c}").alias("src"), F.col("link_id").cast("string").alias("holder"), canonical_id(F.col(c)).alias("ref_id"), F.col("seen_at").alias("ref_time"))
        for c in ("from_id", "to_id")
    ]
    parents = ledger.where("NOT status <=> 'trashed'").select(
        F.lit("ledger_documents.parent_id").alias("src"), canonical_id(F.col("id")).alias("holder"), canonical_id(F.col("parent_id")).alias("ref_id"), F.col("first_seen_at").alias("ref_time")
    )
    records = ledger.select(canonical_id(F.col("id")).alias("id"), (F.col("status") == "trashed").alias("deleted"), "first_seen_at")
    return ends[0].unionByName(ends[1]).unionByName(parents), records


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References to ledger documents that never came, were trashed or came later."""
    ship(spark)
    return O.orphan_references(*_references(spark, d))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field, month and kind."""
    return p3_found(spark, d).groupBy("src", "period", "kind").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """What was added, removed or changed from each ledger snapshot to the next."""
    fields = ["title", "local_path", "status"]
    rows = table(spark, d, "ledger_snapshots").select("snap_no", canonical_id(F.col("id")).alias("id"), "loaded_at", *fields)
    return D.snapshot_changes(rows, fields)


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Changes per snapshot, kind and field."""
    return p4_found(spark, d).groupBy("snap_no", "change", "field").agg(F.count("*").alias("n"))


def _parents(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t, node, parent: table(spark, d, t).select(F.lit(t).alias("src"), canonical_id(F.col(node)).alias("node_id"), canonical_id(F.col(parent)).alias("parent_id"))
    return of("ledger_documents", "id", "parent_id").unionByName(of("wiki_nodes", "node_token", "parent_node_token"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and number of descendants of each node; nodes that no root reaches."""
    return H.contract(_parents(spark, d))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path of each node that a root reaches, as ids from the root joined by '/'."""
    found = H.contract(_parents(spark, d), paths=True)
    return found.where("root_id <> ''").select("src", "node_id", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every (node, descendant) pair with its distance, for nodes that a root reaches."""
    found = H.contract(_parents(spark, d), paths=True).where("root_id <> ''")
    above = found.select("src", F.col("node_id").alias("desc_id"), "depth", F.posexplode("path").alias("at", "node_id"))
    return above.where("at < depth").select("src", "node_id", "desc_id", (F.col("depth") - F.col("at")).alias("dist"))
