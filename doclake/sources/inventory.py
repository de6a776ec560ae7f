"""Inventories of documents from landed platform records.

Every scan gives the same relation, :data:`REMOTE_DOC`: metadata only, one row per delivered object; ``ord`` is the order of
enumeration, which naming depends on. Objects that are delivered again come out again; :func:`last_delivery` keeps the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.ids import canonical_id, strip

REMOTE_DOC = "id string, alt_id string, platform string, type string, parent_id string, title string, edited_at string, url string, ord bigint"
#: Object types of one platform and what they are here; others are files.
OBJECT_TYPES = {"doc": "docx", "docx": "docx", "sheet": "sheet", "bitable": "bitable", "slides": "slides", "mindnote": "mindnote", "folder": "folder", "file": "file"}
UNRESOLVED = "notion:unresolved"


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def dashless(c: Column) -> Column:
    return F.lower(F.replace(strip(c), F.lit("-"), F.lit("")))


def doc_type(obj_type: Column) -> Column:
    """The document type of a platform's object type; unknown ones are files."""
    out = F.when(obj_type.isNull(), "file")
    for k, v in OBJECT_TYPES.items():
        out = out.when(obj_type == k, v)
    return out.otherwise("file")


def rfc3339(t: Column) -> Column:
    """An RFC 3339 time in whole seconds UTC; '' when it is none."""
    good = t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return _blank(F.date_format(F.when(good, t).try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def unix_time(t: Column) -> Column:
    """Unix seconds as RFC 3339 UTC; '' when it is no whole number."""
    return _blank(F.date_format(F.timestamp_seconds(F.when(t.rlike(r"^[0-9]{1,11}$"), t).try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def notion(objects: DataFrame) -> DataFrame:
    """Pages and data sources that are neither trashed nor archived.

    A page under a data source is a database row. A data source is a database; its alias is the dashless database id. Where
    the parent pointer leads nowhere, the first id it holds is given, or a constant, so that the document is an orphan.
    """
    o = objects.where("object IN ('page', 'data_source')").where(~(F.coalesce("in_trash", F.lit(False)) | F.coalesce("is_archived", F.lit(False))))
    p = F.col("parent")
    lost = F.coalesce(canonical_id(p["page_id"]), canonical_id(p["data_source_id"]), canonical_id(p["database_id"]), F.lit(UNRESOLVED))
    parent = F.when(p["type"] == "workspace", "").when(p["type"] == "page_id", _blank(canonical_id(p["page_id"]))).when(p["type"] == "data_source_id", _blank(canonical_id(p["data_source_id"]))).otherwise(lost)
    page = F.col("object") == "page"
    return o.select(
        canonical_id(F.col("id")).alias("id"),
        F.when(page, dashless(F.col("id"))).otherwise(_blank(dashless(p["database_id"]))).alias("alt_id"),
        F.lit("notion").alias("platform"),
        F.when(~page, "db").when(p["type"] == "data_source_id", "db_row").otherwise("page").alias("type"),
        parent.alias("parent_id"),
        F.when(page, _blank(F.col("title"))).otherwise(F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled Database"))).alias("title"),
        rfc3339(F.col("last_edited_time")).alias("edited_at"),
        _blank(F.col("url")).alias("url"),
        F.col("rec_id").alias("ord"),
    )


def wiki(nodes: DataFrame, spaces: DataFrame) -> DataFrame:
    """Wiki spaces as roots (``feishu:wiki:<space>``, ``wiki-<name>``) and their nodes; parents named by node become
    documents, parents that aren't there the space's root."""
    n = nodes.distinct().withColumn("node_token", strip(F.col("node_token"))).withColumn("parent_node_token", strip(F.col("parent_node_token")))
    root = lambda c: F.concat(F.lit("feishu:wiki:"), c)
    up = n.select(F.col("node_token").alias("_n"), F.col("obj_token").alias("_o")).groupBy("_n").agg(F.min("_o").alias("_o"))
    docs = n.join(up, F.col("parent_node_token") == F.col("_n"), "left").select(
        strip(F.col("obj_token")).alias("id"), F.col("node_token").alias("alt_id"), F.lit("feishu").alias("platform"), doc_type(F.col("obj_type")).alias("type"),
        F.coalesce("_o", root(F.col("space_id"))).alias("parent_id"), _blank(F.col("title")).alias("title"), F.lit("").alias("edited_at"), F.lit("").alias("url"), F.lit(1).cast("bigint").alias("ord"),
    )
    used = n.select("space_id").distinct()
    roots = used.join(spaces.select("space_id", "name"), "space_id", "left").select(
        root(F.col("space_id")).alias("id"), F.lit("").alias("alt_id"), F.lit("feishu").alias("platform"), F.lit("folder").alias("type"), F.lit("").alias("parent_id"),
        F.concat(F.lit("wiki-"), F.coalesce(F.nullif("name", F.lit("")), "space_id")).alias("title"), F.lit("").alias("edited_at"), F.lit("").alias("url"), F.lit(0).cast("bigint").alias("ord"),
    )
    return roots.unionByName(docs)


def drive(files: DataFrame) -> DataFrame:
    """Drive files and folders; a file without a parent folder lies in its space's drive root (``feishu:drive:<space>``)."""
    root = F.concat(F.lit("feishu:drive:"), F.col("space_id"))
    docs = files.select(
        strip(F.col("token")).alias("id"), F.lit("").alias("alt_id"), F.lit("feishu").alias("platform"), doc_type(F.col("type")).alias("type"),
        F.coalesce(F.nullif(strip(F.col("parent_token")), F.lit("")), root).alias("parent_id"), _blank(F.col("name")).alias("title"), unix_time(F.col("modified_time")).alias("edited_at"), _blank(F.col("url")).alias("url"), F.col("rec_id").alias("ord"),
    )
    roots = files.select("space_id").distinct().select(
        root.alias("id"), F.lit("").alias("alt_id"), F.lit("feishu").alias("platform"), F.lit("folder").alias("type"), F.lit("").alias("parent_id"),
        F.concat(F.lit("drive-"), F.col("space_id")).alias("title"), F.lit("").alias("edited_at"), F.lit("").alias("url"), F.lit(0).cast("bigint").alias("ord"),
    )
    return roots.unionByName(docs)


def enrich(docs: DataFrame, metas: DataFrame) -> DataFrame:
    """``docs`` with URL and edit time of their last delivered metadata where it tells them."""
    last = metas.groupBy(strip(F.col("doc_token")).alias("_t")).agg(F.max_by(F.struct("url", "latest_modify_time"), "rec_id").alias("_m"))
    j = docs.join(last, F.col("id") == F.col("_t"), "left")
    return j.withColumn("url", F.coalesce(F.nullif(F.col("_m.url"), F.lit("")), "url")).withColumn("edited_at", F.coalesce(F.nullif(unix_time(F.col("_m.latest_modify_time")), F.lit("")), "edited_at")).drop("_t", "_m")


def feishu(nodes: DataFrame, files: DataFrame, metas: DataFrame, spaces: DataFrame) -> DataFrame:
    """Wiki and drive together, with their metadata."""
    return enrich(wiki(nodes, spaces).unionByName(drive(files)), metas)


def last_delivery(docs: DataFrame) -> DataFrame:
    """One row per (platform, id): the one enumerated last."""
    rest = [c for c in docs.columns if c not in ("platform", "id", "ord")]
    best = docs.groupBy("platform", "id").agg(F.max(F.struct("ord", *rest)).alias("r"))
    return best.select("platform", "id", "r.*").select(*docs.columns)
