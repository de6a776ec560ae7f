"""The link graph: references resolved by id or alias, and what moves do to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(refs: DataFrame, docs: DataFrame, aliases: DataFrame, ref: str = "ref") -> DataFrame:
    """``refs`` with ``doc_id``, ``path`` and ``matched_by`` (``id``, ``alias`` or null): first a document of that id that has
    a path, else the document of that alias; only active ones (``docs``: id, local_path, status; ``aliases``: alias, doc_id)."""
    live = docs.where("status = 'active'").select(F.col("id").alias("_id"), F.col("local_path").alias("_path"))
    by_id = refs.join(live.where("_path IS NOT NULL"), F.col(ref) == F.col("_id"), "left")
    named = aliases.join(live, F.col("doc_id") == F.col("_id")).select(F.col("alias").alias("_alias"), F.col("_id").alias("_aid"), F.col("_path").alias("_apath"))
    named = named.groupBy("_alias").agg(F.min(F.struct("_aid", "_apath")).alias("_a"))
    j = by_id.join(named, F.col(ref) == F.col("_alias"), "left")
    hit = F.col("_id").isNotNull()
    return j.select(
        *refs.columns,
        F.when(hit, F.col("_id")).otherwise(F.col("_a._aid")).alias("doc_id"),
        F.when(hit, F.col("_path")).otherwise(F.col("_a._apath")).alias("path"),
        F.when(hit, "id").when(F.col("_alias").isNotNull(), "alias").alias("matched_by"),
    )


def sources(links: DataFrame, docs: DataFrame) -> DataFrame:
    """(platform, from_id) of the active documents that link anywhere, each once."""
    live = docs.where("status = 'active'").select(F.col("id").alias("from_id"), "platform")
    return links.select("from_id").distinct().join(live, "from_id").select("platform", "from_id")


def touched(links: DataFrame, moves: DataFrame) -> DataFrame:
    """Links of which an end has moved, with both ends' moves: two equality joins, not one with OR."""
    m1 = moves.select(F.col("id").alias("from_id"), F.col("old_path").alias("from_old"), F.col("new_path").alias("from_new"))
    m2 = moves.select(F.col("id").alias("to_id"), F.col("old_path").alias("to_old"), F.col("new_path").alias("to_new"))
    return links.select("from_id", "to_id").distinct().join(m1, "from_id", "left").join(m2, "to_id", "left").where("from_new IS NOT NULL OR to_new IS NOT NULL")


def resolve_batch(queries: DataFrame, docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """The first match of each query (qid, query) among its candidates in order: the text itself, its dashless lower-case
    form hyphenated, each segment of a URL; as an id before as an alias, whatever the document's status, or as a path."""
    from doclake.functions.ids import canonical_id, strip

    q = F.col("query")
    tokens = F.when(q.contains("://"), F.filter(F.split(F.regexp_replace(q, r"^[a-z]+://[^/]*|[?#].*$", ""), "/"), lambda s: s != "")).otherwise(F.array(strip(q), canonical_id(q), F.regexp_replace(strip(q), r"^\./", "")))
    kinds = F.array_distinct(F.filter(tokens, lambda s: s.isNotNull() & (s != "")))
    c = queries.select("qid", "query", F.posexplode(kinds).alias("at", "cand"))
    d = docs.groupBy("id").agg(F.min("local_path").alias("local_path"))
    by_id = c.join(d, F.col("cand") == F.col("id")).select("qid", "at", F.lit(0).alias("rank"), F.col("id").alias("doc_id"), F.lit("id").alias("matched_by"))
    by_alias = c.join(aliases, F.col("cand") == F.col("alias")).select("qid", "at", F.lit(1).alias("rank"), "doc_id", F.lit("alias").alias("matched_by"))
    by_path = c.join(d, F.col("cand") == F.col("local_path")).select("qid", "at", F.lit(2).alias("rank"), F.col("id").alias("doc_id"), F.lit("local_path").alias("matched_by"))
    best = by_id.unionByName(by_alias).unionByName(by_path).groupBy("qid").agg(F.min(F.struct("at", "rank", "doc_id", "matched_by")).alias("m"))
    return queries.join(best, "qid", "left").select("qid", "query", F.col("m.doc_id").alias("doc_id"), F.col("m.matched_by").alias("matched_by"))
