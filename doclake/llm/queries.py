"""Queries p6 to p8 over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import mixing, spans, tokens
from doclake.session import cut, ship, spread, table

SEED = 20_250_101
#: Batches in which documents come in, and runs of a level that are compacted.
BATCHES, FAN_OUT = 3, 2


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    ship(spark)
    return table(spark, d, "documents").select(*columns)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The byte_bpe_50k ids of every document."""
    return tokens.encode_column(spread(_documents(spark, d, "doc_id", "text")), ["doc_id"])


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The length and digest of every document's text, decoded from its ids."""
    texts = tokens.decode_column(p6_ids(spark, d), ["doc_id"])
    return texts.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(_documents(spark, d, "doc_id", "source", "text"))
    counted = tokens.count_tokens(docs, ["doc_id", "source"])
    return cut(counted.withColumn("u", mixing.uniform("doc_id", SEED)), "sizes")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of the sources at their target shares: every use of a document, whole, in shuffled order."""
    planned = mixing.plan(_sizes(spark, d), table(spark, d, "source_targets"))
    return mixing.mix(_documents(spark, d, "doc_id", "source", "text"), planned, SEED)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of all tokens that each source makes up in the mixture."""
    sizes = _sizes(spark, d)
    return mixing.report(sizes, mixing.plan(sizes, table(spark, d, "source_targets")))


def _index(spark: SparkSession, d: str) -> spans.SpanIndex:
    index = spans.SpanIndex(spark, fan_out=FAN_OUT)
    for batch in spans.arrival_batches(_documents(spark, d, "doc_id", "text", "crawled_at"), "crawled_at", BATCHES):
        index.add(batch)
    return index


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Of each document, how many characters lie in spans of 200 and more that occur in another one."""
    stretches = _index(spark, d).shared()
    return stretches.groupBy("doc_id").agg(F.sum(F.col("end_at").cast("bigint") - F.col("start_at")).alias("shared_chars"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of each document that spans of 200 and more shared with another one cover."""
    return _index(spark, d).shared()


QUERIES = {f.__name__: f for f in (p6_ids, p6_decoded, p7_mix, p7_shares, p8_found, p8_spans)}
ORACLES: dict[str, str] = {"p6_decoded": "SELECT doc_id, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents"}
