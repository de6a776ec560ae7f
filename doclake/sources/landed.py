"""Readers of landed files: JSON pages, envelopes, bodies, assets, environment files, and a Python data source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from doclake.functions.ids import strip

SEARCH_PAGE = (
    "results array<struct<object: string, id: string, url: string, last_edited_time: string, in_trash: boolean, is_archived: boolean, "
    "parent: struct<type: string, page_id: string, data_source_id: string, database_id: string, workspace: boolean>, title: array<struct<plain_text: string>>>>, "
    "has_more boolean, next_cursor string"
)


def search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Objects of landed search pages (one JSON page per line), like the table of delivered objects."""
    pages = spark.read.schema(SEARCH_PAGE).json(path)
    o = pages.select(F.explode("results").alias("o")).select("o.*").withColumn("rec_id", F.monotonically_increasing_id())
    return o.withColumn("title", F.array_join(F.transform("title", lambda t: t["plain_text"]), ""))


def envelope_case(raw: Column) -> Column:
    """Whether a response has the agreed form: ``ok``, ``error``, or what is wrong with it."""
    shape = "ok string, data string, error string"
    e = F.from_json(raw, shape)
    bad = F.try_parse_json(raw).isNull()
    kind = F.schema_of_variant(F.try_parse_json(raw))
    err = F.from_json(e["error"], "type string, subtype string, code string, message string")
    return (
        F.when(raw.isNull() | (strip(raw) == ""), "empty")
        .when(bad, "malformed")
        .when(~kind.startswith("OBJECT"), "not_an_object")
        .when(e["ok"].isNull(), "no_ok")
        .when(~e["ok"].isin("true", "false"), "ok_not_boolean")
        .when((e["ok"] == "true") & e["data"].isNull(), "no_data")
        .when(e["ok"] == "true", "ok")
        .when(e["error"].isNull(), "no_error")
        .when(err["message"].isNull() & err["code"].isNull(), "error_not_an_object")
        .otherwise("error")
    )


def unwrap(df: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the ``data`` of good responses, quarantined rows with their case)."""
    d = df.withColumn("_case", envelope_case(F.col(raw)))
    good = d.where("_case = 'ok'").withColumn("data", F.get_json_object(raw, "$.data")).drop("_case")
    return good, d.where("_case <> 'ok'").withColumnRenamed("_case", "envelope_case")


def env_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of an environment file: comments, ``export``, quotes and inline comments; the last of a key holds."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    return env_lines(lines)


def env_lines(lines: DataFrame) -> DataFrame:
    """(key, value) of lines (value, n)."""
    line = F.regexp_replace(strip(F.col("value")), r"^export\s+", "")
    pattern = r"^([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$"
    raw = F.regexp_extract(line, pattern, 2)
    quoted = r"^(\"([^\"]*)\"|'([^']*)')\s*(#.*)?$"
    value = F.when(raw.rlike(quoted), F.concat(F.regexp_extract(raw, quoted, 2), F.regexp_extract(raw, quoted, 3))).otherwise(strip(F.regexp_replace(raw, r"(^|\s)#.*$", "")))
    rows = lines.where(~line.startswith("#") & line.rlike(pattern)).select(F.regexp_extract(line, pattern, 1).alias("key"), value.alias("value"), "n")
    return rows.groupBy("key").agg(F.max_by("value", "n").alias("value"))


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of landed Markdown files, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def assets(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest, ext, length) of landed binary files; the extension from the content, where it tells."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", F.sha2("content", 256).alias("digest"), sniffed_extension(F.col("content")).alias("ext"), "length")


def sniffed_extension(content: Column) -> Column:
    """A file extension by the first bytes; '' when they tell nothing."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), ".png").when(head.startswith("FFD8FF"), ".jpg").when(head.startswith("47494638"), ".gif")
        .when(head.startswith("52494646") & head.endswith("57454250"), ".webp").when(head.startswith("25504446"), ".pdf").when(head.startswith("504B0304"), ".zip").otherwise("")
    )


class InventoryReader(DataSourceReader):
    """Reads inventory files one partition each, with a lower bound on the edit time if there is one."""

    def __init__(self, options):
        import glob

        self.paths = sorted(glob.glob(options["path"]))
        self.since = options.get("since", "")

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        import json

        with open(partition.value, encoding="utf-8") as f:
            for n, line in enumerate(f):
                if line.strip():
                    o = json.loads(line)
                    edited = o.get("edited_at") or ""
                    if not self.since or not edited or edited >= self.since:
                        yield tuple(o.get(k) or "" for k in ("id", "alt_id", "platform", "type", "parent_id", "title", "edited_at", "url")) + (n,)


class InventorySource(DataSource):
    """``spark.read.format("doclake_inventory")``: JSON lines of inventory rows; option ``since`` skips older edits. The seam
    at which another platform is plugged in."""

    @classmethod
    def name(cls):
        return "doclake_inventory"

    def schema(self):
        from doclake.sources.inventory import REMOTE_DOC

        return REMOTE_DOC

    def reader(self, schema):
        return InventoryReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(InventorySource)
