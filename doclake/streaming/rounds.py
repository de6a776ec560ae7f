"""Rounds over a landing folder as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclake.operators.ledger import upsert


def landed(spark: SparkSession, folder: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """Parquet files of a landing folder as a stream."""
    r = spark.readStream.schema(schema)
    if per_batch:
        r = r.option("maxFilesPerTrigger", per_batch)
    return r.parquet(folder)


def distinct_within(stream: DataFrame, keys: list[str], time: str, delay: str = "5 minutes") -> DataFrame:
    """The stream without deliveries repeated within ``delay``; what comes later than that is left to a full round."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, time: str, by: list[str], window: str, delay: str | None = None) -> DataFrame:
    """Counts per window and key, final once the watermark has passed the window; ``delay`` sets it where none is set yet."""
    return (stream.withWatermark(time, delay) if delay else stream).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))


def keep_ledger(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], seq: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Apply every micro-batch to the ledger in ``folder`` as the next snapshot (``v=<batch>``).

    A batch that is run again after a failure writes the same snapshot again, from the one before it: each reads the newest
    below its own number.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        have = [int(s.getPath().getName()[2:]) for s in fs.listStatus(root)] if fs.exists(root) else []
        before = max((v for v in have if v < number), default=None)
        rows = batch.drop(seq)
        old = spark.read.schema(rows.schema).parquet(f"{folder}/v={before}") if before is not None else spark.createDataFrame([], rows.schema)
        upsert(old, batch, keys, seq).write.mode("overwrite").parquet(f"{folder}/v={number}")
        if then:
            then(batch, number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
