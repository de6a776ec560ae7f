"""References to records that are missing, deleted or came later, found with bitmaps over dictionary-encoded keys.

All that is known of a key meets in one row: the months in which it is referred to, and what the records say. These rows
are hashed by key into key ranges; within its range a key's code is its place, so codes are dense, and 65,536 neighbouring
codes make one container of a compressed bitmap (:mod:`doclake.operators.bitmaps`). There is a bitmap of references per
month, and one of keys that exist per month in which they first came. The months are passed in order: what has come before
a month is OR-ed up, and the month's references AND NOT that leave the survivors, whose bits are decoded in the same task.
Survivors are the keys that are missing or deleted or came in the reference's month or later; only their references are
then compared one by one, by the exact times.

The months of a key are gathered with map-side combining, so a key that holds a large share of the references sends each
month once per map task. A task holds the bitmaps of one container's keys at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.operators.bitmaps import NONE, SPAN, by_group
from doclake.session import cut

#: Months count from year 0. A reference without a time asks in no month; a record without one was always there.
_NO_TIME, _ALWAYS = -(1 << 30), -(1 << 30)


def month_of(t: Column) -> Column:
    """The UTC month of a timestamp, '' for null."""
    return F.coalesce(F.date_format(F.to_utc_timestamp(F.from_utc_timestamp(t, "UTC"), "UTC"), "yyyy-MM"), F.lit(""))


def _month_number(t: Column) -> Column:
    day = F.date_from_unix_date(F.floor(F.unix_seconds(t) / 86400).cast("int"))
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def _survivors(owner: np.ndarray, asked: np.ndarray, there: np.ndarray, came: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, month) of the references of one container's keys that aren't surely answered: ``owner`` is the key's code
    beside each month ``asked``, ``there`` the codes of existing keys beside the months in which they ``came``."""
    refs, keys = by_group(asked, owner), by_group(came, there)
    every = NONE
    for c in keys.values():
        every = every.or_(c)
    codes, months, so_far = [], [], NONE
    arrived = sorted(keys)
    for month in sorted(refs):
        # What came in the month itself isn't surely there yet.
        while arrived and arrived[0] < month:
            so_far = so_far.or_(keys[arrived.pop(0)])
        left = refs[month].and_not(every if month == _NO_TIME else so_far).values()
        codes.append(left)
        months.append(np.full(len(left), month, np.int32))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(codes).astype(np.int64), np.concatenate(months)


def _and_not(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, months, came, ...) of one key range to those of the surviving (id, month, ...)."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        months = rows.column("months").combine_chunks()
        months = months.chunk(0) if isinstance(months, pa.ChunkedArray) else months
        lengths = months.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        came = rows.column("came").to_numpy()
        there = np.flatnonzero(~np.isnan(came.astype(float)))
        code, month = _survivors(np.repeat(np.arange(rows.num_rows), lengths), months.flatten().to_numpy(), there, came[there].astype(np.int64))
        kept = rows.drop_columns(["months", "came"]).take(pa.array(code)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in kept.columns), pa.array(month, pa.int32())], names=[*kept.column_names, "month"])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, SPAN - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == SPAN:
                yield solved(pa.Table.from_batches(held))
                held, n = [], 0
    if held:
        yield solved(pa.Table.from_batches(held))


def orphan_references(refs: DataFrame, records: DataFrame) -> DataFrame:
    """References of ``refs`` (src, holder, ref_id, ref_time) that ``records`` (id, deleted, first_seen_at) don't answer.

    Gives src, holder, ref_id, period (UTC month of ``ref_time``, '' when null) and kind: ``missing`` (no such id), else
    ``deleted`` (all rows of the id are deleted), else ``late`` (it first came after ``ref_time``; never with a null
    time). Null ids aren't references, blank ones are for the caller to make null. A repeated reference comes out as often
    as it stands. A record without ``first_seen_at`` was always there. Empty inputs give the plain result.
    """
    month = F.coalesce(_month_number(F.col("ref_time")), F.lit(_NO_TIME))
    # Written down, since they are read twice: what a reference says is parsed once.
    refs = cut(refs.where("ref_id IS NOT NULL").select("src", "holder", "ref_id", "ref_time", month.alias("month")), "references")
    asked = refs.select(F.col("ref_id").alias("id"), "month", *(F.lit(None).cast(t).alias(c) for c, t in (("deleted", "boolean"), ("first_seen_at", "timestamp"), ("known", "boolean"))))
    said = records.where("id IS NOT NULL").select("id", F.lit(None).cast("int").alias("month"), F.coalesce("deleted", F.lit(False)).alias("deleted"), F.col("first_seen_at").cast("timestamp").alias("first_seen_at"), F.lit(True).alias("known"))
    keys = (
        asked.unionByName(said).groupBy("id")
        .agg(
            F.collect_set("month").alias("months"), F.min("deleted").alias("deleted"), F.min("first_seen_at").alias("_first"),
            F.max(F.col("known") & F.col("first_seen_at").isNull()).alias("_always"), F.max("known").alias("known"),
        )
    )
    first = F.when(~F.col("_always"), F.col("_first"))
    came = F.when(F.col("known") & ~F.col("deleted"), F.coalesce(_month_number(first), F.lit(_ALWAYS)))
    rows = keys.select(F.col("id").alias("_id"), "deleted", "known", first.alias("_first"), "months", came.alias("came"))
    left = rows.mapInArrow(_and_not, f"_id {rows.schema['_id'].dataType.simpleString()}, deleted boolean, known boolean, _first timestamp, month int")
    joined = refs.join(left.withColumnRenamed("month", "_month"), (F.col("ref_id") == F.col("_id")) & (F.col("month") == F.col("_month")))
    kind = F.when(F.col("known").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("_first") > F.col("ref_time"), "late")
    return joined.withColumn("kind", kind).where("kind IS NOT NULL").select("src", "holder", "ref_id", month_of(F.col("ref_time")).alias("period"), "kind")
