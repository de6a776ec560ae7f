"""Run history: latest runs, streaks, checkpoints, when a full round is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECENT = 64


def run_mode(stats: Column) -> Column:
    """The mode in a run's stats (JSON text); ``full`` when it isn't told."""
    return F.coalesce(F.nullif(F.get_json_object(stats, "$.mode"), F.lit("")), F.lit("full"))


def recent(runs: DataFrame, n: int = RECENT) -> DataFrame:
    """The ``n`` newest runs per platform, with ``nth`` from 1."""
    nth = F.row_number().over(Window.partitionBy("platform").orderBy(F.desc("id")))
    return runs.withColumn("nth", nth).where(F.col("nth") <= n)


def latest(runs: DataFrame) -> DataFrame:
    """The newest run per platform."""
    cols = [c for c in runs.columns if c not in ("platform", "id")]
    best = runs.groupBy("platform").agg(F.max_by(F.struct("id", *cols), "id").alias("r"))
    return best.select("platform", "r.*")


def latest_checkpoint(runs: DataFrame) -> DataFrame:
    """The newest run's checkpoint that isn't empty, per platform."""
    return runs.where("checkpoint <> ''").groupBy("platform").agg(F.max_by("checkpoint", "id").alias("checkpoint"))


def streak(runs: DataFrame) -> DataFrame:
    """How many runs since the last full one, per platform, among the newest :data:`RECENT`."""
    fulls = F.sum(F.when(F.col("mode") == "full", 1).otherwise(0)).over(Window.partitionBy("platform").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0))
    r = recent(runs.withColumn("mode", run_mode(F.col("stats")))).withColumn("fulls", fulls)
    return r.groupBy("platform").agg(F.count(F.when(F.col("fulls") == 0, 1)).alias("streak"))


def modes(runs: DataFrame, now: Column, every: int, tz: str = "UTC", force: bool = False) -> DataFrame:
    """Per platform the mode of a run at ``now``: ``full`` when forced, without checkpoint, as the day's first (in ``tz``) or
    as the ``every``-th since the last full one (0: never for that reason); else ``incremental``."""
    day = lambda t: F.to_date(F.from_utc_timestamp(t, tz))
    last = latest(runs).select("platform", "started_at")
    j = last.join(latest_checkpoint(runs), "platform", "left").join(streak(runs), "platform", "left")
    full = F.lit(force) | F.col("checkpoint").isNull() | (day(F.col("started_at")) != day(now)) | ((F.lit(every) > 0) & (F.col("streak") + 1 >= every))
    return j.select("platform", F.when(full, "full").otherwise("incremental").alias("mode"), "streak", F.coalesce("checkpoint", F.lit("")).alias("checkpoint"))


def first_of_day(runs: DataFrame, tz: str = "UTC") -> DataFrame:
    """``runs`` with ``first``: whether the run before was on another day, or there was none."""
    day = F.to_date(F.from_utc_timestamp("started_at", tz))
    before = F.lag(day).over(Window.partitionBy("platform").orderBy("id"))
    return runs.withColumn("first", before.isNull() | (before != day))


def in_window(edited: Column, checkpoint: Column, minutes: int = 5) -> Column:
    """Whether an edit is to be looked at again: not older than the checkpoint less the look-back; unknown times are."""
    return edited.isNull() | checkpoint.isNull() | (edited >= checkpoint - F.expr(f"INTERVAL {minutes} MINUTES"))


def token_bucket(arrivals: DataFrame, per_second: float, by: list[str]) -> DataFrame:
    """``arrivals`` (*by, at in seconds) with ``slot``: when each may go under a rate of ``per_second``, in order of arrival.

    The n-th waits for the later of its arrival and the slot before plus the gap, which is a running maximum.
    """
    gap = 1.0 / per_second
    w = Window.partitionBy(*by).orderBy("at", "event_id")
    n = F.row_number().over(w)
    ahead = F.max(F.col("at") - F.col("_n") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return arrivals.withColumn("_n", n).withColumn("slot", ahead + F.col("_n") * gap).drop("_n")


def backoff(attempt: Column, base: float = 0.5, most: float = 30.0) -> Column:
    """Seconds before retry ``attempt`` (from 0)."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def before(runs: DataFrame, column: str) -> DataFrame:
    """``runs`` with ``before``: the value of ``column`` in the platform's run before."""
    return runs.withColumn("before", F.lag(column).over(Window.partitionBy("platform").orderBy("id")))
