"""What rounds report: losses counted, statistics merged, how the next round runs, health rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The counters of what was lost in a document.
LOSSES = ("unknown_blocks", "bitables_rendered", "bitables_oversize", "bitables_failed", "truncated_pages", "unknown_block_ids")
#: The checks of a health report, in order: code, name, platform ('' for both) and whether F1 must pass first.
CHECKS = (
    ("G0", "config", "", False), ("G1", "mirror-root", "", False), ("G2", "quota", "", False),
    ("F1", "lark-engine", "feishu", False), ("F2", "lark-auth", "feishu", True), ("F3", "lark-scope-wiki", "feishu", True), ("F3", "lark-scope-docs", "feishu", True),
    ("F3", "lark-scope-drive", "feishu", True), ("F4", "lark-output-format", "feishu", True), ("F5", "feishu-mirror-scope", "feishu", True),
    ("N1", "notion-env", "notion", False), ("N2", "notion-token", "notion", False), ("N3", "notion-visible", "notion", False),
)


def losses(docs: DataFrame, by: str = "platform") -> DataFrame:
    """(by, *LOSSES, degradations): the counters of ``docs`` summed per ``by``, and all together; a null counts as 0."""
    sums = docs.groupBy(by).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in LOSSES))
    return sums.withColumn("degradations", sum((F.col(c) for c in LOSSES[1:]), F.col(LOSSES[0])))


def merge_stats(stats: DataFrame, lists: tuple[str, ...] = ("failures", "warnings")) -> DataFrame:
    """One row of the statistics of all platforms (``platform``, numbers, ``lists``): numbers summed, lists joined in the
    order of the platforms, ``adapters`` the platforms. One row per platform, so the lists are a round's own."""
    numbers = [c for c in stats.columns if c not in ("platform", *lists)]
    joined = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("platform", F.coalesce(c, F.array().cast("array<string>")).alias("x")))), lambda r: r["x"])).alias(c)
    return stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in numbers), *(joined(c) for c in lists), F.array_sort(F.collect_list("platform")).alias("adapters"))


def plan_round(modes: DataFrame, capable: tuple[str, ...]) -> DataFrame:
    """``modes`` (platform, mode, checkpoint) as they are run: platforms that can't scan incrementally run full; an incremental
    round neither deletes nor writes indexes anew, and starts from its checkpoint."""
    mode = F.when(F.col("platform").isin(*capable), F.col("mode")).otherwise("full")
    full = mode == "full"
    return modes.select("platform", mode.alias("mode"), F.when(full, "").otherwise(F.coalesce("checkpoint", F.lit(""))).alias("since"), full.alias("deletes"), full.alias("indexes"))


def kept_checkpoint(before: Column, after: Column, failed: Column) -> Column:
    """The checkpoint a round leaves: the one before it when it failed or found none."""
    return F.when(F.coalesce(failed, F.lit(True)) | (F.coalesce(after, F.lit("")) == ""), F.coalesce(before, F.lit(""))).otherwise(after)


def health(results: DataFrame, configured: tuple[str, ...]) -> DataFrame:
    """(nth, code, name, status, detail): all of CHECKS in order, from ``results`` (name, status, detail).

    Checks of platforms that aren't configured, and those that need F1 when it hasn't passed, are skipped; a check without
    a result is skipped too. Of several results of a check the worst holds (fail, warn, pass, skip).
    """
    spark = results.sparkSession
    layout = spark.createDataFrame([(i, *c) for i, c in enumerate(CHECKS, 1)], "nth int, code string, name string, platform string, after_f1 boolean")
    worst = F.array_position(F.array(*(F.lit(s) for s in ("fail", "warn", "pass", "skip"))), F.col("status"))
    best = results.groupBy(F.col("name").alias("_n")).agg(F.min(F.struct(worst.alias("w"), "status", "detail")).alias("_r"))
    engine = results.where("name = 'lark-engine' AND status = 'pass'").agg((F.count("*") > 0).alias("_up"))  # one row
    j = layout.join(F.broadcast(engine)).join(best, F.col("name") == F.col("_n"), "left")
    off = (F.col("platform") != "") & ~F.col("platform").isin(*configured)
    down = F.col("after_f1") & ~F.col("_up")
    status = F.when(off | down, "skip").otherwise(F.coalesce("_r.status", F.lit("skip")))
    detail = F.when(off, F.concat("platform", F.lit(" not configured"))).when(down, "lark engine unavailable (see F1)").otherwise(F.coalesce("_r.detail", F.lit("")))
    return j.select("nth", "code", "name", status.alias("status"), detail.alias("detail"))


def verdict(rows: DataFrame) -> DataFrame:
    """(ok, failed): whether no check failed, and the codes of those that did, in order."""
    failed = F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "fail", F.struct("nth", "code")))), lambda r: r["code"])
    return rows.agg(F.coalesce(F.bool_and(F.col("status") != "fail"), F.lit(True)).alias("ok"), F.array_join(failed, " ").alias("failed"))
