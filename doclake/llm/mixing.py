"""Mixing sources to target weights by Poisson replication.

Each document is used as often as a Poisson variable with its source's mean says, inverted from a uniform number that is a
hash of the document and a seed: the same on every run and on every executor, without counting or sorting a source. The
variable is cut at the source's cap, so its mean is set by what is drawn, not by formula alone: the tokens of each source
are summed in fine bins of the uniform number, which tells the tokens used at any mean, and the mean is solved from that.

The total is the greatest at which every source that has documents reaches its share within its cap (targets of sources
without documents are spread over the rest in proportion). A source that needs its cap throughout is used that often.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.session import cut

_BINS = 4096
#: Rows up to which a plan is broadcast: under 1 MB at ten repeats.
MAX_SOURCES = 5_000


def uniform(key: str, seed: int):
    """A number in [0, 1) from the document's key and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))


def poisson_cdf(mean: float, cap: int) -> list[float]:
    """P(N <= 0), ..., P(N <= cap - 1) for a Poisson variable; zeros when the mean is infinite."""
    if math.isinf(mean):
        return [0.0] * cap
    out, term, total = [], math.exp(-mean), 0.0
    for j in range(cap):
        total += term
        out.append(min(total, 1.0))
        term *= mean / (j + 1)
    return out


def used(cdf: list[float], bins: dict[int, float]) -> float:
    """Tokens used when a document counts once for each value of ``cdf`` that is not above its uniform number."""
    total = 0.0
    for c in cdf:
        edge = c * _BINS
        whole = math.ceil(edge)
        total += sum(w for b, w in bins.items() if b >= whole)
        if whole > edge:
            total += bins.get(whole - 1, 0.0) * (whole - edge)
    return total


def solve(bins: dict[int, float], cap: int, goal: float) -> list[float]:
    """The distribution function, cut at ``cap``, whose draw uses ``goal`` tokens of those in ``bins``."""
    if goal <= 0:
        return [1.0] * cap
    if goal >= cap * sum(bins.values()) * (1 - 1e-9):
        return poisson_cdf(math.inf, cap)
    lo, hi = 0.0, 1.0
    while used(poisson_cdf(hi, cap), bins) < goal and hi < 700:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if used(poisson_cdf(mid, cap), bins) < goal else (lo, mid)
    return poisson_cdf(hi, cap)


def _solved(rows: pd.DataFrame) -> pd.DataFrame:
    r = rows.iloc[0]
    bins = dict(r["bins"]) if r["bins"] is not None else {}
    cap = int(r["max_repeats"])
    return pd.DataFrame({"source": [r["source"]], "target_share": [r["target_share"]], "max_repeats": [cap], "cdf": [solve(bins, cap, float(r["goal"]))]})


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, cdf) for every source of ``targets`` (source, target_share, max_repeats; of a
    source that comes twice the greatest row), from ``sizes`` (source, n_tokens, u). Sources without tokens, share or
    repeats get an empty ``cdf``. Means are solved where the bins are; the driver sees the total only."""
    goals = targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(0)).alias("r"))).alias("g"))
    goals = goals.select("source", F.col("g.s").alias("target_share"), F.col("g.r").alias("max_repeats"))
    sums = (
        sizes.where("source IS NOT NULL").groupBy("source", F.floor(F.col("u") * _BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n"))
        .groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.col("n").cast("double")))).alias("bins"), F.sum("n").alias("all"))
    )
    held = cut(goals.join(sums, "source", "left"), "goals")
    able = "target_share > 0 AND max_repeats > 0 AND all > 0"
    live = held.where(able)
    shares = live.agg(F.sum("target_share")).first()[0] or 1.0
    total = live.agg(F.min(F.col("all") * F.col("max_repeats") * F.lit(shares) / F.col("target_share"))).first()[0] or 0.0
    schema = "source string, target_share double, max_repeats int, cdf array<double>"
    solved = live.withColumn("goal", F.lit(total) * F.col("target_share") / F.lit(shares)).groupBy("source").applyInPandas(_solved, schema)
    rest = held.where(f"NOT coalesce({able}, false)").select("source", "target_share", "max_repeats", F.array().cast("array<double>").alias("cdf"))
    return cut(solved.unionByName(rest), "plan")


def _small(planned: DataFrame) -> DataFrame:
    """The plan, broadcast if it is short; a longer one is joined as Spark sees fit."""
    return F.broadcast(planned) if planned.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES else planned


def copies(u, cdf):
    """How often a document is used."""
    return F.coalesce(F.size(F.filter(cdf, lambda c: u >= c)), F.lit(0))


def mix(docs: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """The mixture: each document of ``docs`` (doc_id, source, ...) as many times as drawn (``copy_no`` from 1), with all its
    columns, in globally shuffled order: rows go to partitions by a hash of document, copy and seed, and lie in its order.

    Documents whose source is null or has no target aren't used. Repeated rows of a document are drawn alike.
    """
    drawn = docs.join(_small(planned.select("source", "cdf")), "source").withColumn("_n", copies(uniform("doc_id", seed), F.col("cdf"))).where("_n > 0")
    each = drawn.select(*(c for c in docs.columns if c not in ("copy_no", "shuffle_key")), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy_no"))
    keyed = each.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def report(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """Per source of the documents or the targets: what there was, what was used, and the share reached."""
    held = sizes.join(_small(planned.select("source", "cdf")), "source", "left").withColumn("_n", copies(F.col("u"), F.col("cdf")))
    per = held.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("_n").alias("n_used"), F.max("_n").alias("most_repeats"), F.sum(F.col("_n") * F.col("n_tokens")).alias("tokens_used")
    )
    goals = planned.select(F.col("source").alias("_s"), "target_share", "max_repeats")
    both = per.join(goals, F.col("source") == F.col("_s"), "full").withColumn("source", F.coalesce("source", "_s")).drop("_s")
    both = both.fillna(0, ["n_docs", "n_tokens", "n_used", "most_repeats", "tokens_used"])
    both = cut(both, "shares")
    total = both.agg(F.sum("tokens_used")).first()[0] or 0
    return both.withColumn("actual_share", F.col("tokens_used") / F.lit(total) if total else F.lit(0.0))
