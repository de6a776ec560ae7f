import math
import random

import pytest

pytest.importorskip("doclake.llm.mixing")
from doclake.llm import mixing as X

DOCS = "doc_id bigint, source string, text string, n_tokens bigint, copy_no string"
TARGETS = "source string, target_share double, max_repeats int"


def sized(spark, data):
    return spark.createDataFrame(data, DOCS).withColumn("u", X.uniform("doc_id", 1))


def test_shares_are_met_within_caps(spark):
    rnd = random.Random(1)
    data = [(i, s, "t", rnd.randrange(10, 400), None) for i, s in enumerate(["big"] * 6000 + ["mid"] * 2500 + ["small"] * 300 + [None] * 20 + ["other"] * 50)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 5), ("absent", 0.05, 9), (None, 0.5, 1)], TARGETS)
    docs = sized(spark, data)
    planned = X.plan(docs, targets)
    report = {r.source: r for r in X.report(docs, planned).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(report[s].actual_share - share / 0.95) < 0.01
        assert report[s].most_repeats <= report[s].max_repeats
    assert report["absent"].tokens_used == report[None].tokens_used == report["other"].tokens_used == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    mixed = X.mix(docs, planned, 1)
    per = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert per == {s: report[s].n_used for s in ("big", "mid", "small")}
    assert mixed.where("copy_no < 1").count() == 0
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, X.mix(docs, planned, 1).collect()))


def test_nothing_to_mix(spark):
    docs = sized(spark, [(1, "a", "", 0, None), (2, "b", None, 0, None)])
    planned = X.plan(docs, spark.createDataFrame([("a", 1.0, 2), ("b", 0.0, 1)], TARGETS))
    assert X.mix(docs, planned, 1).count() == 0
    assert {r.actual_share for r in X.report(docs, planned).collect()} == {0.0}
    none = docs.limit(0)
    assert X.mix(none, X.plan(none, spark.createDataFrame([], TARGETS)), 1).count() == 0


def test_poisson():
    cdf = X.poisson_cdf(2.0, 4)
    assert all(abs(c - sum(math.exp(-2) * 2**i / math.factorial(i) for i in range(j + 1))) < 1e-12 for j, c in enumerate(cdf))
    bins = {b: 1.0 for b in range(4096)}
    for goal in (10, 1000, 4096, 9000):
        assert abs(X.used(X.solve(bins, 3, goal), bins) - goal) < 1
    assert X.solve(bins, 3, 3 * 4096) == [0.0, 0.0, 0.0]
