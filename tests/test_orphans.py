import datetime as dt
import random

from doclake.operators.orphans import orphan_references

REFS, RECORDS = "src string, holder string, ref_id string, ref_time timestamp, kind string", "id string, deleted boolean, first_seen_at timestamp"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute(refs, records):
    out = []
    for src, holder, ref, t, _ in refs:
        if ref is None:
            continue
        rows = [r for r in records if r[0] == ref]
        period = t.strftime("%Y-%m") if t else ""
        if not rows:
            out.append((src, holder, ref, period, "missing"))
        elif all(r[1] for r in rows):
            out.append((src, holder, ref, period, "deleted"))
        elif t and all(r[2] for r in rows) and min(r[2] for r in rows) > t:
            out.append((src, holder, ref, period, "late"))
    return sorted(out, key=repr)


def test_against_brute_force(spark, rows):
    rnd = random.Random(5)
    records = [(f"d{i}", rnd.random() < 0.2, None if rnd.random() < 0.1 else day(rnd.randrange(200))) for i in range(120)]
    refs = [("l", str(i), rnd.choice([None, f"d{rnd.randrange(150)}", "hot"]), None if rnd.random() < 0.1 else day(rnd.randrange(200)), "clash") for i in range(700)]
    refs += refs[:20]
    got = rows(orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(records, RECORDS)))
    assert got == brute(refs, records)


def test_empty_sides(spark, rows):
    no_refs, no_records = spark.createDataFrame([], REFS), spark.createDataFrame([], RECORDS)
    one = spark.createDataFrame([("l", "1", "x", day(40), None)], REFS)
    assert rows(orphan_references(no_refs, no_records)) == []
    assert rows(orphan_references(one, no_records)) == [("l", "1", "x", "2024-02", "missing")]


def test_a_key_that_holds_most_references(spark):
    """A third and more of all references name one key, over all months; it costs each task its months, and all come out."""
    n = 30_000
    records = spark.createDataFrame([("hot", False, day(100)), ("gone", True, day(0))], RECORDS)
    refs = spark.range(n).selectExpr("'l' AS src", "string(id) AS holder", "if(id % 3 = 0, 'gone', 'hot') AS ref_id", "timestamp_seconds(1704067200 + (id % 200) * 86400) AS ref_time")
    got = {r["kind"]: r["n"] for r in orphan_references(refs, records).groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    late = sum(1 for i in range(n) if i % 3 and i % 200 < 100)
    assert got == {"deleted": n // 3, "late": late}


def test_more_keys_than_one_container_holds(spark, rows):
    n = 150_000
    records = spark.range(n).selectExpr("string(id) AS id", "id % 5 = 0 AS deleted", "timestamp_seconds(1704067200) AS first_seen_at")
    refs = spark.range(0, n + 1_000, 7).selectExpr("'l' AS src", "string(id) AS holder", "string(id) AS ref_id", "timestamp_seconds(1735689600) AS ref_time")
    got = {r["kind"]: r["n"] for r in orphan_references(refs, records).groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    ids = range(0, n + 1_000, 7)
    assert got == {"missing": sum(i >= n for i in ids), "deleted": sum(i < n and i % 5 == 0 for i in ids)}
