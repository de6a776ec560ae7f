import datetime as dt
import random

from doclake.operators.snapshot_diff import SnapshotTree, snapshot_changes

SCHEMA = "snap_no int, id string, loaded_at timestamp, title string, status string, other string"
FIELDS = ["title", "status"]


def brute(data):
    held = {}
    for no, id_, at, *fields, _ in data:
        if no is None or id_ is None:
            continue
        key = (at is not None, at or dt.datetime.min, [f or "" for f in fields])
        if (no, id_) not in held or key > held[no, id_]:
            held[no, id_] = key
    out, snaps = [], sorted({no for no, _ in held})
    for before, now in zip(snaps, snaps[1:]):
        a, b = ({i: v[2] for (no, i), v in held.items() if no == s} for s in (before, now))
        out += [(now, i, "added", "") for i in b.keys() - a.keys()] + [(now, i, "removed", "") for i in a.keys() - b.keys()]
        out += [(now, i, "changed", f) for i in a.keys() & b.keys() for f, x, y in zip(FIELDS, a[i], b[i]) if x != y]
    return sorted(out, key=repr)


def test_against_brute_force(spark, rows):
    rnd = random.Random(3)
    data = []
    for no in (1, 2, 5):
        for i in range(400):
            if rnd.random() < 0.97:
                title = f"t{i}" if rnd.random() < 0.97 else rnd.choice(["", None, "new"])
                for _ in range(rnd.choice([1, 1, 1, 2])):
                    data.append((no, f"d{i}", rnd.choice([None, dt.datetime(2024, 1, no, rnd.randrange(24))]), title, rnd.choice(["active"] * 40 + ["trashed", None]), str(rnd.random())))
    data += [(None, "x", None, "a", "b", None), (1, None, None, "a", "b", None), (3, None, None, "a", "b", None)]
    for per in (2, 16, 10_000):
        assert rows(snapshot_changes(spark.createDataFrame(data, SCHEMA), FIELDS, per)) == brute(data)


def test_nothing_and_one_snapshot(spark, rows):
    assert rows(snapshot_changes(spark.createDataFrame([], SCHEMA), FIELDS)) == []
    assert rows(snapshot_changes(spark.createDataFrame([(1, "a", None, "t", "s", None)], SCHEMA), FIELDS)) == []


def test_few_changes_read_few_rows(spark):
    """The last step's scan is limited to the hash ranges that differ, and its rows aren't moved."""
    base = spark.range(20_000).selectExpr("string(id) AS id", "concat('t', id) AS title", "'active' AS status", "cast(null AS timestamp) AS loaded_at")
    changed = "CASE WHEN id IN ('7', '4000') THEN 'new' ELSE title END"
    both = base.selectExpr("1 AS snap_no", "*").unionByName(base.selectExpr("2 AS snap_no", "id", f"{changed} AS title", "status", "loaded_at"))
    tree = SnapshotTree(both, FIELDS, rows_per_range=200)
    got = tree.changes()
    assert sorted(map(tuple, got.collect())) == [(2, "4000", "changed", "title"), (2, "7", "changed", "title")]
    assert tree.range_level == 2 and len(tree.ranges) <= 2
    scans, todo = [], [got._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.executedPlan()] if hasattr(node, "executedPlan") and node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("Scan parquet"):
            scans.append(node.metrics().apply("numOutputRows").value())
    assert max(scans) < 2 * 20_000 / 20  # of 40,000 rows those of two ranges in 256
    tree.drop()
