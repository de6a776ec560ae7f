"""What changed between full snapshots: hash-range buckets, Merkle-tree digests compared top-down, rows only where they differ.

The records of all snapshots are written once, by the hash range of their key. A leaf's digest combines the digests of its
records without regard to order; 16 neighbouring leaves make up one node of the next level, up to one root. A node holds
the digests of all snapshots side by side, so consecutive snapshots are compared within its row: only below nodes that
differ are children looked at. In the end only the hash ranges that hold a difference are read, and of these only the leaves
that differ are diffed, each record beside its own other versions.

Hash ranges are the tree's nodes at one level, RANGES at most, and folders of what is written: those that differ go to the
scan as a short list, and the others aren't opened. Nothing that grows with the data is broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from doclake.session import cut, discard, new_path

_FAN = 16
#: Hash ranges at most: 16 to this power.
_RANGE_LEVEL = 3
RANGES = _FAN**_RANGE_LEVEL
#: Records that a hash range holds at least, as long as there are fewer than RANGES.
ROWS_PER_RANGE = 50_000


def latest(rows: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """(snap_no, id, *fields): of several rows of an id in a snapshot the one with the latest ``order`` (null is the
    earliest; of equal ones the greatest fields), null and empty the same. Rows without id or snapshot are left out."""
    value = F.struct(F.col(order).alias("o"), *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields))
    best = rows.where("id IS NOT NULL AND snap_no IS NOT NULL").groupBy("snap_no", "id").agg(F.max(value).alias("v"))
    return best.select("snap_no", "id", *(F.col(f"v.{f}").alias(f) for f in fields))


def _nodes(df: DataFrame, at: list[str], parts: list[str]) -> DataFrame:
    """(*at, digests): per node the (pos, x, y, n) of every snapshot that has records there; as many as there are snapshots."""
    per = df.groupBy(*at, "pos").agg(F.bit_xor(F.xxhash64(F.lit(1), *parts)).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), *parts)).alias("y"), F.sum("n").alias("n"))
    return per.groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("x", "y", "n")))).alias("digests"))


class SnapshotTree:
    """All snapshots of ``rows`` in hash ranges with their Merkle trees; see :func:`snapshot_changes`."""

    def __init__(self, rows: DataFrame, fields: list[str], rows_per_bucket: int = 16, order: str = "loaded_at", rows_per_range: int = ROWS_PER_RANGE):
        self.spark, self.fields = rows.sparkSession, fields
        size = rows.groupBy("snap_no").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        self.levels = max(1, math.ceil(math.log(max(2, (size["most"] or 0) / rows_per_bucket), _FAN)))
        self.range_level = min(self.levels, _RANGE_LEVEL, math.ceil(math.log(max(1, (size["all"] or 0) / rows_per_range), _FAN)))
        now = latest(rows, order, fields).withColumn("h", F.xxhash64("id"))
        now = now.select(self._top(self.range_level).cast("int").alias("range"), self._top(self.levels).alias("bucket"), "snap_no", "id", *fields)
        self.path = new_path(self.spark, "snapshots")
        now.repartition("range").sortWithinPartitions("range", "bucket", "id").write.partitionBy("range").parquet(self.path)
        self._passing = [self.path]
        written = self.spark.read.schema(now.schema).parquet(self.path).select(now.columns)
        self.snaps = sorted(r[0] for r in written.select("snap_no").distinct().collect())  # one number per snapshot
        self.numbers = F.array(*(F.lit(s) for s in self.snaps)).cast(T.ArrayType(rows.schema["snap_no"].dataType))
        self.now = written.withColumn("pos", (F.array_position(self.numbers, F.col("snap_no")) - 1).cast("int"))

    def _top(self, level: int):
        """The top 4 * ``level`` bits of the key's hash."""
        return F.lit(0).cast("bigint") if not level else F.shiftrightunsigned("h", 64 - 4 * level) if level < 16 else F.col("h")

    def tree(self) -> list[DataFrame]:
        """The levels, leaves first, each written down once: (bucket, digests)."""
        level = cut(_nodes(self.now.withColumn("n", F.lit(1)), ["bucket"], ["id", *self.fields]), "digests", self._passing)
        levels = [level]
        for _ in range(self.levels):
            below = levels[-1].select(F.shiftrightunsigned("bucket", 4).alias("up"), "bucket", F.explode("digests").alias("pos", "d")).select("up", "bucket", "pos", "d.*")
            levels.append(cut(_nodes(below, ["up"], ["bucket", "x", "y", "n"]).withColumnRenamed("up", "bucket"), "digests", self._passing))
        return levels

    def differing(self) -> DataFrame:
        """(bucket, curs): the leaves that differ, with the positions of the later snapshots of the pairs in which they do.
        Also sets ``ranges``, the hash ranges that hold them."""
        pairs = F.sequence(F.lit(1), F.lit(len(self.snaps) - 1)) if len(self.snaps) > 1 else F.array().cast("array<int>")
        differ = None
        levels = self.tree()
        self.ranges: list[int] = []
        for depth, nodes in enumerate(reversed(levels)):
            if differ is None:
                met = nodes.withColumn("asked", pairs)
            else:
                up = differ.select(F.col("bucket").alias("_up"), F.col("curs").alias("asked"))
                met = nodes.join(up.hint("merge"), F.shiftrightunsigned("bucket", 4) == F.col("_up"))
            found = met.select("bucket", F.filter("asked", lambda c: ~F.col("digests")[c].eqNullSafe(F.col("digests")[c - 1])).alias("curs")).where("size(curs) > 0")
            differ = cut(found, "differ", self._passing)
            if depth == self.range_level:
                self.ranges = [r[0] for r in differ.select(F.col("bucket").cast("int")).collect()]  # RANGES at most
        return differ

    def changes(self) -> DataFrame:
        """(snap_no, id, change, field), from the rows in leaves that differ."""
        differ = self.differing().withColumnRenamed("bucket", "_bucket")
        part = self.now.where(F.col("range").isin(self.ranges)).join(differ.hint("merge"), F.col("bucket") == F.col("_bucket"))
        by_id = Window.partitionBy("bucket", "id").orderBy("pos")
        held = F.struct("pos", *self.fields)
        met = part.select("id", "pos", "curs", *self.fields, F.lag(held).over(by_id).alias("before"), F.lead("pos").over(by_id).alias("after"))
        pos, last = F.col("pos"), len(self.snaps) - 1
        one = lambda at, change, field="": F.struct(at.cast("int").alias("at"), F.lit(change).alias("change"), F.lit(field).alias("field"))
        follows = F.col("before.pos").eqNullSafe(pos - 1)
        rows = [
            F.when((pos > 0) & ~follows, one(pos, "added")),
            F.when((pos < last) & ~F.col("after").eqNullSafe(pos + 1), one(pos + 1, "removed")),
            *(F.when(follows & (F.col(f) != F.col(f"before.{f}")), one(pos, "changed", f)) for f in self.fields),
        ]
        told = met.select("id", "curs", F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull()))).where(F.array_contains("curs", F.col("at")))
        return told.select(F.get(self.numbers, F.col("at")).alias("snap_no"), "id", "change", "field")

    def drop(self) -> None:
        """Delete what was written, once the result has been used."""
        for path in self._passing:
            discard(self.spark, path)


def snapshot_changes(rows: DataFrame, fields: list[str], rows_per_bucket: int = 16, order: str = "loaded_at") -> DataFrame:
    """(snap_no, id, change, field): ``added``, ``removed`` (field '') or ``changed`` per differing field, between each
    snapshot in ``rows`` (snap_no, id, ``order``, *fields) and the one before it that is there.

    Row choice and empty values as in :func:`latest`; otherwise values are compared exactly. The first snapshot has
    nothing to differ from. An empty table gives no rows. ``rows_per_bucket`` sets the size of the hash ranges.
    """
    return SnapshotTree(rows, fields, rows_per_bucket, order).changes()
