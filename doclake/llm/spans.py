"""Long exact spans shared between documents: a log-structured index of window fingerprints.

Each batch of documents becomes one immutable run: the segments of all its windows (see :mod:`doclake.llm.fingerprints`),
bucketed and sorted by representative. The new run is merge-joined with the historical ones bucket by bucket, which moves
neither: what comes out are the new segments whose representative another document has, and those of the history that
had only one document until now. These hits are written down; history that was hit before is not read into them again. Runs
of one level are then compacted, bucket by bucket and without a shuffle, into one of the next when there are ``fan_out`` of
them, so a document is rewritten a logarithmic number of times and a new batch meets few runs.

Hits are verified. A segment whose whole text occurs in two documents (same representative and same digest of its
text) is shared altogether. The others, at the ends of shared passages, are compared window by window: each distinct one
gives the hashes of its windows, once, whatever the number of documents that hold it, and a window is shared where two
documents have it. So copies are never paired: a group of any size costs its distinct segments. A segment is known by its
representative and a 64-bit digest of its text; a window by its representative and its hash modulo two primes, 62 bits more;
before windows are hashed, the text is held against the segment's digest.

With a ``folder`` the index outlives the session: runs, hits and a manifest are kept there, and :meth:`SpanIndex.open` goes on.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from doclake.llm.fingerprints import Exact, codes_of, segments
from doclake.session import cut, discard, new_path

#: Characters of text that a Python worker holds in arrays at a time (a longer text is held alone).
_CHARS = 1_000_000


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > _CHARS:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(lengths):
        yield lo, len(lengths)


def segment_rows(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(fp, seg, doc_id, start_at, windows) of the texts of ``docs``; null texts and texts shorter than ``span`` have none."""
    schema = T.StructType([T.StructField("fp", T.LongType()), T.StructField("seg", T.LongType()), docs.schema["doc_id"], T.StructField("start_at", T.IntegerType()), T.StructField("windows", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in _slices([len(t) for t in texts]):
                owner, start, count, fp, seg = segments(texts[lo:hi], span, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp), pa.array(seg), ids.take(pa.array(owner + lo)), pa.array(start, pa.int32()), pa.array(count, pa.int32())], names=["fp", "seg", "doc_id", "start_at", "windows"]
                )

    return docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= span)).select("doc_id", "text").mapInArrow(run, schema)


class SpanIndex:
    """An incremental index of documents (doc_id, text) that answers which of their spans occur in other documents.

    ``doc_id`` is a key: rows that share one are one document, and rows without one are left out. ``span`` is the least
    length of a shared span in characters (Unicode code points), ``gram`` (under ``span``) that of the hashed grams.
    """

    def __init__(self, spark: SparkSession, span: int = 200, gram: int = 100, fan_out: int = 4, buckets: int | None = None, folder: str | None = None):
        if not 0 < gram < span:
            raise ValueError("gram must be under span")
        self.spark, self.span, self.gram, self.fan_out, self.folder = spark, span, gram, fan_out, folder
        self.buckets = buckets
        self.runs: list[tuple[int, str, str]] = []  # level, table, path; oldest first
        self.hits: list[str] = []  # paths
        self.texts: list[DataFrame] = []
        self.schema: T.StructType | None = None  # of a run

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SpanIndex:
        """The index that an earlier session left in ``folder``; :meth:`shared` then needs the documents."""
        m = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])
        index = cls(spark, m["span"], m["gram"], m["fan_out"], m["buckets"], folder)
        index.schema = T.StructType.fromJson(m["schema"])
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema)
        for level, path in m["runs"]:
            name = f"doclake_run_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (fp) SORTED BY (fp, seg) INTO {index.buckets} BUCKETS LOCATION '{path}'")
            index.runs.append((level, name, path))
        index.hits = m["hits"]
        return index

    def _path(self, what: str) -> str:
        return f"{self.folder}/{what}-{uuid.uuid4().hex}" if self.folder else new_path(self.spark, what)

    def _keep_manifest(self) -> None:
        """Write the manifest beside the old one and put it in its place: what it names is complete by then."""
        if not self.folder:
            return
        m = {"span": self.span, "gram": self.gram, "fan_out": self.fan_out, "buckets": self.buckets, "schema": json.loads(self.schema.json()), "runs": [(level, path) for level, _, path in self.runs], "hits": self.hits}
        jvm = self.spark.sparkContext._jvm
        new, old = (jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}") for n in ("_manifest.new", "manifest.json"))
        fs = new.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(new, True)
        out.write(json.dumps(m).encode())
        out.close()
        fs.delete(old, False)
        fs.rename(new, old)

    def _write(self, rows: DataFrame, level: int) -> tuple[int, str, str]:
        name, path = f"doclake_run_{uuid.uuid4().hex}", self._path("run")
        rows.write.format("parquet").option("path", path).bucketBy(self.buckets, "fp").sortBy("fp", "seg").saveAsTable(name)
        self.schema = self.schema or rows.schema
        return level, name, path

    def _all(self, runs: list[tuple[int, str, str]]) -> DataFrame:
        """The rows of ``runs``; a union of tables with the same buckets is bucketed like them."""
        rows = self.spark.table(runs[0][1])
        for _, name, _ in runs[1:]:
            rows = rows.unionByName(self.spark.table(name))
        return rows

    def add(self, docs: DataFrame) -> None:
        """Index one batch of documents (doc_id, text; other columns are left alone)."""
        docs = docs.select("doc_id", "text")
        if self.buckets is None:  # of the first batch's size: the files' counts of rows tell it
            self.buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // 50_000)
        self.texts.append(docs)
        rows = segment_rows(docs, self.span, self.gram)
        run = self._write(rows.repartition(self.buckets, "fp").sortWithinPartitions("fp", "seg"), 0)
        self._meet(run)
        self.runs.append(run)
        gone = self._compact()
        self._keep_manifest()
        for _, name, path in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, path)

    def _meet(self, run: tuple[int, str, str]) -> None:
        """Write down the hits that a new run brings."""
        ends = lambda rows: rows.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        new, old = self.spark.table(run[1]), self._all(self.runs) if self.runs else None
        met = ends(new)
        if old is not None:
            before = ends(old).select("fp", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
            met = met.join(before.hint("merge"), "fp", "left")
            met = met.select("fp", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"), F.coalesce(F.col("lo2") == F.col("hi2"), F.lit(False)).alias("alone"))
        else:
            met = met.withColumn("alone", F.lit(False))
        passing: list[str] = []
        two = cut(met.where("lo <> hi").select("fp", "alone"), "met", passing)
        hits = new.join(two.select("fp").hint("merge"), "fp", "left_semi")
        if old is not None:
            hits = hits.unionByName(old.join(two.where("alone").select("fp").hint("merge"), "fp", "left_semi"))
        path = self._path("hits")
        hits.write.parquet(path)
        self.hits.append(path)
        discard(self.spark, passing[0])

    def _compact(self) -> list[tuple[int, str, str]]:
        """Merge the runs of full levels; gives the runs that are no longer needed. A row that is there twice (a document
        indexed again) is kept once, which also is what keeps the merge on the runs' buckets."""
        level, gone = 0, []
        while len(same := [r for r in self.runs if r[0] == level]) >= self.fan_out:
            rows = self._all(same)
            merged = rows.groupBy("fp", "seg", "doc_id", "start_at").agg(F.max("windows").alias("windows")).select(rows.columns)
            self.runs = [r for r in self.runs if r not in same] + [self._write(merged, level + 1)]
            gone += same
            level += 1
        return gone

    def _windows(self, parts: DataFrame, texts: DataFrame) -> DataFrame:
        """(fp, seg, whole, lo, hi, off, hash) of every window of the segments ``parts``, from the texts."""
        span = self.span
        per_doc = parts.groupBy("doc_id").agg(F.collect_list(F.struct("fp", "seg", "whole", "lo", "hi", "start_at", "windows")).alias("parts"))
        id_type = parts.schema["lo"].dataType
        schema = T.StructType(
            [T.StructField("fp", T.LongType()), T.StructField("seg", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("lo", id_type), T.StructField("hi", id_type), T.StructField("off", T.IntegerType()), T.StructField("hash", T.LongType())]
        )

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            codes, starts, raw = codes_of([r[0] for r in rows])
            view = memoryview(raw)
            import xxhash

            good = [i for i, r in enumerate(rows) if xxhash.xxh3_64_intdigest(view[4 * starts[i] : 4 * starts[i + 1]]) == r[1]["seg"] % (1 << 64)]
            hashes = Exact.windows(codes, span)
            counts = np.array([rows[i][1]["windows"] for i in good], np.int64)
            first = starts[good] if good else np.zeros(0, np.int64)
            off = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            which = pa.array(np.repeat(np.arange(len(good)), counts))
            held = [rows[i][1] for i in good]
            cols = [pa.array([h[c] for h in held], t).take(which) for c, t in (("fp", pa.int64()), ("seg", pa.int64()), ("whole", pa.bool_()))]
            cols += [pa.array([h[c] for h in held], _arrow(id_type)).take(which) for c in ("lo", "hi")]
            return pa.RecordBatch.from_arrays([*cols, pa.array(off, pa.int32()), pa.array(hashes[np.repeat(first, counts) + off])], names=[f.name for f in schema])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for batch in batches:
                for text, held in zip(batch.column(0), batch.column(1), strict=True):
                    text = text.as_py()
                    for h in held.as_py():
                        piece = text[h["start_at"] : h["start_at"] + h["windows"] - 1 + span]
                        rows.append((piece, h))
                        size += len(piece)
                        if size >= _CHARS:
                            yield flush(rows)
                            rows, size = [], 0
            if rows:
                yield flush(rows)

        return texts.join(per_doc, "doc_id").select("text", "parts").mapInArrow(run, schema)

    def shared(self, docs: DataFrame | None = None) -> DataFrame:
        """(doc_id, start_at, end_at): the stretches of each indexed document covered by spans of at least ``span``
        characters that occur verbatim in another one; stretches of a document don't touch. ``docs`` (doc_id, text) are
        the indexed documents, needed where some were added in another session."""
        if not self.runs:
            raise ValueError("nothing is indexed")
        if docs is None:
            docs = self.texts[0]
            for t in self.texts[1:]:
                docs = docs.unionByName(t)
        hits = self.spark.read.schema(self.schema).parquet(*self.hits)
        segs = hits.groupBy("fp", "seg").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "start_at", "windows")).alias("one"))
        segs = cut(segs.select("fp", "seg", "lo", "hi", F.col("one.doc_id").alias("doc_id"), F.col("one.start_at").alias("start_at"), F.col("one.windows").alias("windows"), (F.col("lo") != F.col("hi")).alias("whole")), "segments")
        uneven = segs.where("NOT whole").select("fp").distinct()
        windows = cut(self._windows(segs.join(uneven, "fp", "left_semi"), docs.select("doc_id", "text")), "windows")
        twice = windows.groupBy("fp", "hash").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).where("_lo <> _hi").select("fp", "hash")
        found = windows.where("NOT whole").join(twice, ["fp", "hash"], "left_semi").select("fp", "seg", "off")
        # Neighbouring windows of a segment become one stretch.
        nth = F.row_number().over(Window.partitionBy("fp", "seg").orderBy("off"))
        some = found.withColumn("island", F.col("off") - nth).groupBy("fp", "seg", "island").agg(F.min("off").alias("first"), F.max("off").alias("last")).drop("island")
        every = segs.where("whole").select("fp", "seg", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))
        at = hits.select("fp", "seg", "doc_id", "start_at").join(every.unionByName(some), ["fp", "seg"])
        spans = at.select("doc_id", (F.col("start_at") + F.col("first")).alias("a"), (F.col("start_at") + F.col("last") + self.span).alias("b")).distinct()
        by_doc = Window.partitionBy("doc_id").orderBy("a", "b")
        reach = F.max("b").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
        marked = spans.withColumn("fresh", F.when(F.col("a") <= reach, 0).otherwise(1))
        numbered = marked.withColumn("stretch", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy("doc_id", "stretch").agg(F.min("a").alias("start_at"), F.max("b").alias("end_at")).drop("stretch")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def arrival_batches(docs: DataFrame, time: str, n: int) -> list[DataFrame]:
    """``docs`` in ``n`` batches of about equal size in the order of ``time``; rows without a time come last."""
    t = F.unix_micros(time)
    cuts = docs.agg(F.percentile_approx(t, [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] if n > 1 else None
    edges = sorted(set(cuts or []))
    out = []
    for lo, hi in zip([None, *edges], [*edges, None], strict=True):
        inside = F.lit(True)
        if lo is not None:
            inside = t > lo
        if hi is not None:
            inside = inside & (t <= hi)
        elif lo is not None:
            inside = inside | t.isNull()
        out.append(docs.where(inside))
    return out
