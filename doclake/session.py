"""What every operator needs from the session: tables, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a cluster (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from a shipped archive
        return
    out = Path(tempfile.mkdtemp(prefix="doclake-ship-")) / "doclake_pkg.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(out))
    atexit.register(shutil.rmtree, out.parent, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if it is set, else (local master only) a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.environ.get("DOCLAKE_LOCAL_SHARED")
    if not own:
        own = os.environ["DOCLAKE_LOCAL_SHARED"] = tempfile.mkdtemp(prefix="doclake-shared-")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, deleted when the process ends or by :func:`discard`."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_discard_all)
    _written.append((spark, path))
    return path


def cut(df: DataFrame, what: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and losing an executor loses nothing.
    The path is added to ``paths``, for callers that :func:`discard` it before the process ends."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _discard_all() -> None:
    for spark, path in _written:
        try:
            if path.startswith("file:") or "://" not in path:
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
            else:
                discard(spark, path)
        except Exception:  # noqa: BLE001 - the application may be gone
            pass
    own = os.environ.get("DOCLAKE_LOCAL_SHARED")
    if own:
        shutil.rmtree(own, ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for costly work per row on few large row groups."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
