"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's ``spark.checkpoint.dir``.

    Where that is unset a local folder stands in, but only if driver and executors are one process; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clear)
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends here, and losing an executor loses nothing.

    The shuffle files of the write are deleted as it ends; the table stays until ``discard`` or the end of the driver.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path  # what ``discard`` deletes
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables of which all that follows has been stored in turn."""
    for t in tables:
        path = getattr(t, "stored_at", None)
        if path:
            _delete(t.sparkSession, path)
            _made[:] = [m for m in _made if m[1] != path]


def clear() -> None:
    """Delete all that is left of this driver's tables, if its session still runs."""
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended; nothing can be deleted through it
            break
    _made.clear()
