"""Scratch folders in the shared folder that spark.checkpoint.dir names, and tables in them that cut a lineage."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a checked side that may be broadcast, and bytes of it.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20

_scratch: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only a local master may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)  # a path without a scheme is the default file system's
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^file:/+", "file:///", full)


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A new folder in the shared folder; release() or the session's end removes it."""
    path = f"{scratch_root(spark).rstrip('/')}/sitlake-{what}-{uuid.uuid4().hex[:12]}"
    _scratch.append((spark, path))
    return path


def scratch_paths() -> set[str]:
    """Scratch folders that are there now."""
    return {path for _, path in _scratch}


def release(paths: set[str] | None = None) -> None:
    """Remove scratch folders, by default all, once no lazy result needs them."""
    for owner, path in list(_scratch):
        if paths is None or path in paths:
            _scratch.remove((owner, path))
            jvm = owner.sparkContext._jvm
            if jvm is None or owner.sparkContext._jsc.sc().isStopped():
                continue
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(owner.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _at_end() -> None:
    try:
        release()
    except Exception:  # the JVM may have gone first; the folder is then the cluster's to clean
        pass


atexit.register(_at_end)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked_broadcast(small: DataFrame, row_bytes: int = 64) -> DataFrame:
    """A stored table, marked for broadcast if its counted rows are within the bound."""
    few = small.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(small) if few <= BROADCAST_ROWS and few * row_bytes <= BROADCAST_BYTES else small
