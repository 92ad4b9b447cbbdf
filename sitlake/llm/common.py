"""What several operators share: words, size-checked joins, names of columns, and what workers need."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import sys
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import BROADCAST_ROWS, checked_broadcast, release, scratch_dir, scratch_paths, stored

__all__ = ["BROADCAST_ROWS", "checked_broadcast", "release", "scratch_dir", "scratch_paths", "stored"]

#: White space of the contracts: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: What stands between words once A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes to UTF-8 bytes: A-Z lower-cased, whatever is not in a word a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Rows of an Arrow batch.
BATCH_ROWS = 512
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8 bytes; a null text has none."""
    return utf8(text).translate(WORD_BYTES).split()


def with_small(left: DataFrame, small: DataFrame, on: Column | str | list[str], how: str = "left", row_bytes: int = 64) -> DataFrame:
    """Join with a stored table: broadcast if its counted rows are within the bound, else by shuffle.

    Beyond the bound AQE splits skewed partitions of the left side, so a hot key is no single task.
    """
    return left.join(checked_broadcast(small, row_bytes), on, how)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def range_count(spark: SparkSession, rows: int, most_rows: int, least_rows: int = 1024) -> int:
    """Ranges to deal rows out to: of most_rows each, but as many as shuffles have where rows are few."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // most_rows), min(usual, -(-rows // least_rows)))


def few_rows(batches, rows: int = 256):
    """The same rows in smaller batches, so Python holds objects for a few rows only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def others(columns: DataFrame | list[str], results: tuple[str, ...]) -> list[str]:
    """Columns that stay beside the results: all but those named like one, in any case."""
    names = columns if isinstance(columns, list) else columns.columns
    taken = {r.lower() for r in results}
    return [c for c in names if c.lower() not in taken]


def whole_row(columns: list[str], name: str = "_row") -> Column:
    """Columns as one struct, so no name of theirs meets a name of the operator's."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in columns]).alias(name)


def held(name: str) -> dict:
    """What a worker keeps from task to task for one kind of work; that of other kinds goes."""
    everything = sys.__dict__.setdefault("_sitlake_held", {})
    for other in [k for k in everything if k != name]:
        del everything[other]
    return everything.setdefault(name, {})


def give_back() -> None:
    """Return a worker's free memory to the machine: allocators keep most of it otherwise."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def lean(run, name: str = ""):
    """A function over batches; before it, the worker drops what other kinds of work keep, and after it, it gives memory back."""

    @wraps(run)
    def task(batches):
        held(name)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; all else stays."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Array of the runs of non-space; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+", -1))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started, and keep their batches small.

    A session with Spark's default of 10,000 rows to an Arrow batch gets BATCH_ROWS, as rows are whole texts.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCHES) == "10000":
        spark.conf.set(_BATCHES, BATCH_ROWS)
    if getattr(context, "_sitlake_shipped", False):
        return
    import shutil
    import tempfile

    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    own = os.path.realpath(tempfile.mkdtemp(prefix="sitlake"))  # the driver's copy, which Spark serves to executors
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    staged = os.path.join(own, "tree", os.path.basename(package))
    shutil.copytree(package, staged, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(own, "sitlake_pkg"), "zip", os.path.join(own, "tree")))
    context._sitlake_shipped = True


def shared_fs(uri: str):
    """(pyarrow file system, path) of a URI in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", uri))
