"""What the corpus operators share: tables in the shared folder, row keys, column handling."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none, and driver and executors are one process (tests), a new
    temporary folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_root(spark)}/stratalens/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    The files outlive any executor, so a lost one never repeats what came before, and partition
    numbers or row orders that were recorded on the way stay as written.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_entry_ids(entries: DataFrame) -> DataFrame:
    """Entries with a number of their own, to be materialised next."""
    return entries.withColumn("entry", F.monotonically_increasing_id())


def tell_entries(entries: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Entries (keys, entry, long lists) with the verdict on their key, one row for each key that has one.

    Only keys and entry numbers meet on the key; the lists are joined by entry number. So a key that a
    third of all rows share brings a short row for each of its entries to one task, and not the rows.
    """
    told = entries.select("entry", *keys).join(verdicts, keys).drop(*keys)
    return entries.join(told, "entry")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path in whatever file system it is in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release() -> None:
    """Delete every table written so far; results that still read them become unusable."""
    while _written:
        spark, path = _written.pop()
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already; the folder is then the cluster's to clear
            pass


atexit.register(release)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an output of these names replaces."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


def hash_bound(share: float) -> int:
    """The 64-bit value that a hash is at or below with this probability; never so small that none is."""
    return max(-(1 << 63), min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)) - 1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """For the actions within: at most ``rows`` rows in a batch that goes to Python, as texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """The same for all that the session still does: for results that are evaluated after the function that makes them has returned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A ``mapInArrow`` function that gives freed memory back to the system once its task ends."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: nothing to trim
                pass

    return wrapped
