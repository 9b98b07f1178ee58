"""Written tables for frames that several steps read, and caches that live as long as a process."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Rows of at most a few dozen bytes each that may be broadcast.
BROADCAST_ROWS = 500_000
#: Spark's setting to drop the shuffle files of a query when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    A temporary folder stands in for it in local sessions without that setting, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = process_value("folder", lambda: tempfile.mkdtemp(prefix="cargolens-llm-"))
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage is cut, columns stay prunable.

    Shuffle files of the job that wrote it go at once, as nothing reads them any more.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def observed(df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict]:
    """The frame as a written table, and aggregates of its rows that need no further job."""
    seen = Observation()
    table = written(df.observe(seen, *(c.alias(name) for name, c in sums.items())), label)
    return table, dict(seen.get)


def discard(*tables: DataFrame) -> None:
    """Delete ``written`` tables whose last reader has been written itself."""
    for table in tables:
        _delete(table.sparkSession, _paths.pop(table))


def release(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder."""
    _delete(spark, shared_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, array: str | None = None) -> DataFrame:
    """Hint a broadcast if a written table of narrow rows, counted first, has at most ``rows``.

    ``array`` names a column of numbers, ten of which weigh as much as a row. Beyond the bound
    Spark joins by a shuffle and splits skewed partitions.
    """
    if array is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    weight = df.agg(F.count("*") + F.coalesce(F.sum(F.size(array)), F.lit(0)) / 10).first()[0]
    return F.broadcast(df) if weight <= rows else df


def least_reached(counts: DataFrame, column: str, most: int) -> int:
    """The least power of two that at most ``most`` rows of the column of counts reach."""
    sizes = counts.groupBy(F.floor(F.log2(column)).alias("power")).count().collect()
    at, reached = max((r["power"] for r in sizes), default=0) + 1, 0
    for row in sorted(sizes, key=lambda r: -r["power"]):
        reached += row["count"]
        if reached > most:
            break
        at = row["power"]
    return 1 << at


def process_value(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gave when this process asked first: tasks of one worker share it."""
    holder = sys.modules.setdefault(
        "cargolens_process_values", types.ModuleType("cargolens_process_values")
    )
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)
