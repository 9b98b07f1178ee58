"""Session settings for local runs, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(app: str, cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session; on a cluster the session comes from spark-submit instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders that stand in for ``spark.checkpoint.dir`` in local sessions, by application.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    A local folder is used only by local sessions without that setting, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    application = spark.sparkContext.applicationId
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if application not in _local_folders:
            _local_folders[application] = tempfile.mkdtemp(prefix="cargolens-tables-")
        folder = _local_folders[application]
    return f"{folder.rstrip('/')}/{application}/tables"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that later steps read several times.

    The frame is computed once and written as a Parquet table to the shared folder, so it
    survives lost executors and its columns stay prunable.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote for this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


SMALL_ROWS = 100_000


def broadcast_if_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast if the frame, counted first, has at most ``most`` narrow rows.

    For materialized frames, whose size Spark's planner does not know.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def use_all_cores(df: DataFrame) -> DataFrame:
    """Spread a frame in fewer partitions than cores before heavy work on each row.

    A large table has partitions enough and is left as it is. For frames that are read
    or materialized only: asking others for their partitions would run their shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
