"""Session settings and stage tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "tessera") -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow. Cluster settings win where already given."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.parquet.filterPushdown", "true"))
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "20g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables: `spark.checkpoint.dir`. A folder of our own only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    known = getattr(spark, "_tessera_stage_root", None)
    if known is None:
        known = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark._tessera_stage_root = known
    return known


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once as a Parquet stage table and read it back.

    Used where a result feeds several branches, or where the planner needs its
    true size: file sizes are exact statistics, so Spark's own threshold decides
    about broadcasting. The table survives lost executors.
    """
    spark = df.sparkSession
    path = os.path.join(stage_root(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Remove stage tables whose last reader is done. Tables that weren't made by `stage` are left alone."""
    for df in tables:
        path = getattr(df, "_stage_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
            df._stage_path = None


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def shuffles_removed(spark: SparkSession):
    """Shuffle files of a query go with its end, for work that goes from stage table to stage table."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def batches_of(spark: SparkSession, rows: int):
    """Arrow batches hold `rows` rows at most, or fewer where so set, for work on whole texts that goes from stage table to stage table."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    return _setting(spark, key, str(min(now, rows) if now > 0 else rows))


def is_small(df: DataFrame, limit_bytes: int = 64 * 1024 * 1024) -> bool:
    """Whether the planner's size figure for a table read from files is below a limit."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit_bytes


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one split per core before costly row work.

    A small file with a single row group would otherwise be parsed by one task. Large
    inputs have more splits than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
