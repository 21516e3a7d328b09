"""Intermediate tables in the storage that a cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset in local mode a temporary folder stands in."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def deleted(spark: SparkSession, where: str) -> None:
    """Deletes a folder; a stopped session leaves it to the storage's own expiry."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows to shared storage and reads them back, so that they are made once and lost executors cost no
    more than their tasks. They go when the driver's session ends."""
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/textloom/{label}-{uuid.uuid4().hex}"
    atexit.register(deleted, spark, where)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt to all cores, where the source has fewer parts than there are cores (as a file of one row group
    has); else as they are. For what costs far more to work on than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt to all cores by a key, for grouping by it, where the groups cost far more to work on than to move. Groups are made
    where they are dealt to, and the number of parts is known without running anything."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
