"""What the operators of this subpackage share: tables, shared storage, text rules."""

from __future__ import annotations

import atexit
import ctypes
import string
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the alphanumeric kind: runs of 0-9, a-z (after lower-casing) and everything beyond ASCII.
ALNUM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else. Texts of ASCII alone take Spark's fast `lower`."""
    plain = F.octet_length(col) == F.char_length(col)
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, string.ascii_uppercase, string.ascii_lowercase))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir; only where that is unset in local mode (tests) a temporary folder stands in.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder in shared storage; it goes when the driver's session ends."""
    where = f"{shared_dir(spark)}/textloom/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, where)
    return where


def remove(spark: SparkSession, where: str) -> None:
    """Deletes a scratch folder; a stopped session leaves it to the storage's own expiry."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes to shared storage and reads back, so lost executors cost no recomputation."""
    where = scratch(df.sparkSession, label)
    df.write.parquet(where)
    out = df.sparkSession.read.schema(df.schema).parquet(where)
    _WRITTEN[id(out)] = (out, where)
    return out


#: What `written` has stored and `free` not yet deleted.
_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def free(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more. Whatever else is passed stays."""
    for df in tables:
        if id(df) in _WRITTEN:
            remove(df.sparkSession, _WRITTEN.pop(id(df))[1])


def text_key(docs: DataFrame) -> Column:
    """Tells rows with one doc_id apart by their texts."""
    return F.xxhash64(docs["text"])


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id and text are not those of a row of gone.

    gone: doc_id and text_key (see above). Null doc_ids equal each other, so each row is judged by its own text.
    """
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("gone_id", "gone_key"):
        while name in taken:
            name += "_"
        names.append(name)
    listed = gone.select(F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1])).distinct()
    here = docs["doc_id"].eqNullSafe(listed[names[0]]) & (text_key(docs) == listed[names[1]])
    return docs.join(listed, here, "left_anti")


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what a task builds from one stays small.

    At the end it gives freed memory back: Python workers live on, and their peaks would add up.
    """
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
