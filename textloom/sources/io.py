"""Reading and writing tables, crawled records, event logs and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Crawled pages of both schemas: what one of them lacks is null.
PAGE_SCHEMA = (
    "id string, tipo string, titulo string, embedding_text string, metadata map<string,string>, "
    "dados_completos string, url string, title string, text string, depth int, crawled_at string"
)
#: Events of the reliability log.
EVENT_SCHEMA = (
    "ts timestamp, event string, component string, elapsed_ms double, context string, error string, "
    "reason string, fallback_to string, message string"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crawled_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of pages, new or old; nested records stay JSON text."""
    return spark.read.schema(PAGE_SCHEMA).option("multiLine", True).json(path)


def save_json(pages: DataFrame, path: str) -> DataFrame:
    """Writes pages as JSON and returns their number by type."""
    pages.write.mode("overwrite").json(path)
    return counts_by_type(pages, "tipo")


def counts_by_type(rows: DataFrame, kind: str) -> DataFrame:
    return rows.groupBy(kind).agg(F.count("*").alias("n")).orderBy(kind)


def append_to_collection(chunks: DataFrame, path: str) -> None:
    """Adds chunks to a table that is partitioned by collection, so readers of one see no other."""
    chunks.write.mode("append").partitionBy("collection").parquet(path)


def replace_collections(chunks: DataFrame, path: str) -> None:
    """Replaces the collections that the chunks are of, and leaves the others."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("collection") == name)


def of_dimension(vectors: DataFrame, n: int) -> DataFrame:
    """The vectors, or an error at run time if one has another length."""
    right = F.when(F.size("embedding") == n, F.col("embedding"))
    return vectors.withColumn("embedding", F.coalesce(right, F.raise_error(F.lit(f"a vector isn't of {n} dimensions"))))


def append_events(events: DataFrame, path: str) -> None:
    """Adds events to a log of JSON lines; missing and empty fields are left out."""
    clean = [F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in events.dtypes]
    events.select(*clean).write.mode("append").option("ignoreNullFields", True).json(path)


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).json(path)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).json(path)


def text_log(spark: SparkSession, path: str) -> DataFrame:
    """ts, level, logger, message of lines `ts [LEVEL] logger — message`; other lines are left out."""
    pattern = r"^(\S+ \S+) \[(\w+)\] (.*?) — (.*)$"
    part = lambda k: F.regexp_extract("value", pattern, k)
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(part(1).alias("ts"), part(2).alias("level"), part(3).alias("logger"), part(4).alias("message"))


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """page, content of each page of PDF files; needs the optional pypdf package on the executors."""

    def pages(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                texts = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
                yield pd.DataFrame({"source": name, "page": range(len(texts)), "content": texts})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(pages, "source string, page int, content string")
