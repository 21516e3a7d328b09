"""Queries of chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunk
from ..sources.io import table
from .registry import query

#: In SQL: the starts of word windows of size t with overlap o over arrays w.
WINDOWS = r"""
    d AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text, E' \t\n\r'), '\s+'), lambda x: x <> '') AS w FROM documents),
    n AS (SELECT doc_id, w, len(w) AS n, {t} AS t, {o} AS o FROM d WHERE len(w) > 0),
    l AS (SELECT *, CASE WHEN n <= t THEN 0 ELSE ceil((n - t) / (t - o))::BIGINT * (t - o) END AS ls FROM n),
    s AS (
        SELECT doc_id, w, t, unnest(list_concat(range(0, ls + 1, t - o),
            CASE WHEN greatest(ls + 1, n - o) <= n - 1 THEN range(greatest(ls + 1, n - o), n) ELSE [] END)) AS start FROM l)"""


@query(
    "chunk_word_windows",
    f"""
    WITH {WINDOWS.format(t=150, o=30)}
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_no, start,
           array_to_string(list_slice(w, start + 1, start + t), ' ') AS chunk FROM s""",
)
def chunk_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunk.word_windows(table(spark, sf_dir, "documents"), 150, 30)
    return cut.withColumns({"chunk_no": F.col("chunk_no").cast("long"), "start": F.col("start").cast("long")})


@query("chunk_recursive")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.recursive_chunks(table(spark, sf_dir, "documents"))


@query("chunk_sections")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' first line as a summary and the rest as objectives, so that there are sections."""
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    rest = F.substring(F.col("text"), F.length(first) + 2, F.length("text"))
    text = F.concat(F.lit("Resumo: "), first, F.lit("\nObjetivos: "), rest)
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 2 == 0, text).otherwise(F.col("text")))
    return chunk.section_chunks(docs)


@query("chunk_size_sweep")
def chunk_size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and their mean length at several sizes and overlaps."""
    settings = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap")) for s, o in ((200, 20), (500, 50), (800, 80))])
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(settings).alias("s"))
    cut = docs.select("s.*", F.explode(chunk._recursive(F.col("text"), F.col("s.size"), F.col("s.overlap"))).alias("chunk"))
    return cut.groupBy("size", "overlap").agg(F.count("*").alias("chunks"), F.round(F.avg(F.length("chunk")), 6).alias("mean_length"))
