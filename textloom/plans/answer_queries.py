"""Queries of the whole cascade over all users' turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import table
from .answering import Config, answered, context_of, prompt
from .lexical_queries import BM25, questions
from .providers import rarest_words
from .registry import query


@query(
    "prompt_context_assembly",
    f"""
    WITH {BM25},
    p AS (
        SELECT query_id, rank, '[Título: documento ' || doc_id || ' | Fonte: ' || coalesce(source, 'documento') || ']' || chr(10) ||
               CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END AS part
        FROM bmr JOIN documents USING (doc_id) WHERE rank <= 4)
    SELECT query_id, 'Responda apenas com base no contexto.' || E'\\n\\n' || 'Contexto:' || E'\\n\\n' ||
           string_agg(part, E'\\n\\n---\\n\\n' ORDER BY rank) || E'\\n\\n' || 'Pergunta: ' || any_value(b.text) AS prompt
    FROM p JOIN benchmark b ON b.item_id = query_id GROUP BY query_id""",
)
def prompt_context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lexical import bm25

    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    titled = docs.withColumn("title", F.concat(F.lit("documento "), F.col("doc_id").cast("string")))
    contexts = context_of(bm25(asked, docs, 4), titled, 300)
    return contexts.join(asked, "query_id").select("query_id", prompt(F.col("text"), F.col("context")).alias("prompt"))


@query("answer_cascade")
def answer_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users' turns as questions; documents as the corpus, part names as titles, answers of even
    conversations as the cache."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "turn", "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("title"), "source")
    titles = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    cached = asked.where("conv_id % 2 = 0").join(replies, ["conv_id", "turn"]).select(
        F.col("query_id").alias("entry_id"), F.col("text").alias("query"), "response", F.timestamp_seconds("query_id").alias("created_at")
    )
    return answered(asked.select("query_id", "text"), docs, titles, cached, Config(guard_input=True))


@query(
    "keyword_extraction",
    r"""
    WITH df AS (
        SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM documents) GROUP BY w),
    q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM benchmark),
    r AS (
        SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(n, 0), w) AS k FROM q LEFT JOIN df USING (w) WHERE length(w) > 3)
    SELECT query_id, string_agg(w, ',' ORDER BY k) AS keywords FROM r WHERE k <= 3 GROUP BY query_id""",
)
def keyword_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = rarest_words(questions(spark, sf_dir), table(spark, sf_dir, "documents"))
    return words.select("query_id", F.array_join("keywords", ",").alias("keywords"))
