"""Queries of the answer cache: turns of users as requests and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized_query, query_key
from ..operators import cache
from ..sources.io import table
from .registry import query

#: In SQL: normal forms of users' turns.
NORM = r"""
    u AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, text FROM conversations WHERE role = 'user'),
    n AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(lower(text)), '\s+', ' ', 'g')), '[?!.,;]$', '')) AS norm FROM u)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    return users.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "text")


@query("query_normalize_hash", f"WITH {NORM} SELECT id, norm, sha256(norm) AS key FROM n")
def query_normalize_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return turns(spark, sf_dir).select("id", normalized_query(text).alias("norm"), query_key(text).alias("key"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(requests, entries): turns of odd conversations ask, those of even ones are cached."""
    keyed = cache.keyed(turns(spark, sf_dir), "text")
    asked = keyed.where("conv_id % 2 = 1").withColumnRenamed("id", "query_id")
    created = F.timestamp_seconds(F.col("id"))
    return asked, keyed.where("conv_id % 2 = 0").select(F.col("id").alias("entry_id"), "norm", "key", created.alias("created_at"))


@query(
    "cache_exact_hit",
    f"""WITH {NORM} SELECT a.id AS query_id, min(b.id) AS entry_id FROM n a JOIN n b ON a.norm = b.norm
    WHERE a.conv_id % 2 = 1 AND b.conv_id % 2 = 0 GROUP BY a.id""",
)
def cache_exact_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.exact_hits(*sides(spark, sf_dir))


@query(
    "cache_fuzzy_hit",
    f"""
    WITH {NORM},
    g AS (SELECT id, conv_id, list_distinct(list_transform(range(1, length(norm) + 3), lambda i: substr('  ' || norm || '  ', i, 3))) AS g FROM n),
    s AS (
        SELECT a.id AS query_id, b.id AS entry_id, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS s
        FROM g a JOIN g b ON a.conv_id % 2 = 1 AND b.conv_id % 2 = 0
        AND least(len(a.g), len(b.g)) >= 0.82 * greatest(len(a.g), len(b.g)) - 1e-9)
    SELECT query_id, min(entry_id) AS entry_id, round(arg_min(s, entry_id), 6) AS similarity FROM s WHERE s >= 0.82 GROUP BY query_id""",
)
def cache_fuzzy_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = cache.fuzzy_hits(*sides(spark, sf_dir))
    return hits.select("query_id", "entry_id", F.round("similarity", 6).alias("similarity"))


@query(
    "cache_ttl_evict",
    """
    WITH t AS (SELECT max(ts) AS now FROM events)
    SELECT event_id FROM events, t WHERE epoch_us(now) - epoch_us(ts) <= 3600 * 24 * 1000000::BIGINT
    ORDER BY ts DESC, event_id DESC LIMIT 513""",
)
def cache_ttl_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries that live for a day; the newest stay."""
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("created_at"))
    now = F.lit(entries.agg(F.max("created_at")).first()[0])
    kept = cache.kept(cache.live(entries, now, 3600 * 24))
    return kept.select(F.col("entry_id").alias("event_id"))


@query(
    "cache_statistics",
    f"""
    WITH {NORM}, h AS (
        SELECT a.id, a.norm IN (SELECT norm FROM n WHERE conv_id % 2 = 0) AS hit FROM n a WHERE a.conv_id % 2 = 1)
    SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM h""",
)
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, entries = sides(spark, sf_dir)
    hits = cache.exact_hits(asked, entries)
    requests = asked.select("query_id").join(hits, "query_id", "left").withColumn("hit", F.col("entry_id").isNotNull())
    return cache.statistics(requests).withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "cache_invalidate",
    f"WITH {NORM} SELECT id AS entry_id FROM n WHERE conv_id % 2 = 0 AND norm NOT IN (SELECT norm FROM n WHERE conv_id % 2 = 1)",
)
def cache_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, entries = sides(spark, sf_dir)
    return cache.invalidated(entries, asked).select("entry_id")
