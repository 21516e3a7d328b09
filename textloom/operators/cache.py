"""The answer cache as tables: exact and fuzzy hits, expiry, eviction, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import normalized_query, query_key, trigrams
from .lexical import trigram_pairs


def keyed(entries: DataFrame, query: str = "query") -> DataFrame:
    """entries with norm and key."""
    return entries.withColumns({"norm": normalized_query(F.col(query)), "key": query_key(F.col(query))})


def live(entries: DataFrame, as_of: Column, ttl: int = fixed.CACHE_TTL_SECONDS) -> DataFrame:
    """Entries no older than ttl seconds."""
    return entries.where((F.unix_micros(as_of) - F.unix_micros("created_at")) / 1e6 <= ttl)


def exact_hits(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, entry_id: the earliest entry with the same key."""
    first = entries.groupBy("key").agg(F.min_by("entry_id", F.struct("created_at", "entry_id")).alias("entry_id"))
    return queries.select("query_id", "key").join(first, "key").select("query_id", "entry_id")


def fuzzy_hits(queries: DataFrame, entries: DataFrame, least: float = fixed.CACHE_SIMILARITY) -> DataFrame:
    """query_id, entry_id, similarity: the earliest entry (not the best) that is similar enough.

    Equal normal forms are compared once. entries: entry_id, norm, created_at.
    """
    q = queries.select("norm").distinct().select(F.col("norm").alias("id"), F.col("norm").alias("name"))
    e = entries.select("norm").distinct().select(F.col("norm").alias("id"), F.col("norm").alias("name"))
    pairs = trigram_pairs(q, e, trigrams, least)
    first = entries.groupBy("norm").agg(F.min(F.struct("created_at", "entry_id")).alias("first"))
    found = pairs.join(first, F.col("right_id") == F.col("norm")).groupBy("left_id")
    best = found.agg(F.min(F.struct("first", "similarity")).alias("hit"))
    return queries.join(best, F.col("norm") == F.col("left_id")).select(
        "query_id", F.col("hit.first.entry_id").alias("entry_id"), F.col("hit.similarity").alias("similarity")
    )


def storable(answers: DataFrame) -> DataFrame:
    """Of answers with their strategy and route those that the cache may keep: retrieved ones with a route. Blocked,
    cached, looked-up and structured answers, and those from all collections, are made anew each time."""
    return answers.where((F.col("strategy") == "retrieval") & F.col("route").isNotNull())


def kept(entries: DataFrame, most: int = fixed.CACHE_MOST_ENTRIES + 1) -> DataFrame:
    """The newest entries; in the long run one more than the limit stays, as room is made before an entry is added."""
    return entries.orderBy(F.desc("created_at"), F.desc("entry_id")).limit(most)


def invalidated(entries: DataFrame, queries: DataFrame) -> DataFrame:
    return entries.join(queries.select("key"), "key", "left_anti")


def statistics(requests: DataFrame) -> DataFrame:
    """hits, misses, hit_rate over requests with a boolean hit."""
    hits = F.count_if("hit")
    return requests.agg(hits.alias("hits"), F.count_if(~F.col("hit")).alias("misses"), (hits / F.count("*")).alias("hit_rate"))
