"""Answering a table of questions: guard, cache, lookup by title, retrieval, in this order of preference.

Every strategy is a table of candidates for all questions at once, and each question takes the one of highest
priority that has an answer; a single question is a table of one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.rules import entity, input_guard, output_guard, route
from ..functions.text import normalized_query, truncated
from ..operators.cache import exact_hits, keyed
from ..operators.fusion import first_by_prefix, hybrid_weights, overlap_rerank, reciprocal_rank_fusion
from ..operators.lexical import bm25, ranked, title_lookup
from ..operators.search import knn
from ..sources.stored import spread, stored
from .providers import Embedder, ExtractiveGenerator, Generator, HashingEmbedder


@dataclass(frozen=True)
class Config:
    top_k_retrieve: int = fixed.TOP_K_RETRIEVE
    top_k_final: int = fixed.TOP_K_FINAL
    max_chars_per_doc: int = fixed.MAX_CHARS_PER_DOC
    threshold: float = fixed.RELEVANCE_THRESHOLD
    hybrid: bool = False
    alpha: float = 0.5
    rerank: bool = False
    guard_input: bool = True
    guard_output: bool = True
    embedder: Embedder = field(default_factory=HashingEmbedder)
    generator: Generator = field(default_factory=ExtractiveGenerator)


def alike(rows: DataFrame, id: str, most: int | None = None) -> DataFrame:
    """id, same: the smallest id among the rows (id, text) of the same text; with most only so many of the smallest ids of each text. Texts are told apart
    by SHA-256; an id that repeats is like no other. Stored."""
    each = rows.where(F.col(id).isNotNull() & F.col("text").isNotNull()).select(id, F.sha2("text", 256).alias("digest"))
    keys = each.groupBy(id).agg(F.when(F.count("*") == 1, F.min("digest")).otherwise(F.concat(F.lit("id "), F.col(id).cast("string"))).alias("key"))
    if most is None:
        # No text's rows have to meet in one task.
        keys = stored(keys, f"keys-{id}")
        found = keys.join(keys.groupBy("key").agg(F.min(id).alias("same")), "key").select(id, "same")
    else:
        order = Window.partitionBy("key").orderBy(id)
        found = keys.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select(id, F.first(id).over(order).alias("same"))
    return stored(found, f"alike-{id}")


def nearest_texts(queries: DataFrame, docs: DataFrame, k: int, embedder: Embedder) -> DataFrame:
    """query_id, id, distance, rank: the k nearest of docs (doc_id, text) to each query (query_id, text) by embeddings.

    Equal texts are embedded and compared once, and share what is found. Of documents of one text only the k smallest ids can be among
    the k nearest; and if k other texts come before a text, by distance and then by smallest id, then k documents come before each of
    its own. So the k nearest of the different texts are enough.
    """
    asked, known = alike(queries, "query_id"), alike(docs, "doc_id", k)
    once = lambda rows, ids, id: rows.select(id, "text").join(ids.where(F.col(id) == F.col("same")).select(id), id, "left_semi")
    vectors = stored(embedder.embed(once(queries, asked, "query_id"), "query_id"), "query-vectors")
    corpus = stored(embedder.embed(once(spread(docs.select("doc_id", "text")), known, "doc_id"), "doc_id").withColumnRenamed("doc_id", "id"), "document-vectors")
    found = knn(vectors, corpus, k).select(F.col("query_id").alias("asked"), F.col("id").alias("same"), "distance")
    found = found.join(known.select("same", F.col("doc_id").alias("id")), "same")
    every = found.select("asked", "id", "distance").join(asked.select(F.col("same").alias("asked"), "query_id"), "asked")
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return every.select("query_id", "id", "distance", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def dense(queries: DataFrame, docs: DataFrame, config: Config) -> DataFrame:
    """query_id, doc_id, score, rank by embeddings."""
    found = nearest_texts(queries, docs, config.top_k_retrieve, config.embedder)
    return found.select("query_id", F.col("id").alias("doc_id"), (1 - F.col("distance")).alias("score"), "rank")


def retrieved(queries: DataFrame, docs: DataFrame, config: Config) -> DataFrame:
    """query_id, doc_id, score, rank: dense, or fused with BM25, and reranked, as configured."""
    found = dense(queries, docs, config)
    if config.hybrid:
        lexical_weight, dense_weight = hybrid_weights(config.alpha)
        lexical = bm25(queries, docs, config.top_k_retrieve)
        fused = reciprocal_rank_fusion([(found, dense_weight), (lexical, lexical_weight)])
        found = ranked(fused, 2 * config.top_k_retrieve)
    if config.rerank:
        found = overlap_rerank(found, queries, docs, config.top_k_final).withColumnRenamed("rerank_score", "score")
    return found


def keyword_search(keywords: DataFrame, docs: DataFrame, config: Config, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: the best k of what each keyword finds by itself.

    keywords: query_id, keywords (an array, in order of importance). Each of a query's n keywords brings
    max(2, ceil(k / n)) + 1 documents; of those that begin alike, the one that the first keyword brings stays, with its
    score. Null and empty keywords bring none; a keyword that repeats brings nothing new.
    """
    each = keywords.select("query_id", F.posexplode(F.filter("keywords", lambda w: F.trim(w) != "")).alias("nth", "text"))
    n = F.count("*").over(Window.partitionBy("query_id"))
    quota = F.greatest(F.lit(fixed.LEAST_PER_KEYWORD), F.ceil(k / n)).cast("int") + 1
    # Equal keywords are embedded and searched once.
    each = stored(each.select("query_id", "nth", "text", quota.alias("quota"), F.xxhash64("text").alias("word")), "keywords")
    asked = each.groupBy("word").agg(F.min("text").alias("text")).withColumnRenamed("word", "query_id")
    found = nearest_texts(asked, docs, max(fixed.LEAST_PER_KEYWORD, k) + 1, config.embedder).withColumnRenamed("query_id", "word")
    found = each.join(found, "word").where(F.col("rank") <= F.col("quota"))
    found = found.select("query_id", "nth", "rank", F.col("id").alias("doc_id"), (1 - F.col("distance")).alias("score"))
    found = found.join(docs.select("doc_id", "text"), "doc_id")
    firsts = first_by_prefix(found, "text", [F.col("nth"), F.col("rank")])
    return ranked(firsts.select("query_id", "doc_id", "score"), k)


def context_of(results: DataFrame, docs: DataFrame, most: int, full: DataFrame | None = None) -> DataFrame:
    """query_id, context: the results' texts in order of rank under their titles and sources, joined by a rule.

    docs: doc_id, text, title, source (title and source may be null). full (doc_id, data) is added where a
    document comes first.
    """
    # No more of a text is moved than is shown.
    shown_docs = docs.select("doc_id", truncated(F.col("text"), most).alias("text"), "title", "source")
    joined = results.select("query_id", "doc_id", "rank").join(shown_docs, "doc_id")
    source = F.coalesce("source", F.lit("documento"))
    head = F.when(
        F.coalesce("title", F.lit("")) != "", F.concat(F.lit(fixed.TITLE_LABEL), "title", F.lit(fixed.SOURCE_AFTER_TITLE), source, F.lit("]"))
    ).otherwise(F.concat(F.lit(fixed.SOURCE_LABEL), source, F.lit("]")))
    part = F.concat(head, F.lit("\n"), "text")
    if full is not None:
        first = Window.partitionBy("query_id", "doc_id").orderBy("rank")
        joined = joined.join(full.select("doc_id", "data"), "doc_id", "left").withColumn("_nth", F.row_number().over(first))
        shown = F.concat(F.lit(fixed.WHOLE_DOCUMENT), truncated(F.col("data"), 4000))
        part = F.concat(part, F.when((F.col("_nth") == 1) & F.col("data").isNotNull(), shown).otherwise(""))
    parts = joined.withColumn("part", part).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "part"))).alias("parts"))
    return parts.select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n---\n\n").alias("context"))


def prompt(question: Column, context: Column, instruction: str = fixed.INSTRUCTION) -> Column:
    return F.concat_ws("\n\n", F.lit(instruction), F.lit(fixed.CONTEXT_LABEL), context, F.concat(F.lit(fixed.QUESTION_LABEL), question))


def answered(queries: DataFrame, docs: DataFrame, titles: DataFrame, cached: DataFrame, config: Config = Config()) -> DataFrame:
    """query_id, strategy, route, answer.

    queries: query_id, text. docs: doc_id, text, title, source. titles: id, name. cached: entry_id, query,
    response, created_at. strategy is blocked, cache, title, retrieval or none.
    """
    # Judged once: the guard's patterns take longer than all else that is done to a question.
    asked = stored(queries.withColumn("blocked", input_guard(F.col("text")) if config.guard_input else F.lit(None).cast("string")), "judged")
    open_ = asked.where("blocked IS NULL")
    blocked = asked.where("blocked IS NOT NULL").select("query_id", F.lit(0).alias("priority"), F.lit("blocked").alias("strategy"), F.col("blocked").alias("answer"))
    entries = keyed(cached)
    hits = exact_hits(keyed(open_, "text"), entries).join(entries.select("entry_id", "response"), "entry_id")
    from_cache = hits.select("query_id", F.lit(1).alias("priority"), F.lit("cache").alias("strategy"), F.col("response").alias("answer"))
    named = open_.select(F.col("query_id").alias("id"), F.upper(entity(F.col("text"))).alias("name")).where("name IS NOT NULL")
    found = title_lookup(named, titles, 1).join(titles.select(F.col("id").alias("doc_id"), "name"), "doc_id")
    by_title = found.select("query_id", F.lit(2).alias("priority"), F.lit("title").alias("strategy"), F.col("name").alias("answer"))
    # Only questions that nothing of higher priority answers are searched for.
    settled = stored(blocked.unionByName(from_cache).unionByName(by_title).where("answer IS NOT NULL"), "settled")
    searched = stored(open_.join(settled.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "text"), "searched")
    # Without fusion and reranking no rank after the last that is shown counts.
    ranks = config.top_k_retrieve if config.hybrid or config.rerank else max(min(config.top_k_retrieve, config.top_k_final), 1)
    results = stored(retrieved(searched, docs, replace(config, top_k_retrieve=ranks)), "retrieved")
    best = results.groupBy("query_id").agg(F.max("score").alias("best")).where(F.col("best") >= config.threshold)
    kept = results.where(F.col("rank") <= config.top_k_final).join(best.select("query_id"), "query_id", "left_semi")
    contexts = context_of(kept, docs, config.max_chars_per_doc).join(open_, "query_id")
    made = config.generator.answer(F.col("text"), F.col("context"))
    made = F.when(output_guard(made).isNull(), made) if config.guard_output else made
    by_retrieval = contexts.select("query_id", F.lit(3).alias("priority"), F.lit("retrieval").alias("strategy"), made.alias("answer"))
    nothing = open_.select("query_id", F.lit(9).alias("priority"), F.lit("none").alias("strategy"), F.lit(fixed.NOTHING_FOUND).alias("answer"))
    every = settled.unionByName(by_retrieval).unionByName(nothing)
    first = Window.partitionBy("query_id").orderBy("priority")
    chosen = every.where("answer IS NOT NULL").withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    routes = queries.select("query_id", route(normalized_query(F.col("text"))).alias("route"))
    return chosen.select("query_id", "strategy", "answer").join(routes, "query_id").select("query_id", "strategy", "route", "answer")
