"""Graph search and bounded BM25: results, and how much of the corpus they look at."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import graph, lexical, pruned, search


def vectors(spark, rows, dim, seed, groups=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, dim))
    if groups:
        x = rng.normal(size=(groups, dim))[rng.integers(0, groups, rows)] + 0.6 * x
    return spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "id long, embedding array<double>")


def recall_and_share(spark, corpus, beam, shard_rows=graph.SHARD_ROWS, k=5):
    asked = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = graph.graph_search(asked, *graph.graph_index(corpus, shard_rows=shard_rows), k=k, beam=beam).collect()
    want = {(r["query_id"], r["id"]) for r in search.knn(asked, corpus, k).collect()}
    n = asked.count()
    compared = {r["query_id"]: r["compared"] for r in got}
    return len(want & {(r["query_id"], r["id"]) for r in got}) / (n * k), sum(compared.values()) / n / corpus.count()


def test_graph_search_compares_few(spark):
    recall, share = recall_and_share(spark, vectors(spark, 6000, 32, 1, groups=300), beam=32)
    assert recall >= 0.95 and share < 0.1


def test_graph_search_of_shards(spark):
    recall, share = recall_and_share(spark, vectors(spark, 3000, 16, 2), beam=16, shard_rows=1000)
    assert recall >= 0.95 and share < 0.5


def test_graph_of_the_given_vectors(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    recall, share = recall_and_share(spark, corpus, beam=16)
    assert recall >= 0.95 and share < 0.25


def test_graph_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [1.0, 0.0]), (5, [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.1]), (8, None)], "query_id long, embedding array<double>")
    got = [(r["query_id"], r["id"], round(r["distance"], 3)) for r in graph.graph_search(asked, *graph.graph_index(corpus), k=9).orderBy("rank").collect()]
    assert got == [(9, 1, 0.005), (9, 5, 0.005), (9, 5, 0.9), (9, 2, 1.0)]
    assert graph.graph_search(asked, *graph.graph_index(corpus.where("id > 99")), k=2).count() == 0


def corpus_of_words(spark, n=600):
    pick = random.Random(4)
    words = [f"w{k}" for k in range(800)]
    text = lambda m: " ".join(["the"] * pick.randrange(3) + ["of"] * pick.randrange(2) + pick.choices(words, [1 / (k + 1) for k in range(800)], k=m))
    docs = spark.createDataFrame([(k, text(pick.randrange(0, 80)) or None) for k in range(n)], "doc_id long, text string")
    return docs, spark.createDataFrame([(k, text(12) if k else None) for k in range(40)], "query_id long, text string")


def test_bounded_bm25_is_exact(spark):
    docs, asked = corpus_of_words(spark)
    got = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 7)) for r in lexical.bm25(asked, docs, 4).collect()}
    index = lexical.weighted_postings(asked, docs, lexical.space_tokens)
    every = index[0].join(index[1], "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("factor") * F.col("weight")).alias("score"))
    want = {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 7)) for r in lexical.ranked(every, 4).collect()}
    assert got == want and len(want) > 100
    assert lexical.bounded_scores(index, 4).count() < every.count()


def test_bounds_leave_few_documents_of_the_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    asked = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    index = lexical.weighted_postings(asked, docs, lexical.space_tokens)
    every = index[0].join(index[1], "term").count()  # pairs of a question's word and a document with it
    assert lexical.candidates(lexical.stored(lexical.essential_terms(*index, 5), "essential"), index[1]).count() < every / 6


def test_bm25_of_nothing(spark):
    docs, asked = corpus_of_words(spark, 3)
    assert lexical.bm25(asked.where("false"), docs, 3).count() == 0
    assert lexical.bm25(asked, docs.where("false"), 3).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1"])
def test_pruned_search_is_exact_and_skips(spark, metric):
    corpus = vectors(spark, 4000, 8, 5, groups=40)
    asked = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 8)) for r in df.collect())
    got = pruned.pruned_knn(asked, corpus, 5, metric)
    assert key(got) == key(search.knn(asked, corpus, 5, metric))
    assert got.agg(F.avg("compared")).first()[0] < 0.6 * 4000


def test_pruned_search_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [1.0, 0.0]), (6, [-1.0, 0.0])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.1]), (8, None), (7, [0.0, 0.0])], "query_id long, embedding array<double>")
    for k in (1, 3, 10):
        got, want = pruned.pruned_knn(asked, corpus, k), search.knn(asked.where("embedding IS NOT NULL"), corpus.where("size(embedding) > 0"), k)
        assert sorted((r["query_id"], r["rank"], r["id"]) for r in got.collect()) == sorted((r["query_id"], r["rank"], r["id"]) for r in want.collect())
    assert pruned.pruned_knn(asked, corpus.where("id > 99"), 2).count() == 0
    with pytest.raises(ValueError):
        pruned.pruned_knn(asked, corpus, 1, "neg_ip")
