"""Blocks of searches: same rows as without tricks, and bounds on what a task holds and what leaves it."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import graph, lexical, search


@pytest.mark.parametrize("metric", ["cosine", "l2", "neg_ip", "l1"])
@pytest.mark.parametrize("scale", [1.0, 1e6, 1e-6])
def test_block_gives_the_rows_of_all_distances(metric, scale):
    rng = np.random.default_rng(3)
    c = np.round(rng.normal(size=(900, 6)), 1)  # many ties
    c[::7] = c[0]
    c[5] = 0
    q = np.concatenate([c[:40], np.zeros((1, 6)), rng.normal(size=(20, 6))]) * scale
    c = c * scale
    order = rng.permutation(len(c))
    i, j, d = search.block_nearest(metric, q, c, order, 9, np.full(len(q), np.inf))
    whole = search._distances(metric, q, c)
    for row in range(len(q)):
        want = search.least_of(np.round(whole[row], 9), order, 9)
        if scale == 1.0 or metric == "cosine":
            assert j[i == row].tolist() == want.tolist()
        assert np.allclose(d[i == row], whole[row][want], rtol=1e-9, atol=1e-9)


def test_a_task_holds_no_matrix_of_two_blocks():
    rng = np.random.default_rng(4)
    q, c = rng.normal(size=(2048, 16)), rng.normal(size=(16_384, 16))
    tracemalloc.start()
    search.block_nearest("cosine", q, c, np.arange(len(c)), 5, np.full(len(q), np.inf))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2048 * 16_384 * 8 / 4  # a quarter of one matrix in double precision


def test_blocks_grow_with_the_tables():
    assert search.block_numbers(500, 10_000) == (1, 1)
    assert search.block_numbers(400_000, 3_000_000) == (7, 46)


def test_an_exact_check_adds_what_graphs_miss(spark):
    x = np.random.default_rng(1).normal(size=(1500, 24))
    corpus = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    asked = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    found = graph.graph_search(asked, *graph.graph_index(corpus, shard_rows=400), k=5, beam=5)
    exact = key(search.knn(asked, corpus, 5))
    assert key(found) != exact
    assert key(search.completed(found, asked, corpus, 5)) == exact


def test_bm25_of_many_blocks_is_that_of_one(spark, monkeypatch):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.5, n) if x < 300)
    docs = spark.createDataFrame([(k, text(40)) for k in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(k, text(8)) for k in range(30)], "query_id long, text string")
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 8)) for r in df.collect())
    whole = key(lexical.bm25(asked, docs, 3))
    index = lexical.weighted_postings(asked, docs, lexical.space_tokens)
    # No more than k rows of a query leave a block.
    assert lexical.bounded_scores(index, 3).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3
    monkeypatch.setattr(lexical, "DOCUMENT_BLOCK", 40)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 7)
    assert key(lexical.bm25(asked, docs, 3)) == whole
