"""Equal texts are embedded and compared once, with the rows that comparing all of them gives; products by tiles give those of whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import search
from textloom.plans import answering
from textloom.plans.providers import HashingEmbedder

WORDS = ("ana", "rio", "sol", "mar", "céu", "lua")


class Noting(HashingEmbedder):
    """Notes how many rows it embeds."""

    def __init__(self):
        super().__init__(8)
        self.rows = []

    def embed(self, rows, id):
        self.rows.append(rows.count())
        return super().embed(rows, id)


def texts(spark, id, n, repeats):
    draw = np.random.default_rng(n)
    some = [" ".join(draw.choice(WORDS, draw.integers(1, 5))) for _ in range(n // repeats)] + ["", None, "?!"]
    return spark.createDataFrame([(k, some[int(draw.integers(len(some)))]) for k in range(n)], f"{id} long, text string")


def key(found):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in found.collect())


@pytest.mark.parametrize("k", [1, 4, 30])
def test_equal_texts_share_what_is_found(spark, k):
    asked, docs, noting = texts(spark, "query_id", 30, 3), texts(spark, "doc_id", 200, 10), Noting()
    found = key(answering.nearest_texts(asked, docs, k, noting))
    whole = HashingEmbedder(8)
    assert found == key(search.knn(whole.embed(asked, "query_id"), whole.embed(docs, "doc_id").withColumnRenamed("doc_id", "id"), k))
    assert len(found) > 20 * k // 2
    assert noting.rows == [t.where("text IS NOT NULL").select("text").distinct().count() for t in (asked, docs)]


def test_texts_of_one_id_count_as_one(spark):
    docs = spark.createDataFrame([(1, "ana"), (2, "ana"), (2, "rio"), (3, "rio"), (None, "sol")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "ana"), (8, "ana"), (9, "ana rio")], "query_id long, text string")
    found = key(answering.nearest_texts(asked, docs, 2, HashingEmbedder()))
    assert [r[:3] for r in found] == [(7, 1, 1), (7, 2, 2), (8, 1, 1), (8, 2, 2), (9, 1, 2), (9, 2, 1)]


def test_only_shown_ranks_are_searched_for(spark, monkeypatch):
    asked = []
    kept = answering.knn
    monkeypatch.setattr(answering, "knn", lambda queries, corpus, k: asked.append(k) or kept(queries, corpus, k))
    docs = texts(spark, "doc_id", 40, 2).select("doc_id", "text", F.lit(None).cast("string").alias("title"), F.lit("s").alias("source"))
    titles = spark.createDataFrame([(1, "zzz")], "id long, name string")
    cached = spark.createDataFrame([], "entry_id long, query string, response string, created_at timestamp")
    answering.answered(spark.createDataFrame([(1, "onde fica o rio?")], "query_id long, text string"), docs, titles, cached).collect()
    assert asked == [answering.Config().top_k_final]


@pytest.mark.parametrize("metric", ["cosine", "l2", "neg_ip"])
@pytest.mark.parametrize("k", [3, 40, 900, 6000])
def test_tiles_give_the_rows_of_all_distances(metric, k, monkeypatch):
    monkeypatch.setattr(search, "PART", 16)
    monkeypatch.setattr(search, "PAIRS_HELD", 500)
    rng = np.random.default_rng(k)
    c = np.round(rng.normal(size=(5000, 5)), 1)
    c[rng.integers(len(c), size=900)] = c[0]
    q = np.concatenate([c[:20], rng.normal(size=(20, 5))])
    order = rng.permutation(len(c))
    bounds = np.where(np.arange(len(q)) % 2, np.inf, 0.7)
    i, j, d = search.block_nearest(metric, q, c, order, k, bounds)
    whole = np.round(search._distances(metric, q, c), 9)
    for row in range(len(q)):
        want = search.least_of(whole[row], order, k)
        assert j[i == row].tolist() == want[whole[row][want] <= bounds[row]].tolist()


def test_few_pairs_leave_a_product():
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(64, 16)).astype(np.float32), rng.normal(size=(20_000, 16)).astype(np.float32)
    pairs = sum(len(x) for x, _ in search.near_pairs(-q, c, 4, np.full(64, 1e-5), np.full(64, np.inf)))
    assert 4 * 64 <= pairs < 40 * 64
