import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import cells
from textloom.llm.queries import op12_embedding_dedup
from textloom.llm.queries import table as read

from ..conftest import DATA


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id) of each row, by all pairs."""
    usable = []
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            w = np.array(v, np.float64)
            usable.append((k, label, len(v), w / np.linalg.norm(w)))
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    groups = {}
    for k, label, n, v in usable:
        groups.setdefault((label, n), []).append((k, v))
    for members in groups.values():
        numbers, vectors = zip(*members, strict=True)
        close = np.stack(vectors) @ np.stack(vectors).T >= threshold
        for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True):
            a, b = numbers[i], numbers[j]
            links[a] += 1
            links[b] += 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (vec_id, *_) in enumerate(rows):
        if vec_id is not None:
            least[find(k)] = min(least.get(find(k), vec_id), vec_id)
    return sorted(((r[0], links[k], least.get(find(k))) for k, r in enumerate(rows)), key=str)


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("rep", "key", "cell", "cells", "vector", "dim", "copies", "id", "n", "k", "own", "x")])


def result(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()), key=str)


def near(rng, v, cosine):
    """A vector at just this cosine of a unit vector, in a random direction."""
    u = rng.normal(size=len(v))
    u -= u @ v * v
    return cosine * v + math.sqrt(1 - cosine**2) * u / np.linalg.norm(u)


def corpus(seed, n=1500, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vectors = [*base, *(near(rng, base[k], rng.uniform(0.931, 0.96)) for k in range(400)), *(near(rng, base[k], 0.92) for k in range(50))]
    vectors += [near(rng, base[7], rng.uniform(0.96, 0.999)) for _ in range(150)]  # a group that is not all linked
    return [(k, [float(x) for x in np.float32(v)], int(rng.integers(0, 2)) if k >= 2 * n else 0) for k, v in enumerate(vectors)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_cases(spark, kind):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [0.0, 1.0], 1), (5, [1.0, 0.0], 2), (6, [1.0, 0.0], None), (7, None, 1),
        (8, [0.0, 0.0], 1), (9, [1.0, None], 1), (10, [nan, 1.0], 1), (11, [inf, 1.0], 1), (12, [], 1), (13, [1.0, 0.0, 0.0], 1), (14, [-1.0, 0.0], 1),
        (14, [0.0, 1.0], 1), (14, [0.0, 1.0], 1), (None, [0.0, 2.0], 1), (None, [5.0, 5.0], 3), (None, None, None), (15, [-0.0, 1.0], 1), (16, [1e-30, 0.0], 1),
        (17, [1e30, 1.0], 1),
    ]
    df = frame(spark, rows, kind)
    assert result(cells.near_groups(df)) == brute(rows)
    for r in cells.near_groups(df).collect():
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert cells.near_groups(frame(spark, [], kind)).count() == 0
    with pytest.raises(ValueError):
        cells.near_groups(df, 1.5)


def test_blocks_and_cells_lose_no_links_of_any_kind(spark, monkeypatch):
    """With the whole margin every link is found; blocks and hot cells are cut to small parts here."""
    monkeypatch.setattr(cells, "BLOCK", 100)
    monkeypatch.setattr(cells, "ASSIGNED", 300)
    rows = corpus(1, 400)
    assert result(cells.near_groups(frame(spark, rows), margin=math.sqrt(2 - 2 * 0.93))) == brute(rows)


def test_recall_of_the_default_margin(spark):
    rows = corpus(2)
    got, want = result(cells.near_groups(frame(spark, rows))), brute(rows)
    found, there = sum(x[1] for x in got), sum(x[1] for x in want)
    assert all(a[1] <= b[1] for a, b in zip(sorted(got, key=lambda r: r[0]), sorted(want, key=lambda r: r[0]), strict=True))
    assert found >= 0.995 * there and there > 1000


def test_query_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in read(spark, DATA, "embeddings").collect()]
    assert result(op12_embedding_dedup(spark, DATA)) == brute(rows)


def test_cells_are_few_for_a_group_of_copies():
    rng = np.random.default_rng(4)
    middle = rng.normal(size=64)
    middle /= np.linalg.norm(middle)
    group = np.stack([near(rng, middle, 0.99) for _ in range(500)])
    spread = rng.normal(size=(1500, 64))
    spread /= np.linalg.norm(spread, axis=1, keepdims=True)
    centres = cells.fitted(rng.permutation(np.concatenate([group, spread])), 180)
    of = [x.tolist() for x in cells.joined(group, centres, cells.SPREAD / 8 * math.sqrt(0.14))]
    assert max(map(len, of)) <= 3
    assert (np.triu(centres @ centres.T, 1) <= cells.CLOSE).all()
