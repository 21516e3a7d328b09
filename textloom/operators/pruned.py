"""Exact nearest neighbours that leave out what can't be near.

The corpus is cut to cells around pivots, each with the radius of its farthest row. By the triangle inequality no row
of a cell is nearer to a query than the pivot's distance less the radius. A query first looks into the cells where this
bound is least, as many as hold k rows; its k-th distance there then rules out all cells with a greater bound. The
result is exact for any pivots; how much is ruled out depends on how clustered the vectors are (vectors that point
anywhere in many dimensions are all about equally far from each other, and there nothing can be).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .search import CORPUS_BLOCK, QUERY_BLOCK, _distances, least_of

#: Pivots at most, and rows of the sample that they come from; both bound what reaches the driver.
PIVOTS, SAMPLE_ROWS = 256, 20_000
#: Bounds are loosened by this, as distances are rounded.
SLACK = 1e-9


def placed(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in a space where the metric's order is that of distances: for cosine, on the unit sphere."""
    if metric == "cosine":
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    return vectors


def spread(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between placed vectors, which keep the triangle inequality."""
    return _distances("l1" if metric == "l1" else "l2", a, b)


def pivots(corpus: DataFrame, metric: str, most: int, sample_rows: int) -> np.ndarray:
    """Rows of a sample (by the hash of the id) that are far from each other: each the farthest from those before."""
    total = max(corpus.count(), 1)
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    drawn = corpus.select("embedding", chance.alias("h"), "id").where(chance < 1.5 * sample_rows / total * 1_000_003)
    rows = drawn.orderBy("h", "id").limit(sample_rows).select("embedding").toArrow().column(0)
    if not len(rows):
        return np.empty((0, 0))
    points = placed(np.stack(rows.to_numpy(zero_copy_only=False)).astype(np.float64), metric)
    taken, nearest = [0], spread(metric, points[:1], points)[0]
    while len(taken) < min(most, math.isqrt(len(points)) + 1) and nearest.max() > 0:
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, spread(metric, points[taken[-1:]], points)[0])
    return points[taken]


def pruned_knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", most: int = PIVOTS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, id, distance, rank, compared: as `search.knn` gives them, and how many rows a query was compared with.

    queries: query_id, embedding. corpus: id, embedding. metric: cosine, l2 or l1. Rows with a null or empty vector or a
    null id are left out. Ties to nine decimals go to the smaller id. All vectors must have the same length.
    """
    if metric not in ("cosine", "l2", "l1"):
        raise ValueError(f"{metric} keeps no triangle inequality")
    queries = queries.select("query_id", F.col("embedding").alias("q")).where("query_id IS NOT NULL AND size(q) > 0")
    corpus = corpus.select("id", "embedding").where("id IS NOT NULL AND size(embedding) > 0")
    around = pivots(corpus, metric, most, sample_rows)
    if not len(around):
        kinds = {"query_id": dict(queries.dtypes)["query_id"], "id": dict(corpus.dtypes)["id"], "distance": "double", "compared": "long", "rank": "int"}
        return queries.where("false").select(*[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()])

    @F.pandas_udf("struct<cell:int,reach:double>")
    def cell_of(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        d = spread(metric, placed(x, metric), around)
        own = d.argmin(1)
        # A vector of length zero is as far from all, by cosine, so its cell is always looked into.
        reach = np.where((x == 0).all(1) & (metric == "cosine"), np.inf, d[np.arange(len(d)), own])
        return pd.DataFrame({"cell": own.astype(np.int32), "reach": reach})

    celled = stored(corpus.select("id", "embedding", cell_of("embedding").alias("c")).select("id", "embedding", "c.*"), "cells")
    # A row for each pivot.
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")).orderBy("cell").collect()
    cells = np.array([r["cell"] for r in sizes])
    n, radius = np.array([r["n"] for r in sizes]), np.array([r["radius"] for r in sizes])

    @F.pandas_udf("array<double>")
    def bounds_of(vectors: pd.Series) -> pd.Series:
        x = placed(np.stack(vectors.to_numpy()).astype(np.float64), metric)
        zero = (x == 0).all(1, keepdims=True) & (metric == "cosine")
        return pd.Series(list(np.where(zero, 0.0, np.maximum(spread(metric, x, around[cells]) - radius, 0))))

    asked = stored(queries.select("query_id", "q", bounds_of("q").alias("bounds")), "bounds")

    @F.pandas_udf("array<int>")
    def first_cells(bounds: pd.Series) -> pd.Series:
        order = np.argsort(np.stack(bounds.to_numpy()), axis=1, kind="stable")
        enough = (np.cumsum(n[order], axis=1) >= k).argmax(1)
        enough = np.where(n.sum() >= k, enough, len(n) - 1)
        return pd.Series([np.sort(o[: e + 1]).astype(np.int32) for o, e in zip(order, enough, strict=True)])

    @F.pandas_udf("array<int>")
    def other_cells(bounds: pd.Series, least: pd.Series, seen: pd.Series) -> pd.Series:
        out = []
        for b, most_far, had in zip(bounds, least, seen, strict=True):
            # By cosine, distances between unit vectors go by sqrt(2 * distance).
            far = math.sqrt(2 * max(most_far + SLACK, 0)) if metric == "cosine" else most_far
            out.append(np.setdiff1d(np.flatnonzero(np.asarray(b) <= far + SLACK), had).astype(np.int32))
        return pd.Series(out)

    first = stored(asked.withColumn("places", first_cells("bounds")), "first-cells")
    near = stored(_within(first, celled, cells, n, k, metric), "first-neighbours")
    order = Window.partitionBy("query_id").orderBy("distance")
    least = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select("query_id", F.col("distance").alias("least"))
    # With fewer than k rows in all, every cell has been seen.
    later = first.join(least, "query_id").withColumn("seen", F.col("places")).withColumn("places", other_cells("bounds", "least", "seen"))
    later = stored(later.select("query_id", "q", "places"), "other-cells")
    found = near.unionByName(_within(later, celled, cells, n, k, metric))
    held = F.array(*[F.lit(int(x)) for x in n])
    rows = lambda side: side.select("query_id", F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + F.get(held, p)).alias("compared"))
    compared = rows(first).unionByName(rows(later)).groupBy("query_id").agg(F.sum("compared").alias("compared"))
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(compared, "query_id")


def _within(asked: DataFrame, celled: DataFrame, cells: np.ndarray, n: np.ndarray, k: int, metric: str) -> DataFrame:
    """query_id, id, distance of the k nearest rows in each block that a query (query_id, q, places) looks into.

    A cell is cut to parts of bounded size, and the queries of a cell to blocks, so a task holds one block of each.
    """
    blocks = math.ceil(asked.count() / QUERY_BLOCK) or 1
    parts = F.array(*[F.lit(math.ceil(x / CORPUS_BLOCK)) for x in n])
    place_of = F.create_map(*[F.lit(x) for place, cell in enumerate(cells.tolist()) for x in (cell, place)])
    each = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    left = asked.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode("places").alias("place"))
    left = left.withColumn("part", each(F.get(parts, F.col("place"))))
    looked = left.select(F.col("place").alias("looked_into"), F.col("block").alias("by")).distinct()
    right = celled.select("id", "embedding", place_of[F.col("cell")].alias("place"))
    right = right.withColumn("part", F.pmod(F.xxhash64("id"), F.get(parts, F.col("place"))).cast("int"))
    right = right.join(looked, F.col("place") == F.col("looked_into")).select("id", "embedding", "place", "part", F.col("by").alias("block"))
    kind, query_kind = dict(celled.dtypes)["id"], dict(asked.dtypes)["query_id"]

    def nearest(qs: pa.Table, cs: pa.Table) -> pa.Table:
        names = ["query_id", "id", "distance"]
        if not qs.num_rows or not cs.num_rows:
            return pa.schema([qs.schema.field("query_id"), cs.schema.field("id"), pa.field("distance", pa.float64())]).empty_table()
        matrix = lambda column: np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
        d = _distances(metric, matrix(qs.column("q")), matrix(cs.column("embedding")))
        ids = np.array(cs.column("id"))
        at_q, at_c = [], []
        for i, row in enumerate(np.round(d, 9)):
            best = least_of(row, ids, k)
            at_q += [i] * len(best)
            at_c += best.tolist()
        return pa.table([qs.column("query_id").take(at_q), cs.column("id").take(at_c), pa.array(d[at_q, at_c])], names=names)

    keys = ("place", "part", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, f"query_id {query_kind}, id {kind}, distance double")
