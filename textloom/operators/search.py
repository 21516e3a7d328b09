"""Exact nearest-neighbour search, and rankings built on it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.stored import stored

#: Vectors of one block of queries and of one block of the corpus; a pair of blocks is a task's matrix products.
QUERY_BLOCK, CORPUS_BLOCK = 2048, 16_384
#: With more pairs of blocks than this, blocks grow, up to so many rows: what is shuffled is rows times blocks of the other side.
BLOCK_PAIRS, LARGEST_BLOCK = 512, 65_536
#: Queries and rows of one product, the rows of one stretch of it, and pairs that are held, or whose distance is taken, at once; they bound a task's
#: memory.
PART, TILE, STRETCH, PAIRS_HELD, PAIRS_AT_ONCE = 512, 2048, 64, 262_144, 65_536


def _distances(metric: str, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    match metric:
        case "neg_ip":
            return -(q @ c.T)
        case "cosine":
            size = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1))
            return 1 - np.divide(q @ c.T, size, out=np.zeros_like(size), where=size > 0)
        case "l2":
            return np.stack([np.sqrt(((c - x) ** 2).sum(1)) for x in q])
        case "l1":
            return np.stack([np.abs(c - x).sum(1) for x in q])
    raise ValueError(f"no metric {metric!r}")


def least_of(distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k least distances (rounded), ties by id. Only what ties with the last of them is sorted."""
    distances = np.where(np.isnan(distances), np.inf, distances)
    if len(distances) <= k:
        return np.lexsort((ids, distances))
    some = np.flatnonzero(distances <= np.partition(distances, k - 1)[k - 1])
    return some[np.lexsort((ids[some], distances[some]))[:k]]


def near_pairs(left: np.ndarray, right: np.ndarray, k: int, slack: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of left and of right, a tile of right at a time: all pairs whose product can be among the k least of its row of left, or tie with these, if each
    product is off by at most half the row's slack, and that reach the row's bound. Tiles are cut to stretches; the k-th least of the minima of those that
    were seen is never under the k-th least of all, and only stretches whose minimum reaches it are looked into."""
    n, counts = len(left), k < len(right)
    width = max(min(STRETCH, TILE // (2 * k)), 1)
    least = np.full((k if counts else 0, n), np.inf, np.float32)
    memory = np.empty((TILE + STRETCH, n), np.float32)
    for start in range(0, len(right), TILE):
        rows = right[start : start + TILE]
        stretches = -(-len(rows) // width)
        np.matmul(rows, left.T, out=memory[: len(rows)])
        memory[len(rows) : stretches * width] = np.inf
        rough = memory[: stretches * width].reshape(stretches, width, n)
        minima = rough.min(1)
        limit = bound
        if counts:
            least = np.partition(np.concatenate([least, minima]), k - 1, axis=0)[:k]
            limit = np.minimum(bound, least[k - 1])
        limit = limit + slack
        stretch, at_q = np.nonzero(minima <= limit)
        hit, place = np.nonzero(rough[stretch, :, at_q] <= limit[at_q][:, None])
        at_c = stretch[hit] * width + place
        there = at_c < len(rows)
        yield at_q[hit[there]], at_c[there] + start


def exact_distances(metric: str, q: np.ndarray, c: np.ndarray, at_q: np.ndarray, at_c: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, in double precision."""
    out = np.empty(len(at_q))
    for k in range(0, len(at_q), PAIRS_AT_ONCE):
        x, y = q[at_q[k : k + PAIRS_AT_ONCE]], c[at_c[k : k + PAIRS_AT_ONCE]]
        if metric == "l2":
            out[k : k + PAIRS_AT_ONCE] = np.sqrt(((y - x) ** 2).sum(1))
            continue
        product = (x * y).sum(1)
        if metric == "cosine":
            size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
            product = np.divide(product, size, out=np.zeros_like(size), where=size > 0)
        out[k : k + PAIRS_AT_ONCE] = 1 - product if metric == "cosine" else -product
    return out


def nearest_of(
    metric: str, q: np.ndarray, c: np.ndarray, order: np.ndarray, k: int, bounds: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], kept: tuple[np.ndarray, ...]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of c and distances of the k nearest to each query within its bound, among pairs (rows of q and of c) and those kept before; ties
    to nine decimals by order."""
    rows, columns = (np.concatenate([x, *(p[n] for p in pairs)]) for n, x in enumerate(kept[:2]))
    values = np.concatenate([kept[2], exact_distances(metric, q, c, rows[len(kept[0]) :], columns[len(kept[0]) :])])
    good = ~(np.round(values, 9) > np.round(bounds[rows], 9))
    rows, columns, values = rows[good], columns[good], values[good]
    by = np.lexsort((order[columns], np.round(values, 9), rows))
    rows, columns, values = rows[by], columns[by], values[by]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[nth < k], columns[nth < k], values[nth < k]


def block_nearest(metric: str, q: np.ndarray, c: np.ndarray, order: np.ndarray, k: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of c and distances of the k nearest of c to each of q within its bound; ties to nine decimals by order.

    A product in single precision tells which pairs can be among them, by more than its rounding errors; only of those the
    distances are taken in double precision. The other metrics and numbers that aren't finite go without this first step.
    """
    q_size, c_size = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    most = float(c_size.max(initial=0.0))
    rough_first = metric != "l1" and bool(np.isfinite(q_size).all() and np.isfinite(c_size).all()) and 1e-100 < most < 1e100
    # The largest error of a product of vectors of lengths up to 1, and what rounding to nine decimals can add to ties.
    slack = 4 * (q.shape[1] + 8) * 1.2e-7
    unit = lambda x, size: np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    if rough_first:
        scale = np.maximum(q_size, most) if metric == "l2" else q_size
        left = -unit(q, scale[:, None])
        right = unit(c, c_size[:, None]) if metric == "cosine" else c / most
        if metric == "l2":
            # The product is the squared distance over the squared scale, without the query's own part.
            share = (most / scale)[:, None]
            left, right = np.hstack([2 * share * left, share**2]), np.hstack([right, (c_size / most)[:, None] ** 2])
        left, right = left.astype(np.float32), right.astype(np.float32)
    found = []
    for start in range(0, len(q), PART):
        part = slice(start, start + PART)
        own = bounds[part]
        if not rough_first:
            d = _distances(metric, q[part], c)
            rows, columns, values = [], [], []
            for i, row in enumerate(d):
                best = least_of(np.round(row, 9), order, k)
                best = best[~(row[best] > own[i] + 1e-9)]
                rows.append(np.full(len(best), i)), columns.append(best), values.append(row[best])
            found.append((np.concatenate(rows) + start, np.concatenate(columns), np.concatenate(values)))
            continue
        size = q_size[part]
        if metric == "cosine":
            limit, ties = own - 1, np.full(len(size), 1e-9)
        elif metric == "neg_ip":
            whole = np.maximum(size * most, 1e-300)
            limit, ties = own / whole, 1e-9 / whole
        else:
            whole = np.maximum(size, most)
            limit = (own / whole) ** 2 - (size / whole) ** 2
            ties = 8e-9 / whole + 1e-18 / whole**2
        rows, columns, values = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for pairs in near_pairs(left[part], right, k, slack + ties, limit):
            waiting.append(pairs)
            if sum(len(x) for x, _ in waiting) > PAIRS_HELD:
                rows, columns, values = nearest_of(metric, q[part], c, order, k, own, waiting, (rows, columns, values))
                waiting = []
        rows, columns, values = nearest_of(metric, q[part], c, order, k, own, waiting, (rows, columns, values))
        found.append((rows + start, columns, values))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as a matrix in double precision."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(pc.unique(pc.list_value_length(column))) != 1:
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def block_numbers(n_queries: int, n_corpus: int) -> tuple[int, int]:
    """How many blocks the queries and the corpus are dealt to."""
    q_rows, c_rows = QUERY_BLOCK, CORPUS_BLOCK
    blocks = lambda: (math.ceil(n_queries / q_rows) or 1, math.ceil(n_corpus / c_rows) or 1)
    while math.prod(blocks()) > BLOCK_PAIRS and (q_rows < LARGEST_BLOCK or c_rows < LARGEST_BLOCK):
        if q_rows <= c_rows and q_rows < LARGEST_BLOCK:
            q_rows = min(2 * q_rows, LARGEST_BLOCK)
        else:
            c_rows = min(2 * c_rows, LARGEST_BLOCK)
    return blocks()


def within_blocks(left: DataFrame, right: DataFrame, k: int, metric: str, by: str | None = None) -> DataFrame:
    """query_id, id, by, distance: of each pair of blocks the k nearest of right (qb, cb, id, embedding, by) to each query of left
    (qb, cb, query_id, q, bound), in each group of `by`; bound (may be null) is the largest distance that counts."""
    kind = dict(right.dtypes)
    group_type = f", {by} {kind[by]}" if by else ""
    schema = f"query_id {dict(left.dtypes)['query_id']}, id {kind['id']}{group_type}, distance double"
    names = ["query_id", "id", *([by] if by else []), "distance"]

    def nearest(qs: pa.Table, cs: pa.Table) -> pa.Table:
        at_q, at_c, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if qs.num_rows and cs.num_rows:
            q, c = matrix(qs.column("q")), matrix(cs.column("embedding"))
            order = np.unique(np.array(cs.column("id")), return_inverse=True)[1]
            bounds = np.nan_to_num(qs.column("bound").to_numpy(), nan=np.inf)
            groups = pc.rank(cs.column(by).combine_chunks(), tiebreaker="dense").to_numpy() if by else np.zeros(len(c), np.int8)
            for g in np.unique(groups):
                own = np.flatnonzero(groups == g)
                i, j, d = block_nearest(metric, q, c[own] if by else c, order[own], k, bounds)
                at_q.append(i), at_c.append(own[j]), values.append(d)
        picked = np.concatenate(at_c)
        columns = [qs.column("query_id").take(np.concatenate(at_q)), *(cs.column(n).take(picked) for n in names[1:-1])]
        return pa.table([*columns, pa.array(np.concatenate(values))], names=names)

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(nearest, schema)


def spread_over(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def each_of(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", by: str | None = None) -> DataFrame:
    """query_id, id, distance, rank: the k nearest of the corpus (id, embedding) to each query (query_id, embedding).

    Distances are in double precision and ties to nine decimals go to the smaller id. With `by`, a column of the
    corpus, the k nearest in each of its groups are returned with that column. Both sides are dealt to blocks,
    and every pair of blocks is one task's matrix products that keep k rows a query, so no task holds more than
    two blocks. Rows with a null vector or id are left out. All vectors must have the same length. Queries may have a bound, the
    largest distance that counts.
    """
    bound = F.col("bound") if "bound" in queries.columns else F.lit(None)
    queries = queries.select("query_id", F.col("embedding").alias("q"), bound.cast("double").alias("bound")).where("query_id IS NOT NULL AND q IS NOT NULL")
    columns = ["id", "embedding", *([by] if by else [])]
    corpus = corpus.select(*columns).where("id IS NOT NULL AND embedding IS NOT NULL")
    q_blocks, c_blocks = block_numbers(queries.count(), corpus.count())
    left = queries.select("*", spread_over("query_id", q_blocks).alias("qb"), each_of(c_blocks).alias("cb"))
    right = corpus.select(*columns, spread_over("id", c_blocks).alias("cb"), each_of(q_blocks).alias("qb"))
    found = within_blocks(left, right, k, metric, by)
    order = Window.partitionBy("query_id", *([by] if by else [])).orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def completed(found: DataFrame, queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance, rank: what an approximate search found (query_id, id, distance, rank), and instead of its last rows those
    that it missed: all rows are compared, and those that are no farther than the k-th found take part in the ranking."""
    last = stored(found.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound")), "bounds")
    return knn(queries.select("query_id", "embedding").join(last, "query_id", "left"), corpus, k)


def knn_all_metrics(queries: DataFrame, corpus: DataFrame, k: int, metrics=("cosine", "l2", "l1", "neg_ip")) -> DataFrame:
    """The rankings by several metrics under a label."""
    parts = [knn(queries, corpus, k, m).withColumn("metric", F.lit(m)) for m in metrics]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def across_collections(queries: DataFrame, corpus: DataFrame, by: str, k: int, each: int = fixed.PER_COLLECTION_K) -> DataFrame:
    """The best `each` of every collection, and of those the best k of each query."""
    found = knn(queries, corpus, each, "cosine", by).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def gated(results: DataFrame, fallback: DataFrame, threshold: float = fixed.RELEVANCE_THRESHOLD) -> DataFrame:
    """query_id, best, fallback_best, strategy.

    A query whose best score (1 - distance) reaches the threshold keeps its results; else those of the fallback
    are used if they reach it; else the weak results stay.
    """
    best = results.groupBy("query_id").agg((1 - F.min("distance")).alias("best"))
    other = fallback.groupBy("query_id").agg((1 - F.min("distance")).alias("fallback_best"))
    strategy = (
        F.when(F.col("best") >= threshold, "routed").when(F.col("fallback_best") >= threshold, "fallback").otherwise("weak")
    )
    return best.join(other, "query_id", "left").withColumn("strategy", strategy)


def centroids(corpus: DataFrame, by: str) -> DataFrame:
    """id (the group), embedding: the mean vector of every group."""
    parts = corpus.select(F.col(by).alias("id"), F.posexplode("embedding").alias("at", "x"))
    means = parts.groupBy("id", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])
    return means.groupBy("id").agg(ordered.alias("embedding"))


def ann_index(corpus: DataFrame, cells: int, sample_rows: int = 20_000, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """An inverted-file index: every row of the corpus with its cell, and the cells' centres.

    The centres come from k-means on a bounded sample (sample_rows, by the hash of the id); every row is indexed, but
    rows without a vector have no cell. An empty table has no centres.
    """
    usable = corpus.where("embedding IS NOT NULL AND size(embedding) > 0")
    total = max(usable.count(), 1)
    # Half as many again as asked for, so that the least hashes among them are those of the whole table.
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    drawn = usable.select("embedding", chance.alias("h"), "id").where(chance < 1.5 * sample_rows / total * 1_000_003)
    drawn = drawn.orderBy("h", "id").limit(sample_rows).select("embedding").toArrow().column(0)
    if not len(drawn):
        return corpus.withColumn("cell", F.lit(None).cast("int")), np.empty((0, 0))
    points = np.stack(drawn.to_numpy(zero_copy_only=False)).astype(np.float64)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    random = np.random.default_rng(seed)
    centres = points[random.choice(len(points), min(cells, len(points)), replace=False)]
    for _ in range(12):
        own = (points @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = points[own == c].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return corpus.withColumn("cell", nearest_cells(F.col("embedding"), centres, 1)[0]), centres


def nearest_cells(vector: Column, centres: np.ndarray, n: int) -> Column:
    """The n cells whose centres have the largest inner product with the vector."""

    @F.pandas_udf("array<int>")
    def cells(vectors):
        import pandas as pd

        out: list[np.ndarray | None] = [None] * len(vectors)
        there = [k for k, v in enumerate(vectors) if v is not None and len(v)]
        if there and len(centres):
            x = np.stack([vectors.iloc[k] for k in there]).astype(np.float64)
            for k, near in zip(there, np.argsort(-(x @ centres.T), axis=1)[:, :n].astype(np.int32), strict=True):
                out[k] = near
        return pd.Series(out, index=vectors.index)

    return cells(vector)


def ann(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """Approximate cosine neighbours: each query looks into the `probes` nearest cells only."""
    asked = queries.select("query_id", F.col("embedding").alias("q"), F.explode(nearest_cells(F.col("embedding"), centres, probes)).alias("cell"))

    # Cells are cut to blocks, as in exact search.
    n_queries, n_corpus = queries.count(), index.count()
    q_blocks, parts = block_numbers(n_queries, math.ceil(n_corpus / max(len(centres), 1)))
    block = lambda part: F.col("cell") * parts + part
    left = asked.select("query_id", "q", F.lit(None).cast("double").alias("bound"), "cell", spread_over("query_id", q_blocks).alias("qb"), each_of(parts).alias("part"))
    left = left.where("query_id IS NOT NULL").withColumn("cb", block(F.col("part")))
    right = index.where("cell IS NOT NULL AND id IS NOT NULL").select("id", "embedding", block(spread_over("id", parts)).alias("cb"), each_of(q_blocks).alias("qb"))
    near = within_blocks(left.select("query_id", "q", "bound", "qb", "cb"), right, k, "cosine")
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
