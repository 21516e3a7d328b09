"""Approximate nearest neighbours by layered proximity graphs, one for each shard of the corpus.

A shard's rows are nodes; each has a highest layer, drawn by the hash of its id so that every layer up holds one in
LINKS of those below. In a layer a node is linked with near ones that are not nearer to each other than to it, and
links go both ways. A search goes down from the top: greedily to the nearest node of each upper layer, then best-first
through the lowest one with a beam of the best nodes seen, until the nearest open one is farther than all of these. Shards are
searched for themselves and their best rows merged, so a graph never outgrows its task. The links of a layer come
from one matrix product of the shard, not from one insertion after the other, so the graph depends on the rows alone.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

#: Rows of a shard, queries searched by one task, and candidates for a node's links.
SHARD_ROWS, QUERY_ROWS, CANDIDATES = 16_384, 1024, 64
#: Rows of one product while a graph is built.
PART = 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """At length one; zero vectors stay."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def spread_out(vectors: np.ndarray, near: np.ndarray, similarity: np.ndarray, most: int) -> list[int]:
    """Of the candidates, nearest first, those that are nearer to the node than to any one taken before; the nearest
    of the others fill up to `most`."""
    among = vectors[near] @ vectors[near].T
    taken: list[int] = []
    left: list[int] = []
    for k in range(len(near)):
        if len(taken) == most:
            break
        (left if taken and (among[k, taken] > similarity[k]).any() else taken).append(k)
    return [int(near[k]) for k in sorted(taken + left[: most - len(taken)])]


def layer(vectors: np.ndarray, members: np.ndarray, most: int) -> list[np.ndarray]:
    """The links of each member of a layer, as row numbers of `vectors`: `most` of its own, and theirs back, at most
    twice as many."""
    own = vectors[members]
    links: list[list[int]] = []
    n = min(CANDIDATES + 1, len(members))
    for k in range(0, len(members), PART):
        scores = own[k : k + PART] @ own.T
        scores[np.arange(len(scores)), np.arange(k, k + len(scores))] = -np.inf
        near = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        for row, candidates in zip(scores, near, strict=True):
            candidates = candidates[np.lexsort((candidates, -row[candidates]))][: n - 1]
            links.append(spread_out(own, candidates, row[candidates], most))
    back: list[set[int]] = [set(x) for x in links]
    for a, found in enumerate(links):
        for b in found:
            back[b].add(a)
    out = []
    for a, found in enumerate(back):
        found = np.array(sorted(found), np.int64)
        if len(found) > 2 * most:
            scores = own[found] @ own[a]
            order = np.lexsort((found, -scores))
            found = np.array(spread_out(own, found[order], scores[order], 2 * most), np.int64)
        out.append(members[found])
    return out


class Graph:
    """The layers of one shard, and a search through them."""

    def __init__(self, vectors: np.ndarray, layers: list[dict[int, np.ndarray]]):
        self.vectors, self.layers, self.compared = vectors, layers, 0

    @classmethod
    def of(cls, vectors: np.ndarray, heights: np.ndarray, links: int) -> Graph:
        layers = []
        for height in range(int(heights.max(initial=0)) + 1):
            members = np.flatnonzero(heights >= height)
            layers.append(dict(zip(members.tolist(), layer(vectors, members, links), strict=True)))
        return cls(vectors, layers)

    def near(self, query: np.ndarray, k: int, beam: int) -> list[tuple[float, int]]:
        """(similarity, node) of the k best found, best first."""
        start = min(self.layers[-1])
        best = (float(self.vectors[start] @ query), start)
        self.compared += 1
        for links in self.layers[:0:-1]:
            while True:
                around = links[best[1]]
                if not len(around):
                    break
                scores = self.vectors[around] @ query
                self.compared += len(around)
                if scores.max() <= best[0]:
                    break
                best = (float(scores.max()), int(around[scores.argmax()]))
        seen = np.zeros(len(self.vectors), bool)
        seen[best[1]] = True
        open_, found = [(-best[0], best[1])], [best]
        while open_:
            score, node = heapq.heappop(open_)
            if len(found) == beam and -score < found[0][0]:
                break
            around = self.layers[0][node]
            around = around[~seen[around]]
            seen[around] = True
            self.compared += len(around)
            for s, other in zip((self.vectors[around] @ query).tolist(), around.tolist(), strict=True):
                if len(found) < beam:
                    heapq.heappush(found, (s, other))
                elif s > found[0][0]:
                    heapq.heapreplace(found, (s, other))
                else:
                    continue
                heapq.heappush(open_, (-s, other))
        return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


INDEX = "shard int, node int, height int, id long, embedding binary, links array<binary>"


def graph_index(corpus: DataFrame, links: int = fixed.HNSW_LINKS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The graphs of corpus (id long, embedding), a row for each node (see INDEX), and the number of shards.

    Rows whose id or vector is null or empty are left out. Vectors must be of one length. Zero vectors are nodes with a
    similarity of 0 to all. A repeated id is a node for each row.
    """
    usable = corpus.select("id", "embedding").where("id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    shards = max(math.ceil(usable.count() / shard_rows), 1)
    share = (F.pmod(F.xxhash64("id", F.lit("height")), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    height = F.floor(-F.log(share) / math.log(links)).cast("int")
    dealt = usable.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), height.alias("height"), "id", "embedding")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        vectors = unit(np.stack(table.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64))
        graph = Graph.of(vectors, np.array(table.column("height")), links)
        of = [[layer[k].astype("<i4").tobytes() for layer in graph.layers if k in layer] for k in range(len(vectors))]
        return pa.table(
            {
                "shard": table.column("shard"),
                "node": pa.array(range(len(vectors)), pa.int32()),
                "height": table.column("height"),
                "id": table.column("id"),
                "embedding": pa.array([v.tobytes() for v in vectors], pa.binary()),
                "links": pa.array(of, pa.list_(pa.binary())),
            }
        )

    return dealt.groupBy("shard").applyInArrow(build, INDEX), shards


def loaded(index: pa.Table) -> tuple[Graph, np.ndarray]:
    """A shard's graph and its rows' ids."""
    index = index.sort_by("node")
    vectors = np.stack([np.frombuffer(x, np.float64) for x in index.column("embedding").to_pylist()])
    layers: list[dict[int, np.ndarray]] = []
    for node, links in enumerate(index.column("links").to_pylist()):
        for height, packed in enumerate(links):
            if height == len(layers):
                layers.append({})
            layers[height][node] = np.frombuffer(packed, "<i4").astype(np.int64)
    return Graph(vectors, layers), np.array(index.column("id"))


def graph_search(queries: DataFrame, index: DataFrame, shards: int, k: int, beam: int = fixed.HNSW_BEAM) -> DataFrame:
    """query_id, id, distance (1 - cosine), rank, compared of approximate neighbours.

    queries: query_id (long), embedding. index and shards: of graph_index. compared: how many vectors the query was compared with, in
    all shards. Ties to nine decimals go to the smaller id. Queries without a vector or an id are left out.
    """
    asked = queries.select("query_id", F.col("embedding").alias("q")).where("query_id IS NOT NULL AND q IS NOT NULL AND size(q) > 0")
    blocks = max(math.ceil(asked.count() / QUERY_ROWS), 1)
    beam = max(beam, k)
    left = asked.select(
        "query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(qs: pa.Table, shard: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float, int]] = []
        if qs.num_rows and shard.num_rows:
            graph, ids = loaded(shard)
            vectors = unit(np.stack(qs.column("q").to_numpy(zero_copy_only=False)).astype(np.float64))
            for query_id, v in zip(qs.column("query_id").to_pylist(), vectors, strict=True):
                graph.compared = 0
                found = graph.near(v, k, beam)
                # A shard's comparisons stand in its first row.
                rows += [(query_id, int(ids[node]), 1 - s, 0 if nth else graph.compared) for nth, (s, node) in enumerate(found)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "id", "distance", "compared"])

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))
    found = found.applyInArrow(search, "query_id long, id long, distance double, compared long")
    return merged(found, k)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of all shards, and the comparisons of all of them."""
    query = Window.partitionBy("query_id")
    order = query.orderBy(F.round("distance", 9), "id")
    summed = found.withColumns({"compared": F.sum("compared").over(query), "rank": F.row_number().over(order)})
    return summed.where(F.col("rank") <= k)
