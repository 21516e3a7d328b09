"""Near-duplicate embeddings by cells of spherical k-means.

Vectors that are equal, with equal labels, are one class from the start. Each label has centres, fitted by spherical
k-means on a sample. A vector joins the cell of its nearest centre and every other cell whose centre is, by its
cosine, within a margin of the nearest one. Classes are compared inside cells only, by blocked products of unit
vectors in double precision, so no pair is linked below the threshold; a pair that shares several cells counts in the
first one. Blocks give the number of links of each vector and a forest of links that joins the same
components, never all pairs of a group of copies.

Vectors whose cosine is the threshold t are sqrt(2 - 2t) apart, so with that margin no link at all is lost, whatever the
data. The default margin is SPREAD / sqrt(dimensions) of it (and never more than it): as the difference of two near copies points
anywhere, its part in the direction of a centre is mostly that small. A link is lost if its two vectors share no cell;
tests measure this against brute force. Centres are kept at least CLOSE apart, so a group of near copies is in few cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import free, small, written
from .components import components

#: Least cosine of a link.
THRESHOLD = 0.93
#: Margin in standard deviations of half a threshold's distance in a random direction, times two.
SPREAD = 2.5
#: Cells of n classes: this times the root of n, at most MOST_CELLS; classes of the sample for each cell.
CELLS, MOST_CELLS, SAMPLED = 4, 8192, 8
#: No two centres have a higher cosine.
CLOSE = 0.7
#: Rounds of k-means.
ROUNDS = 4
#: Classes in a block, and classes that a task assigns to cells at a time.
BLOCK, ASSIGNED = 2048, 8192
#: Linked pairs looked at together.
PAIRS = 100_000

MARKED = "vec_id long, label string, dim int, key binary, vector binary"
CENTRES = "label string, dim int, centres binary"
MEMBERS = "label string, dim int, cell int, rep long, copies long, cells binary, vector binary"
LINKS = "rep long, links long, other long"


def marked(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, key, vector: the last three are null if nothing can be linked with the vector."""
    single = isinstance(vectors.schema["embedding"].dataType, ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    kind, element = ("<f4", pa.float32()) if single else ("<f8", pa.float64())
    embedding = F.col("embedding").cast("array<float>" if single else "array<double>")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            column, labels = batch.column(2), batch.column(1)
            values = pc.fill_null(column.values.cast(element), float("nan")).to_numpy(zero_copy_only=False).astype(kind) + 0.0
            edges = column.offsets.to_pylist()
            there = (pc.is_valid(column).to_numpy(zero_copy_only=False)) & (pc.is_valid(labels).to_numpy(zero_copy_only=False))
            dims, keys, packed = [], [], []
            for k, (a, b) in enumerate(zip(edges, edges[1:])):  # noqa: B905
                v = values[a:b]
                usable = there[k] and b > a and np.isfinite(v).all() and v.any()
                raw = v.astype(kind).tobytes() if usable else None
                dims.append(b - a if usable else None)
                keys.append(xxhash.xxh3_128_digest(raw) if usable else None)
                packed.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), labels, pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
                ["vec_id", "label", "dim", "key", "vector"],
            )

    return vectors.select("vec_id", F.col("label").cast("string").alias("label"), embedding.alias("embedding")).mapInArrow(rows, MARKED)


def units(packed: list[bytes], dim: int) -> np.ndarray:
    """Vectors of length one in double precision. They are scaled first, so that no square over- or underflows."""
    kind = "<f4" if packed and len(packed[0]) == 4 * dim else "<f8"
    values = np.frombuffer(b"".join(packed), kind).astype(np.float64).reshape(len(packed), dim)
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def apart(candidates: np.ndarray, most: int) -> np.ndarray:
    """In order, those of the candidates that are at least CLOSE apart from the ones taken before."""
    taken = np.empty((min(most, len(candidates)), candidates.shape[1]))
    n = 0
    for k in range(0, len(candidates), 256):
        part = candidates[k : k + 256]
        part = part[(part @ taken[:n].T).max(1, initial=-1) <= CLOSE]
        for v in part:
            if n < len(taken) and (taken[:n] @ v).max(initial=-1) <= CLOSE:
                taken[n] = v
                n += 1
    return taken[:n]


def fitted(sample: np.ndarray, k: int) -> np.ndarray:
    """Up to k centres by spherical k-means."""
    centres = apart(sample, k)
    for _ in range(ROUNDS):
        nearest = np.concatenate([(sample[i : i + 1024] @ centres.T).argmax(1) for i in range(0, len(sample), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1)
        moved = length > 1e-9
        centres[moved] = sums[moved] / length[moved, None]
    return apart(centres, k)


def joined(vectors: np.ndarray, centres: np.ndarray, margin: float) -> list[np.ndarray]:
    """The cells of each vector, ascending."""
    out = []
    for k in range(0, len(vectors), 1024):
        scores = vectors[k : k + 1024] @ centres.T
        near = scores >= scores.max(1, keepdims=True) - margin
        rows, cells = np.nonzero(near)
        out += np.split(cells.astype("<u4"), np.searchsorted(rows, np.arange(1, len(scores))))
    return out


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that the links (i, j) join it with."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def met_before(cells: list[np.ndarray], cell: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the two of each pair share a cell before this one."""
    lower = [c[c < cell] for c in cells]
    every = np.unique(np.concatenate(lower))
    if not len(every):
        return np.zeros(len(i), bool)
    held = np.zeros((len(cells), len(every)), bool)
    held[np.repeat(np.arange(len(cells)), [len(c) for c in lower]), np.searchsorted(every, np.concatenate(lower))] = True
    bits = np.packbits(held, axis=1)
    return np.concatenate([(bits[i[k : k + PAIRS]] & bits[j[k : k + PAIRS]]).any(1) for k in range(0, max(len(i), 1), PAIRS)])


def compared(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one block's classes with another's, or its own: numbers of links, and a forest."""
    column = lambda name: table.column(name).to_numpy()
    rep, copies, own = column("rep"), column("copies"), column("own")
    x, y, cell, dim = (table.column(c)[0].as_py() for c in ("x", "y", "cell", "dim"))
    vectors = units(table.column("vector").to_pylist(), dim)
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    found = [np.nonzero(vectors[left[k : k + 512]] @ vectors[right].T >= threshold) for k in range(0, len(left), 512)]
    i = left[np.concatenate([a + 512 * k for k, (a, _) in enumerate(found)])] if found else left[:0]
    j = right[np.concatenate([b for _, b in found])] if found else right[:0]
    if x == y:
        once = i < j
        i, j = i[once], j[once]
    label = forest(i, j, len(rep))
    fresh = ~met_before([np.frombuffer(c, "<u4") for c in table.column("cells").to_pylist()], cell, i, j)
    i, j = i[fresh], j[fresh]
    links = np.zeros(len(rep), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    counted, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rep)))
    nulls = lambda n: pa.nulls(n, pa.int64())
    return pa.table(
        {
            "rep": pa.array(np.concatenate([rep[counted], rep[tied]]), pa.int64()),
            "links": pa.chunked_array([pa.array(links[counted]), nulls(len(tied))]),
            "other": pa.chunked_array([nulls(len(counted)), pa.array(rep[label[tied]], pa.int64())]),
        }
    )


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD, margin: float | None = None) -> DataFrame:
    """Per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows are linked if their labels are equal and their cosine is at least the threshold, found in cells (see above);
    margin: of the cells, sqrt(2 - 2 * threshold) loses no link. n_links: the other rows linked directly;
    component_id: the smallest vec_id that links lead to, its own included; kept: vec_id is that one.

    A vector that is null, empty, zero or holds nulls or non-finite numbers, or whose label is null, is linked with
    nothing; so are vectors of different lengths. Rows that repeat a vec_id are vectors of their own. A null vec_id
    is linked like others, but names no component; if nothing else names it, component_id is null and
    the row is kept. Other columns are ignored, whatever their names.
    """
    if not 0 < threshold < 1:
        raise ValueError("a threshold between 0 and 1")
    every = written(marked(vectors), "vectors")
    classes = every.where("key IS NOT NULL").groupBy("label", "dim", "key").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")
    )
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "*"), "vector-classes")  # stored, so numbers stay
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    cells = F.least(F.ceil(CELLS * F.sqrt("n")), F.lit(MOST_CELLS)).cast("long")
    sizes = written(sizes.select("label", "dim", "n", cells.alias("k"), F.ceil(F.col("n") / ASSIGNED).alias("salts")), "label-sizes")
    sized = classes.join(sizes, ["label", "dim"])
    # One hash for the sample and one for the tasks.
    share = F.pmod(F.xxhash64("rep", F.lit("sample")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    sample = sized.where(share < SAMPLED * F.col("k") / F.col("n")).select("label", "dim", "k", "vector")

    def fit(table: pa.Table) -> pa.Table:
        label, dim, k = (table.column(c)[0].as_py() for c in ("label", "dim", "k"))
        centres = fitted(units(table.column("vector").to_pylist(), dim), k)
        return pa.table([pa.array([label]), pa.array([dim], pa.int32()), pa.array([centres.astype("<f8").tobytes()], pa.binary())], ["label", "dim", "centres"])

    centres = written(sample.groupBy("label", "dim").applyInArrow(fit, CENTRES), "centres")
    whole = math.sqrt(2 - 2 * threshold)

    def assign(table: pa.Table, fitted_centres: pa.Table) -> pa.Table:
        if not table.num_rows:
            return members_schema.empty_table()
        label, dim = (table.column(c)[0].as_py() for c in ("label", "dim"))
        packed = table.column("vector").to_pylist()
        if fitted_centres.num_rows:
            centres = np.frombuffer(fitted_centres.column("centres")[0].as_py(), "<f8").reshape(-1, dim)
            width = min(whole, SPREAD / math.sqrt(dim) * whole) if margin is None else margin
            in_cells = joined(units(packed, dim), centres, width)
        else:  # nothing was sampled
            in_cells = [np.zeros(1, "<u4")] * len(packed)
        times = [len(c) for c in in_cells]
        at = pa.array(np.repeat(np.arange(len(packed)), times))
        lists = pa.array([c.tobytes() for c in in_cells], pa.binary())
        n = len(at)
        columns = {
            "label": pa.array([label] * n, pa.string()),
            "dim": pa.array([dim] * n, pa.int32()),
            "cell": pa.array(np.concatenate(in_cells).astype(np.int32)),
            "rep": table.column("rep").combine_chunks().take(at),
            "copies": table.column("copies").combine_chunks().take(at),
            "cells": lists.take(at),
            "vector": pa.array(packed, pa.binary()).take(at),
        }
        return pa.table(columns, schema=members_schema)

    members_schema = pa.schema(
        [("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("rep", pa.int64()), ("copies", pa.int64()), ("cells", pa.binary()), ("vector", pa.binary())]
    )
    salted = sized.select("label", "dim", F.pmod(F.xxhash64("rep"), "salts").alias("salt"), "rep", "copies", "vector")
    spread = centres.join(sizes, ["label", "dim"]).select("label", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "centres")
    members = salted.groupBy("label", "dim", "salt").cogroup(spread.groupBy("label", "dim", "salt")).applyInArrow(assign, MEMBERS)
    members = written(members, "cell-members")
    counts = members.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("size"))
    dealt = members.join(counts.where("size > 1").drop("size"), ["label", "dim", "cell"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"x": F.least("own", "o"), "y": F.greatest("own", "o")}).drop("o", "blocks")
    grouped = dealt.groupBy("label", "dim", "cell", "x", "y")
    links = written(grouped.applyInArrow(lambda t: compared(t, threshold), LINKS), "vector-links")
    free(members, centres, sizes)
    joint = components(links.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    others = links.where("links IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("rep", "id").join(joint, F.col("rep") == F.col("node"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.select("rep", "component").join(smallest, "component").select("rep", "component_id")
    classed = classes.select("rep", "label", "key", "id", "copies").join(others, "rep", "left").join(named, "rep", "left").select(
        "label", "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("named_by")
    )
    out = every.select("vec_id", "label", "key").join(classed, ["label", "key"], "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("named_by"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
