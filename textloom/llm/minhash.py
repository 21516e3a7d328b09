"""Near-duplicate documents by min-max hashing.

Every permutation of a document's shingle hashes gives two signature values, its minimum and its maximum, so
half the permutations make a signature of a given length. Bands of ROWS values each send similar documents to
common buckets. Sets that are equal are one class from the start. In each bucket every class is first compared
with the bucket's smallest one only; where a bucket still holds several components after that, all pairs of
classes between the different components are compared too, so no link that any bucket offers is lost. As a
bucket can hold many classes that are alike, but not alike enough, these pairs are not put out as rows: blocks
of classes are compared by long sketches inside tasks, each pair in its first common band only, and only pairs
that the sketches can't rule out go on. Links are confirmed on the full sets of shingle hashes (64 bits each).

With PERMUTATIONS = 120 and ROWS = 6 there are 40 bands: a pair at similarity 0.8 is missed with probability
(1 - 0.8**6)**40, about 5 in a million, and a pair at 0.1 meets with 4 in a hundred thousand. A sketch has the
low bytes of 2 * SKETCH values and rules a pair out below SIGMAS standard deviations under the threshold, which
happens to a linked pair about once in ten million.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, small, text_key, without_rows, written
from .components import components
from .wordblocks import hashes, mix, split_words

#: Words of a shingle, where no contract says otherwise.
SHINGLE = 5
#: Least similarity in percent.
PERCENT = 80
PERMUTATIONS, ROWS = 120, 6
#: Permutations of a sketch, and how far under the threshold it rules pairs out.
SKETCH, SIGMAS = 960, 5.2
#: Classes in a block of sketches, and classes that are paired with one.
BLOCK, HUB = 1024, 256
#: Shingles hashed at a time; bounds memory only.
CHUNK = 2048


def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts."""
    drawn = (mix(np.arange(seed, seed + 2 * n, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)[:, None]
    return drawn[:n] | np.uint32(1), drawn[n:]


_BANDED, _SKETCHED = _permutations(PERMUTATIONS, 1), _permutations(SKETCH, 1_000_001)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's shingles; fewer words than `size` are one shingle."""
    words = hashes(split_words(text, lower=True))
    if not len(words):
        return words
    width = min(size, len(words))
    rolled = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k])
    return np.unique(rolled)


def signature(of: np.ndarray, permutations: tuple[np.ndarray, np.ndarray] = _BANDED) -> np.ndarray:
    """The minima under all permutations, then the maxima. A set's 32-bit values are permuted by odd factors."""
    values, (factor, shift) = (of >> np.uint64(32)).astype(np.uint32), permutations
    least, most = np.full(len(factor), 2**32 - 1, np.uint32), np.zeros(len(factor), np.uint32)
    for k in range(0, len(values), CHUNK):
        permuted = factor * values[k : k + CHUNK] + shift
        permuted ^= permuted >> np.uint32(15)
        np.minimum(least, permuted.min(1), out=least)
        np.maximum(most, permuted.max(1), out=most)
    return np.concatenate([least, most])


def sketch(of: np.ndarray) -> bytes:
    """One byte of each value of a long signature."""
    return (mix(signature(of, _SKETCHED).astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; bands never share keys but by chance. A band's rows are of one kind each."""
    rows = values.reshape(-1, ROWS).astype(np.uint64)
    key = mix(np.arange(1, len(rows) + 1, dtype=np.uint64))
    for k in range(ROWS):
        key = mix(key ^ rows[:, k] * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (128-bit digest of the whole set; null if empty), bands."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n, keys, bands = [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), size)
                n.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(band_keys(signature(found)) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "set_key", "bands"],
            )

    schema = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"
    return docs.select("doc_id", text_key(docs).alias("text_key"), "text").mapInArrow(rows, schema)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """rep, shingles: the full set of each class, by its representative's text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingles(text.as_py(), size).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

    return docs.select("rep", "text").mapInArrow(rows, "rep long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class representatives whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * common >= percent * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def stars(members: DataFrame, percent: int) -> DataFrame:
    """a, b: in each bucket the pairs of its smallest class and the others that their sizes don't rule out.

    In a bucket of over HUB classes these are dealt to groups: classes are paired with their group's smallest, and
    these with the bucket's, so no class is in very many pairs. members: band, rep, n, hub, n_hub, size.
    """
    few = members.where(F.col("size") <= HUB).select(F.col("hub").alias("a"), F.col("n_hub").alias("na"), F.col("rep").alias("b"), F.col("n").alias("nb"))
    # Powers of two, so that a class is in one and the same group in buckets of about one size.
    groups = F.pow(F.lit(2), F.ceil(F.log2(F.col("size") / HUB))).cast("long")
    many = members.where(F.col("size") > HUB).withColumn("part", F.pmod(F.xxhash64("rep"), groups))
    heads = many.groupBy("band", "hub", "n_hub", "part").agg(F.min("rep").alias("head"), F.min_by("n", "rep").alias("n_head"))
    inner = many.join(heads.select("band", "part", "head", "n_head"), ["band", "part"]).select("head", "n_head", "rep", "n")
    pairs = few.union(inner).union(heads.select("hub", "n_hub", "head", "n_head")).where("a <> b")
    # Sets of too different sizes can't be linked, so a set is never sent to a much smaller one.
    return pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct()


def sketches(sets: DataFrame) -> DataFrame:
    """rep, sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            made = [sketch(np.array(x.values).view(np.uint64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["rep", "sketch"])

    return sets.select("rep", "shingles").mapInArrow(rows, "rep long, sketch binary")


def across_components(members: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components in a bucket that their sizes and sketches don't rule out.

    members: band, nth, rep, n, component, bands, sketch, size (of the bucket). A bucket is dealt to blocks, and
    each pair of blocks is a task's work, so a bucket's size bounds no task's memory.
    """
    p = percent / 100
    least = p - SIGMAS * math.sqrt(p * (1 - p) / (2 * SKETCH))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = own.select("*", other).select(
        "nth", "rep", "n", "component", "bands", "sketch", "own", "band",
        F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
    )

    def compare(table: pa.Table) -> pa.Table:
        column = lambda name: np.array(table.column(name))
        rep, n, component, block = column("rep"), column("n"), column("component"), column("own")
        nth = table.column("nth")[0].as_py()
        bands = np.stack(table.column("bands").to_numpy(zero_copy_only=False))
        marks = np.stack([np.frombuffer(x, np.uint8) for x in table.column("sketch").to_pylist()])
        left, right = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("x", "y"))
        a, b = left[:, None], right[None, :]
        open_ = (component[a] != component[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        for k in range(nth):  # met before
            open_ &= bands[left, k][:, None] != bands[right, k][None, :]
        i, j = np.nonzero(open_)
        i, j = left[i], right[j]
        ordered = rep[i] < rep[j] if table.column("x")[0].as_py() == table.column("y")[0].as_py() else np.ones(len(i), bool)
        i, j = i[ordered], j[ordered]
        keep = [np.empty(0, np.int64)]
        for k in range(0, len(i), 4_000):
            part = slice(k, k + 4_000)
            keep.append(k + np.flatnonzero((marks[i[part]] == marks[j[part]]).mean(1) >= least))
        keep = np.concatenate(keep)
        low, high = np.minimum(rep[i[keep]], rep[j[keep]]), np.maximum(rep[i[keep]], rep[j[keep]])
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    return dealt.groupBy("band", "x", "y").applyInArrow(compare, "a long, b long")


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The columns of near_groups, and text_key.

    A class has a number, `rep` in what follows; a number's order means nothing, so a component's smallest doc_id
    is found at the end. Rows that repeat a doc_id with other texts are in classes of their own.
    """
    marked = written(signed(docs, size), "signatures")
    named = marked.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = named.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("least"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
    )
    classes = classes.select(
        F.monotonically_increasing_id().alias("rep"), "set_key", "least.doc_id", "least.text_key", "n", "bands"
    )
    classes = written(classes, "classes")  # stored, so numbers stay
    spread = classes.select("rep", "n", F.posexplode("bands").alias("nth", "band"))
    shared = spread.groupBy("band").agg(
        F.min("rep").alias("hub"), F.min_by("n", "rep").alias("n_hub"), F.max("rep").alias("last"), F.count("*").alias("size")
    )
    shared = shared.where("hub <> last").drop("last")
    members = written(spread.join(shared, "band"), "band-members")
    # The same plan at every size: texts go by doc_id to the list of those that share a bucket.
    needed = members.select("rep").distinct()
    needed = classes.select("rep", F.col("doc_id").alias("id"), F.col("text_key").alias("key")).join(needed, "rep", "left_semi")
    texts = docs.select("doc_id", "text").hint("merge").join(
        needed, (F.col("doc_id") == F.col("id")) & (text_key(docs) == F.col("key"))
    )
    # Rows that repeat a document have one text.
    texts = texts.groupBy("id", "key", "rep").agg(F.max("text").alias("text"))
    sets = written(shingle_sets(texts, size), "shingle-sets")
    links = written(confirmed(stars(members, percent), sets, percent), "star-links")
    labels = components(links)
    labelled = members.join(labels, F.col("rep") == F.col("node"), "left").select(
        "band", "nth", "rep", "n", "size", F.coalesce("component", "rep").alias("component")
    )
    labelled = written(labelled, "labelled-members")
    free(members)
    mixed = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    apart = written(labelled.join(mixed.select("band"), "band", "left_semi"), "mixed-buckets")
    free(labelled)
    left = apart.select("rep").distinct()
    left = classes.select("rep", "bands").join(left, "rep", "left_semi").join(
        sketches(sets.join(left, "rep", "left_semi")), "rep"
    )
    rest = across_components(apart.join(left, "rep"), percent)
    more = written(confirmed(rest.distinct(), sets, percent), "rest-links")
    free(apart, sets)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    # A class's component goes to its members, by its smallest doc_id.
    linked = classes.select("rep", "doc_id").join(labels, F.col("rep") == F.col("node"))
    smallest = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = linked.select("rep", "component").join(smallest, "component").select("rep", "component_id")
    classed = classes.select("rep", "set_key", "doc_id").join(named, "rep", "left")
    classed = classed.select("set_key", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = marked.join(classed, "set_key", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id linked with it), kept.

    Documents are linked if 100 * |common shingles| >= percent * |all shingles of both|. Texts without words
    have no shingles and no links. A null doc_id has a null component_id and is kept, as it can't be named in a
    link. Rows that repeat a doc_id are one document if their texts are equal; with other texts each row has its own
    links and its own component. Other columns are ignored.
    """
    return grouped(docs, size, percent).drop("text_key")


def near_dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that near_groups keeps, with all their columns, whatever their names: one document of each
    group. Each row is judged by its own text; rows that repeat both doc_id and text all stay or go."""
    return without_rows(docs, grouped(docs, size, percent).where("NOT kept"))
