"""Byte-level BPE by a hierarchical-bitmap rank queue.

A block of distinct pre-tokens is laid out as one byte sequence with barriers between pre-tokens. Nodes form a
doubly linked list; every merge rank has a bucket of list positions; a three-level bitmap over the ranks with
pending positions gives the next rank by find-first-set. Popping a rank handles its whole bucket as numpy
arrays: stale positions are skipped, the leftmost non-overlapping pairs of each pre-token merge, and the pairs
that arise are queued. A pre-token of any length costs O(n log n), as no position is ever searched for.

The order is that of the rank files' own libraries: the lowest rank first, leftmost first among equals. Where a
merge brings up a pair of lower rank than itself, the later positions of that pre-token wait in the bucket.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small

#: No such pair.
NONE = np.int32(2**31 - 1)
#: Pre-tokens of a generation of a worker's memory. Bounds memory only.
REMEMBERED = 200_000
#: Bytes of pre-tokens in one block of the queue. Bounds memory only.
BLOCK_BYTES = 8_000_000


class RankBitmap:
    """A set of ranks below 2**18 in three levels of 64-bit words; its minimum by find-first-set."""

    def __init__(self):
        self.top, self.middle, self.low = 0, [0] * 64, [0] * 4096

    def add(self, rank: int) -> None:
        word, group = rank >> 6, rank >> 12
        self.low[word] |= 1 << (rank & 63)
        self.middle[group] |= 1 << (word & 63)
        self.top |= 1 << group

    def pop_first(self) -> int:
        """The least rank, taken out; -1 if there is none."""
        if not self.top:
            return -1
        group = (self.top & -self.top).bit_length() - 1
        bits = self.middle[group]
        word = (group << 6) | ((bits & -bits).bit_length() - 1)
        bits = self.low[word]
        rank = (word << 6) | ((bits & -bits).bit_length() - 1)
        self.low[word] = bits & (bits - 1)
        if not self.low[word]:
            self.middle[group] &= ~(1 << (word & 63))
            if not self.middle[group]:
                self.top &= ~(1 << group)
        return rank


class RankBuckets:
    """List positions by merge rank."""

    def __init__(self):
        self.ranks, self.bucket = RankBitmap(), {}

    def push(self, ranks: np.ndarray, at: np.ndarray) -> None:
        """Queues positions; those without a pair are left out."""
        real = ranks != NONE
        ranks, at = ranks[real], at[real]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        starts = [0, *cuts.tolist(), len(ranks)]
        for k, rank in enumerate(ranks[starts[:-1]].tolist()):
            self.push_one(rank, at[starts[k] : starts[k + 1]])

    def push_one(self, rank: int, at: np.ndarray) -> None:
        if rank in self.bucket:
            self.bucket[rank].append(at)
        else:
            self.bucket[rank] = [at]
            self.ranks.add(rank)

    def pop(self) -> tuple[int, np.ndarray]:
        rank = self.ranks.pop_first()
        if rank < 0:
            return rank, np.empty(0, np.int64)
        parts = self.bucket.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.concatenate(parts)


class Merges:
    """A rank file's tokens and the rank of each pair of tokens whose bytes form a token."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= 2**18:
            raise ValueError("ranks must be below 2**18")
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 18) | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.key_ranks = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], NONE)

    @classmethod
    def from_file(cls, path: str) -> Merges:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; NONE where they form no token or an id is negative (a barrier)."""
        keys = (left << 18) | right
        keys[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.key_ranks[at], NONE)

    def encode_block(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token (not empty)."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        # A barrier node before each pre-token and one at the end keeps neighbours apart.
        size = int(lengths.sum()) + len(pieces) + 1
        ids = np.full(size, -1, np.int64)
        first = np.cumsum(lengths + 1) - lengths
        inside = np.ones(size, bool)
        inside[first - 1] = inside[-1] = False
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths + 1)
        owner = np.append(owner, len(pieces))
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        after[-1] = size - 1
        before[0] = 0
        queue = RankBuckets()
        queue.push(self.rank_of(ids[:-1], ids[1:]), np.arange(size - 1))
        while True:
            rank, at = queue.pop()
            if rank < 0:
                break
            at = np.unique(at)
            second = after[at]
            fresh = (ids[at] >= 0) & (self.rank_of(ids[at], ids[second]) == rank)  # the rest is stale
            at, second = at[fresh], second[fresh]
            if not len(at):
                continue
            # In a chain of overlapping pairs (aaaa) every other one merges, from the left.
            linked = np.append(False, second[:-1] == at[1:])
            where = np.arange(len(at))
            chain = np.maximum.accumulate(np.where(linked, 0, where))
            taken = (where - chain) % 2 == 0
            at, second = at[taken], second[taken]
            third, left = after[second], before[at]
            # What each merge meets if those to its left are done and those to its right are not.
            met = np.append(False, left[1:] == second[:-1])
            new_left = self.rank_of(np.where(met, rank, ids[left]), np.full(len(at), rank))
            new_right = self.rank_of(np.full(len(at), rank), ids[third])
            lower = (new_left < rank) | (new_right < rank)
            if lower.any():  # those right of it in the same pre-token wait
                own = owner[at]
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                done = np.cumsum(lower) - lower
                waits = done > np.repeat(done[starts], np.diff(np.append(starts, len(at))))
                queue.push_one(rank, at[waits])
                at, second, third = at[~waits], second[~waits], third[~waits]
            ids[at] = rank
            ids[second] = -2
            after[at] = third
            before[third] = at
            left = before[at]
            queue.push(
                np.concatenate([self.rank_of(ids[left], ids[at]), self.rank_of(ids[at], ids[after[at]])]),
                np.concatenate([left, at]),
            )
        alive = np.flatnonzero(ids >= 0)
        return np.split(ids[alive].astype("<u4"), np.searchsorted(owner[alive], np.arange(1, len(pieces))))


class Recent:
    """Remembers values by key in two generations: what the old one has and is asked for again moves to the new
    one, so keys that recur stay and the others go."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: Iterable) -> list:
        """The keys without a value; the others are in `new` until the next call."""
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        absent = [k for k in keys if k not in new]
        if old:
            new.update({k: old[k] for k in absent if k in old})
            absent = [k for k in absent if k not in new]
        return absent


class Encoder:
    """Encodes whole texts; remembers the ids of pre-tokens between texts."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.split = merges, regex.compile(pattern).findall
        self.memory = Recent(REMEMBERED)
        self.token_list = [merges.tokens.get(i, b"") for i in range(max(merges.tokens) + 1)]

    def learn(self, pieces: Iterable[str]) -> None:
        block, size = [], 0
        for piece in self.memory.missing(pieces):
            raw = piece.encode()
            if raw in self.merges.ranks:
                self.memory.new[piece] = self.merges.ranks[raw].to_bytes(4, "little")
                continue
            block.append((piece, raw))
            size += len(raw)
            if size > BLOCK_BYTES:
                self.merge(block)
                block, size = [], 0
        self.merge(block)

    def merge(self, block: list[tuple[str, bytes]]) -> None:
        if block:
            for (piece, _), ids in zip(block, self.merges.encode_block([raw for _, raw in block]), strict=True):
                self.memory.new[piece] = ids.tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        known = self.memory.new.__getitem__
        for pieces in split:
            yield b"".join(map(known, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.token_list[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker."""
    return Encoder(Merges.from_file(path), pattern)


def slices(texts: list[str], most: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters, so that a block's memory is bounded."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoded(docs: DataFrame, path: str, pattern: str, decode: bool = True) -> DataFrame:
    """Per row of docs: doc_id, ids (binary, little-endian u32) and, if asked for, decoded (binary).

    Null text is the empty text, which has no ids. Rows are handled one by one, so repeated rows and null
    doc_ids pass through; other columns are ignored, whatever their names.
    """
    schema = "doc_id long, ids binary" + (", decoded binary" if decode else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(path, pattern)
        for batch in small(batches, 2500):
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids = list(use.encode(texts[a:b]))
                columns = [doc_ids[a:b], pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(map(use.decode, ids), pa.binary())] if decode else columns,
                    ["doc_id", "ids", "decoded"][: 2 + decode],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256. The ids stay in the task; only digests leave it.

    Nulls, empty texts, repeated rows and other columns are as in `encoded`.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(path, pattern)
        for batch in small(batches, 2500):
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                n, coded, back = [], [], []
                for ids in use.encode(texts[a:b]):
                    n.append(len(ids) // 4)
                    coded.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(use.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids[a:b], pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
