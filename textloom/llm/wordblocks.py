"""Words as 64-bit hashes, and the exchange of packed hashes between blocks of documents and hash buckets.

Tasks pack the rows that they read, as they come, into blocks of bounded size and store them in shared storage, so
no row's id or text decides where it goes, repeated rows spread like others, and texts are never shuffled. A block
sends each distinct hash once, however often it holds it, so no hash is hot on its way; the rows that travel are
arrays of the hashes of one block that fall in one bucket. A block's work is in proportion to its own hashes: it
has rows for the buckets that it has hashes for, and no others. Blocks and buckets both grow in number with the
input. As inputs grow, a row holds fewer hashes, down to one, which is the cost of an ordinary shuffle of hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small, written
from .files import Reader, opened

#: Characters of text in a block, and of text whose hashes are in one bucket; they bound a task's memory.
BLOCK_CHARS, BUCKET_CHARS = 4_000_000, 32_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (an invertible finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but space and \\t-\\r (bytes.split has just these), A-Z lower-cased if asked for."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


STORED = "block long, file long, offset long, size long, chars long"


def stored_blocks(docs: DataFrame, label: str, pack: Callable[[list[tuple]], bytes]) -> tuple[DataFrame, str]:
    """Packs the rows of docs (doc_id, text and what else there is) to blocks; their list (see STORED) and folder.

    Every file has the number of the task attempt that wrote it, and only attempts that Spark commits are listed.
    """
    folder = scratch(docs.sparkSession, label)
    where, path = opened(folder)
    where.create_dir(path, recursive=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, listed, offset = TaskContext.get().taskAttemptId(), 0, 0
        held, chars = [], 0
        where, path = opened(f"{folder}/{file}.blocks")
        with where.open_output_stream(path) as out:

            def closed() -> pa.RecordBatch:
                data = pack(held)
                out.write(data)
                found = ((file << 24) + listed, file, offset, len(data), chars)
                return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in found], [x.split()[0] for x in STORED.split(", ")])

            for batch in small(batches):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append(row)
                    chars += len(row[1] or "")
                    if chars >= BLOCK_CHARS or len(held) >= BLOCK_CHARS:
                        done = closed()
                        offset += done.column(3)[0].as_py()
                        listed, held, chars = listed + 1, [], 0
                        yield done
            if held:
                yield closed()

    return written(docs.mapInArrow(rows, STORED), "blocks"), folder


def parts_for(blocks: DataFrame) -> tuple[int, int]:
    """How many tasks the blocks need, and how many buckets their hashes."""
    chars = blocks.agg(F.sum("chars")).first()[0] or 0
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(math.ceil(chars / BLOCK_CHARS / 2), least), max(math.ceil(chars / BUCKET_CHARS), least)


def contents(blocks: pa.Table | pa.RecordBatch, folder: str) -> Iterator[tuple[int, bytes]]:
    """Each listed block's number and what was packed."""
    reader = Reader()
    for block, file, offset, size in zip(*(blocks.column(c).to_pylist() for c in ("block", "file", "offset", "size")), strict=True):
        yield block, reader.read(f"{folder}/{file}.blocks", offset, size)


def runs_of(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of an array whose equal values are neighbours, and where it stands."""
    edges = np.append(np.flatnonzero(np.diff(values, prepend=-1)), len(values)).tolist()
    for a, b in zip(edges, edges[1:]):  # noqa: B905
        yield int(values[a]), slice(a, b)


def deltas(positions: np.ndarray) -> bytes:
    """Ascending positions below 2**32, packed as their differences; most are small and compress well."""
    gaps = np.diff(positions, prepend=0)
    wide = bool(len(gaps)) and int(gaps.max()) > 0xFFFF
    return (b"\4" if wide else b"\2") + gaps.astype("<u4" if wide else "<u2").tobytes()


def positions(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, f"<u{packed[0]}", offset=1), dtype=np.int64)
