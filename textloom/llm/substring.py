"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Documents are packed to stored blocks. Each block hashes all its windows by one rolling polynomial over 64-bit word hashes. Windows that
repeat inside the block are known at once; each distinct window goes to its bucket once. Buckets find the
hashes that several blocks hold and answer with their positions; blocks merge all repeated windows into maximal
intervals of words and remove them. A window has 64 bits in its hash, and its bucket's number comes from a
second, independent sum, so windows are told apart by 64 bits plus the logarithm of the number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordblocks import contents, deltas, hashes, mix, parts_for, positions, runs_of, split_words, stored_blocks

#: Words of a window in the contract.
WINDOW = 35
#: The odd base of the rolling polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)

PACKED = "block long, bucket int, hashes binary, at binary"
REPEATS = "block long, at binary"
REMOVED = "doc_id long, n_words long, n_removed long, intervals array<struct<start:int,end:int>>, kept_text string"


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(words: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside one document each, their hashes, and a second hash for dealing them out.

    words: the word hashes of all documents in a row; lengths: words of each document.
    """
    n = len(words)
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = np.flatnonzero(np.arange(n) + size <= ends)
    rolled = np.append(np.uint64(0), np.cumsum(words * powers(BASE, n), dtype=np.uint64))
    summed = np.append(np.uint64(0), np.cumsum(words, dtype=np.uint64))
    shift = powers(INVERSE, n)
    main = (rolled[starts + size] - rolled[starts]) * shift[starts]
    return starts, mix(main), mix(summed[starts + size] - summed[starts])


def pack(rows: list[tuple]) -> bytes:
    """A block's rows (doc_id, text), compressed."""
    doc_ids, texts = zip(*rows, strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(texts, pa.large_string())], ["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> list[tuple]:
    with pa.ipc.open_stream(data) as stream:
        return list(zip(*(c.to_pylist() for c in stream.read_all().columns), strict=True))


def without_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, intervals, kept_text.

    A window of `size` consecutive words is repeated if the same words start anywhere else, in any document or
    the same one, overlapping or not. Words of repeated windows are removed; intervals are the maximal runs
    removed, as word numbers [start, end); kept_text has the kept words joined by one space. Windows are judged
    on the input. Null and empty texts have no words; texts shorter than a window keep all. Rows that repeat a
    document remove each other's windows; a null doc_id is a document like any other; other columns are ignored.
    """
    blocks, folder = stored_blocks(docs.select("doc_id", "text"), "texts", pack)
    tasks, buckets = parts_for(blocks)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in contents(batch, folder):
                words = [hashes(split_words(text)) for _, text in unpacked(data)]
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                starts, main, second = window_hashes(np.concatenate(words), lengths, size)
                order = np.argsort(main)
                same = main[order][1:] == main[order][:-1]
                first = np.sort(order[np.append(True, ~same)] if len(order) else order)
                inside = np.sort(order[np.append(same, False) | np.append(False, same)] if len(order) else order)
                bucket = ((second[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                rows = [(b, main[first[by[at]]].tobytes(), deltas(starts[first[by[at]]])) for b, at in runs_of(bucket[by])]
                rows.append((block % buckets, None, deltas(starts[inside])))  # passed on as it is
                columns = [[block] * len(rows), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, packed.types, strict=True)], schema=packed)

    def answer(table: pa.Table) -> pa.Table:
        out_block, out_at, sent = [], [], []
        for block, packed_hashes, at in zip(*(table.column(c) for c in ("block", "hashes", "at")), strict=True):
            if packed_hashes.is_valid:
                sent.append((block.as_py(), np.frombuffer(packed_hashes.as_buffer(), "<u8"), at))
            else:
                out_block.append(block.as_py())
                out_at.append(at.as_py())
        if sent:
            every = np.concatenate([h for _, h, _ in sent])
            order = np.argsort(every)
            same = every[order][1:] == every[order][:-1]
            repeated = np.zeros(len(every), bool)
            repeated[order] = np.append(same, False) | np.append(False, same)
            for (block, h, at), mine in zip(sent, np.split(repeated, np.cumsum([len(h) for _, h, _ in sent])[:-1]), strict=True):
                if mine.any():
                    out_block.append(block)
                    out_at.append(deltas(positions(at.as_py())[mine]))
        return pa.table({"block": pa.array(out_block, pa.int64()), "at": pa.array(out_at, pa.binary())})

    def cut(table: pa.Table, repeats: pa.Table) -> pa.Table:
        (_, data), = contents(table, folder)
        docs_here = unpacked(data)
        words = [split_words(text) for _, text in docs_here]
        bounds = np.append(0, np.cumsum([len(w) for w in words]))
        cover = np.zeros(bounds[-1] + 1, np.int64)
        for at in repeats.column("at"):
            where = positions(at.as_py())
            cover += np.bincount(where, minlength=len(cover)) - np.bincount(where + size, minlength=len(cover))
        gone = np.cumsum(cover)[:-1] > 0
        out: dict[str, list] = {k: [] for k in removed.names}
        for k, (doc_id, _) in enumerate(docs_here):
            mask = gone[bounds[k] : bounds[k + 1]]
            edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist()
            kept = [w for w, g in zip(words[k], mask.tolist(), strict=True) if not g] if edges else words[k]
            out["doc_id"].append(doc_id)
            out["n_words"].append(len(words[k]))
            out["n_removed"].append(int(mask.sum()))
            out["intervals"].append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            out["kept_text"].append(b" ".join(kept).decode())
        return pa.table(out, removed)

    packed = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("at", pa.binary())])
    removed = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
            ("intervals", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ("kept_text", pa.string()),
        ]
    )
    listed = blocks.repartition(tasks, "block")
    sent = listed.mapInArrow(send, PACKED).repartition(buckets, "bucket")
    repeats = sent.groupBy("bucket").applyInArrow(answer, REPEATS).repartition(tasks, "block")
    return listed.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(cut, REMOVED)
