"""Token ids in a content-addressed store.

Rolling hashes cut each document's id stream into chunks where the content says so, so equal passages give
equal chunks. Every unique chunk is stored once, in pack files; a document's recipe lists its chunks; Merkle
roots over chunk digests, documents and recipe files verify whatever is read back.

The store is a folder:

* packs/<number>.ids chunks one after the other, ids as little-endian unsigned integers of 2 or 4 bytes;
* chunks             a table: digest (SHA-256 of the chunk's bytes), pack, offset, size;
* recipes            a table in ascending doc_id order: doc_id, start, n_tokens, root and the chunks' places;
* manifest           a table: each recipe file's number of documents, first id's place, ids and Merkle root over its
                     rows (doc_id, place, ids, root), and the root over all these rows.

Building it takes two passes over the ids but one over the texts: texts are encoded into compressed staging
packs; the chunks' digests (not their bytes) meet in Spark to choose one place for each chunk;
the chosen chunks are then copied from staging packs to final ones. Every file has a name of its own, and only
files that finished tasks report are ever read, so tasks can fail and run again.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, scratch, small, written
from .files import Reader, opened

#: Ids that the rolling hash covers, mean ids of a chunk beyond them, and most ids of a chunk. Most documents have
#: some hundred ids, so chunks are short enough for several in each.
ROLLING, MEAN, MOST = 8, 128, 1024
#: Words and pieces that a worker remembers, rows and characters encoded at a time, and bytes of a pack read at once.
#: They bound memory only.
WORDS, ROWS, CHUNK, READ = 800_000, 2500, 4_000_000, 8_000_000
#: What stands between words in a line for the library.
MARK = "\u2400"
#: A chunk's place among all staging packs is one long: the task attempt that wrote the pack, then the byte in it.
PLACE_BITS = 38

_GEAR = np.random.default_rng(11).integers(0, 2**32, 65_536, dtype=np.uint32)


def cuts(ids: np.ndarray, stops: np.ndarray | None = None) -> np.ndarray:
    """Where chunks end: where the rolling hash of the last ids says so, after MOST ids at the latest, and at stops.

    stops: where the texts end that ids has in a row (ascending; one text if left out). What lies before a text's
    start never bears on its chunks.
    """
    stops = np.unique(np.array([len(ids)]) if stops is None else stops)
    stops = stops[stops > 0]
    if not len(stops):
        return np.empty(0, np.int64)
    ends = stops
    if len(ids) > ROLLING:
        gear = _GEAR[ids & 0xFFFF] ^ (ids >> 16).astype(np.uint32) * np.uint32(0x9E3779B1)
        rolled = np.zeros(len(ids) - ROLLING, np.uint32)
        for k in range(ROLLING):
            rolled = rolled * np.uint32(0x01000193) + gear[k : len(ids) - ROLLING + k]
        rolled ^= rolled >> np.uint32(16)
        found = np.flatnonzero(rolled % np.uint32(MEAN) == 0) + ROLLING
        begins = np.append(0, stops)[np.searchsorted(stops, found, side="right")]
        ends = np.union1d(found[found - begins >= ROLLING], stops)
    wide = np.diff(ends, prepend=0) > MOST
    if wide.any():
        begins = np.append(0, ends[:-1])
        extra = [np.arange(a + MOST, b, MOST) for a, b in zip(begins[wide], ends[wide], strict=True)]
        ends = np.unique(np.concatenate([ends, *extra]))
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """The root over digests; pairs are hashed level by level, an odd last one goes up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]  # noqa: B905
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


#: A word of these characters alone is normal but for its case, and all libraries agree on its classes.
_PLAIN = regex.compile(r"[\x21-\x7E\xA1-\u024F]+")


class WordEncoder:
    """Encodes texts with the tokenizers library, white space apart; remembers the ids of what lies between.

    Right for tokenizers that drop white space, as then no token reaches over it. New words go to the library once,
    many in one line, with a mark between them that no word has. Where the tokenizer lower-cases words and cuts
    them by a pattern to pieces of bytes, plain words are cut here by its own pattern, and its model gets each
    new piece once: words differ far more often than their pieces.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 65_536 else 4
        self.kind, self.code = np.dtype(f"<u{self.width}"), "H" if self.width == 2 else "I"
        self.model = self.tokenizer.model
        self.between = np.array(self.ids(MARK), self.kind)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added)) or "(?!)", regex.IGNORECASE)
        with open(path, encoding="utf-8") as f:
            self.pattern = None if any(map(str.isalpha, added)) else piece_pattern(json.load(f))
        if self.pattern:
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            # The library's letter for each byte of the plain characters.
            each = {c: level.pre_tokenize_str(chr(c)) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250))}
            self.letters = {c: found[0][0] for c, found in each.items()}
        self.pieces: dict[str, bytes] = {}
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        # By word number: the place and number of its ids in flat.
        self.begin, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, self.kind)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def library(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        out: list[bytes] = []
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            line = f" {MARK} ".join(some)
            ids, size = np.array(self.ids(line), self.kind), len(self.between)
            marks = np.ones(max(len(ids) - size + 1, 0), bool)
            for n, x in enumerate(self.between):
                marks &= ids[n : len(ids) - size + 1 + n] == x
            at = np.flatnonzero(marks)
            if line.count(MARK) != len(some) - 1 or len(at) != len(some) - 1:  # a word has the mark
                out += [np.array(self.ids(w), self.kind).tobytes() for w in some]
                continue
            out += [ids[a:b].tobytes() for a, b in zip([0, *(at + size).tolist()], [*at.tolist(), len(ids)], strict=True)]
        return out

    def piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))]
        ids = array(self.code, ids).tobytes()
        if len(self.pieces) > WORDS:
            self.pieces.clear()
        self.pieces[piece] = ids
        return ids

    def new_words(self, texts: list[str]) -> list[bytes]:
        """The ids of each word, by pieces where it is plain."""
        if not self.pattern:
            return self.library(texts)
        out: list[bytes | None] = []
        plain, find, known, added = _PLAIN.fullmatch, self.pattern.findall, self.pieces, self.added.search
        for text in texts:
            low = text.lower()
            if not text:
                out.append(b"")
            elif not (low.isascii() and low.isprintable() or plain(low)):
                out.append(None)
            elif low.isalpha():
                out.append(known.get(low) or self.piece(low))
            elif added(low):
                out.append(None)
            else:
                out.append(b"".join([known.get(piece) or self.piece(piece) for piece in find(low)]))
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self.library([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.number) > WORDS:
            self.reset()
        # Arrow parts and tells the words; Python sees each once. Blank ends give empty words, which have no ids.
        split = pc.ascii_split_whitespace(texts)
        told = split.flatten().dictionary_encode()
        words = told.dictionary.to_pylist()
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new = [words[k] for k in missing.tolist()]
            ids = self.new_words(new)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(lengths) - lengths)
            self.length = np.append(self.length, lengths)
            self.flat = np.append(self.flat, np.frombuffer(b"".join(ids), self.kind))
            number[missing] = np.arange(len(self.number), len(self.number) + len(new))
            self.number.update(zip(new, number[missing].tolist(), strict=True))
        # Each word's ids follow those of the word before.
        number = number[np.array(told.indices)]
        n = self.length[number]
        stop = np.cumsum(n)
        where = np.repeat(self.begin[number] - (stop - n), n) + np.arange(int(n.sum()))
        until = np.append(0, stop)[np.append(0, np.cumsum(np.array(split.value_lengths(), np.int64)))]
        return self.flat[where], np.diff(until)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        ids, lengths = self.encode_all(pa.array(texts, pa.string()))
        yield from np.split(ids, np.cumsum(lengths)[:-1])


def piece_pattern(description: dict):
    """The pattern that cuts a tokenizer's words to pieces, if it is of the kind that `WordEncoder` can cut: texts
    are composed and lower-cased, what the pattern matches is kept, and its bytes go to a BPE model. Else None."""
    normal, cut = description.get("normalizer") or {}, description.get("pre_tokenizer") or {}
    steps, parts, model = normal.get("normalizers", []), cut.get("pretokenizers", []), description["model"]
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if steps != [{"type": "NFC"}, blank, {"type": "Lowercase"}] or [p["type"] for p in parts] != ["Split", "ByteLevel"]:
        return None
    split, level = parts
    if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        return None
    if model["type"] != "BPE" or model.get("dropout"):
        return None
    return regex.compile(split["pattern"]["Regex"])


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(path)


def parts_of(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The texts in slices of about so many bytes; a longer text is one of its own."""
    piece = np.cumsum(np.array(pc.binary_length(texts), np.int64)) // size
    edges = [*np.flatnonzero(np.diff(piece, prepend=-1)).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):  # noqa: B905
        yield texts.slice(a, b - a)


STAGED = "doc_id long, file long, nth long, n_tokens long, chunks array<struct<digest:binary,place:long,size:int>>"
CHUNKS = "digest binary, pack long, offset long, size int"
RECIPES = (
    "part int, doc_id long, start_in_part long, n_tokens long, root binary, "
    "chunks array<struct<seq:int,digest:binary,pack:long,offset:long,size:int>>"
)


def staging_pack(staging: str, file: int) -> str:
    return f"{staging}/{file}.zst"


def pack_file(store: str, pack: int) -> str:
    return f"{store}/packs/{pack:016x}.ids"


def build(docs: DataFrame, tokenizer_path: str, end_id: int, store: str) -> None:
    """Writes the store of docs (doc_id, text); null text is empty, so only its end id is stored.

    Rows are told apart even where they repeat a doc_id; they follow each other in no particular order then.
    Null doc_ids come first. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    staging = f"{store}/staging"
    for folder in (staging, f"{store}/packs"):
        where, path = opened(folder)
        where.create_dir(path, recursive=True)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = word_encoder(tokenizer_path)
        gc.disable()  # nothing here has cycles, and the encoder's memory is slow to go through
        file = TaskContext.get().taskAttemptId()
        if file >> (62 - PLACE_BITS):
            raise ValueError(f"task attempt {file} has no room in a chunk's place")
        where, path = opened(staging_pack(staging, file))
        place = count = 0
        with where.open_output_stream(path) as raw, zstandard.ZstdCompressor(level=1).stream_writer(raw, closefd=False) as out:
            for batch in small(batches, ROWS):
                texts = pc.fill_null(batch.column(1), "")
                n_tokens, n_chunks, digests, places, sizes = [], [], [], [], []
                # Digests of this batch's chunks: a copy of one needs no second place in the staging pack.
                seen: dict[bytes, int] = {}
                for part in parts_of(texts, CHUNK):
                    ids, lengths = use.encode_all(part)
                    stops = np.cumsum(lengths)
                    ids = np.insert(ids, stops, end_id)
                    stops += np.arange(1, len(stops) + 1)
                    ends = cuts(ids, stops)
                    data = memoryview(ids.tobytes())
                    n_tokens.append(lengths + 1)
                    n_chunks.append(np.diff(np.searchsorted(ends, stops, side="right"), prepend=0))
                    bounds = (ends * use.width).tolist()
                    sizes.append(np.diff(ends, prepend=0) * use.width)
                    fresh = []
                    for x, y in zip([0, *bounds[:-1]], bounds, strict=True):
                        digest = hashlib.sha256(data[x:y]).digest()
                        at = seen.get(digest)
                        if at is None:
                            at = seen[digest] = place
                            fresh.append(data[x:y])
                            place += y - x
                        digests.append(digest)
                        places.append(at)
                    out.write(b"".join(fresh))
                rows, ends = len(texts), np.append(0, np.cumsum(np.concatenate(n_chunks)))
                chunks = pa.StructArray.from_arrays(
                    [
                        pa.array(digests, pa.binary()),
                        pa.array(np.array(places, np.int64) + (file << PLACE_BITS), pa.int64()),
                        pa.array(np.concatenate(sizes).astype(np.int32), pa.int32()),
                    ],
                    ["digest", "place", "size"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(rows, file), pa.int64()),
                        pa.array(np.arange(count, count + rows), pa.int64()),
                        pa.array(np.concatenate(n_tokens), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks),
                    ],
                    ["doc_id", "file", "nth", "n_tokens", "chunks"],
                )
                count += rows
        gc.enable()
        if place >> PLACE_BITS:
            raise ValueError(f"a staging pack of {place} bytes is too large")

    staged = written(docs.select("doc_id", "text").mapInArrow(stage, STAGED), "staged")

    # One place for each unique chunk: the least.
    chunk = F.explode("chunks").alias("chunk")
    owned = staged.select(chunk).groupBy(F.col("chunk.digest").alias("digest"))
    owned = owned.agg(F.min("chunk.place").alias("place"), F.max("chunk.size").alias("size"))
    owned = owned.withColumn("file", F.shiftright("place", PLACE_BITS))

    def copy(table: pa.Table) -> pa.Table:
        """Copies a staging pack's chosen chunks to a final pack, in their order."""
        table = table.sort_by("place")
        pack = uuid.uuid4().int >> 65
        places = np.array(table.column("place"), np.int64) & ((1 << PLACE_BITS) - 1)
        sizes = np.array(table.column("size"), np.int64)
        # Neighbours are copied at once.
        first = np.append(True, places[1:] != places[:-1] + sizes[:-1])
        begin = places[first]
        end = (places + sizes)[np.append(first[1:], True)]
        source, source_path = opened(staging_pack(staging, table.column("file")[0].as_py()))
        target, target_path = opened(pack_file(store, pack))
        at = 0
        with (
            source.open_input_stream(source_path) as raw,
            zstandard.ZstdDecompressor().stream_reader(raw, closefd=False) as packed,
            target.open_output_stream(target_path) as out,
        ):
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                while at < b:
                    data = packed.read(min((a if at < a else b) - at, 1 << 20))
                    if not data:
                        raise OSError(f"{source_path} ends at {at}, expected {b}")
                    if at >= a:
                        out.write(data)
                    at += len(data)
        return pa.table(
            {
                "digest": table.column("digest"),
                "pack": pa.array(np.full(len(sizes), pack), pa.int64()),
                "offset": pa.array(np.cumsum(sizes) - sizes, pa.int64()),
                "size": table.column("size"),
            }
        )

    owned.groupBy("file").applyInArrow(copy, CHUNKS).write.parquet(f"{store}/chunks")
    where, path = opened(staging)
    where.delete_dir(path)
    chunks = spark.read.parquet(f"{store}/chunks")
    placed = staged.select("doc_id", "file", "nth", "n_tokens", F.posexplode("chunks").alias("seq", "chunk"))
    placed = placed.withColumn("digest", F.col("chunk.digest")).drop("chunk").join(chunks, "digest")
    recipes = placed.groupBy("file", "nth", "doc_id", "n_tokens").agg(
        F.array_sort(F.collect_list(F.struct("seq", "digest", "pack", "offset", "size"))).alias("chunks")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "file", "nth"]
    ranged = recipes.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds each document's Merkle root and the ids before it in its recipe file."""
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = np.array(batch.column("n_tokens"), np.int64)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            chunks = batch.column("chunks")
            digests, ends = chunks.flatten().field("digest").to_pylist(), np.cumsum(chunks.value_lengths())
            roots = [merkle(digests[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(n), pa.int32()),
                    batch.column("doc_id"),
                    pa.array(starts, pa.int64()),
                    batch.column("n_tokens"),
                    pa.array(roots, pa.binary()),
                    batch.column("chunks"),
                ],
                ["part", "doc_id", "start_in_part", "n_tokens", "root", "chunks"],
            )

    numbered = ranged.select("doc_id", "n_tokens", "chunks").mapInArrow(number, RECIPES)
    numbered.write.parquet(f"{store}/recipes")
    free(staged)
    # One row for each recipe file, as many as there are tasks.
    parts = recipe_parts(spark.read.parquet(f"{store}/recipes"))
    root = store_root(parts)
    rows = [(*r, root) for r in parts]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{store}/manifest")


MANIFEST = "part int, n_docs long, n_tokens long, root binary, start long, store_root binary"


def recipe_parts(recipes: DataFrame) -> list[tuple]:
    """What the manifest has to say of the recipes: part, n_docs, n_tokens, root and start of each recipe file."""

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("start_in_part", "ascending"), ("root", "ascending")])
        columns = [table.column(c).to_pylist() for c in ("doc_id", "start_in_part", "n_tokens", "root")]
        leaves = [f"{d} {start} {n} ".encode() + root for d, start, n, root in zip(*columns, strict=True)]
        found = (table.column("part")[0].as_py(), len(leaves), sum(columns[2]), merkle(leaves))
        return pa.table([pa.array([x], t) for x, t in zip(found, types, strict=True)], names)

    names, types = ["part", "n_docs", "n_tokens", "root"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    rows = recipes.select("part", "doc_id", "start_in_part", "n_tokens", "root")
    found = rows.groupBy("part").applyInArrow(summed, "part int, n_docs long, n_tokens long, root binary")
    out, start = [], 0
    for part, n_docs, n_tokens, root in sorted(tuple(r) for r in found.collect()):
        out.append((part, n_docs, n_tokens, bytes(root), start))
        start += n_tokens
    return out


def store_root(parts: list[tuple]) -> bytes:
    return merkle([f"{part} {n_docs} {n_tokens} {start} ".encode() + root for part, n_docs, n_tokens, root, start in parts])


def verify(spark: SparkSession, store: str) -> None:
    """Fails if the manifest isn't whole or the recipe files aren't those that it lists."""
    rows = [tuple(r) for r in spark.read.schema(MANIFEST).parquet(f"{store}/manifest").collect()]
    listed = sorted((*r[:3], bytes(r[3]), r[4]) for r in rows)
    root = store_root(listed)
    if any(bytes(r[5]) != root for r in rows):
        raise ValueError(f"{store}: the manifest doesn't match its Merkle root")
    there = recipe_parts(spark.read.schema(RECIPES).parquet(f"{store}/recipes"))
    if wrong := sorted({r[0] for r in set(listed) ^ set(there)}):
        raise ValueError(f"{store}: recipe files {wrong} don't match the manifest's counts and Merkle roots")


def read(spark: SparkSession, store: str, width: int, digest: Callable[[bytes], int]) -> DataFrame:
    """Reads every document back from the files: doc_id, start, n_tokens, digest (of its ids as unsigned
    little-endian 32-bit integers) and merkle_root. The manifest and the recipe files are verified at once, chunks,
    sizes and documents' roots on the way."""
    verify(spark, store)
    recipes = spark.read.schema(RECIPES).parquet(f"{store}/recipes")
    manifest = spark.read.parquet(f"{store}/manifest").select("part", F.col("start").alias("part_start"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in small(batches):
            nested = batch.column("chunks")
            flat = nested.flatten()
            packs, offsets, sizes = (np.array(flat.field(c), np.int64) for c in ("pack", "offset", "size"))
            # Neighbours in a pack are read at once, up to a bound.
            first = np.append(True, (packs[1:] != packs[:-1]) | (offsets[1:] != offsets[:-1] + sizes[:-1]))
            total = np.cumsum(sizes) - sizes
            first |= np.diff(total // READ, prepend=-1) > 0
            begins = np.flatnonzero(first)
            n_bytes = np.add.reduceat(sizes, begins) if len(begins) else sizes
            read = zip(packs[begins].tolist(), offsets[begins].tolist(), n_bytes.tolist(), strict=True)
            data = b"".join([reader.read(pack_file(store, pack), offset, size) for pack, offset, size in read])
            view, bounds = memoryview(data), [0, *np.cumsum(sizes).tolist()]
            found = [hashlib.sha256(view[a:b]).digest() for a, b in zip(bounds, bounds[1:])]  # noqa: B905
            ids = memoryview(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
            digests = []
            ends = np.cumsum(nested.value_lengths()).tolist()
            wanted = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "root")), [0, *ends[:-1]], ends, strict=True)
            for doc_id, n, root, at, end in wanted:
                if merkle(found[at:end]) != root:
                    raise ValueError(f"document {doc_id}: what was read doesn't match its Merkle root")
                a, b = bounds[at] // width, bounds[end] // width
                if b - a != n:
                    raise ValueError(f"document {doc_id}: {b - a} ids, expected {n}")
                digests.append(digest(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("part", "doc_id", "start_in_part", "n_tokens")), pa.array(digests, pa.int64())]
                + [batch.column("root")],
                ["part", "doc_id", "start_in_part", "n_tokens", "digest", "root"],
            )

    schema = "part int, doc_id long, start_in_part long, n_tokens long, digest long, root binary"
    # The manifest has a row for each recipe file, as many as there are tasks to read them.
    return recipes.mapInArrow(rows, schema).join(F.broadcast(manifest), "part").select(
        "doc_id",
        (F.col("start_in_part") + F.col("part_start")).alias("start"),
        "n_tokens",
        "digest",
        F.lower(F.hex("root")).alias("merkle_root"),
    )


def stored(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Builds a store in shared storage and reads it back; see `build` and `read`. digest is the CRC-32."""
    store = scratch(docs.sparkSession, "tokens")
    build(docs, tokenizer_path, end_id, store)
    return read(docs.sparkSession, store, word_encoder(tokenizer_path).width, zlib.crc32)
