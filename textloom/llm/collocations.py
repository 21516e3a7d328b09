"""Phrase collocation mining with counting quotient filters.

Texts are packed to stored blocks, as numbers of the block's distinct words. A block sends each distinct word of a
language once, with its count; buckets add the counts up, give the words that are frequent enough ids and answer.
A phrase that is frequent has only frequent words, so the others end pieces for good. A block then counts its pairs
and triples of ids in filters (see quotient), one for each shard of the permuted numbers, and the shards merge what
the blocks send. So a frequent word or phrase is one entry of a block, however often it stands there, and its
counting is no hot key. What is left, the frequent phrases, is scored by joins.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, written
from .lm import in_range_buckets, pack, unpack
from .quotient import Filter, Packing, filters
from .wordblocks import contents, parts_for, runs_of, stored_blocks

#: Words of the longest phrases; shorter ones have two at least.
LONGEST = 3
#: Occurrences of a phrase, per cent of them inside a longer phrase that drop it, and phrases of a language that are listed.
LEAST, INSIDE, FIRST = 10, 50, 2000
#: The language of rows without one.
UNKNOWN = "und"
#: Scores are whole numbers up to this one.
UNIT = 1_000_000
#: Scores of one step of a language's histogram.
STEP = 1000
#: A-Z lower-cased, ends of pieces as \n, tabs as spaces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")

WORDS = "block long, bucket int, langs array<string>, words binary, of binary, counts binary"
NUMBERED = "block long, bucket int, ids binary, rank long, lang string, word string, n long"
FILTERS = "size int, shard int, filter binary"
PHRASES = "size int, w1 long, w2 long, w3 long, a long"
#: For sorting out the rows of NUMBERED.
IDS, WORD, TOTAL = "block IS NOT NULL", "rank IS NOT NULL", "rank IS NULL AND lang IS NOT NULL"


def tokens(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The words of the texts in a row, and which of them begin a piece."""
    raw = b"\n".join((t or "").encode() for t in texts).translate(FOLD)
    held = np.frombuffer(raw, np.uint8)
    ends = held == 10
    gap = ends | (held == 32)
    starts = np.flatnonzero(~gap & np.append(True, gap[:-1])[: len(gap)])
    return raw.split(), np.diff(np.cumsum(ends, dtype=np.int32)[starts], prepend=-1) != 0


def pack_block(rows: list[tuple]) -> bytes:
    """A block's rows (lang, text): per distinct word of a language, in the order of hashes, and per token."""
    texts: dict[str, list[str | None]] = {}
    for lang, text in rows:
        texts.setdefault(lang, []).append(text)
    distinct, hashed, of, word, begins = [], [], [], [], []
    for k, (lang, own) in enumerate(texts.items()):
        words, begin = tokens(own)
        unique = dict.fromkeys(words)
        number = dict(zip(unique, range(len(distinct), len(distinct) + len(unique)), strict=True))
        word.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        begins.append(begin)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        hashed.append(np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in unique), np.uint64, len(unique)))
        of.append(np.full(len(unique), k, np.uint32))
        distinct += unique
    hashed = np.concatenate(hashed)
    order = np.argsort(hashed)
    renumbered = np.empty(len(order), np.uint32)
    renumbered[order] = np.arange(len(order), dtype=np.uint32)
    out = io.BytesIO()
    np.savez(
        out,
        word=renumbered[np.concatenate(word)],
        begins=np.packbits(np.concatenate(begins)),
        hashes=hashed[order],
        of=np.concatenate(of)[order],
        words=np.frombuffer(b"\n".join([distinct[k] for k in order.tolist()]), np.uint8),
        langs=np.frombuffer(json.dumps(list(texts)).encode(), np.uint8),
    )
    return zstandard.compress(out.getbuffer(), 3)


def unpack_block(data: bytes, *names: str) -> list[np.ndarray]:
    with np.load(io.BytesIO(zstandard.decompress(data))) as file:
        return [file[name] for name in names]


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def of_text(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (see PHRASES), frequent words (id, lang, word, n), and all words of each language (lang, n)."""
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    blocks, folder = stored_blocks(texts, "word-pieces", pack_block)
    tasks, parts = parts_for(blocks)
    shard_bits = max(parts - 1, 1).bit_length()
    shards = 1 << shard_bits
    listed = blocks.repartition(tasks, "block")
    words_schema, numbered_schema, filters_schema, phrases_schema = map(of_text, (WORDS, NUMBERED, FILTERS, PHRASES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in contents(batch, folder):
                word, hashes, of, words, langs = unpack_block(data, "word", "hashes", "of", "words", "langs")
                counts = np.bincount(word, minlength=len(hashes)).astype(np.uint64)
                words, langs = words.tobytes().split(b"\n"), json.loads(langs.tobytes())
                yield rows_of(
                    words_schema,
                    [
                        (block, bucket, langs, b"\n".join(words[at]), pack(of[at].astype(np.uint64)), pack(counts[at]))
                        for bucket, at in runs_of(in_range_buckets(hashes, shards))
                        if len(hashes)
                    ],
                )

    def number(table: pa.Table) -> pa.Table:
        """Ids of a bucket's frequent words for the blocks, the words themselves, and the languages' words."""
        seen: dict[tuple[str, bytes], int] = {}
        places, counts = [], []
        for langs, words, of, counted in zip(*(table.column(c).to_pylist() for c in ("langs", "words", "of", "counts")), strict=True):
            own = [langs[k] for k in unpack(of).tolist()]
            keys = zip(own, words.split(b"\n"), strict=True)
            places.append(np.fromiter((seen.setdefault(key, len(seen)) for key in keys), np.int64, len(own)))
            counts.append(unpack(counted))
        totals = np.zeros(len(seen), np.int64)
        np.add.at(totals, np.concatenate(places), np.concatenate(counts).astype(np.int64))
        often = totals >= least
        ids = np.where(often, np.cumsum(often), 0).astype(np.uint64)  # from 1; 0 for the others
        by_lang: dict[str, int] = {}
        rows = []
        bucket = table.column("bucket")[0].as_py()
        for (lang, word), n, k in zip(seen, totals.tolist(), ids.tolist(), strict=True):
            by_lang[lang] = by_lang.get(lang, 0) + n
            if k:
                rows.append((None, bucket, None, k - 1, lang, word.decode(), n))
        rows += [(None, bucket, None, None, lang, None, n) for lang, n in by_lang.items()]
        rows += [(block, bucket, pack(ids[at]), None, None, None, None) for block, at in zip(table.column("block").to_pylist(), places, strict=True)]
        return pa.Table.from_batches([rows_of(numbered_schema, rows)])

    sent = listed.mapInArrow(send, WORDS).repartition(shards, "bucket")
    numbered = written(sent.groupBy("bucket").applyInArrow(number, NUMBERED), "numbered-words")
    most = numbered.agg(F.max("rank")).first()[0] or 0
    rank_bits = max(most.bit_length(), 1)
    bits = shard_bits + rank_bits

    def count(table: pa.Table, answers: pa.Table) -> pa.Table:
        ((_, data),) = contents(table, folder)
        if not answers.num_rows:
            return pa.Table.from_batches([rows_of(filters_schema, [])])
        word, begins = unpack_block(data, "word", "begins")
        answers = answers.sort_by("bucket")
        found = [unpack(x) for x in answers.column("ids").to_pylist()]
        buckets = np.repeat(answers.column("bucket").to_numpy().astype(np.uint64), [len(x) for x in found])
        found = np.concatenate(found)
        known = (found > 0)[word]
        token = ((buckets << np.uint64(rank_bits)) | (found - np.uint64(1)))[word]
        # A phrase goes on from the token before where both are known and no piece begins.
        goes_on = ~np.unpackbits(begins, count=len(word)).astype(bool) & known & np.append(False, known[:-1])[: len(word)]
        ends, rows = goes_on, []
        for size in range(2, LONGEST + 1):
            at = np.flatnonzero(ends)
            ids = [token[at - k] for k in range(size - 1, -1, -1)]
            rows += [(size, f.shard, f.packed()) for f in filters(Packing(size, bits), shard_bits, ids)]
            ends = goes_on & np.append(False, ends[:-1])[: len(word)]
        return pa.Table.from_batches([rows_of(filters_schema, rows)])

    def merge(table: pa.Table) -> pa.Table:
        size, shard = (table.column(c)[0].as_py() for c in ("size", "shard"))
        packing = Packing(size, bits)
        held = Filter.merged([Filter.unpacked(packing, shard_bits, shard, x) for x in table.column("filter").to_pylist()])
        ids, counts = held.at_least(least)
        columns = [pa.array(x.astype(np.int64)) for x in ids] + [pa.nulls(len(counts), pa.int64())] * (LONGEST - size)
        return pa.table([pa.array([size] * len(counts), pa.int32()), *columns, pa.array(counts.astype(np.int64))], schema=phrases_schema)

    answers = numbered.where(IDS).select("block", "bucket", "ids").repartition(tasks, "block")
    counted = listed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(count, FILTERS)
    dealt = counted.repartition(shards, "size", "shard").groupBy("size", "shard")
    found = written(dealt.applyInArrow(merge, PHRASES), "phrases")
    one = F.shiftleft(F.col("bucket").cast("long"), rank_bits).bitwiseOR(F.col("rank")).alias("id")
    words = written(numbered.where(WORD).select(one, "lang", "word", "n"), "frequent-words")
    totals = written(numbered.where(TOTAL).groupBy("lang").agg(F.sum("n").alias("n")), "language-words")
    free(numbered)
    return found, words, totals


def quotient(a: str, left: str, right: str) -> Column:
    """floor(UNIT * a * a / (left * right)), exact."""
    return F.expr(f"({UNIT} * CAST({a} AS DECIMAL(19, 0)) * CAST({a} AS DECIMAL(19, 0))) div (CAST({left} AS DECIMAL(19, 0)) * CAST({right} AS DECIMAL(19, 0)))")


def best_first(scored: DataFrame, first: int) -> DataFrame:
    """The rows that can be among the first of their language, and no others beyond those of the last step.

    Scores and, among the highest ones, counts go by the steps of a histogram, which a language has few of.
    """
    step = F.floor(F.col("score") / STEP) * 1000 + F.when(F.col("score") == UNIT, F.least(F.floor(8 * F.log2("a")), F.lit(999))).otherwise(0)
    stepped = scored.withColumn("step", step.cast("long"))
    steps = stepped.groupBy("lang", "step").agg(F.count("*").alias("rows"))
    higher = F.coalesce(F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = steps.withColumn("higher", higher).where(F.col("higher") < first).groupBy("lang").agg(F.min("step").alias("least"))
    return stepped.join(least, "lang").where("step >= least").drop("step", "least")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, first: int = FIRST) -> DataFrame:
    """Per language its first phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split to pieces at .,;:!? and line ends and to words at spaces and tabs. A phrase of
    2 to 3 words that stands a >= least times within pieces is a candidate; of its cuts into a left and a right
    part, which stand l and r times, that with the lowest score counts (ties: the first). A candidate is
    dropped if a longer one that holds it stands at least inside/100 times as often. n: the language's words. Order: score and a
    descending, then phrase by bytes.

    Null and empty texts have no words; a null lang is UNKNOWN, as is that name itself. Rows that repeat count each
    time; other columns are ignored, doc_id too. Without candidates there are no rows.
    """
    found, words, totals = phrases(docs, least)
    pairs = found.where("size = 2").select("w1", "w2", "a")
    triples = found.where("size = 3").select("w1", "w2", "w3", "a")
    parts = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    parts = parts.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    pairs_left = pairs.join(parts, ["w1", "w2"], "left").where(f"longer IS NULL OR 100 * longer < {inside} * a").drop("longer")
    word = lambda id_, n, *more: words.select(F.col("id").alias(id_), F.col("n").alias(n), *more)
    twos = pairs_left.join(word("w1", "l", "lang"), "w1").join(word("w2", "r"), "w2")
    twos = twos.select("lang", "w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l", "r", quotient("a", "l", "r").alias("score"))
    part = lambda x, y, n: pairs.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(n))
    threes = triples.join(part("w1", "w2", "l2"), ["w1", "w2"]).join(part("w2", "w3", "r1"), ["w2", "w3"])
    threes = threes.join(word("w1", "l1", "lang"), "w1").join(word("w3", "r2"), "w3")
    threes = threes.withColumns({"s1": quotient("a", "l1", "r1"), "s2": quotient("a", "l2", "r2")})
    lower = F.col("s1") <= F.col("s2")
    threes = threes.select(
        "lang", "w1", "w2", "w3", "a",
        F.when(lower, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(lower, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    scored = written(twos.unionByName(threes), "scored-phrases")
    free(found)
    text = lambda id_, name: words.select(F.col("id").alias(id_), F.col("word").alias(name))
    top = best_first(scored, first)
    top = top.join(text("w1", "t1"), "w1").join(text("w2", "t2"), "w2").join(text("w3", "t3"), "w3", "left")
    top = top.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = top.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
