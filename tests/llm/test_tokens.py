import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textloom.llm import bpe, tokenstore

from .data import ROWS, table

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
STORE_PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=80, deadline=None)
@given(text=st.text(max_size=300) | st.text(alphabet="aab  é'st\n", max_size=2000))
def test_encodes_like_the_library(reference, text):
    use = bpe.encoder(PATH, public_tokenizers.PATTERN)
    (ids,) = use.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert use.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", "a" * 50_000, "ab" * 9000, "".join(random.Random(2).choices("abcdet", k=60_000)), "日本語" * 500, "<|endoftext|>"])
def test_long_pre_tokens(reference, text):
    test_encodes_like_the_library.hypothesis.inner_test(reference, text)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.binary(min_size=2, max_size=5).map(lambda b: bytes(x % 3 for x in b)), st.just(0), max_size=25), st.lists(st.integers(0, 2), max_size=40))
def test_any_rank_file(extra, data):
    """Ranks in any order, so that merges bring up pairs of lower rank than themselves."""
    ranks = {bytes([b]): k for k, b in enumerate(range(256))} | {b: 256 + k for k, b in enumerate(extra)}
    merges, piece = bpe.Merges(ranks), bytes(data)
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        found = [(ranks.get(a + b, 10**9), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        if not found or min(found)[0] == 10**9:
            break
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    if piece:
        assert merges.encode_block([piece, b"\x05", piece])[0].tolist() == [ranks[p] for p in parts]


def test_rank_bitmap_pops_the_least():
    bitmap, values = bpe.RankBitmap(), [5, 4096, 63, 64, 200_000, 0]
    for v in values:
        bitmap.add(v)
    assert [bitmap.pop_first() for _ in range(7)] == [*sorted(values), -1]


def test_round_trip_of_all_cases(spark, reference):
    got = sorted(tuple(r) for r in bpe.round_trip(table(spark), PATH, public_tokenizers.PATTERN).fillna(-1, ["doc_id"]).collect())
    want = []
    for d, t in ROWS:
        ids = reference.encode_ordinary(t or "")
        want.append((-1 if d is None else d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip(table(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
    first = bpe.encoded(table(spark, ROWS[:1]), PATH, public_tokenizers.PATTERN).first()
    assert bytes(first["decoded"]) == ROWS[0][1].encode()


def test_store_of_all_cases(spark):
    library = Tokenizer.from_file(STORE_PATH)
    got = tokenstore.stored(table(spark), STORE_PATH, 2).collect()
    at, want = 0, []
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["n_tokens"], r["digest"]) for r in got), key=key) == sorted(want, key=key)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered[:-1])]).tolist()
    assert [r["doc_id"] for r in ordered if r["doc_id"]] == sorted(d for d, _ in ROWS if d)
    assert tokenstore.stored(table(spark, []), STORE_PATH, 2).count() == 0


def test_words_apart_encode_like_whole_texts():
    library, use = Tokenizer.from_file(STORE_PATH), tokenstore.WordEncoder(STORE_PATH)
    pick = random.Random(3)
    parts = [*"abZKÉéñH.,;:!?'\"-()0129 \n\t\x1c\x85Σςİſ", "́", "̱", "<|endoftext|>", "<|ENDOFTEXT|>", "…", "'S", "'re"]
    texts = ["".join(pick.choices(parts, k=pick.randrange(50))) for _ in range(3000)]
    for text, ids in zip(texts, use.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_follow_the_content():
    ids = np.random.default_rng(1).integers(0, 40_000, 50_000).astype(np.uint16)
    ends = tokenstore.cuts(ids)
    assert ends[-1] == len(ids) and (np.diff(ends, prepend=0) > 0).all() and np.diff(ends, prepend=0).max() <= tokenstore.MOST
    moved = tokenstore.cuts(np.concatenate([ids[:100], ids]))
    assert len(set((ends + 100).tolist()) & set(moved.tolist())) > 0.8 * len(ends)
    assert tokenstore.cuts(ids[:0]).tolist() == []


def test_documents_that_share_a_passage_share_chunks(spark):
    from textloom.llm.common import scratch

    pick = random.Random(6)
    some = lambda n: ["".join(pick.choices("abcdefghij", k=6)) for _ in range(n)]
    passage = some(250)
    rows = [(d, " ".join([*some(60), *passage, *some(60)])) for d in (1, 2)]
    store = scratch(spark, "passage")
    tokenstore.build(table(spark, rows), STORE_PATH, 2, store)
    own = [{bytes(c["digest"]): c["size"] for c in r["chunks"]} for r in spark.read.parquet(f"{store}/recipes").collect()]
    shared = own[0].keys() & own[1].keys()
    ids = len(Tokenizer.from_file(STORE_PATH).encode(" ".join(passage), add_special_tokens=False).ids)
    assert sum(own[0][d] for d in shared) > ids  # of two bytes each: over half of the passage
    stored = spark.read.parquet(f"{store}/chunks").agg({"size": "sum"}).first()[0]
    assert stored == sum((own[0] | own[1]).values())


def test_a_changed_pack_is_found(spark):
    from textloom.llm.common import scratch
    from textloom.llm.files import opened

    store = scratch(spark, "damaged")
    tokenstore.build(table(spark, ROWS[:3]), STORE_PATH, 2, store)
    where, path = opened(f"{store}/packs")
    from pyarrow import fs

    for info in where.get_file_info(fs.FileSelector(path)):
        with where.open_input_file(info.path) as f:
            data = bytearray(f.read())
        data[0] ^= 1
        with where.open_output_stream(info.path) as f:
            f.write(bytes(data))
    with pytest.raises(Exception, match="Merkle"):
        tokenstore.read(spark, store, 2, zlib.crc32).collect()


def test_lost_and_changed_recipes_are_found(spark):
    from pyarrow import fs
    from pyspark.sql import functions as F

    from textloom.llm.common import scratch
    from textloom.llm.files import opened

    store = scratch(spark, "recipes")
    tokenstore.build(table(spark, ROWS), STORE_PATH, 2, store)
    assert tokenstore.read(spark, store, 2, zlib.crc32).count() == len(ROWS)
    recipes = spark.read.parquet(f"{store}/recipes").cache()
    one = F.col("doc_id") == 3
    first, other = (recipes.where(f"doc_id = {d}").first() for d in (1, 3))
    swapped = [F.when(one, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in (("root", bytes(first["root"])), ("n_tokens", first["n_tokens"]))]
    assert first["root"] != other["root"]
    changes = {
        "row": recipes.where("doc_id IS NULL OR doc_id <> 3"),
        "id": recipes.withColumn("doc_id", F.when(one, 99).otherwise(F.col("doc_id"))),
        "swap": recipes.select("part", "doc_id", "start_in_part", swapped[1], swapped[0], "chunks"),
    }
    for name, changed in changes.items():
        damaged = f"{store}-{name}"
        spark.read.parquet(f"{store}/manifest").write.parquet(f"{damaged}/manifest")
        changed.write.parquet(f"{damaged}/recipes")
        with pytest.raises(ValueError, match="recipe files"):
            tokenstore.verify(spark, damaged)
    recipes.unpersist()
    where, path = opened(f"{store}/recipes")
    files = [f for f in where.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet")]
    where.delete_file(max(files, key=lambda f: f.size).path)
    with pytest.raises(ValueError, match="recipe files"):
        tokenstore.read(spark, store, 2, zlib.crc32).collect()
