import random
import re
from collections import Counter

import numpy as np
import pytest

from textloom.llm import collocations
from textloom.llm.quotient import Filter, Packing, filters

from . import data


def brute(rows, least, inside, first):
    """lang, rank, phrase, a, l, r, n, score, by dictionaries of tuples of words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(data.LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[s : s + k]) for s in range(len(words) - k + 1))
    out = {}
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for (lang, *p), a in candidates.items():
        if any(len(q) > len(p) + 1 and q[0] == lang and 100 * b >= inside * a and any(list(q[s : s + len(p)]) == p for s in range(1, len(q))) for q, b in candidates.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *p[:k]] * f[lang, *p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, *p[:k]], f[lang, *p[k:]]))
    found = set()
    for lang, listed in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:first], 1):
            found.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return found


def texts(seed, n=120):
    pick = random.Random(seed)
    words = [*"abcdefgh", "É", "new", "York", "new-york", "x\x00y"]
    rows = [("en", None), (None, ""), ("und", "a b. a b"), (None, "a b! A B"), ("de", " \t\n,;"), ("xx", "only one")]
    for _ in range(n):
        text = "".join(pick.choice(words) + pick.choice((" ", " ", " ", "\t", ". ", ",", "\n", " ;")) for _ in range(pick.randrange(60)))
        rows.append((pick.choice(("en", "en", "de", None)), text))
    return rows


def table(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("a", "l", "w1", "rank", "n", "word", "id", "size", "block")])


@pytest.mark.parametrize(("least", "inside", "first"), [(10, 50, 2000), (3, 30, 7), (1, 100, 25)])
def test_collocations_of_all_cases(spark, least, inside, first):
    rows = texts(least)
    got = {tuple(r) for r in collocations.collocations(table(spark, rows), least, inside, first).collect()}
    assert got == brute(rows, least, inside, first)


def test_many_small_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr("textloom.llm.wordblocks.BLOCK_CHARS", 300)
    rows = texts(99)
    df = table(spark, rows).repartition(5)
    got = {tuple(r) for r in collocations.collocations(df, 5).collect()}
    assert got == brute(rows, 5, 50, 2000)


def test_nothing_to_find(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [("en", None), ("en", "a b c")])).count() == 0


def test_scores_past_64_bits(spark):
    big = 3_000_000_000
    df = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long")
    assert df.select(collocations.quotient("a", "l", "r")).first()[0] == 1_000_000 * big * big // ((big + 1) * (big + 2))


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 5), (3, 7), (3, 20), (2, 32), (3, 22), (3, 32), (4, 32)])
def test_packing_can_be_inverted(n, bits):
    packing = Packing(n, bits)
    ids = [np.random.default_rng(k).integers(0, 1 << bits, 500, dtype=np.uint64) for k in range(n)]
    high, low = packing.packed(ids)
    again = packing.unpacked(*packing.restored(*packing.permuted(high, low)))
    assert all((a == b).all() for a, b in zip(ids, again, strict=True))
    whole = [sum(int(x) << bits * (n - 1 - k) for k, x in enumerate(row)) for row in zip(*ids, strict=True)]
    assert [(int(h) << packing.low) | int(w) for h, w in zip(high, low, strict=True)] == whole
    if bits < 6:
        every = np.arange(1 << n * bits, dtype=np.uint64)
        moved = packing.permuted(every >> np.uint64(packing.low), every & np.uint64((1 << packing.low) - 1))
        assert len(set(zip(*(x.tolist() for x in moved), strict=True))) == len(every)
    with pytest.raises(ValueError):
        Packing(5, 32)


@pytest.mark.parametrize(("n", "bits", "shard_bits"), [(2, 6, 1), (3, 8, 3), (2, 30, 4), (3, 32, 5)])
def test_filters_count_as_dictionaries_do(n, bits, shard_bits):
    packing, pick = Packing(n, bits), random.Random(bits)
    want, held = Counter(), {}
    for _ in range(4):
        grams = [tuple(pick.randrange(1 << min(bits, pick.choice((2, 3, 30)))) for _ in range(n)) for _ in range(700)]
        grams += [(0,) * n] * 400
        want.update(grams)
        for f in filters(packing, shard_bits, [np.array(c, np.uint64) for c in zip(*grams, strict=True)]):
            again = Filter.unpacked(packing, shard_bits, f.shard, f.packed())
            assert all((getattr(f, c) == getattr(again, c)).all() for c in ("high", "low", "counts"))
            held.setdefault(f.shard, []).append(again)
    for least in (1, 2, 300):
        got = {}
        for fs in held.values():
            ids, counts = Filter.merged(fs).at_least(least)
            got |= dict(zip(zip(*(x.tolist() for x in ids), strict=True), counts.tolist(), strict=True))
        assert got == {g: c for g, c in want.items() if c >= least}
    assert filters(packing, shard_bits, [np.zeros(0, np.uint64)] * n) == []
