import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from textloom.llm import exact, minhash, substring
from textloom.llm.components import components

from . import data
from .data import ROWS, table


def test_exact_groups_of_all_cases(spark):
    norm = lambda t: (t or "").translate(data.LOWER)
    n = Counter(norm(t) for _, t in ROWS)
    best = {}
    for d, t in ROWS:
        if d is not None:
            best[norm(t)] = max(best.get(norm(t), d), d)
    want = Counter((d, best.get(norm(t)), n[norm(t)], d == best.get(norm(t)), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in ROWS)
    assert Counter(tuple(r) for r in exact.exact_groups(table(spark)).collect()) == want
    assert Counter(tuple(r) for r in exact.exact_groups(table(spark), slots=2).collect()) == want
    assert exact.exact_groups(table(spark, [])).count() == 0


def test_exact_dedup_keeps_columns(spark):
    kept = exact.exact_dedup(table(spark))
    assert kept.columns == table(spark).columns
    assert {r["doc_id"] for r in kept.collect()} >= {2, 3, 12, None}


def test_heavy_digests_are_found(spark):
    rows = [(k, "hot" if k % 3 else f"t{k}") for k in range(300)]
    keyed = table(spark, rows).selectExpr("doc_id", "sha2(text, 256) AS text_sha256")
    assert hashlib.sha256(b"hot").hexdigest() in {r[0] for r in exact.heavy_digests(keyed, 5).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_groups_of_all_cases(spark, size):
    got = minhash.near_groups(table(spark), size).collect()
    want = data.components(ROWS, size)
    assert len(got) == len(ROWS)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    sets = {d: len(data.shingle_set(t, size)) for d, t in ROWS if d is not None}
    assert all(r["n_shingles"] == sets[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert minhash.near_groups(table(spark, []), size).count() == 0


def test_near_groups_of_many_variants(spark):
    """A large group of variants that are not all linked with each other, and unrelated texts."""
    pick = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for d in range(150):
        words = list(base)
        for _ in range(pick.randrange(0, 22)):
            words[pick.randrange(len(words))] = f"n{pick.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    rows += [(200 + k, " ".join(f"z{pick.randrange(50)}" for _ in range(30))) for k in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(table(spark, rows), 2).collect()}
    assert got == data.components(rows, 2)


def test_blocks_of_a_bucket_agree(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "HUB", 5)
    test_near_groups_of_many_variants(spark)


def test_signature_estimates_similarity():
    random_sets = np.random.default_rng(3)
    both, a, b = (random_sets.integers(0, 2**64, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = np.unique(np.append(both, a)), np.unique(np.append(both, b))
    same = (minhash.signature(x, minhash._SKETCHED) == minhash.signature(y, minhash._SKETCHED)).mean()
    assert abs(same - 0.8) < 0.05


def test_near_dedup_keeps_one(spark):
    kept = {r["doc_id"] for r in minhash.near_dedup(table(spark)).collect()}
    want = data.components(ROWS, 5)
    assert kept == {d for d in want if want[d] == d} | {None}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {99: 99, 100: 99}
    assert components(links.where("a < 0")).count() == 0


def removed_words(rows, size):
    starts = Counter()
    for _, t in rows:
        w = data.words(t)
        starts.update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = []
    for d, t in rows:
        w = data.words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if starts[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("size", [35, 3])
def test_repeated_windows_of_all_cases(spark, size):
    rows = [*ROWS, (20, "a b c a b c a b c d"), (21, "q q q q q q")]
    got = substring.without_repeats(table(spark, rows), size).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=key) == sorted(removed_words(rows, size), key=key)
    for r in got:
        assert sum(i["end"] - i["start"] for i in r["intervals"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["intervals"], r["intervals"][1:], strict=False))
    assert substring.without_repeats(table(spark, []), size).count() == 0


def test_rolling_hashes_equal_for_equal_windows():
    words = np.random.default_rng(1).integers(0, 2**64, 50, dtype=np.uint64)
    line = np.concatenate([words, words])
    starts, main, second = substring.window_hashes(line, np.array([50, 50]), 35)
    assert starts.tolist() == [*range(16), *range(50, 66)]
    assert (main[:16] == main[16:]).all() and (second[:16] == second[16:]).all() and len(set(main.tolist())) == 16
