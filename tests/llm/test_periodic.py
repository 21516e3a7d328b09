import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from textloom.llm import periodic
from textloom.llm.queries import op13_periodic_runs
from textloom.llm.queries import table as read

from ..conftest import DATA
from . import data


def brute(words, least, times):
    """All runs: the maximal stretches that each lag keeps, smallest lag first, so that multiples add nothing."""
    found = {}
    for q in range(1, len(words) // times + 1):
        k = 0
        while k + q < len(words):
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            length = k + q - start
            if length >= max(least, times * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def by_start(found):
    return sorted(found, key=lambda r: (r[0], r[2]))


def of_batch(texts, least, times):
    numbers, begins = periodic.numbered([[str(w).encode() for w in t] for t in texts])
    start, length, period = periodic.runs(numbers, max(map(len, texts), default=0), least, times)
    out = [[] for _ in texts]
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        k = int(np.searchsorted(begins, s, side="right")) - 1
        out[k].append((s - int(begins[k]), n, q))
    return out


def odd_texts(seed):
    pick = random.Random(seed)
    texts = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 200, list("abcabcab") * 9, list("abcdefgh") * 3, list("abcdefghi") * 3, list("abcdefghi") * 3 + list("abcdefgh")]
    thue = "a"
    while len(thue) < 600:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts += [list(thue), list(thue[:150]) * 4]
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    texts.append(list(fib[-1]))
    for _ in range(40):
        text = []
        while len(text) < pick.randrange(1, 500):
            part = [pick.choice("ab" if pick.random() < 0.5 else "abcdefghijk") for _ in range(pick.randrange(1, 60))]
            text += part * pick.choice((1, 1, 2, 3, 4, 7))
        texts.append(text)
    block = ["x"] * 30
    texts.append((block + ["y"] + block + ["z"]) * 5)  # a period that holds runs of its own
    return texts


@pytest.mark.parametrize(("least", "times"), [(24, 3), (2, 3), (10, 4), (100, 3)])
def test_runs_are_those_of_brute_force(least, times):
    for seed in range(3):
        texts = odd_texts(seed)
        for got, text in zip(of_batch(texts, least, times), texts, strict=True):
            assert got == by_start(brute(text, least, times))


def test_runs_do_not_cross_documents():
    assert of_batch([["a"] * 20, ["a"] * 20], 24, 3) == [[], []]


def test_a_long_text_of_one_word_has_few_seeds():
    words = np.zeros(300_000, np.int64)
    assert [x.tolist() for x in periodic.runs(words, len(words))] == [[0], [300_000], [1]]
    with pytest.raises(ValueError):
        periodic.runs(words, len(words), times=2)


def expected(text, runs):
    words = data.words(text)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return len(words), best, hashlib.sha256(lines.encode()).hexdigest(), " ".join(w for k, w in enumerate(words) if k not in gone)


def test_operator_of_all_cases(spark):
    rows = [*data.ROWS, (30, "one two three " * 9 + "end"), (31, "é\t" * 30), (32, "A a " * 20), (33, "a " * 24 + "b " * 30 + "a " * 48)]
    got = periodic.periodic_runs(data.table(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    want = []
    for d, t in rows:
        found = by_start(brute(data.words(t), 24, 3)) if t not in (data.LONG, data.LONG + " end") else []
        n, best, digest, kept = expected(t, found)
        want.append((d, n, len(found), found, best, digest, kept))
    found = [
        (r["doc_id"], r["n_words"], r["n_runs"], [tuple(x) for x in r["runs"]], r["best"] and tuple(r["best"]), r["runs_sha256"], r["collapsed_text"])
        for r in got
    ]
    assert sorted(found, key=key) == sorted(want, key=key)
    assert periodic.periodic_runs(data.table(spark, [])).count() == 0


def planted(doc_id, text):
    """The contract's change of a text, word by word."""
    words, h = data.words(text), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p if i >= a else i] for i in range(n)]


def test_query_against_brute_force(spark):
    rows = read(spark, DATA, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op13_periodic_runs(spark, DATA).collect()}
    assert len(got) == len(rows)
    some = 0
    for d, t in rows:
        words = planted(d, t)
        if len(words) > 6000:
            continue
        found = by_start(brute(words, 24, 3))
        some += bool(found)
        n, best, digest, kept = expected(" ".join(words), found)
        r = got[d]
        assert (r["n_runs"], r["runs_sha256"]) == (len(found), digest)
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
    assert some > 10
