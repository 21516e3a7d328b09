"""Periodic run detection by seeds that are extended along diagonals.

A run is a maximal stretch of words with smallest period q that is at least `least` words and `times` periods long
(times >= 3). On the diagonal of lag q it overlaps itself in at least (times - 1) * q words. Lags are taken by
classes (k, 2k] with k a power of two, and 1 to k for the first; the overlap that a class guarantees holds a whole
k-gram that starts at a multiple of k. So the occurrences to pair are, for each place j, the one k-gram at a
multiple of k whose lag to j is in the class: a document of n words has at most n seeds a class, however often its
k-grams recur.

k-grams are indexed by names, found by doubling: the name of a 2k-gram is the number of its pair of k-grams' names.
Names are told apart by the words themselves, no hash decides, and a k-gram that stands once in its document has no
name, so longer ones are only looked at where something recurs. Seeds of a lag are extended in ascending order; one
that starts where the one before it ends is covered by the same extension and dropped. A seed inside a run
of a smaller period, whose lag can only be a multiple of that period, is dropped too. Extensions go left and right
by descending powers of two, all seeds of a class at once.

Texts are worked on in groups of about GROUP_WORDS words inside Arrow tasks; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small
from .wordblocks import split_words

#: Least words and least periods of a run.
LEAST, TIMES = 24, 3
#: Words of the texts that are worked on together; bounds memory, but for single texts that are longer.
GROUP_WORDS = 400_000

RUNS = "doc_id long, n_words long, n_runs long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, runs_sha256 string, collapsed_text string"


def named(pairs: np.ndarray) -> np.ndarray:
    """A number for each value that stands more than once, -1 for the others."""
    order = np.argsort(pairs, kind="stable")
    ordered = pairs[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1])
    alone = fresh & np.append(fresh[1:], True)
    out = np.empty(len(pairs), np.int64)
    out[order] = np.where(alone, -1, np.cumsum(fresh & ~alone) - 1)
    return out


def index(words: np.ndarray) -> list[np.ndarray]:
    """For k = 1, 2, 4 ... the name of the k-gram at each place, -1 where it stands once; until none recurs.

    words: numbers, equal only for equal words of one document; -1 parts documents.
    """
    counts = np.bincount(words[words >= 0], minlength=1) if len(words) else np.zeros(1, np.int64)
    levels = [np.where((words >= 0) & (counts[words] > 1), words, -1)]
    while (levels[-1] >= 0).any():
        last, k = levels[-1], 1 << (len(levels) - 1)
        at = np.flatnonzero(last[: max(len(last) - k, 0)] >= 0)
        at = at[last[at + k] >= 0]
        new = np.full(len(words), -1, np.int64)
        new[at] = named(last[at] * (int(last.max()) + 1) + last[at + k])
        levels.append(new)
    return levels


def seeds(names: np.ndarray, k: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Place and lag of the pairs of equal k-grams whose lag is in (k, 2k] (first: in [1, k]), one at a multiple of k.

    Ascending by lag, then by place.
    """
    j = np.flatnonzero(names >= 0)
    i = (-(-j // k) - (1 if first else 2)) * k
    there = i >= 0
    i, j = i[there], j[there]
    same = names[i] == names[j]
    i, lag = i[same], j[same] - i[same]
    order = np.lexsort((i, lag))
    return i[order], lag[order]


def extended(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words before i and j, and how many from there on, are alike."""
    n = len(levels[0])
    ahead, behind = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        names, k = levels[level], 1 << level
        a, b = i + ahead, j + ahead
        inside = np.flatnonzero(b < n)
        alike = inside[(names[a[inside]] == names[b[inside]]) & (names[b[inside]] >= 0)]
        ahead[alike] += k
        a, b = i - behind - k, j - behind - k
        inside = np.flatnonzero(a >= 0)
        alike = inside[(names[a[inside]] == names[b[inside]]) & (names[b[inside]] >= 0)]
        behind[alike] += k
    return behind, ahead


def runs(words: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, ascending by start, then period.

    words: as for `index`; longest: words of the longest document. Words that are -1 are in no run.
    """
    if times < 3 or least < 2:
        raise ValueError("runs of at least 2 words and 3 periods")
    levels = index(words)
    k = 1 << (max((least + 1) // 3, 1).bit_length() - 1)
    found = [np.zeros((3, 0), np.int64)]
    covered = np.zeros(len(words) + 1, np.int64)  # the furthest end of known runs that start here or before
    first = True
    while (1 if first else k + 1) * times <= longest and k.bit_length() <= len(levels):
        i, lag = seeds(levels[k.bit_length() - 1], k, first)
        # Inside a run of a smaller period, which is at most k.
        fresh = covered[i] < i + lag + k
        i, lag = i[fresh], lag[fresh]
        # The seed before on the same lag has been extended over this one.
        chained = np.append(False, (lag[1:] == lag[:-1]) & (i[1:] == i[:-1] + k))[: len(i)]
        i, lag = i[~chained], lag[~chained]
        behind, ahead = extended(levels, i, i + lag)
        start, length = i - behind, behind + ahead + lag
        enough = length >= np.maximum(least, times * lag)
        part = np.unique(np.stack([start, length, lag])[:, enough], axis=1)
        found.append(part)
        np.maximum.at(covered, part[0], part[0] + part[1])
        np.maximum.accumulate(covered, out=covered)
        first, k = False, k if first else 2 * k
    start, length, period = np.concatenate(found, axis=1)
    # A stretch has one smallest period; its multiples cover just the same words.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    smallest = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[smallest], length[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def described(text_words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """n_words, n_runs, runs, best, runs_sha256, collapsed_text of one text."""
    n = len(text_words)
    if not found:
        return n, 0, [], None, hashlib.sha256(b"").hexdigest(), b" ".join(text_words).decode()
    rows = [dict(zip(("start", "length", "period"), r, strict=True)) for r in found]
    best = max(rows, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]))
    edges = np.zeros(n + 1, np.int64)
    for s, length, q in found:
        edges[s + q] += 1
        edges[s + length] -= 1
    keep = np.cumsum(edges)[:-1] == 0
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for w, k in zip(text_words, keep.tolist(), strict=True) if k)
    return n, len(rows), rows, best, hashlib.sha256(lines.encode()).hexdigest(), kept.decode()


def grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The rows' words, in groups of about so many words."""
    held, n = [], 0
    for batch in small(batches):
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            held.append((doc_id.as_py(), split_words(text.as_py())))
            n += len(held[-1][1])
            if n >= most:
                yield held
                held, n = [], 0
    if held:
        yield held


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words as numbers, each text with numbers of its own and -1 after it; where each text begins."""
    numbers, base = [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        numbers.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + base)
        numbers.append(np.array([-1]))
        base += len(seen)
    lengths = np.fromiter((len(w) + 1 for w in texts), np.int64, len(texts))
    return np.concatenate(numbers) if numbers else np.empty(0, np.int64), np.cumsum(lengths) - lengths


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_runs, runs, best, runs_sha256, collapsed_text.

    runs: start (word number), length and period in words, by start, then period; best: the run of the greatest
    length / period, of ties that with the smallest start, then period; null without runs. runs_sha256: of the
    lines `start,length,period`. collapsed_text: the words, joined by one space, but for those that a run holds after
    its first period. Null and empty texts have no words and no runs. Rows that repeat a document are
    worked on each for itself; a null doc_id is a document like any other; other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, GROUP_WORDS):
            texts = [words for _, words in group]
            numbers, begins = numbered(texts)
            start, length, period = runs(numbers, max(map(len, texts)), least, times)
            cuts = np.searchsorted(start, np.append(begins, len(numbers)))
            out = []
            for k, (doc_id, words) in enumerate(group):
                at = slice(cuts[k], cuts[k + 1])
                found = list(zip((start[at] - begins[k]).tolist(), length[at].tolist(), period[at].tolist(), strict=True))
                out.append((doc_id, *described(words, found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    run = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_runs", pa.int64()),
            ("runs", pa.list_(run)),
            ("best", run),
            ("runs_sha256", pa.string()),
            ("collapsed_text", pa.string()),
        ]
    )
    return docs.select("doc_id", "text").mapInArrow(rows, RUNS)


def looped(docs: DataFrame, replaced: Callable[[Column], Column]) -> DataFrame:
    """doc_id and text, some texts' ends being made to repeat; for tests and queries that need periods to find.

    replaced takes doc_id's hash h and says where this happens. With n words and g = h // 10, every word i >= a
    becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8). A null doc_id has no hash.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    docs = docs.select("doc_id", "text", h.alias("h")).withColumn("hit", F.coalesce(replaced(F.col("h")), F.lit(False)))
    docs = docs.withColumn("words", F.when(F.col("hit"), words))
    docs = docs.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", place(i).cast("int")))
    return docs.select("doc_id", F.when(F.col("hit") & (n > 0), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
