"""Small tables with every odd case, and brute-force versions of the operators' rules."""

import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
BASE = " ".join(f"word{k}" for k in range(60))

#: doc_id, text: nulls, empty and very long texts, ties, repeated rows, case, accents.
ROWS = [
    (1, BASE),
    (2, BASE.upper()),
    (3, BASE.replace("word7 ", "other ")),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, LONG),
    (8, LONG + " end"),
    (9, "É aÇão É aÇão"),
    (10, "é aÇão É aÇão"),
    (11, "one"),
    (12, "one"),
    (12, "one"),
    (13, "!!! ??? ..."),
    (None, "lonely text without an id"),
    (None, None),
    (14, "x " + BASE + " y"),
    (15, "under the MIT license, and CC-BY-NC; under the mit license"),
    (16, "Licensed under the GNU General Public License, version 3.\nmore"),
    (17, "aaaa" * 2000),
]


def table(spark, rows=ROWS, lang="en"):
    """documents with columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, lang if t else None) for i, t in rows], "doc_id long, text string, lang string")
    names = ("source", "n_chars", "rep", "band", "block", "bucket", "key", "id", "words", "keep_id", "count", "label", "text_key", "ids", "row")
    return df.select("*", *[F.lit("clash").alias(n) for n in names])


def words(text, lower=False):
    text = (text or "").translate(LOWER) if lower else (text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingle_set(text, size):
    w = words(text, lower=True)
    if not w:
        return set()
    return {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))}


def components(rows, size, percent=80):
    """doc_id to the smallest doc_id that it is linked with."""
    rows = [(d, shingle_set(t, size)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(rows):
        for b, t in rows[:k]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in rows}
