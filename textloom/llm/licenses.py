"""License scans: phrase places, and an exact set-similarity join of text blocks with license notices.

A block is a run of a paragraph's words, twice as long as the template that it is held against, so a notice is
found however it is wrapped and with as many other words between as it has itself, while words scattered over a
long text or line are none. Blank lines part paragraphs. A template matches a block if at least `threshold` of the
template's distinct words stand in it, in any order, and its mark, consecutive words that notices of other licenses
don't have, stands in it as it is. A label without a version goes where its license is found with one. Blocks are looked for in windows: three times as long as the
longest template, beginning as many words apart as it has, so every block lies whole in one. The join finds every
matching pair without comparing all pairs:

* template words are ordered by their frequency over the whole corpus, rarest first;
* prefix filter: a window that holds o of a template's n words holds one of its n - o + 1 rarest;
* length filter: a window needs at least o words of the vocabulary;
* positional filter: after the first common word, at i in the template and at j in the window, at most
  min(n - 1 - i, m - 1 - j) more can be common (m: the window's words of the vocabulary);
* what passes is counted in full, block by block.

Only DataFrame operations are used. The templates are a parameter and bounded by what a person lists, so their
words and counts are plain literals; nothing that grows with the corpus reaches the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_BREAK, ascii_lower, text_key
from .notices import TEMPLATES, VERSIONS

#: Phrases of consecutive words and their labels (fixed by the contract).
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: What parts paragraphs: lines without anything but white space.
BLANK_LINE = r"\n[ \t\r]*\n"

#: The least share of a template's distinct words that a block must hold.
THRESHOLD = 0.9


def spaced(text: Column) -> Column:
    """' word word word ', lower-cased; ' ' if there are no words. The text is gone through once."""
    line = F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.regexp_replace(line, ALNUM_BREAK, " ")


def line(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often a phrase stands in spaced words, and the word numbers of its first and last place."""
    mark = f" {phrase} "
    there = F.contains(words, F.lit(mark))
    count = F.when(there, F.regexp_count(words, F.lit(f"(?<= ){re.escape(phrase)}(?= )"))).otherwise(0)
    first = F.when(there, spaces(F.substring(words, F.lit(1), F.instr(words, mark))) - 1)
    until = F.length(words) - F.instr(F.reverse(words), mark[::-1]) - len(mark) + 2
    return count, first, F.when(there, spaces(F.substring(words, F.lit(1), until)) - 1)


def template_words(notice: str) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in notice)
    return list(dict.fromkeys(w for w in re.split(ALNUM_BREAK, lowered) if w))


def word_count(notice: str) -> int:
    return len([w for w in re.split(ALNUM_BREAK, notice.lower()) if w])


def word_counts(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """How often each word of the vocabulary stands in the corpus."""
    found = docs.select(F.explode(F.split(spaced(F.col("text")), " ")).alias("word"))
    rows = found.where(F.col("word").isin(list(vocabulary))).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in rows}


def license_blocks(
    docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """Every (window, template) with a block at or above the threshold: doc_id, text_key, paragraph, place,
    template_no, label, containment (that of the best block).

    templates: label, notice, mark (empty: none). text_key tells rows with one doc_id apart. Repeated rows give
    repeated answers' keys once each; null and empty texts have no blocks, and without templates there are none.
    """
    if not templates:
        none = {"paragraph": "int", "place": "int", "template_no": "int", "label": "string", "containment": "double"}
        keys = docs.select("doc_id", text_key(docs).alias("text_key")).where("false")
        return keys.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])
    words = [template_words(t) for _, t, _ in templates]
    counts = word_counts(docs, sorted({w for ws in words for w in ws}))
    order = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    words = [sorted(ws, key=order.__getitem__) for ws in words]
    needed = [math.ceil(threshold * len(ws) - 1e-9) for ws in words]
    spark = docs.sparkSession
    prefixes = [
        (w, k, i) for k, ws in enumerate(words) for i, w in enumerate(ws[: len(ws) - needed[k] + 1])
    ]
    rare = sorted({w for w, _, _ in prefixes})
    index = spark.createDataFrame(prefixes, "word string, template_no int, i int")
    full = spark.createDataFrame(
        [(k, label, ws, needed[k], 2 * word_count(t), f" {mark} " if mark else "") for k, ((label, t, mark), ws) in enumerate(zip(templates, words, strict=True))],
        "template_no int, label string, template array<string>, needed int, block int, mark string",
    )
    ranks = F.create_map(*[F.lit(x) for w, k in order.items() for x in (w, k)])
    vocabulary = F.array(*[F.lit(w) for w in order])
    has_rare = F.arrays_overlap("words", F.array(*[F.lit(w) for w in rare]))
    paragraphs = docs.select("doc_id", text_key(docs).alias("text_key"), F.posexplode(F.split(docs["text"], BLANK_LINE)))
    paragraphs = paragraphs.select(
        "doc_id", "text_key", F.col("pos").alias("paragraph"), F.split(F.trim(spaced(F.col("col"))), " ").alias("words")
    ).where(has_rare)
    step = max(word_count(notice) for _, notice, _ in templates)
    begins = F.sequence(F.lit(1), F.size("words"), F.lit(step))
    windows = F.transform(begins, lambda k: F.slice("words", k, 3 * step))
    blocks = paragraphs.select("doc_id", "text_key", "paragraph", F.posexplode(windows).alias("place", "words")).where(has_rare)
    # The window's words of the vocabulary, rarest first; words of no template can never be common.
    known = F.array_sort(
        F.transform(F.array_intersect(vocabulary, "words"), lambda w: F.struct(ranks[w].alias("rank"), w.alias("word")))
    )
    keys = ["doc_id", "text_key", "paragraph", "place"]
    blocks = blocks.select(*keys, "words", known.alias("known"))
    found = blocks.select("*", F.posexplode("known").alias("j", "at")).withColumn("word", F.col("at.word"))
    pairs = (
        found.join(F.broadcast(index), "word")
        .groupBy(*keys, "template_no")
        .agg(F.min(F.struct("i", "j")).alias("first"), F.first("known").alias("known"), F.first("words").alias("words"))
        .join(F.broadcast(full), "template_no")
        .where(F.size("known") >= F.col("needed"))
        .where(
            1
            + F.least(F.size("template") - 1 - F.col("first.i"), F.size("known") - 1 - F.col("first.j"))
            >= F.col("needed")
        )
        .where(F.size(F.array_intersect("template", F.transform("known", lambda s: s["word"]))) >= F.col("needed"))
        .where(F.contains(line(F.col("words")), F.col("mark")))
    )
    # Blocks that begin with a word of the template: others hold no more than the next one of these.
    starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda k: F.array_contains("template", F.get("words", k - 1)))
    block = lambda k: F.slice("words", k, F.col("block"))
    held = lambda k: F.size(F.array_intersect("template", block(k)))
    common = F.transform(starts, lambda k: F.when(F.contains(line(block(k)), F.col("mark")), held(k)).otherwise(0))
    counted = pairs.withColumn("common", F.array_max(common)).where("common >= needed")
    return counted.select(*keys, "template_no", "label", (F.col("common") / F.size("template")).alias("containment"))


def license_scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    versions: Mapping[str, Sequence[str]] = VERSIONS,
) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    versions: labels that go where one of the labels listed with them is found. score is 1 for a phrase, else the best containment, else 0. Null and empty texts have no words, no places
    (null first_word and last_word) and empty labels. Rows with one doc_id are told apart by their texts; a
    null doc_id is a document like any other; other columns are ignored.
    """
    marks = (
        license_blocks(docs, templates, threshold)
        .groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    )
    base = docs.select("doc_id", text_key(docs).alias("text_key"), spaced(docs["text"]).alias("words"))
    places = {p: phrase_places(F.col("words"), p) for p, _ in phrases}
    by_label: dict[str, list[Column]] = {}
    for phrase, label in phrases:
        by_label.setdefault(label, []).append(places[phrase][0] > 0)
    hits = []
    for label in sorted(by_label):
        any_of = by_label[label][0]
        for other in by_label[label][1:]:
            any_of = any_of | other
        hits.append(F.when(any_of, label))
    total = places[phrases[0][0]][0]
    for phrase, _ in phrases[1:]:
        total = total + places[phrase][0]
    pick = lambda f, k: f(*[places[p][k] for p, _ in phrases]) if len(phrases) > 1 else places[phrases[0][0]][k]
    base = base.select(
        "doc_id",
        "text_key",
        (spaces(F.col("words")) - 1).cast("long").alias("n_words"),
        total.cast("long").alias("n_base"),
        pick(F.least, 1).cast("long").alias("first_word"),
        pick(F.greatest, 2).cast("long").alias("last_word"),
        F.array_compact(F.array(*hits)).alias("base"),
    )
    joined = base.join(
        marks, base["doc_id"].eqNullSafe(marks["id"]) & base["text_key"].eqNullSafe(marks["key"]), "left"
    )
    found = F.coalesce("found", F.array().cast("array<string>"))
    for general, specific in versions.items():
        found = F.when(F.arrays_overlap(found, F.array(*map(F.lit, specific))), F.array_remove(found, general)).otherwise(found)
    labels = F.array_sort(F.array_union("base", found))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
