import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import decontam, langid, licenses, lm, warc

from . import data
from .data import BASE, ROWS, table

ITEMS = [(1, BASE), (2, "one"), (3, None), (4, ""), (5, "zzz never there at all"), (6, "LONELY text"), (None, "one"), (7, BASE.upper())]


def contaminated(rows, items, size=13):
    windows = {}
    for i, t in items:
        w = data.alnum(t)
        for k in range(max(len(w) - size + 1, 1) if w else 0):
            if i is not None:
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = data.alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("size", [13, 2])
def test_contamination_of_all_cases(spark, size):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("terms", F.lit("clash"))
    got = decontam.contamination(table(spark), items, size)
    assert Counter(tuple(r)[:6] for r in got.collect()) == Counter(contaminated(ROWS, ITEMS, size))
    assert not any(r["contaminated"] for r in decontam.contamination(table(spark), items.where("item_id < 0"), size).collect())
    assert decontam.contamination(table(spark, []), items, size).count() == 0


def test_shuffled_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "sized", lambda df, rows=0: df)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contamination(table(spark), items)
    assert Counter(tuple(r)[:6] for r in got.collect()) == Counter(contaminated(ROWS, ITEMS))


def near_windows(rows, items, size, slop):
    """Per row, how many distinct windows have all their terms at most slop words off their places."""
    windows = {tuple(w[k : k + size]) for i, t in items if i is not None and (w := data.alnum(t)) for k in range(max(len(w) - size + 1, 1))}
    out = []
    for d, t in rows:
        w = data.alnum(t)
        there = lambda s, win: all(x in w[max(s + k - slop, 0) : max(s + k + slop + 1, 0)] for k, x in enumerate(win))  # noqa: B023, E731
        out.append((d, sum(any(there(s, win) for s in range(-slop, len(w) + slop)) for win in windows)))
    return out


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_checks_every_term(spark, slop):
    pick = random.Random(8)
    rows = [(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "alpha beta zzz yyy"), (4, "beta alpha delta gamma"), (5, None), (6, "x alpha x x beta gamma x delta"), (7, "delta")]
    rows += [(100 + k, " ".join(pick.choices(["alpha", "beta", "gamma", "delta", "x"], k=12))) for k in range(60)]
    items = [(1, "alpha beta gamma delta"), (2, "gamma gamma x"), (3, "delta")]
    got = decontam.contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 4, slop)
    assert sorted((r["doc_id"], r["n_near"]) for r in got.collect()) == near_windows(rows, items, 4, slop)


def test_filters_judge_each_row_by_its_own_text(spark):
    """Repeated ids over other texts, null ids, and columns named like those that the filters use inside."""
    from textloom.llm import exact, minhash

    rows = [(1, "same text"), (1, "unique other text of id one"), (2, "Same text"), (2, BASE), (3, BASE + " tail"), (None, "12345"), (None, "good words here"), (None, "same text"), (1, "12345")]
    docs = table(spark, rows)
    for name in ("dropped_id", "rejected_id", "bad_id", "gone_id", "gone_key", "text_key"):
        docs = docs.withColumn(name, F.lit("clash"))
    left = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns and left(kept) == Counter(r for r in rows if r not in [(1, "same text"), (None, "same text"), (None, "12345")])
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns and left(kept) == Counter(r for r in rows if r not in [(2, "Same text"), (3, BASE + " tail")])
    items = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    kept = decontam.decontaminated(docs, items)
    assert kept.columns == docs.columns and left(kept) == Counter(r for r in rows if r[1][:5] != "word0")
    model = langid.train(table(spark, [(k, f"good words here {k}") for k in range(20)]), F.lit(True))
    kept = langid.not_rejected(docs, model)
    assert kept.columns == docs.columns and left(kept)[None, "12345"] == 0 and left(kept)[None, "good words here"] == 1


def license_model(rows):
    templates = [(label, set(licenses.template_words(t)), 2 * len(data.alnum(t)), f" {mark} ") for label, t, mark in licenses.TEMPLATES]
    out = []
    for d, t in rows:
        w = data.alnum(t)
        base, at = set(), []
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            places = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += places
            base |= {label} if places else set()
        found, best = set(), 0.0
        for paragraph in re.split(licenses.BLANK_LINE, t or ""):
            have = data.alnum(paragraph)
            for label, words, block, mark in templates:
                if not words <= set(have) and len(words & set(have)) < math.ceil(licenses.THRESHOLD * len(words) - 1e-9):
                    continue
                most = max(len(set(have[k : k + block]) & words) if mark in f" {' '.join(have[k : k + block])} " else 0 for k in range(len(have)))
                if most >= math.ceil(licenses.THRESHOLD * len(words) - 1e-9):
                    found.add(label)
                    best = max(best, most / len(words))
        found = base | {x for x in found if not found & set(licenses.VERSIONS.get(x, ()))}
        out.append((d, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(found)), 1.0 if base else best))
    return out


def test_licenses_of_all_cases(spark):
    rows = [*ROWS, (30, "cc by nc cc by nc"), (31, "Apache License, Version 2.0 applies"), (32, "released license under mit the"), (33, "\n\nThis program is free software: you can redistribute it under the GNU General Public License\n")]
    got = licenses.license_scan(table(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == Counter(license_model(rows))
    assert licenses.license_scan(table(spark, [])).count() == 0


def test_wrapped_notices_are_found(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by"
    before = "some words of\nanother kind " * 40
    rows = [(1, mit), (2, bsd), (3, gpl), (4, before + mit), (5, before + gpl.replace(" ", "\n") + before), (6, bsd.replace("without\n", "without\n\n"))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_scan(table(spark, rows)).collect()}
    assert [got[k][0] for k in range(1, 7)] == ["mit", "bsd", "gpl", "mit", "gpl", ""]
    assert all(got[k][1] >= 0.9 for k in range(1, 6))
    assert Counter((r["doc_id"], r["labels"], round(r["score"], 9)) for r in licenses.license_scan(table(spark, rows)).collect()) == Counter(
        (r[0], r[6], round(r[7], 9)) for r in license_model(rows)
    )


def test_labels_of_licenses_that_are_alike(spark):
    cc = "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."
    boost = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display"
    rows = [
        (1, cc),
        (2, "Licensed under the GNU Lesser General Public License, version 3"),
        (3, "Licensed under the GNU Affero General Public License, version 3"),
        (4, boost),
        (5, "Released under the BSD license, MIT and the GPL are others"),
        (6, cc.replace("-NonCommercial-ShareAlike", "") + "\n\n" + cc.replace("NonCommercial-", "")),
        (7, "Licensed under the GNU General Public License, version 2. This program is free software: you can redistribute it under the GNU General Public License"),
        (8, "Licensed under CC BY-NC-SA 4.0."),
        (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(table(spark, rows)).collect()}
    assert got == {1: "cc-by-nc-sa", 2: "lgpl-3", 3: "agpl-3", 4: "bsl-1", 5: "", 6: "cc-by,cc-by-sa", 7: "gpl-2", 8: "cc-by-nc,cc-by-nc-sa", 9: "mit"}  # 8: "cc by nc" is a phrase of the contract
    assert got == {r[0]: r[6] for r in license_model(rows)}
    assert all(r["labels"] == r["base_labels"] for r in licenses.license_scan(table(spark, rows), templates=()).collect())


def test_every_notice_has_its_own_label(spark):
    rows = [(k, f"Before it. {notice}.\n\nAfter it.") for k, (_, notice, _) in enumerate(licenses.TEMPLATES)]
    phrases = (("no such phrase", "none"),)
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.license_scan(table(spark, rows), phrases).collect()}
    for k, (label, notice, mark) in enumerate(licenses.TEMPLATES):
        assert label in got[k] or set(got[k]) & set(licenses.VERSIONS.get(label, ())), notice
        assert len(got[k]) == 1 and f" {mark} " in f" {' '.join(data.alnum(notice))} "


def test_scattered_words_are_no_notice(spark):
    pick = random.Random(2)
    filler = lambda n: " ".join(pick.choices(["river", "stone", "of", "and", "tree"], k=n))
    words = ["released", "under", "the", "MIT", "license"]
    rows = [
        (1, " ".join(f"{filler(120)} {w}" for w in words)),
        (2, f"{filler(300)} released it under the old MIT license {filler(300)}"),
        (3, " ".join(f"{filler(5)} {w}" for w in words)),
        (4, "\n".join(f"{filler(120)} {w}" for w in words)),
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(table(spark, rows)).collect()}
    assert got == {1: "", 2: "mit", 3: "", 4: ""}
    assert got == {r[0]: r[6] for r in license_model(rows)}

def lm_model(rows, least=lm.LEAST_STATE, priors=(lm.PRIOR, lm.TRIGRAM_PRIOR)):
    """The scores by plain interpolation, without an automaton."""
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [(d, [*data.words(t, lower=True), None]) for d, t in rows]
    c, pairs, triples, texts = Counter(), Counter(), Counter(), 0
    for d, w in tokens:
        if not held(d):
            c.update(w)
            line = ["<s>", *w]
            pairs.update(zip(line, w))
            triples.update(zip(line, line[1:], w[1:]))
            texts += 1
    total, distinct = sum(c.values()), len(c)
    p = lambda w: (c[w] + 1) / (total + distinct + 1)
    want = []
    for d, w in tokens:
        score, line = 0.0, ["<s>", *w]
        for k, word in enumerate(w):
            h = line[k]
            prob = (pairs[h, word] + priors[0] * p(word)) / ((texts if h == "<s>" else c[h]) + priors[0])
            if k and pairs[line[k - 1], h] >= least:
                prob = (triples[line[k - 1], h, word] + priors[1] * prob) / (pairs[line[k - 1], h] + priors[1])
            score += math.log10(prob)
        want.append((d, held(d), len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10(p(x)) for x in w), 5), round(score, 5)))
    return want


def test_lm_of_all_cases(spark, monkeypatch):
    from textloom.llm import wordblocks

    scores = lambda df: Counter((*tuple(r)[:5], round(r["base_score"], 5), round(r["score"], 5)) for r in df.collect())
    pick = random.Random(9)
    rows = [*ROWS, *((100 + k, " ".join(pick.choices(["a", "b", "c", "d e", "f g h"], k=40))) for k in range(60))]
    held = lm.remainder("doc_id", 7) == 2
    assert scores(lm.scored(table(spark, rows), held)) == Counter(lm_model(rows))
    monkeypatch.setattr(wordblocks, "BLOCK_CHARS", 500)  # many blocks
    assert scores(lm.scored(table(spark, rows).repartition(5), held)) == Counter(lm_model(rows))
    assert scores(lm.scored(table(spark, rows), held, least=4)) == Counter(lm_model(rows, 4))
    assert lm.scored(table(spark, []), held).count() == 0
    nothing = lm.scored(table(spark, ROWS[:3]), F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in nothing)


def test_packed_keys():
    import numpy as np

    pick = np.random.default_rng(3)
    for keys in (pick.integers(1, 2**64, 50, dtype=np.uint64), np.array([], np.uint64), np.array([1 << 48, (1 << 48) + 1, 3 << 48, 2**64 - 1], np.uint64), np.arange(1, 9, dtype=np.uint64)):
        keys = np.unique(keys)
        assert lm.unpack_keys(lm.pack_keys(keys)).tolist() == keys.tolist()


def test_lm_continuations_sum_to_one():
    import numpy as np

    block = lm.Block.of_texts(["a b a c a b a", "b a a b a"])
    learn = np.array([True, True])
    block.find_trigrams(np.ones(len(block.word), bool))
    counts = [block.counts(learn, *x) for x in ((block.word, len(block.words)), (block.bigram, len(block.bigrams)), (block.trigram, len(block.trigrams)))]
    words = counts[0]
    automaton = lm.BackoffAutomaton(block, *counts, int(words.sum()), len(words), (2.0, 3.0))
    unknown = math.log10(1 / (words.sum() + len(words) + 1))

    def weight(state, word):
        total = 0.0
        while state:
            if word is not None and (arc := automaton.arcs.get(state * automaton.size + word)):
                return total + arc[0]
            total += automaton.fail_weight[state]
            state = automaton.fail_state[state]
        return total + (unknown if word is None else automaton.root_weight[word])

    end = int(np.searchsorted(block.words, lm.END))
    states = {1} | {arc[1] for arc in automaton.arcs.values()}
    assert max(states) > len(words) + 1  # bigrams among them
    for state in states:
        if state == end + 2 or (state > len(words) + 1 and block.word[block.first[state - 2 - len(words)]] == end):
            continue
        assert sum(10 ** weight(state, w) for w in [*range(len(words)), None]) == pytest.approx(1)


def test_language_of_all_cases(spark):
    rows = [(k, " ".join(("the house and the garden", "das haus und der garten")[k % 2].split() * 3) + f" {k}") for k in range(60)]
    labelled = table(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))
    model = langid.train(labelled, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r for r in langid.predicted(table(spark, [*rows, (100, None), (101, "12 !"), (102, ""), (None, "the garden")]), model).collect()}
    assert all(got[k]["lang_pred"] == ("en", "de")[k % 2] and 0 <= got[k]["score"] <= 1 for k, _ in rows)
    assert all(got[k]["lang_pred"] == "und" and got[k]["rejected"] for k in (100, 101, 102))
    assert got[None]["lang_pred"] == "en"
    kept = {r["doc_id"] for r in langid.not_rejected(table(spark, [*rows, (100, None)]), model).collect()}
    assert 100 not in kept and set(range(60)) <= kept
    assert langid.train(table(spark, []), F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.predicted(table(spark), None).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, lm.remainder("doc_id", 5) != 0)
    held = docs.where(lm.remainder("doc_id", 5) == 0).select("doc_id", "lang")
    right = langid.predicted(docs, model).join(held, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert right[0] > 0.97 and right[1] < 0.02



def test_unlearned_languages_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    model = langid.train(docs, (F.col("lang") != "fr") & (lm.remainder("doc_id", 5) != 0))
    short = F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("text")
    pick = random.Random(4)
    noise = [(k, " ".join("".join(pick.choices(string.ascii_lowercase, k=pick.randint(2, 9))) for _ in range(30))) for k in range(100)]
    share = lambda df: langid.predicted(df, model).agg(F.avg(F.col("rejected").cast("int"))).first()[0]
    known = docs.where(F.col("lang") != "fr").where(lm.remainder("doc_id", 5) == 0)
    assert share(known) < 0.02 and share(known.select("doc_id", short)) < 0.03
    assert share(docs.where("lang = 'fr' AND length(text) > 200")) > 0.8
    assert share(spark.createDataFrame(noise, "doc_id long, text string")) > 0.95


def test_language_sample_of_copies_and_long_texts(spark):
    hot = [(k, "one text with many copies", "en") for k in range(400)]
    own = [(1000 + k, f"text number {k} of its own", "en") for k in range(300)] + [(2000 + k, f"texto de {k % 20}", "es") for k in range(300)]
    long = [(3000 + k, f"sehr langer text {k} " * 3000, "de") for k in range(5)]
    docs = spark.createDataFrame(hot + own + long, "doc_id long, text string, lang string")
    got = langid.sample(docs, rows=50)
    assert Counter(lang for _, lang in got) == {"en": 50, "es": 20, "de": 5}
    assert len(set(got)) == len(got) and max(len(t.encode()) for t, _ in got) <= langid.SAMPLE_BYTES
    assert sorted(got) == sorted(langid.sample(docs.repartition(7, "doc_id"), rows=50))

PAGES = [(1, "http://a.org/x", "<p>1</p>"), (2, "https://www.A.org:443/x#f", "<p>1</p>"), (3, None, None), (4, "b.org/?q=1", ""), (5, "http://a.org/a\nb", "é" * 100_000), (6, "http://a.org/x", "é" * 100_000), (None, "c.net", "<p>1</p>"), (6, "http://a.org/x", "é" * 100_000)]


def test_archives_of_all_cases(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    got = warc.archived(pages, F.col("page_id")).collect()
    assert len(got) == len(PAGES)
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = Counter()
    for i, _, html in PAGES:
        of = first[html or ""]
        revisit = i is not None and i != of
        want[i, len((html or "").encode()), warc.base32_sha1((html or "").encode()), "revisit" if revisit else "response", of if revisit else None] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    ordered = sorted(got, key=lambda r: r["position"])
    assert [r["position"] for r in ordered] == list(range(len(PAGES)))
    keys = [(r["url_key"], r["captured"] or 0) for r in ordered]
    assert keys == sorted(keys)
    assert warc.archived(pages.where("page_id < 0"), F.col("page_id")).count() == 0
    small = warc.archived(pages, F.col("page_id"), least_bytes=100)
    assert {r["page_id"] for r in small.where("record_type = 'revisit'").collect()} == {6}


@pytest.mark.parametrize("fan_in", [2, 64])
def test_runs_merge_block_by_block(spark, monkeypatch, fan_in):
    from textloom.llm.common import scratch

    pick = random.Random(7)
    rows = [(k if k % 9 else None, f"http://h{pick.randrange(12)}.org/{pick.randrange(5)}", f"p{pick.randrange(150)}") for k in range(600)]
    rows += [(700, "http://h1.org/", "same")] * 20
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(warc, "ARCHIVE_RECORDS", 25)
        patch.setattr(warc, "BLOCK", 4)
        folder = scratch(spark, "merge")
        runs = warc.write(pages, F.lit(5), folder)
        got = warc.merged(runs, folder, fan_in).orderBy("part", "place").collect()
    assert runs.count() > 20 and len(got) == len(rows)
    keys = [tuple(r)[: warc.KEY] for r in got]
    assert keys == sorted(keys) and len({r["record_id"] for r in got}) == len(rows)
    assert len({(r["run"], r["offset"]) for r in got}) == len(rows)
    for part in {r["part"] for r in got}:
        here = [r["place"] for r in got if r["part"] == part]
        assert here == list(range(len(here)))


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/a?b=1#c") == "com,example)/a?b=1"
    assert warc.url_key("http://example.com") == "com,example)/"
    assert warc.url_key(None) == ""


def test_loser_tree_merges():
    runs = [[1, 4, 9], [], [2, 3, 3], [0], [9, 10]]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == [] and list(warc.LoserTree([[1, 2]])) == [1, 2]


def subword_buckets(text):
    """By plain Python: the buckets of all subwords of 1 to LONGEST letters and single spaces."""
    line, out = [], []
    for char in text:
        letter = char.lower()[0] if char.isalpha() else " "
        if letter != " " or not line or line[-1] != " ":
            line.append(letter)
    for n in range(1, langid.LONGEST + 1):
        for k in range(len(line) - n + 1):
            h = 0x811C9DC5
            for letter in line[k : k + n]:
                h = (h ^ ord(letter)) * 0x01000193 % 2**32
                h ^= h >> 15
            out.append((h * 0x9E3779B1 % 2**32) >> (32 - langid.BUCKET_BITS))
    return out


def test_language_scores_by_plain_python():
    rows = [(f"the house number {k} and the garden of {k * 7} roses", "en") for k in range(60)]
    rows += [(f"das haus mit nummer {k} und der garten der {k * 7} rosen", "de") for k in range(60)]
    model = langid.fit(rows)
    texts = ["the garden", "Der Garten, das Haus!", "É  x\t\ty", "a", "7 roses 7", *(t for t, _ in rows[:5])]
    logits, usual, n = model.measures(texts)
    best, p, rejected = model.predict(texts)
    for k, text in enumerate(texts):
        buckets = subword_buckets(text)
        assert n[k] == len(buckets)
        want = [sum(model.scores[b, j] for b in buckets) / len(buckets) + model.bias[j] for j in range(2)]
        assert logits[k] == pytest.approx(want, abs=1e-5)
        assert usual[k] == pytest.approx(sum(model.usual[b] for b in buckets) / len(buckets), abs=1e-9)
        e = [math.exp((w - max(want)) / model.temperature) for w in want]
        assert best[k] == want.index(max(want)) and p[k] == pytest.approx(max(e) / sum(e), abs=1e-5)
        least = model.thresholds[min(int(math.log2(len(buckets))), len(model.thresholds) - 1)]
        assert rejected[k] == (math.log(p[k]) < least[0] or usual[k] < least[1])
    assert [model.languages[b] for b in best[:2]] == ["en", "de"]


def test_language_sample_has_its_bounds_with_many_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 300)
    monkeypatch.setattr(langid, "TOTAL_BYTES", 6000)
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id, repeat(' word', 30)) AS text", "concat('l', id % 500) AS lang")
    got = langid.sample(docs)
    assert len(got) == 300 == len({lang for _, lang in got}) and sum(len(t.encode()) for t, _ in got) <= 6000
