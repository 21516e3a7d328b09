"""The trigram join against plain Python, and how little leaves it to be counted."""

import random

from pyspark.sql import functions as F

from textloom.functions.text import trigrams
from textloom.operators import lexical


def grams(name):
    padded = f"  {name}  "
    return {padded[k : k + 3] for k in range(len(padded) - 2)}


def texts():
    """Random texts over few letters, which share many trigrams, and changed copies of every third."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcde") for _ in range(draw.randint(2, 9)))
    out = [" ".join(word() for _ in range(draw.randint(3, 30))) for _ in range(240)]
    for k in range(0, 240, 3):
        letters = list(out[k])
        for _ in range(1 + k % 5):
            letters[draw.randrange(len(letters))] = draw.choice("abcde")
        out.append("".join(letters))
    return list(enumerate(out))


def test_pairs_are_those_of_plain_python_and_few_candidates_leave_the_join(spark, monkeypatch):
    rows = texts()
    names = spark.createDataFrame(rows, "id long, name string")
    seen = []
    candidates = lexical.similar_candidates
    monkeypatch.setattr(lexical, "similar_candidates", lambda *x: seen.append(candidates(*x)) or seen[-1])
    left, right = names.where("id < 240"), names.where("id >= 240")
    found = lexical.trigram_pairs(left, right, trigrams, 0.82).collect()
    sets = {k: grams(t) for k, t in rows}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    expected = {(a, b): share(a, b) for a in sets for b in sets if a < 240 <= b and share(a, b) >= 0.82}
    assert {(r["left_id"], r["right_id"]): r["similarity"] for r in found} == expected
    assert expected and seen[0].count() <= 3 * len(expected)
    found = lexical.trigram_pairs(names, names, trigrams, 0.7, ascending=True).select("left_id", "right_id").collect()
    assert {tuple(r) for r in found} == {(a, b) for a in sets for b in sets if a < b and share(a, b) >= 0.7}


def test_a_name_is_made_once_not_for_each_of_its_trigrams(spark):
    names = spark.createDataFrame(texts()[:20], "id long, name string").withColumn("name", F.regexp_replace("name", r"\s+", " "))
    rows = lexical.gram_rows(names, "a", trigrams)
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()
