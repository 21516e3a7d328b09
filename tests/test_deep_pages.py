"""Pages with odd markup: nesting without end and tags without an end must not stop a job."""

import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import pages
from textloom.functions.details import parts_of
from textloom.operators import records

DEEP = "<div>" * 100_000 + "<p>inside" + "</div>" * 100_000 + "<p>after"
UNCLOSED = "<title>t</title>" + "<b><i><span>x " * 80_000
TABLES = "<h2>Head</h2>" + "<table><tr><td>cell " * 3_000
NOISE = "<nav>" * 100_000 + "menu" + "</div>" * 50_000 + "</nav>" * 100_000 + "text"


@pytest.mark.parametrize(("html", "words"), [(DEEP, ["inside", "after"]), (UNCLOSED, ["x"] * 80_000), (NOISE, ["text"])])
def test_text_of_odd_markup(html, words):
    began = time.time()
    text = pages.parsed(html).text().split()
    assert [w for w in text if w != "t"] == words
    assert time.time() - began < 30


def test_depth_keeps_texts_in_order():
    html = "".join(f"<div>a{k} " for k in range(600)) + "".join(f"</div>b{k} " for k in range(600))
    assert pages.parsed(html).text().split() == [f"a{k}" for k in range(600)] + [f"b{k}" for k in range(600)]


def test_shallow_markup_is_as_before():
    root = pages.parsed("<ul><li>a<li>b<p>c<p>d</ul>e<nav>no<p>no</nav></nope><h2>H</h2>x<div>y<h3>I</h3>z</div>w")
    assert root.text() == "a b c d e H x y I z w"
    assert pages.list_items(root) == ["a", "b c d"]
    assert pages.headed_sections(root) == {"H": "x y", "I": "z w"}


@pytest.mark.parametrize("html", [DEEP, UNCLOSED, TABLES, NOISE])
def test_parts_of_odd_markup(html):
    assert parts_of(html, "https://x.org/")["text"]


def test_queries_survive_odd_pages(spark):
    rows = [(k, f"https://x.org/cursos/{k}", html) for k, html in enumerate([DEEP, UNCLOSED, NOISE, None, ""])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = [r[0] for r in df.select(pages.page_text(F.col("html"))).collect()]
    assert texts[0] == "inside after" and texts[2] == "text"
    assert records.all_records(df, F.lit("curso")).count() == 5
