"""Tables are read by the form of a page, once for all pages of that form, and give the rows of the standard parser."""

import random

import pandas as pd

from textloom.functions import fixed, pages
from textloom.plans.page_queries import page_table_rows

from .conftest import DATA
from .test_plain_pages import PIECES, standard

CELLS = (
    "<table>", "<table class='t'>", "</table>", "<tr>", "</tr>", "<th>", "</th>", "<td>", "<td id=\"x\">", "</td>", "<tr><td>", "</td></tr>", "<tr><th>", "</th></tr>", "1", "a b",
    " ", "é", "Pe&ccedil;a", "x" * 70, fixed.MISSING, "&nbsp;", "&lt;", "a\n\n\n\nb",
)


def test_random_tables_give_the_standard_rows():
    draw = random.Random(5)
    rows = 0
    for n in range(8000):
        some = CELLS if n % 2 else CELLS + PIECES
        html = "<table>" * (n % 3 > 0) + "".join(draw.choice(some) for _ in range(draw.randrange(24)))
        want = pages.table_rows(standard(html))
        assert pages.page_table_rows(html) == want, html
        rows += len(want)
    assert rows > 1500


def test_brackets_that_are_no_tags():
    for html in ("", "<", ">", "<>", "a > td < b", ">table<", "<table><tr><td>1 >td< 2</td></tr></table>", "<table><tr><td>a</td>>td<</tr>", "<td", "td>"):
        assert pages.page_table_rows(html) == pages.table_rows(standard(html)), html
    assert pages.page_table_rows(None) == []


def test_deep_and_long_pages():
    row = "<tr><td>1</td><td><b>x</b> y</td></tr>"
    for html in ("<div>a" * 300 + f"<table>{row}</table>b", "<table>" + row * (pages.FORM_TAGS // 4) + "</table>", "<div>" * 254 + f"<table>{row}</table>"):
        assert pages.page_table_rows(html) == pages.table_rows(standard(html))


def test_given_pages_give_the_standard_rows():
    for html in pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"]:
        assert pages.page_table_rows(html) == pages.table_rows(standard(html))


def test_pages_of_one_form_are_read_once(monkeypatch):
    made = []
    builder = pages._Builder
    monkeypatch.setattr(pages, "_Builder", lambda: made.append(1) or builder())
    pages._table_places.cache_clear()
    for k in range(500):
        html = f"<table><tr><th>n</th></tr><tr><td><a href='/{k}'>{k} &amp; é</a></td></tr></table>"
        assert pages.page_table_rows(html) == [{"n": f"{k} & é"}]
    assert len(made) == 1


def test_no_lines_are_grouped_before_the_query_runs(spark):
    spark.sparkContext.setJobGroup("plan", "plan")
    plan = page_table_rows(spark, DATA)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # The table's columns are read.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("plan")) <= 1
    assert plan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
