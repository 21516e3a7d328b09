"""Pages of plain tags are read without the standard parser, and give the tree that it gives."""

import random

import pandas as pd
import pytest

from textloom.functions import pages
from textloom.plans.page_queries import page_label_map


def standard(html):
    builder = pages._Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def shape(node):
    """Neighbouring texts are one, as in a page."""
    out = []
    for part in node.children:
        if isinstance(part, str):
            out[-1:] = [out[-1] + part] if out and isinstance(out[-1], str) else [*out[-1:], part]
        else:
            out.append(shape(part))
    return node.tag, node.attributes, out


PIECES = (
    "<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<b class='x'>", '<a href="/p" rel=\'next\'>', "</a>", "<br>", "</br>", "<script>", "</script>", "<style>", "</style>",
    "<nav>", "</nav>", "<h2>", "</h2>", "<td>", "</td>", "<title>", "</title>", "text", " é&nbsp; ", "a &amp b", "&lt;p&gt;", "&am", "\n", "<noscript>", "</noscript>",
    "<br/>", "<P>", "< p>", "a < b", "a > b", "<!-- <p> -->", "<a href=x>", "</p x='1'>", "<a title='&amp;'>", "<textarea>", "</textarea>", "<iframe>", "</iframe>",
)


def test_random_pages_give_the_standard_tree():
    draw = random.Random(3)
    plain = 0
    for n in range(6000):
        html = "".join(draw.choice(PIECES[: 24 if n % 2 else None]) for _ in range(draw.randrange(12)))
        found = pages._built_plainly(html)
        plain += found is not None
        if found is not None:
            assert shape(found) == shape(standard(html)), html
    assert plain > 1000


def test_given_pages_give_the_standard_tree():
    for html in pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"]:
        assert shape(pages.parsed(html)) == shape(standard(html))


@pytest.mark.parametrize("name", ["part"])
def test_a_table_of_one_row_group_is_read_by_all_cores(spark, name):
    plan = page_label_map(spark, "/root/testdata/sf0.001")
    assert plan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
