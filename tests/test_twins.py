"""Rows on which a query and its SQL twin once differed."""

import duckdb
import pytest

from textloom.plans.catalog import ORACLES, QUERIES


def both(spark, folder, name, table, sql_rows):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {table} AS {sql_rows}")
    con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    found = QUERIES[name](spark, str(folder))
    twin = con.execute(ORACLES[name])
    names = [c[0] for c in twin.description]
    return sorted(tuple(r[c] for c in names) for r in found.collect()), sorted(twin.fetchall())


@pytest.mark.parametrize("name", ["rule_route", "route_by_confidence"])
def test_routes_are_found_in_whole_words_only(spark, tmp_path, name):
    words = ["Teseatha", "tese", "Anteses", "projeto", "projetosx", "trabalha", "Docente", "areatrabalha", ""]
    cases = ", ".join(f"({k}, {t}, 'user', '{w} x')" for k, w in enumerate(words) for t in range(9))
    got, want = both(spark, tmp_path, name, "conversations", f"SELECT * FROM (VALUES {cases}) t(conv_id, turn, role, text)")
    assert got == want and len({r[2] for r in got}) > 2


def test_references_without_a_semicolon_are_characters(spark, tmp_path):
    pages = ["<p>a&amp</p><p>b &amp;&amp; c</p>", "<p>x &lt y &gt;z &quot</p>", "<p>&amp;lt; &ampx &am &</p>"]
    cases = ", ".join(f"({k}, 'u', '{h}')" for k, h in enumerate(pages))
    got, want = both(spark, tmp_path, "page_text_strip_noise", "pages", f"SELECT * FROM (VALUES {cases}) t(page_id, url, html)")
    assert got == want == [(0, "a& b && c"), (1, 'x < y >z "'), (2, "&lt; &x &am &")]
