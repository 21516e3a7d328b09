"""Queries over web pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, pages
from ..operators import listing
from ..sources.io import table
from ..sources.stored import dealt, spread
from .registry import query


@query("page_title", "SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.page_title(F.col("html")).alias("title"))


@query(
    "page_links_distinct",
    """
    SELECT href, count(*) AS n FROM (
        SELECT regexp_replace(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), '#.*$', '') AS href FROM pages)
    WHERE href <> '' GROUP BY href""",
)
def page_links_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select(F.explode(pages.page_links(F.col("html"))).alias("link"))
    return links.groupBy(pages.normalized_url(F.col("link")).alias("href")).agg(F.count("*").alias("n")).where("href <> ''")


@query("page_url_normalize", "SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages")
def page_url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.normalized_url(F.col("url")).alias("url"))


@query(
    "page_host_counts",
    "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
)
def page_host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"))


@query(
    "page_absolute_links",
    """
    SELECT DISTINCT page_id, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href
        WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href ELSE url END AS link
    FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)""",
)
def page_absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(pages.page_links(F.col("html"))).alias("link"))
    return links.select("page_id", pages.joined_url("url", "link").alias("link")).distinct()


#: In SQL: what is no text of a page. In page_text_strip_noise these references count without their semicolon too, as in browsers.
MARKUP = "|".join([*(rf"<{t}\b.*?</{t}>" for t in fixed.NOISE_TAGS), "<!--.*?-->", "<!DOCTYPE[^>]*>", "</?[a-z][^>]*>"])


@query(
    "page_text_strip_noise",
    rf"""
    WITH a AS (SELECT page_id, regexp_replace(html, '(?is)(?:{MARKUP})', chr(1), 'g') AS t FROM pages),
    b AS (
        SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(x, E' \t\n\r')), lambda x: x <> ''), ' ') AS t
        FROM a)
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
        '[ \t]+', ' ', 'g') AS text
    FROM b""",
)
def page_text_strip_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.page_text("html").alias("text"))


def marked_up(rows: DataFrame, page_id: str, *parts: str) -> DataFrame:
    """page_id, html: rows' columns put into markup; in parts, {x} stands for the column x. The given pages have no
    label maps, sections, tables or lists, so these queries make pages of columns whose contents SQL knows too."""
    pieces = [p for part in parts for p in re.split(r"({\w+})", part) if p]
    html = F.concat(*[F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in pieces])
    page = F.concat(F.lit("<html><head><script>x</script></head><body><nav><ul><li>menu</ul></nav>"), html, F.lit("<footer>foot</footer>"))
    return rows.select(F.col(page_id).alias("page_id"), page.alias("html"))


@query(
    "page_label_map",
    """
    SELECT p_partkey AS page_id, unnest(['Nome', 'Marca', 'Tipo']) AS label, unnest([p_name, p_brand, 'é ' || p_type]) AS value FROM part""",
)
def page_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages with a list of labels and a table row."""
    html = "<dl><dt>Nome:</dt><dd><b>{p_name}</b></dd><dt>Marca :</dt><dd>{p_brand}</dd></dl>", "<table><tr><th>Tipo:</th><td>&eacute;  {p_type}</td></tr><tr><td>a</td><td>b</td></tr></table>"
    found = marked_up(spread(table(spark, sf_dir, "part")), "p_partkey", *html)
    return found.select("page_id", F.explode(pages.page_labels("html")).alias("label", "value"))


@query(
    "page_sections",
    """
    SELECT c_custkey AS page_id, unnest([c_mktsegment, 'Nação']) AS heading, unnest([c_name || ' de ' || c_custkey, 'n ' || c_nationkey]) AS body
    FROM customer""",
)
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages of two headed sections."""
    html = "before<h2>{c_mktsegment}</h2><p>{c_name}<div>de <i>{c_custkey}</i></div>", "<div><h3>Na&ccedil;&atilde;o</h3>n</div> {c_nationkey}"
    found = marked_up(spread(table(spark, sf_dir, "customer")), "c_custkey", *html)
    return found.select("page_id", F.explode(pages.page_sections("html")).alias("heading", "body"))


@query(
    "page_table_rows",
    """
    SELECT l_orderkey AS page_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INT AS row_no,
           '{"Linha":"' || l_linenumber || '","Peça":"' || l_partkey || '"}' AS row FROM lineitem""",
)
def page_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages with a table of their lines; a row of missing values is none."""
    line = F.struct("l_linenumber", "l_partkey")
    lines = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    cells = lambda x: F.concat(F.lit("<tr><td>"), x["l_linenumber"], F.lit("</td><td><a href='/p'>"), x["l_partkey"], F.lit("</a></td></tr>"))
    rows = lines.withColumn("rows", F.array_join(F.transform("lines", cells), ""))
    html = "<table><tr><th>Linha</th><th>Pe&ccedil;a</th></tr>{rows}<tr><td> </td><td></td></tr></table>"
    found = marked_up(rows, "l_orderkey", html).select("page_id", F.posexplode(pages.page_tables("html")).alias("row_no", "row"))
    return found.select("page_id", "row_no", F.to_json("row").alias("row"))


@query(
    "page_list_items",
    """
    SELECT o_custkey AS page_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS item_no,
           'order ' || o_orderkey AS item FROM orders""",
)
def page_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages with a list of their orders; items that are empty are none."""
    lists = dealt(table(spark, sf_dir, "orders"), "o_custkey").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    item = lambda k: F.concat(F.lit("<li>order <b>"), k, F.lit("</b>"))
    rows = lists.withColumn("items", F.array_join(F.transform("keys", item), ""))
    found = marked_up(rows, "o_custkey", "<ul>{items}<li> </li></ul>")
    return found.select("page_id", F.posexplode(pages.page_list_items("html")).alias("item_no", "item"))


@query("page_records")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records of all pages; the kind goes by the page's number, as addresses don't tell it."""
    from ..operators.records import FIELDS, all_records

    kinds = F.array(*[F.lit(k) for k in FIELDS])
    kind = F.element_at(kinds, (F.col("page_id") % len(FIELDS) + 1).cast("int"))
    found = all_records(table(spark, sf_dir, "pages"), kind, F.lit("2025-01-01").cast("date"))
    return found.select("id", "tipo", "titulo", "embedding_text", "dados_completos")


@query(
    "people_in_area",
    """
    WITH d AS (SELECT 'n' || (doc_id % 97) AS name, source AS url, text AS content, doc_id FROM documents),
    hit AS (SELECT *, content ILIKE '%secret%' OR content ILIKE '%token%' AS h FROM d),
    p AS (SELECT DISTINCT name, url, content FROM hit WHERE h AND doc_id % 2 = 0 ORDER BY name, url, content LIMIT 50),
    q AS (SELECT DISTINCT name, url, content FROM hit WHERE h AND doc_id % 2 = 1 ORDER BY name, url, content LIMIT 5),
    pn AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY url, content) AS n,
        coalesce(nullif(instr(lower(content), 'secret'), 0), nullif(instr(lower(content), 'token'), 0)) AS x FROM p),
    qn AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY url, content) AS n FROM q)
    SELECT 'person' AS part, name, url, substr(content, greatest(x - 100, 1), x + 300 - greatest(x - 100, 1)) AS excerpt FROM pn WHERE n = 1
    UNION ALL SELECT 'project', name, url, left(content, 300) FROM qn WHERE n = 1""",
)
def people_in_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even numbers as people, of odd ones as projects."""
    from ..operators import records

    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("n"), (F.col("doc_id") % 97).cast("string")).alias("name"), F.col("source").alias("url"), F.col("text").alias("content"), "doc_id"
    )
    people, projects = docs.where("doc_id % 2 = 0").drop("doc_id"), docs.where("doc_id % 2 = 1").drop("doc_id")
    return records.people_in_area(people, projects, ["secret", "token"])


def order_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, html: each customer's orders as a listing, a page for every two of them. A page names the next one in one of
    several ways; the last one leads back to the first, to itself or nowhere."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    page = orders.withColumn("page", F.floor(place / 2)).groupBy("o_custkey", "page").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    page = page.withColumn("last", F.max("page").over(Window.partitionBy("o_custkey")))
    address = lambda n: F.concat(F.lit("https://x.org/c/"), F.col("o_custkey"), F.lit("/"), n)
    back = F.when(F.col("o_custkey") % 3 == 0, F.lit("0")).when(F.col("o_custkey") % 3 == 1, F.col("page").cast("string")).otherwise("gone")
    to = F.when(F.col("page") < F.col("last"), (F.col("page") + 1).cast("string")).otherwise(back)
    way = F.element_at(F.array(*map(F.lit, ("rel='next'>on", ">Next page", ">&raquo;", "class='pag-proxima'>on"))), (F.col("page") % 4 + 1).cast("int"))
    links = F.array_join(F.transform("keys", lambda k: F.concat(F.lit("<li><a href='/orders/"), k, F.lit("#top'>order</a></li>"))), "")
    html = F.concat(F.lit("<nav><a href='/'>home</a><a href='"), to, F.lit("' "), way, F.lit("</a></nav><ul>"), links, F.lit("</ul><a href='/orders/list.pdf'>pdf</a>"))
    return page.select(address(F.col("page")).alias("url"), html.alias("html"))


@query(
    "listing_chain",
    """
    WITH p AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 2 AS page FROM orders)
    SELECT DISTINCT o_custkey AS listing, page::BIGINT AS place, 'https://x.org/c/' || o_custkey || '/' || page AS url FROM p""",
)
def listing_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of every listing in order, from its first one on."""
    pages_ = order_listings(spark, sf_dir)
    starts = pages_.where(F.endswith("url", F.lit("/0"))).select(F.col("url").alias("start"))
    found = listing.chains(starts, listing.successors(pages_))
    return found.select(F.split_part("start", F.lit("/"), F.lit(5)).cast("long").alias("listing"), "place", "url")


@query(
    "listing_links",
    "SELECT o_custkey AS listing, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_custkey",
)
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all pages of every listing."""
    pages_ = order_listings(spark, sf_dir)
    starts = pages_.where(F.endswith("url", F.lit("/0"))).select(F.col("url").alias("start"))
    found = listing.chain_links(pages_, starts, "/orders/")
    number = lambda c, n: F.split_part(c, F.lit("/"), F.lit(n)).cast("long")
    return found.groupBy(number("start", 5).alias("listing")).agg(F.count("*").alias("n"), F.sum(number("link", 5)).alias("keys"))
