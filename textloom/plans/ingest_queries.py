"""Queries of ingesting and shaping tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_current, parsed_date
from ..operators import ingest, nested
from ..sources.io import table
from .registry import query


@query("count_by_type", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(
    "dedup_keep_longest",
    """
    SELECT doc_id, n_chars FROM (
        SELECT *, row_number() OVER (PARTITION BY lower(left(text, 40)) ORDER BY length(text) DESC, doc_id) AS n FROM documents)
    WHERE n = 1""",
)
def dedup_keep_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = ingest.longest_per_key(docs, F.lower(F.left("text", F.lit(40))), "text", "doc_id")
    return kept.select("doc_id", "n_chars")


@query(
    "dedup_prefix150",
    """
    SELECT doc_id FROM (
        SELECT doc_id, row_number() OVER (PARTITION BY left(text, 150) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""",
)
def dedup_prefix150(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of documents that begin alike: a minimum, which needs no sort."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.left("text", F.lit(150)).alias("prefix")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(
    "exact_duplicate_groups",
    "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest"))
    return groups.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(
    "cap_per_group",
    """
    SELECT doc_id, lang, nth FROM (
        SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents) WHERE nth <= 50""",
)
def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = ingest.limited_per_group(table(spark, sf_dir, "documents"), "lang", "doc_id", 50)
    return capped.select("doc_id", "lang", "nth")


@query(
    "upsert_latest",
    """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality,
           CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS batch
    FROM labels""",
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch turns each third label round."""
    old = table(spark, sf_dir, "labels").select("doc_id", "quality")
    new = old.where("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality"))
    return ingest.upserted(old, new, "doc_id")


@query(
    "enrich_nested_left_join",
    """
    SELECT o_orderkey, count(l_orderkey) AS members,
           string_agg(p_name || '/' || p_brand, ';' ORDER BY l_linenumber, l_partkey::VARCHAR) AS enriched
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""",
)
def enrich_nested_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as members, whose part's name and brand fill their blanks."""
    member = F.struct(
        F.col("l_linenumber").alias("_n"),
        F.col("l_partkey").cast("string").alias("name"),
        F.lit(None).cast("string").alias("unit"),
        F.col("l_partkey").cast("string").alias("url"),
        F.lit("").alias("lattes"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(member)).alias("m"))
    lines = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.transform("m", lambda s: s.dropFields("_n")).alias("members"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("url"),
        F.col("p_name").alias("unit"),
        F.col("p_brand").alias("lattes"),
        F.lit(0).alias("ordinal"),
    )
    done = ingest.enriched_members(orders, "o_orderkey", "members", parts)
    shown = F.array_join(F.transform("members", lambda m: F.concat(m["unit"], F.lit("/"), m["lattes"])), ";")
    return done.select("o_orderkey", F.size("members").cast("long").alias("members"), F.nullif(shown, F.lit("")).alias("enriched"))


@query(
    "recency_topk_nulls_last",
    """
    SELECT o_custkey, o_orderkey, nth FROM (
        SELECT o_custkey, o_orderkey, row_number() OVER (
            PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS nth
        FROM orders) WHERE nth <= 3""",
)
def recency_topk_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest three orders; open ones have no date."""
    orders = table(spark, sf_dir, "orders").withColumn("dated", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    order = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("dated"), "o_orderkey")
    latest = orders.withColumn("nth", F.row_number().over(order)).where("nth <= 3")
    return latest.select("o_custkey", "o_orderkey", "nth")


@query(
    "json_prop_filter",
    """
    SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events
    WHERE event_type = 'error' AND json_extract_string(props, '$.k')::INT >= 50""",
)
def json_prop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    found = table(spark, sf_dir, "events").where(F.col("event_type") == "error").withColumn("k", k)
    return found.where("k >= 50").select("event_id", "k")


@query(
    "variant_path_projection",
    "SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k, json_extract_string(props, '$.none') AS missing FROM events",
)
def variant_path_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.try_variant_get(data, "$.k", "bigint").alias("k"),
        F.try_variant_get(data, "$.none", "string").alias("missing"),
    )


@query(
    "project_is_current",
    """
    WITH o AS (
        SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS d,
               CASE o_orderstatus WHEN 'F' THEN 'Finalizado' WHEN 'O' THEN 'Em andamento' ELSE '' END AS s FROM orders)
    SELECT o_orderkey, CASE WHEN s = 'Finalizado' THEN strptime(d, '%d/%m/%Y') >= TIMESTAMP '1997-01-01'
        WHEN s = 'Em andamento' THEN true ELSE strptime(d, '%d/%m/%Y') >= TIMESTAMP '1997-01-01' END AS current FROM o""",
)
def project_is_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Finalizado").when(F.col("o_orderstatus") == "O", "Em andamento").otherwise("")
    ended = F.date_format("o_orderdate", "dd/MM/yyyy")
    return orders.select("o_orderkey", is_current(ended, status, F.lit("1997-01-01").cast("date")).alias("current"))


@query(
    "date_in_text",
    """
    SELECT o_orderkey, datediff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS parsed_day FROM orders""",
)
def date_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("desde "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" em vigor"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(parsed_date(text), F.lit("1970-01-01").cast("date")).alias("parsed_day"))


@query(
    "subjects_by_semester",
    """
    WITH l AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS s, l_suppkey FROM lineitem)
    SELECT l_orderkey AS o_orderkey, s || 'º Semestre' AS semester, count(*) AS subjects,
           string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_linenumber, l_suppkey::VARCHAR) AS names
    FROM l GROUP BY l_orderkey, s""",
)
def subjects_by_semester(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a curriculum, grouped by semester."""
    row = F.create_map(
        F.lit("semestre"), F.concat((F.col("l_linenumber") % 3).cast("string"), F.lit("º Semestre")),
        F.lit("nome"), F.col("l_suppkey").cast("string"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    matrix = lines.agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.to_json(row).alias("row")))), lambda s: F.from_json(s["row"], "map<string,string>")).alias("matrix"))
    grouped = nested.by_semester(matrix, "o_orderkey", "matrix")
    names = F.array_join(F.transform("subjects", lambda r: r["nome"]), ",")
    return grouped.select("o_orderkey", "semester", F.size("subjects").cast("long").alias("subjects"), names.alias("names"))


@query(
    "subjects_with_credits",
    """
    SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_linenumber % 3 = 1 AND l_quantity::INT % 4 = 2) AS found
    FROM lineitem GROUP BY l_orderkey""",
)
def subjects_with_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.create_map(
        F.lit("semestre"), (F.col("l_linenumber") % 3).cast("string"), F.lit("Cr."), (F.col("l_quantity").cast("int") % 4).cast("string")
    )
    matrix = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(row).alias("matrix"))
    found = nested.subjects_with_credits(F.col("matrix"), F.lit(2), F.lit("1"))
    return matrix.select("o_orderkey", F.size(found).cast("long").alias("found"))
