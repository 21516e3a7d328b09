"""Queries of structured answers, of routing with a provider, and of configurations side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, pages, rules
from ..functions.text import replaced_section
from ..operators import evaluate, fusion, lexical
from ..operators.structured import structured_answers
from ..sources.io import table
from .lexical_queries import BM25, DENSE, questions, ranked_lists
from .registry import query
from .rule_queries import _SQL_ASK, SQL_ROUTE
from .rule_queries import questions as asked_turns

#: Questions about a course, one of each kind.
_KINDS = (
    "qual a matriz curricular do curso de ", "disciplinas do 2º semestre do curso de ", "disciplinas de 4 créditos do curso de ",
    "professores do curso de ", "turmas ofertadas do curso de ",
)


@query(
    "structured_answers",
    """
    WITH c AS (SELECT min(p_partkey) AS id, p_name AS title FROM part GROUP BY p_name),
    l AS (
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY l_orderkey, l_linenumber, l_suppkey::VARCHAR, l_quantity::INT % 5) AS n, l_suppkey, l_linenumber,
               (l_linenumber % 3 + 1) || 'º Semestre' AS sem, l_quantity::INT % 5 AS cr, l_suppkey || ' | Créditos: ' || (l_quantity::INT % 5) AS line
        FROM c JOIN lineitem ON l_partkey = id),
    by_sem AS (SELECT id, sem, min(n) AS pos, chr(10) || sem || ':' || chr(10) || string_agg('- ' || line, chr(10) ORDER BY n) AS t FROM l GROUP BY id, sem),
    by_cr AS (SELECT id, sem, min(n) AS pos, chr(10) || sem || ':' || chr(10) || string_agg('- ' || line, chr(10) ORDER BY n) AS t FROM l WHERE cr = 4 GROUP BY id, sem),
    body AS (
        SELECT id, 0 AS k, '=== MATRIZ CURRICULAR COMPLETA ===' AS head, (SELECT string_agg(t, chr(10) ORDER BY pos) FROM by_sem s WHERE s.id = c.id) AS t FROM c
        UNION ALL SELECT id, 1, '=== DISCIPLINAS DO 2º SEMESTRE ===', (SELECT string_agg('- ' || line, chr(10) ORDER BY n) FROM l WHERE l.id = c.id AND sem = '2º Semestre') FROM c
        UNION ALL SELECT id, 2, '=== DISCIPLINAS COM 4 CRÉDITOS ===', (SELECT string_agg(t, chr(10) ORDER BY pos) FROM by_cr s WHERE s.id = c.id) FROM c
        UNION ALL SELECT id, 3, '=== CORPO DOCENTE ===', (SELECT string_agg('  - Prof ' || l_suppkey, chr(10) ORDER BY n) FROM l WHERE l.id = c.id) FROM c
        UNION ALL SELECT id, 4, '=== TURMAS OFERTADAS ===', (SELECT string_agg('  - ' || l_suppkey || ' | Prof: Prof ' || l_suppkey || ' | Turma T' || l_linenumber, chr(10) ORDER BY n) FROM l WHERE l.id = c.id) FROM c)
    SELECT id * 10 + k AS query_id, ['MATRIX_FULL', 'MATRIX_SEMESTRE', 'CREDITOS_FILTER', 'PROFS_CURSO', 'TURMAS_CURSO'][k + 1] AS kind, id,
           'Curso: ' || title || ' (graduação)' || chr(10) || 'URL: http://c/' || id || chr(10) || head || chr(10) || coalesce(t, '') AS context,
           '[' || title || '](http://c/' || id || ')' AS sources
    FROM body JOIN c USING (id)""",
)
def structured_answers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as courses, their order lines as curricula, teachers and classes; five questions about each."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("id"))
    lines = table(spark, sf_dir, "lineitem").join(names.select("id"), F.col("l_partkey") == F.col("id"))
    row = F.struct(
        "l_orderkey",
        "l_linenumber",
        F.col("l_suppkey").cast("string").alias("nome"),
        F.concat((F.col("l_linenumber") % 3 + 1).cast("string"), F.lit("º Semestre")).alias("semestre"),
        (F.col("l_quantity").cast("int") % 5).cast("string").alias("credits"),
    )
    each = lines.groupBy("id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    text = lambda value: value.cast("string")
    none = F.lit(None)
    person = lambda r: F.concat(F.lit("Prof "), r["nome"])
    record = each.select(
        "id",
        F.transform("rows", lambda r: F.create_map(F.lit("semestre"), r["semestre"], F.lit("nome"), r["nome"], F.lit("Cr."), r["credits"])).alias("matrix"),
        F.transform("rows", lambda r: F.struct(person(r).alias("nome"), text(none).alias("unidade"), text(none).alias("lattes"), text(none).alias("url"))).alias("teachers"),
        F.transform(
            "rows",
            lambda r: F.struct(
                r["nome"].alias("disciplina"), F.array(person(r)).alias("professores"), F.concat(F.lit("T"), text(r["l_linenumber"])).alias("turma"),
                text(none).alias("vagas"), text(none).alias("matriculados"),
            ),
        ).alias("classes"),
    )
    courses = names.join(record, "id", "left").withColumns(
        {"level": F.lit("graduação"), "url": F.concat(F.lit("http://c/"), F.col("id").cast("string"))}
    )
    kinds = F.posexplode(F.array(*[F.lit(k) for k in _KINDS])).alias("k", "start")
    asked = names.select("id", "title", kinds).select(
        (F.col("id") * 10 + F.col("k")).alias("query_id"), F.concat("start", "title", F.lit("?")).alias("text")
    )
    return structured_answers(asked, courses).select("query_id", "kind", "id", "context", "sources")


@query(
    "route_by_confidence",
    f"""
    WITH q AS (SELECT conv_id, turn, {SQL_ROUTE} AS rule FROM {_SQL_ASK})
    SELECT conv_id, turn, coalesce(rule, CASE WHEN conv_id % 3 < 2 AND (conv_id + turn) % 10 >= 6
        THEN ['{sorted(fixed.COLLECTIONS.values())[0]}', '{sorted(fixed.COLLECTIONS.values())[-1]}'][conv_id % 3 + 1] END) AS route FROM q""",
)
def route_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where no rule is found a provider's answer counts: here one that goes by the conversation's number, with an
    unknown collection for a third of them."""
    known = sorted(fixed.COLLECTIONS.values())
    named = F.element_at(F.array(F.lit(known[0]), F.lit(known[-1]), F.lit("unknown")), (F.col("conv_id") % 3 + 1).cast("int"))
    answer = F.to_json(F.struct(named.alias("collection"), ((F.col("conv_id") + F.col("turn")) % 10 / 10).alias("confidence")))
    return asked_turns(spark, sf_dir).select("conv_id", "turn", rules.route_with(F.col("text"), answer).alias("route"))


@query(
    "config_comparison",
    f"""
    WITH {BM25}, {DENSE},
    f AS (
        SELECT query_id, doc_id, sum(p) AS score FROM (
            SELECT query_id, doc_id, 0.5 / (60 + rank) AS p FROM bmr WHERE rank <= 10 UNION ALL
            SELECT query_id, doc_id, 0.5 / (60 + rank) FROM dsr WHERE rank <= 10) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f),
    u AS (
        SELECT 'base' AS config, query_id, doc_id, rank FROM dsr WHERE rank <= 5 UNION ALL
        SELECT 'hybrid', query_id, doc_id, rank FROM r WHERE rank <= 5),
    j AS (
        SELECT k.config, item_id, rank, coalesce(contains(lower(d.text), lower(b.text)) OR contains(lower(b.text), lower(d.text)), false) AS rel
        FROM (SELECT unnest(['base', 'hybrid']) AS config) k CROSS JOIN benchmark b
        LEFT JOIN u ON u.query_id = item_id AND u.config = k.config LEFT JOIN documents d USING (doc_id)),
    x AS (SELECT config, item_id, min(rank) FILTER (rel) AS first_rank, count(*) FILTER (rel) AS hits, count(rank) AS returned FROM j GROUP BY ALL)
    SELECT config, count(*) AS queries, round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr, round(avg((hits > 0)::INT), 6) AS recall,
           round(avg(CASE WHEN returned > 0 THEN hits / returned ELSE 0 END), 6) AS precision
    FROM x GROUP BY config""",
)
def config_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense retrieval alone and fused with BM25, over all questions."""
    by_vector, by_word = ranked_lists(spark, sf_dir)
    lexical_weight, dense_weight = fusion.hybrid_weights(0.5)
    fused = lexical.ranked(fusion.reciprocal_rank_fusion([(by_vector, dense_weight), (by_word, lexical_weight)]), 5)
    results = {"base": by_vector.where("rank <= 5"), "hybrid": fused}
    quality = evaluate.compared(results, questions(spark, sf_dir), table(spark, sf_dir, "documents"))
    return quality.select("config", "queries", *[F.round(c, 6).alias(c) for c in ("mrr", "recall", "precision")])


@query(
    "listed_links",
    """
    SELECT DISTINCT regexp_replace(href, '#.*$', '') AS link FROM (
        SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
    WHERE contains(href, '://') AND NOT regexp_matches(lower(href), '\\.(pdf|docx?|xlsx?|zip|rar|png|jpe?g|gif|svg|mp4|mp3|ico)([?#].*)?$')""",
)
def listed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.listed_links(table(spark, sf_dir, "pages"), "://")


@query(
    "section_replace",
    """
    SELECT p_partkey, 'Curso ' || p_name || chr(10) || chr(10) || 'Professores:' || chr(10) || p_brand || ' $1' || chr(10) || chr(10) || 'Turmas' AS text FROM part""",
)
def section_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section of a text that is put together from a part's columns gets other teachers."""
    old = F.concat(F.lit("Curso "), "p_name", F.lit("\n\nProfessores:\n"), "p_type", F.lit("\n\nnem todos\n\nTurmas"))
    new = replaced_section(old, "Professores:", F.concat("p_brand", F.lit(" $1")))
    return table(spark, sf_dir, "part").select("p_partkey", new.alias("text"))
