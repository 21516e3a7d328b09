"""Queries of guards, routes, intents and other rules over conversations and documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, rules
from ..functions.text import sentiment
from ..sources.io import table
from .registry import query


def sql_pattern(pattern: str) -> str:
    """A pattern as a DuckDB string literal: case-insensitive, word boundaries as in the SQL engine."""
    return "'" + "(?i)" + pattern.replace("'", "''") + "'"


def sql_any(patterns, text: str = "text") -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {sql_pattern(p)})" for p in patterns) + ")"


def sql_first(named, text: str = "text") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {sql_pattern(p)}) THEN '{n}'" for p, n in named) + " END"


_PII = [(p, n) for n, p in fixed.PII_PATTERNS]
_LENGTH = "length(trim(text)) < 3 OR length(trim(text)) > 1000"


@query(
    "guard_length",
    """SELECT conv_id, turn, CASE WHEN length(trim(text)) < 3 THEN 'short' WHEN length(trim(text)) > 1000 THEN 'long' END AS failure
    FROM conversations""",
)
def guard_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.length_failure(F.col("text")).alias("failure"))


@query("guard_injection", f"SELECT doc_id, {sql_any(fixed.INJECTION_PATTERNS)} AS injection FROM documents")
def guard_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rules.has_injection(F.col("text")).alias("injection"))


@query("guard_pii", f"SELECT doc_id, {sql_first(_PII)} AS kind FROM documents")
def guard_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rules.pii_kind(F.col("text")).alias("kind"))


@query(
    "guard_first_failure",
    f"""SELECT conv_id, turn, CASE WHEN {_LENGTH} THEN 'length' WHEN {sql_any(fixed.INJECTION_PATTERNS)} THEN 'injection'
        WHEN {sql_first(_PII)} IS NOT NULL THEN 'pii' END AS failure FROM conversations""",
)
def guard_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.input_guard(F.col("text")).alias("failure"))


@query(
    "guard_strict",
    f"""SELECT doc_id, CASE WHEN length(trim(text)) < 5 THEN 'length' WHEN {sql_any(fixed.STRICT_INJECTION_PATTERNS)} THEN 'injection'
        WHEN {sql_any([p for _, p in fixed.STRICT_PII_PATTERNS])} THEN 'pii' END AS failure FROM documents""",
)
def guard_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", rules.strict_input_guard(F.col("text")).alias("failure"))


@query(
    "output_guard",
    """SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 8000 THEN 'length' END AS failure
    FROM conversations WHERE role = 'assistant'""",
)
def output_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return answers.select("conv_id", "turn", rules.output_guard(F.col("text")).alias("failure"))


#: Question templates for the rules, dealt to the turns of users with the turn's first word.
_ASK = (
    "quem pesquisa ", "qual professor atua com ", "projetos de extensão em ", "endereço da unidade ", "disciplinas do curso de ",
    "professores do curso de ", "disciplinas do 4º semestre do curso de ", "disciplinas de 4 créditos do curso de ", "turmas ofertadas do curso de ",
)
_SQL_ASK = (
    f"(SELECT conv_id, turn, [{', '.join(repr(a) for a in _ASK)}][(conv_id + turn) % {len(_ASK)} + 1] || "
    "lower(regexp_extract(text, '[A-Za-z]+')) AS text FROM conversations WHERE role = 'user')"
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    starts = F.array(*[F.lit(a) for a in _ASK])
    start = F.element_at(starts, ((F.col("conv_id") + F.col("turn")) % len(_ASK) + 1).cast("int"))
    return asked.select("conv_id", "turn", F.concat(start, F.lower(F.regexp_extract("text", "[A-Za-z]+", 0))).alias("text"))


#: In SQL: where words of any alphabet begin and end stands a mark, as the SQL engine's own boundaries know ASCII only.
SQL_MARKED = r"regexp_replace(text, '([\p{L}\p{N}\p{M}_]+)', chr(1) || '\1' || chr(1), 'g')"
_ROUTES = [(re.sub(r"\.\{0,(\d+)\}", r"(?:\\x01*[^\\x01\\n]){0,\1}\\x01*", p).replace(r"\b", r"\x01"), n) for p, n in fixed.ROUTES]
#: In SQL: the collection of the first routing rule that is found in whole words.
SQL_ROUTE = sql_first(_ROUTES, SQL_MARKED)


@query("rule_route", f"SELECT conv_id, turn, {SQL_ROUTE} AS route FROM {_SQL_ASK}")
def rule_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("conv_id", "turn", rules.route(F.col("text")).alias("route"))


@query(
    "intent_classify",
    f"""
    WITH q AS (SELECT conv_id, turn, text, (conv_id + turn) % {len(_ASK)} AS k, regexp_extract(text, '[a-z]+$') AS w FROM {_SQL_ASK})
    SELECT conv_id, turn,
           CASE WHEN k = 4 THEN 'MATRIX_FULL' WHEN k = 5 THEN 'PROFS_CURSO' WHEN k = 6 THEN 'MATRIX_SEMESTRE'
                WHEN k = 7 THEN 'CREDITOS_FILTER' WHEN k = 8 THEN 'TURMAS_CURSO' END AS kind,
           CASE WHEN k = 6 THEN '4º Semestre' END AS semester, CASE WHEN k = 7 THEN 4 END AS credits
    FROM q""",
)
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = questions(spark, sf_dir).withColumn("i", rules.intent(F.col("text")))
    return found.select("conv_id", "turn", F.col("i.kind").alias("kind"), F.col("i.semester").alias("semester"), F.col("i.credits").alias("credits"))


@query(
    "asks_for_area",
    f"SELECT conv_id, turn, (conv_id + turn) % {len(_ASK)} IN (0, 1) AS area FROM conversations WHERE role = 'user'",
)
def asks_for_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("conv_id", "turn", rules.asks_for_area(F.col("text")).alias("area"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KINDS = " ".join(f"WHEN contains(t, {_sql(word)}) THEN {_sql(kind)}" for word, kind in fixed.TYPE_HINTS.items())
_NAMED = ", ".join(f"CASE WHEN regexp_matches(t, {_sql(p)}) THEN regexp_extract(t, {_sql(p)}, 1) END" for p in fixed.ENTITY_PATTERNS)
_GENERIC = ", ".join(map(_sql, fixed.GENERIC_WORDS))


@query(
    "entity_of_question",
    rf"""
    WITH a AS (SELECT conv_id, turn, lower(trim(text)) AS t, regexp_split_to_array(lower(trim(text)), '\s+') AS w FROM {_SQL_ASK}),
    e AS (SELECT *, coalesce({_NAMED}, CASE WHEN len(list_intersect(w, [{_GENERIC}])) = 0 AND len(w) <= 6 THEN t END) AS named FROM a)
    SELECT conv_id, turn, CASE {_KINDS} END AS kind, nullif(rtrim(trim(named), '?. '), '') AS entity FROM e""",
)
def entity_of_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    return asked.select("conv_id", "turn", rules.type_hint(F.col("text")).alias("kind"), rules.entity(F.col("text")).alias("entity"))


_COUNT = lambda words: " + ".join(f"contains(t, '{w}')::INT" for w in words)


@query(
    "sentiment_rule",
    f"""
    WITH c AS (SELECT conv_id, turn, lower(text || [' ótimo', ' péssimo', ' bom e ruim', ''][turn % 4 + 1]) AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN {_COUNT(fixed.POSITIVE_WORDS)} > {_COUNT(fixed.NEGATIVE_WORDS)} THEN 'Positivo'
        WHEN {_COUNT(fixed.NEGATIVE_WORDS)} > {_COUNT(fixed.POSITIVE_WORDS)} THEN 'Negativo' ELSE 'Neutro' END AS sentiment FROM c""",
)
def sentiment_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*[F.lit(x) for x in (" ótimo", " péssimo", " bom e ruim", "")])
    text = F.concat("text", F.element_at(ends, (F.col("turn") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sentiment(text).alias("sentiment"))


@query(
    "collection_of_type",
    "SELECT doc_id, CASE source WHEN 'src0' THEN 'cursos' WHEN 'src1' THEN 'servidores' ELSE 'portal_geral' END AS collection FROM documents",
)
def collection_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("source") == "src0", "curso").when(F.col("source") == "src1", "servidor").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", rules.collection_of(kind).alias("collection"))
