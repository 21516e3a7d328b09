"""Queries of retrieval and generation quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lcs_length, space_tokens, truncated
from ..operators import evaluate, lexical
from ..sources.io import table
from ..sources.stored import stored
from .lexical_queries import BM25, hashed, questions
from .providers import HashingEmbedder
from .registry import query

JUDGED = f"""
    {BM25},
    j AS (
        SELECT query_id, rank, contains(lower(d.text), lower(b.text)) OR contains(lower(b.text), lower(d.text)) AS rel
        FROM bmr JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 5),
    x AS (SELECT query_id, min(rank) FILTER (rel) AS first_rank, count(*) FILTER (rel) AS hits, count(rank) AS returned FROM j GROUP BY query_id)"""


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    found = lexical.bm25(asked, docs, 5).select("query_id", "doc_id", "rank")
    joined = found.join(docs.select("doc_id", "text"), "doc_id").join(asked.select("query_id", F.col("text").alias("wanted")), "query_id")
    judged = joined.select("query_id", "rank", evaluate.relevant_by_text(F.col("text"), F.col("wanted")).alias("relevant"))
    return evaluate.ranking_details(judged)


@query("ranking_details", f"WITH {JUDGED} SELECT * FROM x")
def ranking_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details(spark, sf_dir)


@query(
    "mrr_recall_precision",
    f"""WITH {JUDGED} SELECT count(*) AS queries, round(avg(coalesce(1 / first_rank, 0)), 6) AS mrr,
    round(avg((hits > 0)::INT), 6) AS recall, round(avg(hits / returned), 6) AS precision FROM x""",
)
def mrr_recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = evaluate.ranking_quality(details(spark, sf_dir))
    return quality.select("queries", *[F.round(c, 6).alias(c) for c in ("mrr", "recall", "precision")])


@query(
    "recall_precision_at_k",
    """
    WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey) AS rec,
        list(o_orderkey) FILTER (o_totalprice > 250000) AS rel FROM orders GROUP BY o_custkey)
    SELECT o_custkey,
           round(CASE WHEN len(rel) > 0 THEN len(list_intersect(rec[1:3], rel)) / len(rel) ELSE 0 END, 6) AS recall_3,
           round(len(list_intersect(rec[1:3], coalesce(rel, []))) / 3, 6) AS precision_3 FROM o""",
)
def recall_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's latest orders as results, the dear ones as relevant."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct(-F.unix_micros(F.col("o_orderdate").cast("timestamp")), "o_orderkey"))).alias("by"),
        F.collect_list(F.when(F.col("o_totalprice") > 250000, F.col("o_orderkey"))).alias("rel"),
    )
    rec = F.transform("by", lambda s: s["o_orderkey"])
    return per.select(
        "o_custkey",
        F.round(evaluate.recall_at(F.col("rel"), rec, 3), 6).alias("recall_3"),
        F.round(evaluate.precision_at(F.col("rel"), rec, 3), 6).alias("precision_3"),
    )


#: In SQL: the longest common subsequence of the lists a and b of p (id, a, b), a row of the table a step.
COMMON = """
    r AS (
        SELECT id, a, b, 0 AS i, list_transform(a, lambda x: 0) AS row FROM p
        UNION ALL
        SELECT id, a, b, i + 1, list_transform(range(1, len(a) + 1), lambda j: list_max(list_slice(c, 1, j))) FROM (
            SELECT *, list_transform(range(1, len(a) + 1), lambda j:
                greatest(row[j], CASE WHEN a[j] = b[i + 1] THEN coalesce(CASE WHEN j > 1 THEN row[j - 1] END, 0) + 1 ELSE 0 END)) AS c
            FROM r WHERE i < len(b))),
    lcs AS (SELECT id, len(a) AS na, len(b) AS nb, coalesce(list_max(row), 0) AS common FROM r WHERE i = len(b))"""


@query(
    "rouge_l",
    f"""
    WITH RECURSIVE p AS (
        SELECT (a.conv_id, a.turn) AS id, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS a, regexp_extract_all(lower(q.text), '[a-z0-9]+') AS b
        FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1
        WHERE a.role = 'assistant' AND q.role = 'user'),
    {COMMON},
    s AS (SELECT id, CASE WHEN na > 0 THEN common / na ELSE 0 END AS p, CASE WHEN nb > 0 THEN common / nb ELSE 0 END AS r FROM lcs)
    SELECT id[1] AS conv_id, id[2] AS turn, round(p, 4) AS precision, round(r, 4) AS recall,
           round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM s""",
)
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer against the question before it; a fold over both texts' words."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    pairs = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    r = evaluate.rouge_l(F.col("text"), F.col("question"))
    return pairs.select("conv_id", "turn", r.alias("r")).select(
        "conv_id", "turn", *[F.round(f"r.{c}", 4).alias(c) for c in ("precision", "recall", "f1")]
    )


#: In SQL: answers and the questions before them as lists of words.
TURNS = """
    pairs AS (
        SELECT a.conv_id * 1000 + a.turn AS id, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS a, regexp_extract_all(lower(q.text), '[a-z0-9]+') AS b
        FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1
        WHERE a.role = 'assistant' AND q.role = 'user')"""
#: In SQL: of pairs (id, a, b) the greedy alignment of words by their trigrams, weighted by rarity.
ALIGNED = r"""
    total AS (SELECT count(*) AS n FROM pairs),
    token_df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(b)) AS token FROM pairs) GROUP BY token),
    w AS (SELECT token, ln((n + 1) / (df + 1)) AS weight FROM token_df, total),
    t AS (
        SELECT id, side, token, count(*) AS times,
               list_distinct(list_transform(range(1, length(token) + 2), lambda i: substr('  ' || token || ' ', i, 3))) AS g
        FROM (SELECT id, 0 AS side, unnest(a) AS token FROM pairs UNION ALL SELECT id, 1 AS side, unnest(b) AS token FROM pairs) GROUP BY ALL),
    best AS (
        SELECT x.id, x.side, x.token, x.times, max(len(list_intersect(x.g, y.g)) / sqrt(len(x.g) * len(y.g))) AS s
        FROM t x JOIN t y ON y.id = x.id AND y.side = 1 - x.side GROUP BY ALL),
    sums AS (
        SELECT id, side, sum(times * coalesce(weight, 1)) AS total, sum(times * coalesce(weight, 1) * s) AS got, sum(times) AS plain, sum(times * s) AS plain_got
        FROM best LEFT JOIN w USING (token) GROUP BY id, side),
    m AS (SELECT id, side, CASE WHEN total > 0 THEN got / total ELSE plain_got / plain END AS v FROM sums),
    pr AS (SELECT id, coalesce(max(v) FILTER (side = 0), 0) AS p, coalesce(max(v) FILTER (side = 1), 0) AS r FROM pairs LEFT JOIN m USING (id) GROUP BY id)"""


@query(
    "aligned_token_score",
    f"""WITH {TURNS}, {ALIGNED} SELECT id, round(p, 6) AS precision, round(r, 6) AS recall,
    round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr""",
)
def aligned_token_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer against the question before it, by greedily aligned token vectors; rare words weigh more."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    pairs = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    pairs = pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("candidate"), "reference")
    found = evaluate.aligned_score(pairs, evaluate.token_weights(pairs.select(F.col("reference").alias("text"))))
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "lcs_of_part_names",
    f"""
    WITH RECURSIVE p AS (
        SELECT DISTINCT (p_name, p_type) AS id, string_split(p_name, ' ') AS a, string_split(lower(p_type || ' ' || p_name), ' ') AS b FROM part),
    {COMMON}
    SELECT id[1] AS p_name, id[2] AS p_type, common::BIGINT AS common FROM lcs""",
)
def lcs_of_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequences of short word lists: a part's name, and its type and name in small letters."""
    parts = table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    common = lcs_length(space_tokens(F.col("p_name")), space_tokens(F.lower(F.concat_ws(" ", "p_type", "p_name"))))
    return parts.select("p_name", "p_type", common.cast("long").alias("common"))


@query(
    "answer_groundedness",
    """
    WITH a AS (
        SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(lower(a.text), '[a-z0-9]+')) AS w,
               regexp_extract_all(lower(q.text), '[a-z0-9]+') AS c
        FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1
        WHERE a.role = 'assistant' AND q.role = 'user')
    SELECT conv_id, turn, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, c)) / len(w) ELSE 0 END, 6) AS share FROM a""",
)
def answer_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    pairs = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    share = evaluate.groundedness(F.col("text"), F.col("question"))
    return pairs.select("conv_id", "turn", F.round(share, 6).alias("share"))


@query(
    "evaluation_suite",
    rf"""
    WITH RECURSIVE {JUDGED},
    answers AS (
        SELECT item_id AS query_id, b.text AS reference, CASE WHEN length(d.text) > 300 THEN left(d.text, 300) || '…' ELSE d.text END AS answer
        FROM benchmark b LEFT JOIN (SELECT query_id, documents.text FROM bmr JOIN documents USING (doc_id) WHERE rank = 1) d ON d.query_id = item_id),
    pairs AS (
        SELECT query_id AS id, regexp_extract_all(lower(coalesce(answer, '')), '[a-z0-9]+') AS a, regexp_extract_all(lower(reference), '[a-z0-9]+') AS b
        FROM answers),
    {ALIGNED}, p AS (SELECT * FROM pairs), {COMMON},
    rouge AS (
        SELECT id, CASE WHEN common > 0 THEN 2 * (common / na) * (common / nb) / (common / na + common / nb) ELSE 0 END AS f1 FROM lcs),
    texts AS (SELECT query_id * 2 AS row, answer AS text FROM answers UNION ALL SELECT query_id * 2 + 1, reference FROM answers),
    {hashed("e", "texts", "row")},
    near AS (SELECT x.row // 2 AS id, list_cosine_similarity(x.v, y.v) AS s FROM e_v x JOIN e_v y ON y.row = x.row + 1 AND x.row % 2 = 0)
    SELECT answers.query_id, round(coalesce(1 / first_rank, 0), 6) AS reciprocal_rank, coalesce(hits, 0) AS hits, coalesce(returned, 0) AS returned,
           round(coalesce(near.s, 0), 6) AS cosine, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS aligned_f1, round(rouge.f1, 6) AS rouge_f1
    FROM answers LEFT JOIN x ON x.query_id = answers.query_id LEFT JOIN near ON near.id = answers.query_id
    JOIN pr ON pr.id = answers.query_id JOIN rouge ON rouge.id = answers.query_id""",
)
def evaluation_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of each benchmark text as a question: five documents by BM25, the first one's beginning as the answer."""
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    found = stored(lexical.bm25(asked, docs, 5).select("query_id", "doc_id", "rank"), "results")
    first = found.where("rank = 1").join(docs.select("doc_id", "text"), "doc_id").select("query_id", truncated(F.col("text"), 300).alias("answer"))
    wanted = asked.select("query_id", F.col("text").alias("wanted"), F.col("text").alias("reference"))
    weights = evaluate.token_weights(asked)
    measures = evaluate.composed(wanted, found, docs, first, HashingEmbedder(), weights=weights)
    return measures.select("query_id", "hits", "returned", *[F.round(c, 6).alias(c) for c in ("reciprocal_rank", "cosine", "aligned_f1", "rouge_f1")])
