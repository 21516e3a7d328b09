"""Queries of lexical retrieval and fusion: benchmark texts as questions to documents, part names as titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cites, tokens, trigrams
from ..operators import fusion, lexical
from ..operators.nested import projects_of
from ..sources.io import table
from .answering import Config, dense, keyword_search
from .registry import query

#: In SQL: BM25 of every benchmark text and document with a common word.
BM25 = r"""
    tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(trim(text, E' \t\n\r'), '\s+'), lambda w: w <> '')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    dl AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY d.doc_id),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
    idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    q AS (
        SELECT item_id AS query_id, term, count(*) AS times
        FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(trim(text, E' \t\n\r'), '\s+'), lambda w: w <> '')) AS term FROM benchmark)
        GROUP BY ALL),
    bm AS (
        SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
        FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
    bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)"""


def hashed(name: str, source: str, id: str) -> str:
    """In SQL: the hashing embedder's vectors."""
    return rf"""
    {name}_tok AS (
        SELECT {id}, concat('0x', substr(md5(t), 1, 8))::BIGINT % 64 AS b
        FROM (SELECT {id}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS t FROM {source})),
    {name}_n AS (SELECT {id}, b, count(*) AS n FROM {name}_tok GROUP BY ALL),
    {name}_v AS (SELECT {id}, list(coalesce(n, 0)::DOUBLE ORDER BY k) AS v FROM (
        SELECT i.{id}, k, n FROM (SELECT DISTINCT {id} FROM {name}_n) i CROSS JOIN range(64) t(k)
        LEFT JOIN {name}_n x ON x.{id} = i.{id} AND x.b = k) GROUP BY {id})"""


DENSE = f"""
    {hashed("d", "documents", "doc_id")}, {hashed("b", "benchmark", "item_id")},
    ds AS (SELECT item_id AS query_id, doc_id, list_cosine_similarity(b_v.v, d_v.v) AS score FROM b_v, d_v),
    dsr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - score, 9), doc_id) AS rank FROM ds)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def ranked_lists(spark: SparkSession, sf_dir: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(dense, lexical) rankings of documents for every benchmark text."""
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    return dense(asked, docs, Config(top_k_retrieve=k)), lexical.bm25(asked, docs, k)


@query(
    "bm25_topk",
    f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 5",
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.bm25(questions(spark, sf_dir), table(spark, sf_dir, "documents"), 5)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "dense_text_topk",
    f"WITH {DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dsr WHERE rank <= 5",
)
def dense_text_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense(questions(spark, sf_dir), table(spark, sf_dir, "documents"), Config(top_k_retrieve=5))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "rrf_hybrid",
    f"""
    WITH {BM25}, {DENSE},
    f AS (
        SELECT query_id, doc_id, sum(p) AS score FROM (
            SELECT query_id, doc_id, 0.5 / (60 + rank) AS p FROM bmr WHERE rank <= 10 UNION ALL
            SELECT query_id, doc_id, 0.5 / (60 + rank) FROM dsr WHERE rank <= 10) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f)
    SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r""",
)
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to twice as many as each list has."""
    by_vector, by_word = ranked_lists(spark, sf_dir)
    lexical_weight, dense_weight = fusion.hybrid_weights(0.5)
    fused = fusion.reciprocal_rank_fusion([(by_vector, dense_weight), (by_word, lexical_weight)])
    found = lexical.ranked(fused, 20)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


#: In SQL: both lists' scores, scaled.
FUSED = """
    u AS (
        SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id,
               coalesce(a.score, 0) AS ds, coalesce(b.score, 0) AS bs
        FROM (SELECT * FROM dsr WHERE rank <= 10) a
        FULL JOIN (SELECT * FROM bmr WHERE rank <= 10) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
    s AS (
        SELECT query_id, doc_id,
               (ds - min(ds) OVER w) / (max(ds) OVER w - min(ds) OVER w + 1e-8) AS ds,
               bs / CASE WHEN max(bs) OVER w = 0 THEN 1 ELSE max(bs) OVER w END AS bs
        FROM u WINDOW w AS (PARTITION BY query_id))"""


@query(
    "score_fusion_hybrid",
    f"""
    WITH {BM25}, {DENSE}, {FUSED},
    r AS (
        SELECT query_id, doc_id, 0.5 * ds + 0.5 * bs AS score,
               row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * ds + 0.5 * bs, 9) DESC, doc_id) AS rank
        FROM s)
    SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
)
def score_fusion_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_vector, by_word = ranked_lists(spark, sf_dir)
    found = lexical.ranked(fusion.score_fusion(by_vector, by_word, F.lit(0.5)), 5)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "alpha_sweep",
    f"""
    WITH {BM25}, {DENSE}, {FUSED},
    a AS (SELECT *, a * ds + (1 - a) * bs AS score FROM s, (SELECT unnest([0, 0.3, 0.5, 0.7, 1])::DOUBLE AS a)),
    r AS (SELECT *, row_number() OVER (PARTITION BY a, query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM a)
    SELECT a AS alpha, query_id, doc_id, round(score, 6) AS score FROM r WHERE rank = 1""",
)
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_vector, by_word = ranked_lists(spark, sf_dir)
    fused = fusion.score_fusion(by_vector, by_word, F.lit(0.0)).drop("score")
    swept = fused.select("*", F.explode(F.array(*[F.lit(float(a)) for a in (0, 0.3, 0.5, 0.7, 1)])).alias("alpha"))
    swept = swept.withColumn("score", F.col("alpha") * F.col("dense") + (1 - F.col("alpha")) * F.col("lexical"))
    order = Window.partitionBy("alpha", "query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    best = swept.withColumn("n", F.row_number().over(order)).where("n = 1")
    return best.select("alpha", "query_id", "doc_id", F.round("score", 6).alias("score"))


@query(
    "overlap_rerank",
    rf"""
    WITH {BM25},
    w AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS has FROM documents),
    b AS (SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS asked FROM benchmark),
    s AS (
        SELECT query_id, doc_id, CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, has)) / len(asked) ELSE 0 END AS s
        FROM bmr JOIN w ON w.id = doc_id JOIN b ON b.id = query_id WHERE rank <= 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM s)
    SELECT query_id, doc_id, round(s, 6) AS rerank_score, rank FROM r WHERE rank <= 4""",
)
def overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    found = fusion.overlap_rerank(lexical.bm25(asked, docs, 10), asked, docs, 4)
    return found.select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


TERMS = ["mit license", "apache", "secret", "token"]


@query(
    "ilike_any_term",
    "SELECT doc_id FROM documents WHERE " + " OR ".join(f"text ILIKE '%{t}%'" for t in TERMS),
)
def ilike_any_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.any_term(table(spark, sf_dir, "documents"), TERMS).select("doc_id")


_PLACES = ", ".join(f"nullif(instr(lower(text), '{t}'), 0)" for t in TERMS)


@query(
    "snippet_extract",
    f"""
    WITH d AS (SELECT doc_id, text, coalesce({_PLACES}) AS p FROM documents)
    SELECT doc_id, CASE WHEN p IS NULL THEN left(text, 250)
        ELSE substr(text, greatest(p - 100, 1), p + 300 - greatest(p - 100, 1)) END AS snippet FROM d""",
)
def snippet_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import snippet

    return table(spark, sf_dir, "documents").select("doc_id", snippet(F.col("text"), TERMS).alias("snippet"))


@query(
    "keyword_union_search",
    """
    WITH k AS (SELECT i AS ix, w FROM (SELECT unnest([1, 2, 3]) AS i, unnest(['license', 'secret', 'token']) AS w)),
    m AS (
        SELECT ix, doc_id, text, row_number() OVER (PARTITION BY ix ORDER BY instr(lower(text), w), doc_id) AS rank
        FROM documents, k WHERE instr(lower(text), w) > 0),
    f AS (SELECT *, row_number() OVER (PARTITION BY left(text, 150) ORDER BY ix, rank) AS nth FROM m WHERE rank <= 50)
    SELECT doc_id, ix AS keyword, rank FROM f WHERE nth = 1""",
)
def keyword_union_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of each keyword (earliest mention first); of texts that begin alike the first keyword's."""
    words = F.array(*[F.struct(F.lit(k).alias("ix"), F.lit(w).alias("w")) for k, w in ((1, "license"), (2, "secret"), (3, "token"))])
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(words).alias("k"))
    found = docs.withColumn("place", F.expr("instr(lower(text), k.w)")).where("place > 0")
    order = Window.partitionBy("k.ix").orderBy("place", "doc_id")
    found = found.withColumn("rank", F.row_number().over(order)).where("rank <= 50").withColumn("query_id", F.lit(0))
    first = fusion.first_by_prefix(found, "text", [F.col("k.ix"), F.col("rank")])
    return first.select("doc_id", F.col("k.ix").alias("keyword"), "rank")


@query(
    "trigram_jaccard_pairs",
    """
    WITH n AS (SELECT DISTINCT p_name AS name FROM part),
    t AS (SELECT name, list_distinct(list_transform(range(1, length(name) + 3), lambda i: substr('  ' || name || '  ', i, 3))) AS g FROM n),
    s AS (SELECT a.name AS a, b.name AS b, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS s
          FROM t a JOIN t b ON a.name < b.name)
    SELECT a, b, round(s, 6) AS similarity FROM s WHERE s >= 0.3""",
)
def trigram_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct()
    found = lexical.trigram_pairs(names, names, trigrams, 0.3, ascending=True)
    return found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.round("similarity", 6).alias("similarity"))


#: In SQL: word trigrams of part names and of what part types and brands spell in words.
WORD_TRIGRAMS = r"""
    g AS (
        SELECT id, name, list_distinct(flatten(list_transform(regexp_extract_all(lower(name), '[\p{L}\p{N}]+'),
            lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM names),
    s AS (
        SELECT q.id AS query_id, d.id AS doc_id, d.name AS doc_name,
               len(list_intersect(q.g, d.g)) / len(list_distinct(list_concat(q.g, d.g))) AS s
        FROM g q, g d WHERE q.id <> d.id)"""
NAMES = "names AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name)"


def title_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every part name as a question, and as a title of other names."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return names, names


@query(
    "pgtrgm_title_lookup",
    f"""
    WITH {NAMES}, {WORD_TRIGRAMS},
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM s WHERE s >= 0.35)
    SELECT query_id, doc_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 3""",
)
def pgtrgm_title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.title_lookup(*title_sides(spark, sf_dir), others=True)
    return found.select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    "entity_best_tie_band",
    f"""
    WITH {NAMES}, {WORD_TRIGRAMS},
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM s WHERE s >= 0.3),
    t AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS best FROM r WHERE rank <= 5),
    p AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
            CASE WHEN s >= best - 0.05 - 1e-12 AND doc_name LIKE '%ring' THEN 1 ELSE 0 END DESC, round(s, 9) DESC, doc_id) AS n
        FROM t)
    SELECT query_id, doc_id, round(s, 6) AS similarity FROM p WHERE n = 1""",
)
def entity_best_tie_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, titles = title_sides(spark, sf_dir)
    found = lexical.title_lookup(asked, titles, k=5, least=0.3, others=True)
    found = found.join(titles.select(F.col("id").alias("doc_id"), "name"), "doc_id")
    picked = lexical.best_in_tie_band(found, F.col("name").endswith("ring"))
    return picked.select("query_id", "doc_id", F.round("similarity", 6).alias("similarity"))


@query(
    "source_cutoff",
    f"""
    WITH {BM25},
    s AS (SELECT query_id, coalesce(source, 'documento') AS source, max(score) AS score
          FROM bmr JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY ALL),
    t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM s)
    SELECT query_id, source, round(score, 6) AS score FROM t WHERE score >= 0.85 * top""",
)
def source_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lexical.bm25(questions(spark, sf_dir), docs, 10).join(docs.select("doc_id", "source"), "doc_id")
    return fusion.sources_near_best(found).select("query_id", "source", F.round("score", 6).alias("score"))


@query(
    "title_word_citation",
    f"""
    WITH {BM25},
    p AS (
        SELECT query_id, doc_id, lower(b.text) AS title, lower(d.text) AS answer FROM bmr
        JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10),
    w AS (SELECT *, list_filter(regexp_split_to_array(trim(title, E' \\t\\n\\r'), '\\s+'), lambda x: length(x) > 3) AS ws FROM p)
    SELECT query_id, doc_id, len(ws) > 0 AND len(list_filter(ws, lambda x: contains(answer, x))) >= greatest(1, len(ws) // 2) AS cited
    FROM w""",
)
def title_word_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document (the answer) has half of a benchmark text's (the title's) long words."""
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    found = lexical.bm25(asked, docs, 10).select("query_id", "doc_id")
    joined = found.join(docs.select("doc_id", F.col("text").alias("answer")), "doc_id").join(asked, "query_id")
    return joined.select("query_id", "doc_id", cites(F.col("answer"), F.col("text")).alias("cited"))


@query(
    "related_members_exists",
    """
    WITH names AS (SELECT c_custkey AS asker, upper(c_name) AS name FROM customer),
    projects AS (
        SELECT o_orderkey, o_orderdate, c.c_name AS coordinator, n.c_name AS member
        FROM orders JOIN customer c ON c.c_custkey = o_custkey
        JOIN customer n ON n.c_custkey = (o_custkey * 7 + 3) % (SELECT count(*) FROM customer)),
    own AS (
        SELECT asker, o_orderkey AS project, row_number() OVER (PARTITION BY asker ORDER BY strftime(o_orderdate, '%d/%m/%Y') DESC, o_orderkey::VARCHAR) AS nth
        FROM projects JOIN names ON upper(coordinator) = name),
    kept AS (SELECT * FROM own WHERE nth <= 10),
    few AS (SELECT n.asker, n.name FROM names n LEFT JOIN (SELECT asker, count(*) AS k FROM kept GROUP BY asker) USING (asker) WHERE coalesce(k, 0) < 5),
    team AS (
        SELECT asker, o_orderkey AS project, row_number() OVER (PARTITION BY asker ORDER BY strftime(o_orderdate, '%d/%m/%Y') DESC, o_orderkey::VARCHAR) AS nth
        FROM projects JOIN few ON upper(member) = name WHERE upper(coordinator) <> name)
    SELECT asker, project::VARCHAR AS project, 1 AS step, nth FROM kept UNION ALL
    SELECT asker, project::VARCHAR, 2, nth FROM team WHERE nth <= 10""",
)
def related_members_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as projects: their customer coordinates, another one is in the team."""
    customers = table(spark, sf_dir, "customer")
    n = customers.count()
    names = customers.select(F.col("c_custkey").alias("asker"), F.upper("c_name").alias("name"))
    people = customers.select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = orders.withColumn("other", (F.col("o_custkey") * 7 + 3) % n)
    named = orders.join(people.toDF("o_custkey", "coordinator"), "o_custkey").join(people.toDF("other", "member"), "other")
    projects = named.select(
        F.col("o_orderkey").cast("string").alias("project"),
        "coordinator",
        F.array(F.concat("member", F.lit(" — membro"))).alias("team"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("start"),
    )
    return projects_of(names, projects, 10)


@query(
    "keyword_vector_search",
    rf"""
    WITH {hashed("d", "documents", "doc_id")},
    words AS (
        SELECT item_id AS query_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 6)))[1:3] AS ws FROM benchmark),
    kw AS (SELECT query_id, len(ws) AS n, unnest(ws) AS text, unnest(range(len(ws))) AS nth FROM words),
    uniq AS (SELECT DISTINCT text, text AS word FROM kw),
    {hashed("k", "uniq", "word")},
    s AS (SELECT word, doc_id, list_cosine_similarity(k_v.v, d_v.v) AS score FROM k_v, d_v),
    r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(1 - score, 9), doc_id) AS rank FROM s),
    f AS (
        SELECT query_id, nth, rank, doc_id, score, documents.text FROM kw JOIN r ON r.word = kw.text JOIN documents USING (doc_id)
        WHERE rank <= greatest(2, ceil(4 / n)) + 1),
    u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, left(text, 150) ORDER BY nth, rank) = 1)
    SELECT query_id, doc_id, round(score, 6) AS score, place AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM u) WHERE place <= 4""",
)
def keyword_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question by its first three long words in order of the alphabet, one vector search a word."""
    long_words = F.filter(F.array_distinct(tokens(F.col("text"))), lambda w: F.length(w) > 6)
    asked = questions(spark, sf_dir).select("query_id", F.slice(F.array_sort(long_words), 1, 3).alias("keywords"))
    found = keyword_search(asked, table(spark, sf_dir, "documents"), Config(), 4)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")
