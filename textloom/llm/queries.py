"""The contract's query of each operator, over its whole table, and its SQL twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cells, collocations, decontam, exact, langid, licenses, lm, minhash, periodic, substring, tokenstore, warc
from .common import table
from .decontam import SLOP
from .licenses import PHRASES, THRESHOLD, template_words, word_count
from .notices import TEMPLATES, VERSIONS

#: Runs of alphanumeric words in the SQL twins.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), size=2)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return tokenstore.stored(table(spark, sf_dir, "documents"), path, end_id=2).withColumnRenamed("digest", "ids_crc32")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, lm.remainder("doc_id", 5) != 0)
    held_out = F.coalesce(lm.remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out")
    return langid.predicted(docs, model).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"), lm.remainder("doc_id", 7) == 2)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The pages have no time of capture; one second after another by page_id stands in.
    captured = F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0))
    return warc.archived(table(spark, sf_dir, "pages"), captured)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.near_groups(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = periodic.looped(table(spark, sf_dir, "documents"), lambda h: h % 10 == 0)
    best = F.col("best")
    return periodic.periodic_runs(texts).select(
        "doc_id",
        "n_runs",
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_near_dedup": op2_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_store": op4_token_store,
    "op5_language_id": op5_language_id,
    "op6_lm_score": op6_lm_score,
    "op7_warc": op7_warc,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_license_scan": op10_license_scan,
    "op11_collocations": op11_collocations,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}


def sql_list(words: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


PHRASE_ROWS = ", ".join(f"('{label}', {sql_list(p.split())})" for p, label in PHRASES)
TEMPLATE_ROWS = ", ".join(f"('{label}', {sql_list(template_words(t))}, {2 * word_count(t)}, ' {mark} ')" for label, t, mark in TEMPLATES)
GENERAL_ROWS = ", ".join(f"('{general}', {sql_list(specific)})" for general, specific in VERSIONS.items())

ORACLES: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        wins AS (
            SELECT doc_id, s, sha256(array_to_string(list_slice(w, s, s + 34), ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p
            FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS n FROM wins) WHERE n > 1),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
            FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_exact_dedup": f"""
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op9_decontamination": f"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w
            FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w
            FROM benchmark),
        bw AS (
            SELECT item_id, list_slice(w, s, s + 12) AS win
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
        dw AS (
            SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (win)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
            SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id),
        terms AS (SELECT DISTINCT doc_id, unnest(w) AS t FROM d),
        seen AS (SELECT t, count(*) AS n FROM terms GROUP BY t),
        rare AS (
            SELECT win, arg_min(t, coalesce(n, 0)) AS t FROM (SELECT DISTINCT win, unnest(win) AS t FROM bw)
            LEFT JOIN seen USING (t) GROUP BY win),
        likely AS (SELECT doc_id, w, win FROM rare JOIN terms USING (t) JOIN d USING (doc_id) WHERE list_has_all(w, win)),
        near AS (
            SELECT doc_id, count(*) AS n_near FROM likely
            WHERE len(list_filter(range(-{SLOP}, len(w) + {SLOP}), lambda s: len(list_filter(
                range(0, len(win)),
                lambda k: NOT list_contains(list_slice(w, greatest(s + k - {SLOP}, 0) + 1, s + k + {SLOP} + 1), win[k + 1])
            )) = 0)) > 0
            GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
               sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
               coalesce(n_near, 0) AS n_near
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op10_license_scan": f"""
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t,
                   regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w
            FROM documents),
        p(label, ws) AS (VALUES {PHRASE_ROWS}),
        m(label, ws, block, mark) AS (VALUES {TEMPLATE_ROWS}),
        g(label, versions) AS (VALUES {GENERAL_ROWS}),
        places AS (
            SELECT doc_id, label, s - 1 AS place FROM (
                SELECT doc_id, label, w, ws, unnest(range(1, len(w) - len(ws) + 2)) AS s
                FROM d, p WHERE len(w) >= len(ws) AND contains(t, ws[1]))
            WHERE list_slice(w, s, s + len(ws) - 1) = ws),
        base AS (
            SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z, list(DISTINCT label) AS ls
            FROM places GROUP BY doc_id),
        paragraphs AS (
            SELECT doc_id, regexp_extract_all(paragraph, '{ALNUM}') AS ws
            FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\\n[ \\t\\r]*\\n')) AS paragraph FROM d)),
        likely AS (
            SELECT doc_id, label, paragraphs.ws AS w, m.ws AS ws, block, mark, ceil({THRESHOLD} * len(m.ws) - 1e-9) AS needed
            FROM paragraphs, m WHERE len(list_intersect(m.ws, paragraphs.ws)) >= ceil({THRESHOLD} * len(m.ws) - 1e-9)),
        joined AS (
            SELECT doc_id, label, c / len(ws) AS c FROM (
                SELECT doc_id, label, ws, needed, len(list_intersect(ws, list_slice(w, s, s + block - 1))) AS c
                FROM (SELECT *, unnest(range(1, len(w) + 1)) AS s FROM likely)
                WHERE contains(' ' || array_to_string(list_slice(w, s, s + block - 1), ' ') || ' ', mark))
            WHERE c >= needed),
        best AS (SELECT doc_id, list(DISTINCT label) AS ls, max(c) AS best FROM joined GROUP BY doc_id),
        gone AS (
            SELECT doc_id, list(DISTINCT g.label) AS ls FROM joined, g WHERE list_contains(versions, joined.label) GROUP BY doc_id),
        found AS (
            SELECT doc_id, best, list_filter(best.ls, lambda x: gone.ls IS NULL OR NOT list_contains(gone.ls, x)) AS ls
            FROM best LEFT JOIN gone USING (doc_id))
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word,
               coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(base.ls, found.ls))), ','), '') AS labels,
               CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
        FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op11_collocations": rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        d AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        f AS (
            SELECT lang, list_slice(w, s, s + k - 1) AS p, count(*) AS a FROM (
                SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)
            GROUP BY ALL),
        totals AS (SELECT lang, sum(a) AS n FROM f WHERE len(p) = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE len(p) > 1 AND a >= 10),
        parts AS (
            SELECT lang, p, a, k, list_slice(p, 1, k) AS left_part, list_slice(p, k + 1, len(p)) AS right_part
            FROM (SELECT *, unnest(range(1, len(p))) AS k FROM c)),
        cuts AS (
            SELECT parts.lang, parts.p, parts.a, k, x.a AS l, y.a AS r,
                   (1000000::HUGEINT * parts.a * parts.a) // (x.a::HUGEINT * y.a) AS score
            FROM parts JOIN f x ON x.lang = parts.lang AND x.p = left_part JOIN f y ON y.lang = parts.lang AND y.p = right_part),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        longer AS (
            SELECT lang, p, max(a) AS longest FROM (
                SELECT lang, list_slice(p, 1, 2) AS p, a FROM c WHERE len(p) = 3
                UNION ALL SELECT lang, list_slice(p, 2, 3) AS p, a FROM c WHERE len(p) = 3)
            GROUP BY ALL),
        ranked AS (
            SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score
            FROM best LEFT JOIN longer USING (lang, p) WHERE longest IS NULL OR 100 * longest < 50 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
               phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM ranked JOIN totals USING (lang) QUALIFY rank <= 2000""",
}
