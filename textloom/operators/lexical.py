"""Lexical retrieval: BM25 over an inverted index, any-term search and title lookup by trigrams."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import contains_any, snippet, space_tokens, word_trigrams
from ..sources.stored import spread, stored
from .search import least_of


#: Rows of its rarest terms that a query's first bound comes from, for each row that is asked for.
SEED_ROWS = 20
#: Words of 64 bits of a trigram set's bitmap.
BITMAP_WORDS = 4
#: Documents and queries of one block of BM25.
DOCUMENT_BLOCK, QUERY_BLOCK = 8192, 2048


def bm25(
    queries: DataFrame, docs: DataFrame, k: int, tokenize: Callable[[Column], Column] = space_tokens
) -> DataFrame:
    """query_id, doc_id, score, rank of the k best of docs (doc_id, text) for each query (query_id, text).

    Okapi weights; a term in over half of the documents takes BM25_EPSILON of the mean idf. A query's repeated
    terms count each time. Documents without any of a query's terms are not ranked. Ties to nine decimals go to
    the smaller doc_id. The result is exact, and few of the scores leave the task that makes them: see bounded_scores.
    """
    return ranked(bounded_scores(weighted_postings(queries, docs, tokenize), k), k)


def weighted_postings(queries: DataFrame, docs: DataFrame, tokenize: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(asked, postings): query_id, term, factor (idf and times), df, most (the largest weight in any document); and
    doc_id, term, weight of the documents' terms that some query has. All are stored. Texts are gone through
    twice: for the frequencies of all terms, counted where the documents are read, and for the postings of asked terms."""
    words = spread(docs.select("doc_id", "text")).select("doc_id", tokenize(F.coalesce("text", F.lit(""))).alias("words"))
    asked = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term"))
    asked = stored(asked.groupBy("query_id", "term").agg(F.count("*").alias("times")), "query-terms")
    # Each document also names a null term, which counts the documents and their words.
    each = words.select(F.size("words").alias("dl"), F.explode(F.array_append(F.array_distinct("words"), F.lit(None).cast("string"))).alias("term"))
    df = stored(each.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("words")), "term-frequencies")
    n, total = (df.where("term IS NULL").select("df", "words").first() or (0, 0))
    raw = df.where("term IS NOT NULL").select("term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    terms = asked.select("term").distinct()
    idf = raw.join(terms, "term", "left_semi").join(F.broadcast(mean))
    idf = idf.select("term", "df", F.when(F.col("raw") < 0, fixed.BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    token = words.select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("term")).join(terms, "term", "left_semi")
    tf = token.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    k1, b = fixed.BM25_K1, fixed.BM25_B
    share = 1 - b + b * F.col("dl") / (total / n if n else 1.0)
    postings = stored(tf.select("doc_id", "term", (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * share)).alias("weight")), "postings")
    most = postings.groupBy("term").agg(F.max("weight").alias("most"))
    asked = asked.join(idf, "term").join(most, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("factor"), "df", "most")
    return stored(asked, "asked-terms"), postings


def essential_terms(asked: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """asked with bound, least (a score that k documents of the query reach), rest, and essential: which lists a search by lists must read.

    Documents of a query's rarest terms are scored in full; the k-th best of these scores is a bound from below. Terms
    whose largest weights together stay under this bound are not essential: a document with no other terms can't be
    among the k best. rest is what they can add.
    """
    query = Window.partitionBy("query_id")
    rarest = query.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumn("bound", F.greatest(F.col("factor") * F.col("most"), F.lit(0.0)))
    seeds = asked.withColumn("before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("before") < SEED_ROWS * k)
    some = seeds.select("query_id", "term").join(postings, "term").select("query_id", "doc_id").distinct()
    first = scored_in_full(some, asked, postings)
    reached = first.withColumn("nth", F.row_number().over(query.orderBy(F.desc("score")))).where(F.col("nth") == k)
    asked = asked.join(reached.select("query_id", F.col("score").alias("least")), "query_id", "left")
    weakest = query.orderBy("bound", F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    # Ties to nine decimals count as reached.
    out = asked.withColumn("essential", F.coalesce(F.sum("bound").over(weakest) >= F.col("least") - 1e-8, F.lit(True)))
    return out.withColumn("rest", F.sum(F.when(~F.col("essential"), F.col("bound")).otherwise(0.0)).over(query))


def scored_in_full(pairs: DataFrame, asked: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, doc_id, score of the pairs (query_id, doc_id) by the terms that are asked for."""
    found = pairs.join(asked.select("query_id", "term", "factor"), "query_id").join(postings, ["doc_id", "term"])
    return found.groupBy("query_id", "doc_id").agg(F.sum(F.col("factor") * F.col("weight")).alias("score"))


def candidates(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, doc_id, part: scores by essential terms of the documents that can still reach the bound."""
    found = asked.where("essential").join(postings, "term").groupBy("query_id", "doc_id").agg(
        F.sum(F.col("factor") * F.col("weight")).alias("part"), F.first("rest").alias("rest"), F.first("least").alias("least")
    )
    return found.where("least IS NULL OR part + rest >= least - 1e-8").select("query_id", "doc_id", "part")


def bounded_scores(index: tuple[DataFrame, DataFrame], k: int) -> DataFrame:
    """query_id, doc_id, score of all documents that can be among a query's k best.

    Documents and queries are dealt to blocks. A task has the lists of one block of documents, scores all of them for each query of a
    block, and only the k best leave it, so no pair of a query and a document is ever a row. What is shuffled is the lists, once for each
    block of queries, and the queries' terms.
    """
    asked, postings = index
    n_docs = postings.agg(F.approx_count_distinct("doc_id")).first()[0]
    n_queries = asked.agg(F.approx_count_distinct("query_id")).first()[0]
    d_blocks, q_blocks = math.ceil(n_docs / DOCUMENT_BLOCK) or 1, math.ceil(n_queries / QUERY_BLOCK) or 1
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("query_id", "term", "factor", dealt("query_id", q_blocks).alias("qb"), each(d_blocks).alias("db"))
    right = postings.select("doc_id", "term", "weight", dealt("doc_id", d_blocks).alias("db"), each(q_blocks).alias("qb"))

    def best(qs: pa.Table, ps: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if qs.num_rows and ps.num_rows:
            terms = pc.unique(qs.column("term"))
            term = pc.index_in(ps.column("term"), value_set=terms).fill_null(-1).to_numpy()
            order = np.argsort(term, kind="stable")
            starts = np.searchsorted(term[order], np.arange(len(terms) + 1))
            firsts, document = np.unique(np.array(ps.column("doc_id")), return_inverse=True, return_index=True)[1:]
            document, weight = document[order], ps.column("weight").to_numpy()[order]
            queries, query = np.unique(np.array(qs.column("query_id")), return_inverse=True, return_index=True)[1:]
            wanted, factor = pc.index_in(qs.column("term"), value_set=terms).to_numpy(), qs.column("factor").to_numpy()
            by_query = np.argsort(query, kind="stable")
            for rows in np.split(by_query, np.searchsorted(query[by_query], np.arange(1, len(queries)))):
                lists = [slice(starts[t], starts[t + 1]) for t in wanted[rows]]
                has = np.concatenate([document[x] for x in lists])
                if len(has):
                    score = np.bincount(has, np.concatenate([f * weight[x] for f, x in zip(factor[rows], lists, strict=True)]), len(firsts))
                    own = np.flatnonzero(np.bincount(has, minlength=len(firsts)))
                    top = own[least_of(-np.round(score[own], 9), own, k)]
                    found.append((np.full(len(top), queries[query[rows[0]]]), firsts[top], score[top]))
        at_q, at_d, score = map(np.concatenate, zip(*found, strict=True))
        return pa.table([qs.column("query_id").take(at_q), ps.column("doc_id").take(at_d), pa.array(score)], names=["query_id", "doc_id", "score"])

    kinds = dict(asked.dtypes), dict(postings.dtypes)
    blocks = left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db"))
    return blocks.applyInArrow(best, f"query_id {kinds[0]['query_id']}, doc_id {kinds[1]['doc_id']}, score double")


def ranked(scores: DataFrame, k: int, score: str = "score", id: str = "doc_id") -> DataFrame:
    """The k best rows of each query, ties to nine decimals by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), id)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def any_term(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with any of the terms, and the text around the first one."""
    return docs.where(contains_any(F.col("text"), terms)).withColumn("snippet", snippet(F.col("text"), terms))


def searchable_terms(terms: list[str]) -> list[str]:
    """Terms of at least four letters; all of them if none is so long."""
    return [t for t in terms if len(t) >= 4] or terms


def trigram_pairs(
    left: DataFrame, right: DataFrame, grams: Callable[[Column], Column], least: float, ascending: bool = False
) -> DataFrame:
    """left_id, right_id, similarity of the names (id, name; ids once each) whose trigram sets have at least this
    Jaccard index; with ascending only pairs with left_id < right_id.

    A set-similarity join: trigrams are ordered by how many names have them, rarest first. Sets of n trigrams that
    are similar enough share one of their n - ceil(least * n) + 1 rarest (prefix filter), have sizes that allow
    it (length filter), and enough trigrams from there on (positional filter). Bitmaps of the sets' hashes differ in no more
    places than the sets themselves, so a pair whose bitmaps differ in too many is none (bitmap filter). All filters
    are checked inside the join, so next to nothing but similar pairs leaves it; these are counted in full.
    """
    a, b = gram_rows(left, "a", grams), gram_rows(right, "b", grams)
    every = a.select("gram").unionAll(b.select("gram"))
    counts = stored(every.groupBy("gram").agg(F.count("*").alias("n")), "gram-frequencies")
    a, b = sorted_sets(a, counts, "a"), sorted_sets(b, counts, "b")
    na, nb = F.col("na"), F.col("nb")
    pairs = similar_candidates(a, b, least, ascending)
    both = pairs.join(a.select("a_row", "a_id", "a", "na"), "a_row").join(b.select("b_row", "b_id", "b", "nb"), "b_row")
    common = F.size(F.array_intersect("a", "b"))
    counted = both.select(F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"), (common / (na + nb - common)).alias("similarity"))
    return counted.where(F.col("similarity") >= least)


def similar_candidates(a: DataFrame, b: DataFrame, least: float, ascending: bool = False) -> DataFrame:
    """a_row, b_row of the sets (see sorted_sets) that no filter tells apart."""

    def prefixes(sets: DataFrame, name: str, place: str) -> DataFrame:
        n = F.col(f"n{name}")
        prefix = F.slice(name, F.lit(1), (n - F.ceil(least * n - 1e-9) + 1).cast("int"))
        ids = [f"{name}_id"] if ascending else []
        bits = [f"{name}_bits{k}" for k in range(BITMAP_WORDS)]
        return sets.select(f"{name}_row", *ids, n, *bits, F.posexplode(prefix).alias(place, "gram"))

    na, nb = F.col("na"), F.col("nb")
    fits = F.least(na, nb) >= least * F.greatest(na, nb) - 1e-9
    needed = F.ceil(least / (1 + least) * (na + nb) - 1e-9)
    fits = fits & (1 + F.least(na - 1 - F.col("i"), nb - 1 - F.col("j")) >= needed)
    differ = [F.bit_count(F.col(f"a_bits{k}").bitwiseXOR(F.col(f"b_bits{k}"))) for k in range(BITMAP_WORDS)]
    fits = fits & (reduce(lambda x, y: x + y, differ) <= na + nb - 2 * needed)
    if ascending:
        fits = fits & (F.col("a_id") < F.col("b_id"))
    # The filters are met by a pair's first common trigram; later ones can only be stricter, so pairs are told apart after.
    pairs = prefixes(a, "a", "i").join(prefixes(b, "b", "j"), "gram").where(fits)
    return pairs.select("a_row", "b_row").distinct()


def gram_rows(names: DataFrame, side: str, grams: Callable[[Column], Column]) -> DataFrame:
    """{side}_row, {side}_id, gram of names (id, name), numbered and stored first, so that what makes a name is not done anew
    for each of its trigrams."""
    named = stored(names.select(F.monotonically_increasing_id().alias(f"{side}_row"), F.col("id").alias(f"{side}_id"), "name"), "names")
    return spread(named).select(f"{side}_row", f"{side}_id", F.explode(F.array_distinct(grams(F.col("name")))).alias("gram"))


def sorted_sets(rows: DataFrame, counts: DataFrame, side: str) -> DataFrame:
    """{side}_row, {side}_id, the trigrams of each name, rarest first, their number n{side} and their bitmap. Stored."""
    place = F.xxhash64("gram").bitwiseAND(64 * BITMAP_WORDS - 1)
    bit = F.expr("shiftleft(1L, cast(xxhash64(gram) & 63 as int))")
    words = [F.bit_or(F.when(F.floor(place / 64) == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"{side}_bits{k}") for k in range(BITMAP_WORDS)]
    each = rows.join(counts, "gram").groupBy(f"{side}_row")
    found = each.agg(F.first(f"{side}_id").alias(f"{side}_id"), F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("by"), *words)
    bits = [f"{side}_bits{k}" for k in range(BITMAP_WORDS)]
    return stored(found.select(f"{side}_row", f"{side}_id", F.transform("by", lambda x: x["gram"]).alias(side), F.size("by").alias(f"n{side}"), *bits), "gram-sets")


def title_lookup(
    queries: DataFrame, titles: DataFrame, k: int = fixed.TITLE_TOP_K, least: float = fixed.TITLE_THRESHOLD, others: bool = False
) -> DataFrame:
    """query_id, doc_id, similarity, rank of the titles (id, name) most like each query (id, name); with others only
    titles of other ids."""
    found = trigram_pairs(queries, titles, word_trigrams, least).toDF("query_id", "doc_id", "similarity")
    if others:
        found = found.where("query_id <> doc_id")
    return ranked(found, k, "similarity")


def best_in_tie_band(found: DataFrame, preferred: Column, band: float = fixed.COURSE_TIE_BAND) -> DataFrame:
    """One row a query: of those within the band of the best similarity a preferred one, else the best."""
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    near = F.col("similarity") >= best - band - 1e-12
    order = Window.partitionBy("query_id").orderBy(
        F.desc(F.when(near & preferred, 1).otherwise(0)), F.desc(F.round("similarity", 9)), "doc_id"
    )
    return found.withColumn("pick", F.row_number().over(order)).where("pick = 1").drop("pick")
