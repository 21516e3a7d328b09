"""Quality of rankings and of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ascii_tokens, f_measure
from ..functions.vector import cosine


def relevant_by_text(text: Column, wanted: Column) -> Column:
    """Either contains the other, without regard to case."""
    a, b = F.lower(text), F.lower(wanted)
    return F.contains(a, b) | F.contains(b, a)


def ranking_details(judged: DataFrame) -> DataFrame:
    """query_id, first_rank (of a relevant result), hits, returned, from (query_id, rank, relevant)."""
    return judged.groupBy("query_id").agg(
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"),
        F.count_if("relevant").alias("hits"),
        F.count("rank").alias("returned"),
    )


def ranking_quality(details: DataFrame) -> DataFrame:
    """queries, mrr, recall (any hit), precision (hits of those returned): means over all queries."""
    return details.agg(
        F.count("*").alias("queries"),
        F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"),
        F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("recall"),
        F.avg(F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")).otherwise(0.0)).alias("precision"),
    )


def truncated_rank(reciprocal: Column) -> Column:
    """The rank that int(1 / rr) gives. In floating point it is one too small at some ranks, 93 the first."""
    return F.when(reciprocal > 0, F.floor(1 / reciprocal).cast("int")).otherwise(0)


def compared(results: dict[str, DataFrame], wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """config, queries, mrr, recall, precision: the quality of each configuration's results, side by side.

    results: of each configuration query_id, doc_id, rank. wanted: query_id, text. docs: doc_id, text. A question
    without any result counts in all means.
    """
    parts = []
    for name, found in results.items():
        joined = wanted.select("query_id", F.col("text").alias("wanted")).join(found.select("query_id", "doc_id", "rank"), "query_id", "left")
        joined = joined.join(docs.select("doc_id", "text"), "doc_id", "left")
        relevant = F.coalesce(relevant_by_text(F.col("text"), F.col("wanted")), F.lit(False))
        quality = ranking_quality(ranking_details(joined.select("query_id", "rank", relevant.alias("relevant"))))
        parts.append(quality.select(F.lit(name).alias("config"), *quality.columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def recall_at(relevant: Column, returned: Column, k: int) -> Column:
    """The share of relevant ids among the first k returned; 0 if none is relevant."""
    hits = F.size(F.filter(F.slice(returned, 1, max(k, 0)), lambda x: F.array_contains(relevant, x)))
    return F.when(F.size(relevant) > 0, hits / F.size(relevant)).otherwise(0.0)


def precision_at(relevant: Column, returned: Column, k: int) -> Column:
    """Hits among the first k, divided by k; 0 if k is."""
    if k <= 0:
        return F.lit(0.0)
    return F.size(F.filter(F.slice(returned, 1, k), lambda x: F.array_contains(relevant, x))) / F.lit(float(k))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    places: dict[str, int] = {}
    for k, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << k
    every = (1 << len(a)) - 1
    row = every
    for word in b:
        met = row & places.get(word, 0)
        row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def rouge_l(candidate: Column, reference: Column) -> Column:
    """A struct of precision, recall and f1 of the longest common subsequence of words. Null counts as empty."""
    a, b = ascii_tokens(F.coalesce(candidate, F.lit(""))), ascii_tokens(F.coalesce(reference, F.lit("")))
    common = _common(a, b)
    precision = F.when(F.size(a) > 0, common / F.size(a)).otherwise(0.0)
    recall = F.when(F.size(b) > 0, common / F.size(b)).otherwise(0.0)
    return F.struct(precision.alias("precision"), recall.alias("recall"), f_measure(precision, recall).alias("f1"))


class TrigramTokens:
    """Token vectors without a model: a token's three-character windows, at unit length. Equal tokens have similarity 1,
    and tokens that share a stem are alike; vectors don't depend on what stands around them."""

    def vectors(self, tokens: list[str]) -> np.ndarray:
        windows = [{f"  {t} "[k : k + 3] for k in range(len(t) + 1)} for t in tokens]
        places = {w: k for k, w in enumerate(sorted(set().union(*windows)))}
        out = np.zeros((len(tokens), len(places)))
        for k, own in enumerate(windows):
            out[k, [places[w] for w in own]] = 1 / np.sqrt(len(own))
        return out


def token_weights(texts: DataFrame) -> DataFrame:
    """token, weight: ln((n + 1) / (df + 1)) over texts (text), n in all, df with the token."""
    cut = texts.select(F.array_distinct(ascii_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))
    total = cut.agg(F.count("*").alias("n"))
    df = cut.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(total)).select("token", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("weight"))  # one row


def aligned_score(pairs: DataFrame, weights: DataFrame | None = None, embedder=TrigramTokens()) -> DataFrame:
    """id, precision, recall, f1 of pairs (id, candidate, reference) by greedy alignment of token vectors.

    Each token is aligned with the most similar one of the other text; precision is the weighted mean over the
    candidate's tokens, recall over the reference's, each token as often as it stands. weights: of token_weights;
    without them, and for all others, tokens weigh the same: 1, and in a text whose tokens all weigh 0 too. Null counts as
    empty; without tokens in either text all three are 0. Each id is one pair. embedder: vectors(tokens) gives unit rows.
    """
    cut = lambda c, side: pairs.select("id", F.lit(side).alias("side"), F.explode(ascii_tokens(F.coalesce(c, F.lit("")))).alias("token"))
    token = cut("candidate", 0).unionByName(cut("reference", 1)).groupBy("id", "side", "token").agg(F.count("*").alias("times"))
    token = token.join(weights, "token", "left") if weights is not None else token.withColumn("weight", F.lit(1.0))
    token = token.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    lists = token.groupBy("id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("token", "times", "weight")))).alias(n) for k, n in enumerate("ab")]
    )

    @F.pandas_udf("struct<precision:double,recall:double>")
    def align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            if not len(x) or not len(y):
                out.append((0.0, 0.0))
                continue
            v = embedder.vectors([t["token"] for t in x] + [t["token"] for t in y])
            similar = v[: len(x)] @ v[len(x) :].T
            out.append((weighted_mean(similar.max(1), x), weighted_mean(similar.max(0), y)))
        return pd.DataFrame(out, columns=["precision", "recall"])

    found = lists.select("id", align("a", "b").alias("s")).select("id", "s.precision", "s.recall")
    p, r = (F.coalesce(c, F.lit(0.0)) for c in ("precision", "recall"))
    return pairs.select("id").join(found, "id", "left").select("id", p.alias("precision"), r.alias("recall"), f_measure(p, r).alias("f1"))


def weighted_mean(values: np.ndarray, tokens: list) -> float:
    times = np.array([t["times"] for t in tokens], np.float64)
    weight = times * [t["weight"] for t in tokens]
    return float((values * (weight if weight.sum() > 0 else times)).sum() / (weight if weight.sum() > 0 else times).sum())


def groundedness(answer: Column, context: Column) -> Column:
    """The share of the answer's distinct words that the context has: a stand-in for a judge model."""
    words = F.array_distinct(ascii_tokens(answer))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, ascii_tokens(context))) / F.size(words)).otherwise(0.0)


def composed(
    questions: DataFrame, results: DataFrame, docs: DataFrame, answers: DataFrame, embedder, tokens=TrigramTokens(), weights: DataFrame | None = None
) -> DataFrame:
    """query_id, reciprocal_rank, hits, returned, cosine, aligned_f1, rouge_f1: all measures of each question.

    questions: query_id, wanted (a text that a right document holds), reference (the right answer). results: query_id,
    doc_id, rank. docs: doc_id, text. answers: query_id, answer. embedder: embed(rows, id), see plans.providers. A question
    without results, answer or reference has zeros there, and counts in the means.
    """
    asked = questions.select("query_id", "wanted", "reference")
    judged = results.join(docs.select("doc_id", "text"), "doc_id").join(asked, "query_id")
    judged = judged.select("query_id", "rank", F.coalesce(relevant_by_text(F.col("text"), F.col("wanted")), F.lit(False)).alias("relevant"))
    pairs = asked.join(answers.select("query_id", "answer"), "query_id", "left")
    # Both sides of a pair are embedded as rows of one table, told apart by the side.
    side = lambda c, k: pairs.select((F.xxhash64("query_id", F.lit(k))).alias("row"), F.coalesce(c, F.lit("")).alias("text"))
    vectors = embedder.embed(side("answer", 0).unionByName(side("reference", 1)), "row")
    vector = lambda k, name: pairs.select("query_id", F.xxhash64("query_id", F.lit(k)).alias("row")).join(vectors, "row").select("query_id", F.col("embedding").alias(name))
    near = vector(0, "a").join(vector(1, "b"), "query_id").select("query_id", cosine(F.col("a"), F.col("b")).alias("cosine"))
    aligned = aligned_score(pairs.select(F.col("query_id").alias("id"), F.col("answer").alias("candidate"), "reference"), weights, tokens)
    rouge = pairs.select("query_id", rouge_l(F.col("answer"), F.col("reference"))["f1"].alias("rouge_f1"))
    out = rouge.join(ranking_details(judged), "query_id", "left").join(near, "query_id", "left")
    out = out.join(aligned.select(F.col("id").alias("query_id"), F.col("f1").alias("aligned_f1")), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "query_id", zero(1 / F.col("first_rank")).alias("reciprocal_rank"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
        F.coalesce("returned", F.lit(0)).cast("long").alias("returned"), zero(F.col("cosine")).alias("cosine"), zero(F.col("aligned_f1")).alias("aligned_f1"), "rouge_f1",
    )


def means(measures: DataFrame) -> DataFrame:
    """questions, mrr, recall (any hit), precision, cosine, aligned_f1, rouge_f1 over all of `composed`."""
    share = F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")).otherwise(0.0)
    return measures.agg(
        F.count("*").alias("questions"), F.avg("reciprocal_rank").alias("mrr"), F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("recall"),
        F.avg(share).alias("precision"), *[F.avg(c).alias(c) for c in ("cosine", "aligned_f1", "rouge_f1")],
    )
