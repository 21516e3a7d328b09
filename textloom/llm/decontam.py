"""Benchmark decontamination by a distributed positional inverted index.

1. Benchmark texts become windows of consecutive words; each distinct window is kept once with its items.
2. The windows' terms are counted over the corpus; a window with a term that the corpus lacks cannot occur.
3. The postings (term, document, position) of every window's two rarest terms are stored.
4. The rarest term's list, adjusted by the term's offset in the window, is intersected with the second's (for
   proximity, at every distance that its slop allows); what is left is checked in full against the document's words.

A list is joined by (term, document, position) after the first term, so a passage that thousands of documents
share is spread by document. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_BREAK, ascii_lower, text_key, without_rows, written

#: Words of a window; an item with fewer is one window.
WINDOW = 13
#: Words that a term may stand off its place in a proximity match.
SLOP = 1
#: The benchmark side of a join is broadcast up to so many bytes, all its columns written out, and shuffled beyond.
BROADCAST_BYTES = 32_000_000


def words_of(text: Column) -> Column:
    """Lower-cased words; an empty array for null and for texts without words. The text is gone through once."""
    words = F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_BREAK)
    return F.array_remove(words, "")


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written table for broadcast if its rows, summed up, are small; else joins shuffle. Rows are the same."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """window (its words joined by a space), terms, items (ids as strings, sorted)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(
        (F.size("words") > 0) & F.col("item_id").isNotNull()
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    cut = items.select(F.col("item_id").cast("string").alias("item"), "words", F.explode(starts).alias("start"))
    cut = cut.select("item", F.slice("words", F.col("start"), size).alias("terms"))
    return cut.groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        F.array_join("terms", " ").alias("window"), "terms", "items"
    )


def keyed_words(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, words."""
    return docs.select("doc_id", text_key(docs).alias("text_key"), words_of(docs["text"]).alias("words"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms stands in the corpus; terms that it lacks are left out."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return tokens.join(sized(terms), "term").groupBy("term").count()


def rarest_terms(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each possible window with its rarest terms and their offsets: term1, offset1, term2, offset2.

    A window of one word has it twice.
    """
    terms = windows.select("window", F.posexplode("terms").alias("offset", "term"))
    counted = terms.join(counts, "term", "left").groupBy("window").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "offset", "term"))).alias("by")
    )
    # Two different terms, if there are: equal ones would have one and the same list.
    second = F.coalesce(F.get(F.filter("by", lambda t: t["term"] != F.col("by")[0]["term"]), F.lit(0)), F.col("by")[0])
    return counted.where("by[0].n > 0").select(
        "window",
        F.col("by")[0]["term"].alias("term1"),
        F.col("by")[0]["offset"].alias("offset1"),
        second["term"].alias("term2"),
        second["offset"].alias("offset2"),
    )


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of the given terms: term, doc_id, text_key, position (from 0). Stored."""
    tokens = keyed_words(docs).select("doc_id", "text_key", F.posexplode("words").alias("position", "term"))
    return written(tokens.join(sized(terms), "term"), "postings")


def index(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, their rarest terms, the stored postings of those terms)."""
    windows = written(benchmark_windows(benchmark, size), "windows")
    terms = written(windows.select(F.explode("terms").alias("term")).distinct(), "terms")
    counts = written(term_counts(docs, terms), "term-counts")
    rare = written(rarest_terms(windows, counts), "rare-terms")
    probes = rare.select(F.explode(F.array("term1", "term2")).alias("term")).distinct()
    return windows, rare, postings(docs, written(probes, "probes"))


def intersected(rare: DataFrame, lists: DataFrame, slop: int = 0) -> DataFrame:
    """Where a window's two rarest terms may stand in place: doc_id, text_key, window, start.

    start is where the window begins if the rarest term is in place. With slop either term can be off its own
    place by so many words, so the second one's distance can be off by twice as many.
    """
    first = lists.join(sized(rare), F.col("term") == F.col("term1")).select(
        "doc_id", "text_key", "window", "term2", "offset2", (F.col("position") - F.col("offset1")).alias("start")
    )
    second = lists.select(
        F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.col("term").alias("term2"), "position"
    )
    shifts = F.explode(F.array(*[F.lit(k) for k in range(-2 * slop, 2 * slop + 1)])).alias("off")
    first = first.select("*", shifts).withColumn("at", F.col("start") + F.col("offset2") + F.col("off"))
    here = (
        first["doc_id"].eqNullSafe(second["id"])
        & (first["text_key"] == second["key"])
        & (first["term2"] == second["term2"])
        & (first["at"] == second["position"])
    )
    # Repeated rows and several second terms about one place give one candidate.
    return first.join(second, here).select("doc_id", "text_key", "window", "start").distinct()


def near_window(words: Column, terms: Column, start: Column, slop: int) -> Column:
    """Whether every term of a window that begins at start stands at most slop words off its place."""

    def there(term: Column, offset: Column) -> Column:
        low = F.greatest(start + offset - slop, F.lit(0))
        return F.array_contains(F.slice(words, low + 1, F.greatest(start + offset + slop + 1 - low, F.lit(0))), term)

    return F.aggregate(
        F.transform(terms, lambda t, k: there(t, k)), F.lit(True), lambda all_of, one: all_of & one
    )


def judged(docs: DataFrame, benchmark: DataFrame, size: int, slop: int) -> DataFrame:
    """The columns of contamination, and text_key."""
    windows, rare, lists = index(docs, benchmark, size)
    candidates = intersected(rare, lists, slop).join(sized(windows), "window")
    by_document = candidates.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(
        F.array_sort(F.collect_list(F.struct("start", "terms", "items"))).alias("places")
    )
    # Texts are joined as they are, and split to words after: arrays of words take over twice the room.
    texts = docs.select("doc_id", "text", text_key(docs).alias("text_key"))
    joined = texts.join(
        by_document, texts["doc_id"].eqNullSafe(by_document["id"]) & (texts["text_key"] == by_document["key"]), "left"
    ).select("doc_id", "text_key", words_of(F.col("text")).alias("words"), "places")
    exact = F.filter(
        "places",
        lambda p: (p["start"] >= 0) & (F.slice("words", F.greatest(p["start"], F.lit(0)) + 1, F.size(p["terms"])) == p["terms"]),
    )
    starts = [F.lit(k) for k in range(-slop, slop + 1)]
    near = F.filter(
        "places",
        lambda p: F.exists(F.array(*starts), lambda k: near_window(F.col("words"), p["terms"], p["start"] + k, slop)),
    )
    joined = joined.select(
        "doc_id",
        "text_key",
        F.size("words").cast("long").alias("n_words"),
        exact.alias("places"),
        F.coalesce(F.size(F.array_distinct(F.transform(near, lambda p: p["terms"]))), F.lit(0)).cast("long").alias("n_near"),
    )
    # Places are in order of their start, so what each adds to the words hit follows from the furthest end so far.
    hit = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(
            F.greatest(acc["end"], p["start"] + F.size(p["terms"])).alias("end"),
            (acc["n"] + F.greatest(p["start"] + F.size(p["terms"]) - F.greatest(acc["end"], p["start"]), F.lit(0)))
            .cast("long")
            .alias("n"),
        ),
    )["n"]
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda p: p["items"]))))
    counted = joined.select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(items, F.array().cast("array<string>")).alias("items"),
        "n_near",
    )
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "n_near",
        "text_key",
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    A word inside any occurrence of a benchmark window is hit; a document is contaminated if at least one in 20
    of its words is hit. n_near counts the distinct windows that match by proximity: for some start in the text every
    term stands at most slop words off its place; exact phrases are among them. Null and empty texts have no words
    and are clean; items without words or with a null id have no windows; an empty benchmark leaves all clean.
    Repeated rows get equal answers; rows with one doc_id are told apart by their texts; other columns are ignored.
    """
    return judged(docs, benchmark, size, slop).drop("text_key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever their names. Each row is judged
    by its own text, those of one doc_id and those without any alike."""
    return without_rows(docs, judged(docs, benchmark, size, 0).where("contaminated"))
