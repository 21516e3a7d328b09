"""Text functions as column expressions."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def space_tokens(text: Column) -> Column:
    """Runs of anything but white space, as they are; no text has none."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and digits; accented letters part words."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


#: Ends of sentences: a full stop behind a word that is no abbreviation or initial, before a capital, a quote or the end.
_STOP = r"(?<!(?:^|[\s(])(?:\p{L}|(?i:" + "|".join(fixed.ABBREVIATIONS) + r")))\.(?=[)\]}>\"'”»]*(?:\s+[\p{Lu}\p{N}\"'“«(]|\s*\z))"
#: What is cut off from words, in this order: pattern and replacement.
_CUTS = (
    (r"[“”«»\"]|``|\'\'", " \" "),
    (r"\.{3}|…", " ... "),
    (_STOP, " . "),
    (r"([:,])(?=\D)|([:,])\z", " , "),
    (r"[;@#$%&?!]", " ; "),
    (r"[\[\](){}<>]", " ( "),
    (r"--", " -- "),
    (r"(?<=^|\s)'(?=\S)", " ' "),
    (r"(?i)(?<=[^' ])(n't)(?=\s|\z)", " $1"),
    (r"(?i)(?<=[^' ])('(?:s|m|d|ll|re|ve)?)(?=\s|\z)", " $1"),
    (r"(?i)\b(can)(not)\b", "$1 $2"),
    (r"(?i)\b(gon|got|wan)(na|ta)\b", "$1 $2"),
    (r"(?i)\b(gim|lem)(me)\b", "$1 $2"),
)


def word_tokens(text: Column) -> Column:
    """Lower-cased words as a tokenizer of words and sentences cuts them; only those of letters and digits alone stay.

    Punctuation is cut off, contractions fall apart, a full stop goes with the end of a sentence, but stays with
    abbreviations, initials and numbers. So `2024.2`, `RS/SC`, `pós-graduação` and `Dr.` are one word each, which has other
    characters than letters and digits, and is left out. Null has no words.
    """
    line = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    for pattern, replacement in _CUTS:
        line = F.regexp_replace(line, pattern, replacement)
    words = F.split(F.trim(F.lower(line)), r"\s+")
    return F.filter(words, lambda w: w.rlike(r"^[\p{L}\p{N}]+$"))


def normalized_query(query: Column) -> Column:
    """Lower-cased, white space collapsed, one closing mark dropped."""
    line = F.trim(F.regexp_replace(F.trim(F.lower(query)), r"\s+", " "))
    return F.trim(F.regexp_replace(line, r"[?!.,;]$", ""))


def query_key(query: Column) -> Column:
    return F.sha2(normalized_query(query), 256)


def _windows(text: Column, size: int) -> Column:
    last = F.length(text) - (size - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))).otherwise(
        F.array().cast("array<string>")
    )


def trigrams(text: Column) -> Column:
    """The set of three-character windows of the whole text between two spaces on each side."""
    return F.array_distinct(_windows(F.concat(F.lit("  "), text, F.lit("  ")), 3))


def word_trigrams(text: Column) -> Column:
    """The set of three-character windows of every word, with two spaces before it and one after."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: _windows(w, 3))))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap_share(query: Column, document: Column) -> Column:
    """The share of the query's distinct words that the document has."""
    words = F.array_distinct(query)
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, document)) / F.size(words)).otherwise(0.0)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def snippet(text: Column, terms: list[str]) -> Column:
    """The text around the first of the terms that it has; else its beginning."""
    lowered = F.lower(text)
    places = [F.instr(lowered, t.lower()) for t in terms]
    at = F.coalesce(*[F.when(p > 0, p) for p in places])
    begin = F.greatest(at - fixed.SNIPPET_BEFORE, F.lit(1))
    around = F.substring(text, begin, at + fixed.SNIPPET_AFTER - begin)
    return F.when(at.isNotNull(), around).otherwise(F.left(text, F.lit(fixed.SNIPPET_DEFAULT)))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Case-insensitive; % and _ in a term stay wildcards."""
    return reduce(lambda a, b: a | b, [text.ilike(f"%{t}%") for t in terms])


def known(text: Column) -> Column:
    """Null for blank texts and for the marker of missing information."""
    return F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit(fixed.MISSING))


def first_known(*texts: Column) -> Column:
    return F.coalesce(*[known(t) for t in texts], F.lit(fixed.MISSING))


def parsed_date(text: Column) -> Column:
    """The first dd/mm/yyyy in the text; null if there is none or it is no date."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"(\d{2}/\d{2}/\d{4})", 1), F.lit("")), "dd/MM/yyyy")


def is_current(end_date: Column, status: Column, as_of: Column) -> Column:
    """Whether a project still runs: a closed status needs an end date to come, an open one nothing."""
    lowered = F.lower(F.coalesce(status, F.lit("")))
    # Words of closed and of open statuses.
    closed = "concluído|concluido|encerrado|finalizado|cancelado|suspenso|inativo"
    current = "em execução|ativo|em andamento|vigente|aberto|aprovado|em vigor"
    date = parsed_date(end_date)
    return (
        F.when(lowered.rlike(closed), F.coalesce(date >= as_of, F.lit(False)))
        .when(lowered.rlike(current), F.lit(True))
        .otherwise(F.coalesce(date >= as_of, F.lit(True)))
    )


def _plain(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), r"\(.*?\)", ""), r"\s+", " "))


def loosely_keyed(labels: Column) -> Column:
    """The map by its keys without parentheses, spacing and case; of keys that become equal, the first stays."""
    keys = F.transform(F.map_keys(labels), _plain)
    firsts = F.filter(F.map_entries(labels), lambda e: F.array_position(keys, _plain(e["key"])) == F.array_position(F.map_keys(labels), e["key"]))
    return F.transform_keys(F.map_from_entries(firsts), lambda k, _: _plain(k))


def label_value(labels: Column, *keys: str, loose: Column | None = None) -> Column:
    """A map's value by the first key that it has: as it is, else without parentheses, spacing and case.

    loose is `loosely_keyed(labels)` where it is at hand."""
    loose = loosely_keyed(labels) if loose is None else loose
    return F.coalesce(*[c for k in keys for c in (F.try_element_at(labels, F.lit(k)), F.try_element_at(loose, _plain(F.lit(k))))])


def expanded(text: Column) -> Column:
    """Whole-word abbreviations of courses written out, one after another."""
    for short, full in fixed.COURSE_ABBREVIATIONS.items():
        text = F.regexp_replace(text, rf"(?iu)\b{short}\b", full)
    return text


def sentiment(text: Column) -> Column:
    lowered = F.lower(text)
    count = lambda words: reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(w)).cast("int") for w in words])
    good, bad = count(fixed.POSITIVE_WORDS), count(fixed.NEGATIVE_WORDS)
    return F.when(good > bad, "Positivo").when(bad > good, "Negativo").otherwise("Neutro")


def cites(answer: Column, title: Column) -> Column:
    """Whether the answer has at least half of the title's words of over three letters."""
    words = F.filter(F.split(F.lower(F.trim(title)), r"\s+"), lambda w: F.length(w) > 3)
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(answer), w)))
    return (F.size(words) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(words) / 2)))


def lcs_length(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence of two arrays, by folds over both."""
    zero = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))

    def row(previous: Column, word: Column) -> Column:
        cells = F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            F.array(F.lit(0)),
            lambda done, j: F.concat(
                done,
                F.array(
                    F.when(F.element_at(b, j.cast("int")) == word, F.element_at(previous, j.cast("int")) + 1).otherwise(
                        F.greatest(F.element_at(previous, (j + 1).cast("int")), F.element_at(done, -1))
                    )
                ),
            ),
        )
        return cells

    table = F.aggregate(a, zero, row, lambda last: F.element_at(last, -1))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), table).otherwise(0)


def f_measure(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def replaced_section(text: Column, heading: str, body: Column) -> Column:
    """The section that begins with heading has body instead, up to the next paragraph that begins with a capital or
    to the end. A text without the heading stays as it is."""
    pattern = F.lit(rf"(?s){re.escape(heading)}.*?(?=\n\n[A-Z]|\z)")
    # What is put in is no pattern: its backslashes and dollars are escaped.
    literal = F.regexp_replace(F.concat(F.lit(heading + "\n"), body), r"([\\$])", r"\\$1")
    return F.regexp_replace(text, pattern, literal)


def capped_json(value: Column, most: int = 4000) -> Column:
    """A struct, map or array as JSON with a line for each field, cut after so many characters, which it then says."""
    pretty = F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"})
    return F.when(F.length(pretty) > most, F.concat(F.left(pretty, F.lit(most)), F.lit("\n... (truncado)"))).otherwise(pretty)
