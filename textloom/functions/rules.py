"""Rule tables as column expressions: routes, guards, intents and named entities of questions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import expanded


def found(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iu){pattern}")


def any_found(text: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [found(text, p) for p in patterns])


def first_found(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The name of the first (pattern, name) rule that is found, else null."""
    return F.coalesce(*[F.when(found(text, p), F.lit(name)) for p, name in rules])


def captured(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first place where the pattern is found, else null."""
    return F.when(found(text, pattern), F.regexp_extract(text, f"(?iu){pattern}", group))


def route(query: Column) -> Column:
    """The collection of the first routing rule that is found, else null."""
    return first_found(query, fixed.ROUTES)


def route_with(query: Column, provided: Column, least: float = fixed.ROUTE_CONFIDENCE) -> Column:
    """The rules' collection, else that of a provider's JSON answer {collection, confidence} if it names a known
    collection and is sure enough, else null (all collections). An answer that is no such JSON counts as none."""
    answer = F.from_json(provided, "collection string, confidence double")
    known = answer["collection"].isin(*sorted({name for _, name in fixed.ROUTES} | set(fixed.COLLECTIONS.values())))
    return F.coalesce(route(query), F.when(known & (answer["confidence"] >= least), answer["collection"]))


def collection_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.COLLECTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(fixed.GENERAL_COLLECTION))


# --- guards -------------------------------------------------------------------------------------------------


def length_failure(query: Column, least: int = fixed.GUARD_LEAST, most: int = fixed.GUARD_MOST) -> Column:
    size = F.length(F.trim(query))
    return F.when(size < least, "short").when(size > most, "long")


def has_injection(query: Column) -> Column:
    return any_found(query, fixed.INJECTION_PATTERNS)


def pii_kind(query: Column) -> Column:
    return first_found(query, [(p, name) for name, p in fixed.PII_PATTERNS])


def input_guard(query: Column) -> Column:
    """The first check that fails (length, injection, pii), else null. Null counts as empty."""
    query = F.coalesce(query, F.lit(""))
    return F.coalesce(
        F.when(length_failure(query).isNotNull(), "length"),
        F.when(has_injection(query), "injection"),
        F.when(pii_kind(query).isNotNull(), "pii"),
    )


def strict_input_guard(query: Column) -> Column:
    """The second table of rules: shorter lists, and at least five characters."""
    query = F.coalesce(query, F.lit(""))
    return F.coalesce(
        F.when(F.length(F.trim(query)) < fixed.STRICT_GUARD_LEAST, "length"),
        F.when(any_found(query, fixed.STRICT_INJECTION_PATTERNS), "injection"),
        F.when(any_found(query, [p for _, p in fixed.STRICT_PII_PATTERNS]), "pii"),
    )


def output_guard(answer: Column) -> Column:
    """empty or length, else null."""
    answer = F.coalesce(answer, F.lit(""))
    return F.when(F.trim(answer) == "", "empty").when(F.length(answer) > fixed.OUTPUT_MOST, "length")


# --- questions about a course's structure -------------------------------------------------------------------


def semester(text: Column) -> Column:
    """'4º Semestre' and the like. The first kind of mention decides, even where its number is none we know."""
    label = lambda n: F.when(n.between(1, 10), F.concat(n.cast("string"), F.lit("º Semestre")))
    number = lambda p: label(F.regexp_extract(text, f"(?iu){p}", 1).try_cast("int"))
    symbol, word, after = fixed.SEMESTER_SYMBOL, fixed.SEMESTER_WORD, fixed.SEMESTER_AFTER
    ordinals = F.array(*[F.lit(w) for w in fixed.ORDINALS])
    spelled = label(F.array_position(ordinals, F.lower(F.regexp_extract(text, f"(?iu){word}", 1))).cast("int"))
    return F.when(found(text, symbol), number(symbol)).when(found(text, word), spelled).when(found(text, after), number(after))


def course_name(text: Column) -> Column:
    """The course that a question names, else null."""

    def cleaned(name: Column) -> Column:
        return F.regexp_replace(F.rtrim(F.trim(name), F.lit("?., ")), f"(?iu){fixed.SEMESTER_PREFIX}", "")

    after = captured(text, fixed.COURSE_AFTER + fixed.COURSE_END)
    of = captured(text, fixed.COURSE_OF + fixed.COURSE_END)
    return F.when(after.isNotNull(), cleaned(after)).otherwise(
        F.regexp_replace(cleaned(of), f"(?iu){fixed.ORDINAL_PREFIX}", "")
    )


def intent(query: Column) -> Column:
    """A struct of kind, course, semester and credits; null unless the question is about a course's structure."""
    text = F.lower(expanded(F.trim(query)))
    course = course_name(text)
    term, credits = semester(text), F.nullif(captured(text, fixed.CREDITS).try_cast("int"), F.lit(0))
    kind = (
        F.when(found(text, fixed.TEACHER_WORDS), "PROFS_CURSO")
        .when(found(text, fixed.CLASS_WORDS), "TURMAS_CURSO")
        .when(credits.isNotNull(), "CREDITOS_FILTER")
        .when(term.isNotNull(), "MATRIX_SEMESTRE")
        .otherwise("MATRIX_FULL")
    )
    matrix = ~kind.isin("PROFS_CURSO", "TURMAS_CURSO")
    fits = found(text, fixed.STRUCTURE_WORDS) & (F.coalesce(F.trim(course), F.lit("")) != "")
    return F.when(
        fits,
        F.struct(
            kind.alias("kind"),
            course.alias("course"),
            F.when(matrix, term).alias("semester"),
            F.when(matrix, credits).alias("credits"),
        ),
    )


def asks_for_area(query: Column) -> Column:
    return any_found(query, fixed.AREA_PATTERNS)


def type_hint(query: Column) -> Column:
    lowered = F.lower(F.trim(query))
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(word)), F.lit(kind)) for word, kind in fixed.TYPE_HINTS.items()])


def entity(query: Column) -> Column:
    """The named thing that a question asks for; a short question without question words is a name itself."""
    text = F.lower(F.trim(query))
    named = F.coalesce(*[captured(text, p) for p in fixed.ENTITY_PATTERNS])
    words = F.split(text, r"\s+")
    generic = F.array(*[F.lit(w) for w in fixed.GENERIC_WORDS])
    whole = F.when(~F.arrays_overlap(words, generic) & (F.size(words) <= 6), text)
    return F.nullif(F.rtrim(F.trim(F.coalesce(named, whole)), F.lit("?. ")), F.lit(""))
