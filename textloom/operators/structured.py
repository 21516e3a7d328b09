"""Questions about a course's structure, answered from its record: five kinds, each a filter, a grouping and a format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.rules import intent
from ..functions.text import known
from .lexical import best_in_tie_band, title_lookup
from .nested import formatted_subjects, named, subjects_of_semester, subjects_with_credits

#: What a course record has, beside id and title.
COURSE = (
    "level string, url string, matrix array<map<string,string>>, "
    "teachers array<struct<nome:string,unidade:string,lattes:string,url:string>>, "
    "classes array<struct<disciplina:string,professores:array<string>,turma:string,vagas:string,matriculados:string>>"
)


def semesters(rows: Column) -> Column:
    """The semesters of a curriculum's rows, in order of first appearance, each followed by its subjects."""
    of = lambda r: F.coalesce(F.try_element_at(r, F.lit("semestre")), F.lit(fixed.NO_SEMESTER))
    parts = F.transform(
        F.array_distinct(F.transform(rows, of)),
        lambda s: F.concat(F.lit("\n"), s, F.lit(":\n"), formatted_subjects(F.filter(rows, lambda r: of(r) == s))),
    )
    return F.array_join(parts, "\n")


def teacher_line(t: Column) -> Column:
    page = F.coalesce(
        F.concat(F.lit(fixed.TEACHER_RECORD), F.nullif(t["lattes"], F.lit(""))), F.concat(F.lit(fixed.TEACHER_PAGE), F.nullif(t["url"], F.lit(""))), F.lit("")
    )
    unit = F.coalesce(F.concat(F.lit(" ("), known(t["unidade"]), F.lit(")")), F.lit(""))
    return F.concat(F.lit("  - "), t["nome"], unit, page)


def class_line(c: Column) -> Column:
    part = lambda label, value: F.coalesce(F.concat(F.lit(label), known(value)), F.lit(""))
    return F.concat(
        F.lit("  - "),
        F.coalesce(c["disciplina"], F.lit("?")),
        part(fixed.CLASS_TEACHERS, F.nullif(F.array_join(c["professores"], ", "), F.lit(""))),
        part(fixed.CLASS_NAME, c["turma"]),
        part(fixed.CLASS_PLACES, c["vagas"]),
        part(fixed.CLASS_ENROLLED, c["matriculados"]),
    )


def context_of_course() -> Column:
    """The context of a row with kind, semester, credits and a course's columns."""
    kind, term, credits = F.col("kind"), F.col("semester"), F.col("credits")
    matrix = F.coalesce("matrix", F.array().cast("array<map<string,string>>"))
    head = F.concat(F.lit(fixed.COURSE_NAME), "title", F.lit(" ("), F.coalesce("level", F.lit("")), F.lit(fixed.COURSE_URL), F.coalesce("url", F.lit("")), F.lit("\n"))
    upper = lambda label: F.coalesce(F.upper(label), F.lit(""))
    fitting = subjects_with_credits(matrix, credits, term)
    filtered = F.concat(
        F.lit(fixed.SUBJECTS),
        upper(F.concat(F.lit(fixed.OF_SEMESTER), term)),
        upper(F.concat(F.lit(fixed.WITH_CREDITS), credits.cast("string"), F.lit(fixed.CREDITS_LABEL))),
        F.lit(fixed.HEADING_END),
        F.when(term.isNotNull(), formatted_subjects(fitting)).otherwise(semesters(fitting)),
    )
    lines = lambda items, line: F.array_join(F.transform(items, line), "\n")
    body = (
        F.when(kind == "MATRIX_FULL", F.concat(F.lit(fixed.WHOLE_MATRIX), semesters(matrix)))
        .when(
            kind == "MATRIX_SEMESTRE",
            F.concat(F.lit(fixed.SUBJECTS), F.upper(F.concat(F.lit(fixed.OF_SEMESTER), term)), F.lit(fixed.HEADING_END), formatted_subjects(subjects_of_semester(matrix, term))),
        )
        .when(kind == "CREDITOS_FILTER", filtered)
        .when(kind == "PROFS_CURSO", F.concat(F.lit(fixed.TEACHERS), F.coalesce(lines(named(F.col("teachers")), teacher_line), F.lit(""))))
        .when(kind == "TURMAS_CURSO", F.concat(F.lit(fixed.CLASSES), F.coalesce(lines(F.col("classes"), class_line), F.lit(""))))
    )
    return F.concat(head, body)


def structured_answers(questions: DataFrame, courses: DataFrame, preferred: Column | None = None) -> DataFrame:
    """query_id, kind, id (of the course), similarity, context, sources of every question about a known course.

    questions: query_id, text. courses: id, title and what COURSE says. Questions that ask for no course's structure,
    or for a course that no title is like, have no row and go on to retrieval. preferred marks the courses that
    win among titles about as alike as the best.
    """
    asked = questions.select("query_id", intent(F.col("text")).alias("i")).where("i IS NOT NULL")
    asked = asked.select("query_id", "i.kind", "i.course", "i.semester", "i.credits")
    named_courses = courses.select("id", F.col("title").alias("name"))
    found = title_lookup(asked.select(F.col("query_id").alias("id"), F.col("course").alias("name")), named_courses, 5, fixed.COURSE_THRESHOLD)
    found = found.join(courses.select(F.col("id").alias("doc_id"), "title", "level"), "doc_id")
    best = best_in_tie_band(found, F.lit(False) if preferred is None else preferred)
    rows = asked.join(best.select("query_id", F.col("doc_id").alias("id"), "similarity"), "query_id").join(courses, "id")
    source = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("["), "title", F.lit("]("), "url", F.lit(")")))
    return rows.select("query_id", "kind", "id", "similarity", context_of_course().alias("context"), source.alias("sources"))
