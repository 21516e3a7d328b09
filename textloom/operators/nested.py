"""Course records with nested arrays: filters, groups and formatting; lookups over team lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import known


def subjects_of_semester(matrix: Column, semester: Column) -> Column:
    """Rows (maps) of a curriculum in a semester."""
    return F.filter(matrix, lambda r: F.try_element_at(r, F.lit("semestre")) == semester)


def subjects_with_credits(matrix: Column, credits: Column, semester: Column | None = None) -> Column:
    """Rows with so many credits (compared as text), in the semester if one is given."""
    row_credits = lambda r: F.coalesce(F.try_element_at(r, F.lit("Cr.")), F.try_element_at(r, F.lit("créditos")), F.lit(""))
    rows = F.filter(matrix, lambda r: row_credits(r) == credits.cast("string"))
    return rows if semester is None else F.when(semester.isNull(), rows).otherwise(subjects_of_semester(rows, semester))


def named(members: Column, field: str = "nome") -> Column:
    """Members with a name."""
    return F.filter(members, lambda m: known(m[field]).isNotNull())


def by_semester(rows: DataFrame, id: str, matrix: str) -> DataFrame:
    """id, semester, position, subjects: a curriculum grouped by semester in order of first appearance."""
    each = rows.select(id, F.posexplode(matrix).alias("pos", "row"))
    semester = F.coalesce(F.try_element_at("row", F.lit("semestre")), F.lit("Sem semestre"))
    # Maps have no order, so positions are sorted and their rows looked up.
    groups = each.groupBy(id, semester.alias("semester")).agg(
        F.min("pos").alias("position"),
        F.sort_array(F.collect_list("pos")).alias("order"),
        F.map_from_entries(F.collect_list(F.struct("pos", "row"))).alias("at"),
    )
    subjects = F.transform("order", lambda p: F.element_at("at", p)).alias("subjects")
    return groups.select(id, "semester", "position", subjects)


def formatted_subjects(subjects: Column) -> Column:
    """One line for each subject: its name, code, credits and hours where it has them."""
    part = lambda r, key, label: F.concat(F.lit(label), known(F.try_element_at(r, F.lit(key))))
    line = lambda r: F.concat(
        F.lit("- "),
        F.concat_ws(
            " | ",
            F.coalesce(known(F.try_element_at(r, F.lit("nome"))), F.lit(fixed.MISSING)),
            part(r, "código", "Código: "),
            part(r, "Cr.", "Créditos: "),
            part(r, "CH", "CH: "),
        ),
    )
    return F.array_join(F.transform(subjects, line), "\n")


def formatted_list(items: Column, most: int) -> Column:
    """Lines of the first items, and how many more there are."""
    lines = F.array_join(F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit("- "), x)), "\n")
    more = F.size(items) - most
    return F.when(more > 0, F.concat(lines, F.lit("\n... +"), more.cast("string"))).otherwise(lines)


def projects_of(
    names: DataFrame, projects: DataFrame, limit: int, separator: str = " — ", chronological: bool = False
) -> DataFrame:
    """asker, project, step, nth: projects that a named person coordinates (step 1), then those with the person
    in the team (step 2), which are asked for only where step 1 gives fewer than half of the limit.

    names: asker, name (upper case). projects: project, coordinator, team (array of 'name — role'), start.
    Each step is ordered by start, latest first and missing last; as text unless chronological. A project without a
    coordinator never comes in step 2.
    """
    start = F.try_to_date("start", "dd/MM/yyyy") if chronological else F.col("start")
    order = Window.partitionBy("asker").orderBy(F.desc_nulls_last("_start"), "project")
    projects = projects.withColumn("_start", start).where(known(F.col("project")).isNotNull())
    own = projects.join(names, F.upper("coordinator") == F.col("name"))
    own = own.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)
    counts = own.groupBy("asker").agg(F.count("*").alias("n"))
    few = names.join(counts, "asker", "left").where(F.coalesce("n", F.lit(0)) < limit // 2).select("asker", "name")
    person = F.upper(F.split_part(F.col("member"), F.lit(separator), F.lit(1)))
    teams = projects.where("coordinator IS NOT NULL").select("project", "coordinator", "_start", F.explode("team").alias("member"))
    other = teams.withColumn("person", person).join(few, F.col("person") == F.col("name"))
    other = other.where(F.upper("coordinator") != F.col("name")).dropDuplicates(["asker", "project"])
    other = other.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)
    both = own.select("asker", "project", F.lit(1).alias("step"), "nth").unionByName(
        other.select("asker", "project", F.lit(2).alias("step"), "nth")
    )
    first = Window.partitionBy("asker", "project").orderBy("step", "nth")
    return both.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
