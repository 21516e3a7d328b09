"""Ingesting records: one schema, no duplicates, enriched nested arrays, limits per group, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import known


def canonical(pages: DataFrame) -> DataFrame:
    """doc_id, content, title, kind, source, extra: pages of the new or the old schema as documents.

    A page is of the new schema if its embedding_text isn't null. The title ends before the first ` | `; pages
    without content are left out; extra metadata overrides what it names.
    """
    new = F.col("embedding_text").isNotNull()
    content = F.trim(F.when(new, F.col("embedding_text")).otherwise(F.col("text")))
    title = F.when(new, F.col("titulo")).otherwise(F.trim(F.split_part(F.col("title"), F.lit(" | "), F.lit(1))))
    fixed = F.create_map(
        F.lit("source"), F.coalesce(F.col("metadata")["url"], F.col("url")), F.lit("titulo"), title, F.lit("tipo"), F.col("tipo")
    )
    extra = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    return pages.select(
        F.nullif(F.col("id"), F.lit("")).alias("doc_id"),
        content.alias("content"),
        title.alias("title"),
        F.col("tipo").alias("kind"),
        F.map_concat(fixed, extra).alias("metadata"),
    ).where(F.length("content") > 0)


def longest_per_key(rows: DataFrame, key: Column, text: str, ordinal: str) -> DataFrame:
    """Of the rows of a key the one with the longest text, the first of equals by the ordinal."""
    order = Window.partitionBy(key).orderBy(F.desc(F.length(text)), ordinal)
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def limited_per_group(rows: DataFrame, group: str, ordinal: str, most: int) -> DataFrame:
    """The first `most` rows of each group by the ordinal."""
    order = Window.partitionBy(group).orderBy(ordinal)
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def upserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The existing rows, replaced or joined by the new ones; new rows without a key are left out.

    A key must stand once on each side.
    """
    both = existing.withColumn("batch", F.lit(0)).unionByName(new.where(F.col(key).isNotNull()).withColumn("batch", F.lit(1)))
    latest = Window.partitionBy(key).orderBy(F.desc("batch"))
    return both.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth")


def enriched_members(
    parents: DataFrame, parent_id: str, members: str, people: DataFrame, url: str = "url"
) -> DataFrame:
    """parents with their array of member structs (name, unit, url, lattes), blanks filled from people (url, unit,
    lattes, ordinal): the last person of a url counts. Members keep their order; a null array becomes empty."""
    last = Window.partitionBy(url).orderBy(F.desc("ordinal"))
    people = people.withColumn("_nth", F.row_number().over(last)).where("_nth = 1")
    people = people.select(F.col(url).alias("_url"), F.col("unit").alias("_unit"), F.col("lattes").alias("_lattes"))
    out = parents.select(parent_id, F.posexplode_outer(members).alias("pos", "m"))
    joined = out.join(people, F.col("m")[url] == F.col("_url"), "left")
    filled = F.struct(
        F.col("pos"),
        F.col("m.name").alias("name"),
        F.coalesce(known(F.col("m.unit")), known(F.col("_unit"))).alias("unit"),
        F.col(f"m.{url}").alias(url),
        F.coalesce(known(F.col("m.lattes")), known(F.col("_lattes"))).alias("lattes"),
    )
    nested = joined.groupBy(parent_id).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), filled))), lambda s: s.dropFields("pos")).alias(members)
    )
    return parents.drop(members).join(nested, parent_id)
