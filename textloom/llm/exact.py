"""Exact dedup by a heavy-hitter split.

Digests that are frequent enough to overload one task are found by the Misra-Gries summary
(`DataFrame.stat.freqItems`), counted again exactly, and their winners are broadcast, so those rows never
shuffle. By the summary's guarantee every other digest holds under 1/SLOTS of the rows; those go through an
ordinary shuffled aggregation and join. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_key, without_rows, written

#: Counters of the Misra-Gries summary; also the most rows that the broadcast side can have.
SLOTS = 200


def text_digest(text) -> F.Column:
    """Hex SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def heavy_digests(keyed: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Every digest with over 1/slots of the rows, and at most `slots` digests in all."""
    found = keyed.stat.freqItems(["text_sha256"], 1.0 / slots)
    return found.select(F.explode("text_sha256_freqItems").alias("text_sha256"))


def winners(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def judged(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The columns of exact_groups, and text_key."""
    keyed = docs.select("doc_id", text_digest(F.col("text")).alias("text_sha256"), text_key(docs).alias("text_key"))
    keyed = written(keyed, "digests")
    heavy = written(heavy_digests(keyed, slots), "heavy-digests")
    verified = winners(keyed.join(F.broadcast(heavy), "text_sha256")).where("group_size > 1")
    verified = written(verified, "heavy-winners")  # at most `slots` rows
    frequent = keyed.join(F.broadcast(verified), "text_sha256")
    rest = keyed.join(F.broadcast(verified.select("text_sha256")), "text_sha256", "left_anti")
    # Singletons win by default, so only digests with copies take part in the join.
    repeated = winners(rest).where("group_size > 1")
    ordinary = rest.join(repeated, "text_sha256", "left").select(
        "text_sha256",
        "doc_id",
        "text_key",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    )
    return frequent.select(*ordinary.columns).unionByName(ordinary).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "text_key"
    )


def exact_groups(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null text is the empty text, and empty texts form
    one group. The largest doc_id of a group stays; a null doc_id stays only in a group without any other.
    Rows that repeat a doc_id with an equal text are one document listed again: they count in group_size and
    get the same answer. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    return judged(docs, slots).drop("text_key")


def exact_dedup(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows of `docs` that exact_groups keeps, with all their columns, whatever their names.

    Each row is judged by its own text: of rows that repeat a doc_id with other texts each is kept or not as its
    text's group has it. Rows that repeat both doc_id and text all stay, as they are one document.
    """
    return without_rows(docs, judged(docs, slots).where("NOT kept"))
