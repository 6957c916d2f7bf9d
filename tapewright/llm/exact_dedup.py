"""Exact dedup: rows are grouped by a 128-bit content hash and by the bytes themselves.

Only DataFrame functions are used. The grouping carries the text behind the hash, so two texts whose
hashes collide fall into two groups. Counting and choosing the row that stays are partial aggregates:
a group that holds a third of all rows leaves each task as one row. The way back to the documents is
a join on the hash, whose hot keys adaptive execution splits.

Defined results:
* a null text equals an empty one (``null_as_empty``);
* an empty table gives an empty result;
* rows without an id count in ``group_size`` but never stay while a row of their group has an id;
  a group without any id has ``keep_id`` null and all its rows stay;
* rows that repeat both id and text of the row that stays are all marked kept;
* other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, _UPPER, _LOWER)


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "min" or "max": which id of a group stays.
    """
    best = {"min": F.min, "max": F.max}[keep]
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    groups = (
        rows.groupBy(F.md5("text").alias("content"), "text")
        .agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.unhex("content").alias("content"), F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    keyed = rows.select("id", F.unhex(F.md5("text")).alias("content"), F.sha2("text", 256).alias("text_sha256"))
    return keyed.join(groups, ["content", "text_sha256"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The documents that stay, with all their columns; a row without an id stays if its group has no id.

    Rows go by id and text hash, so another text of the same id, or of no id, is not taken along.
    """
    gone = exact_groups(docs, id_col=id_col, text_col=text_col, keep=keep).where(~F.col("kept"))
    gone = gone.select(F.col(id_col).alias("gone_id"), F.unhex("text_sha256").alias("gone_sha")).distinct()
    sha = F.unhex(F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["gone_id"]) & (sha == gone["gone_sha"]), "left_anti")
