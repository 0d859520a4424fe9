"""The write log and its fold: last write wins.

A log is a table (seq, ord, op, id, vector, attrs); op is ``upsert`` or ``delete``. An upsert replaces the whole document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_SCHEMA = "seq long, ord int, op string, id long, vector array<float>, attrs map<string, struct<b: boolean, i: bigint, f: double, s: string>>"


def last_entries(log: DataFrame) -> DataFrame:
    """The last entry of each id, deletes included.

    A grouped maximum: entries are combined on the map side, so an id written very often costs one row per task.
    """
    rest = [c for c in log.columns if c != "id"]
    last = log.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("seq", "ord")).alias("last"))
    return last.select("id", *[F.col(f"last.`{c}`").alias(c) for c in rest])


def fold(log: DataFrame) -> DataFrame:
    """The live documents after all entries: for each id the last entry, unless it is a delete."""
    return last_entries(log).where("op = 'upsert'").drop("op", "seq", "ord")


def overlay(base: DataFrame, tail: DataFrame, in_order: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of a base (id, seq, ord, ...) that a tail of last entries does not replace, and the tail's that count.

    Rows of the base are never shuffled while the tail is small. ``in_order`` says that every entry of the tail is later than
    the base; otherwise entries older than the base's are left out of the tail.
    """
    ids = tail.select("id", F.struct("seq", "ord").alias("_at"))
    if in_order:
        return base.join(ids.select("id"), "id", "left_anti"), tail
    at = base.select("id", F.struct("seq", "ord").alias("_base"))
    fresh = tail.join(at, "id", "left").where(F.col("_base").isNull() | (F.struct("seq", "ord") > F.col("_base"))).drop("_base")
    return base.join(fresh.select("id"), "id", "left_anti"), fresh


def delete_ids(docs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Documents without those ids; unknown ids change nothing."""
    gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def upsert(docs: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Whole-document replacement; attributes that a new row lacks become null."""
    return delete_ids(docs, rows.select(id_col), id_col).unionByName(rows, allowMissingColumns=True)
