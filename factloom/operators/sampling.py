"""Deterministic samples and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions.names import hash_share


def hash_sample(rows: DataFrame, identity: list[Column], weight: Column) -> DataFrame:
    """Rows whose identity hashes below their weight; the same rows on every run."""
    return rows.where(hash_share(*identity) < weight)


def round_robin_cap(rows: DataFrame, group: list[str], kind: str, order: Column, cap: int) -> DataFrame:
    """At most cap rows per group, taken from its kinds in turn.

    The cap per kind comes first, so that the second window sees cap rows per kind at most.
    """
    w = Window.partitionBy(*group, kind).orderBy(order)
    ranked = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
    turn = Window.partitionBy(*group).orderBy("_r", kind)
    return ranked.withColumn("_t", F.row_number().over(turn)).where(F.col("_t") <= cap).drop("_r", "_t")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def ranked_cut(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with incomplete: whether there were more. One row more than k is read for that."""
    top = rows.orderBy(*order).limit(k + 1).withColumn("_r", F.row_number().over(Window.orderBy(*order)))  # of k + 1 rows
    more = F.max("_r").over(Window.partitionBy(F.lit(1))) > k
    return top.withColumn("incomplete", more).where(F.col("_r") <= k).drop("_r")
