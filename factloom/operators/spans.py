"""Joins over positions: containment, innermost interval, as-of, overlap.

Positions and intervals of one key meet without comparing all pairs: intervals are dealt into bins of their key, so a
position joins the few intervals of its bin; as-of lookups are one ordered pass over both sides together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def contained(points: DataFrame, intervals: DataFrame, key: list[str], bin_width: int, how: str = "inner") -> DataFrame:
    """points (key, pos, …) with each interval (key, start, end inclusive, …) of their key that holds them.

    An interval is listed in each bin that it touches; bin_width should be about the length of a long interval.
    """
    binned = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor(F.col("end") / bin_width))))
    p = points.withColumn("_bin", F.floor(F.col("pos") / bin_width))
    held = (F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("end"))
    if how == "inner":
        return p.join(binned, [*key, "_bin"]).where(held).drop("_bin")
    on = [F.col(f"p.{c}") == F.col(f"i.{c}") for c in (*key, "_bin")]
    both = p.alias("p").join(binned.alias("i"), [*on, held], how)
    return both.select("p.*", *(f"i.{c}" for c in binned.columns if c not in (*key, "_bin"))).drop("_bin")


def innermost(points: DataFrame, intervals: DataFrame, key: list[str], point_id: list[str], bin_width: int, value: str) -> DataFrame:
    """The value of the smallest interval around each point; ties go to the one that starts first."""
    hit = contained(points, intervals, key, bin_width)
    return hit.groupBy(*point_id).agg(F.min_by(value, F.struct((F.col("end") - F.col("start")).alias("size"), "start", value)).alias(value))


def latest_start(points: DataFrame, intervals: DataFrame, key: list[str], point_id: list[str], bin_width: int, value: str) -> DataFrame:
    """The value of the interval around each point that starts last."""
    hit = contained(points, intervals, key, bin_width)
    return hit.groupBy(*point_id).agg(F.max_by(value, F.struct("start", value)).alias(value))


def as_of(points: DataFrame, facts: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """points with the value of the latest fact of their key at or before them, by order; both sides share key and order columns.

    One pass in order over the union of both sides: a fact sorts before a point of the same place.
    """
    rest = [c for c in points.columns if c not in (*key, *order)]
    f = facts.select(*key, *order, F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_fact"), *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in rest))
    p = points.select(*key, *order, F.lit(1).alias("_side"), F.lit(None).cast(f.schema["_fact"].dataType).alias("_fact"), *rest)
    w = Window.partitionBy(*key).orderBy(*order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = f.unionByName(p).withColumn("_last", F.last("_fact", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*key, *order, *rest, F.col("_last.v").alias(value))


def overlap_free(rows: DataFrame, others: DataFrame, key: list[str], bin_width: int) -> DataFrame:
    """rows (key, start, end, …) that overlap none of the others of their key (half-open).

    Both sides are listed in the bins that they touch, so that a row meets only what is near it; a row of a null key stays.
    """
    binned = lambda df: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor(F.greatest("start", "end") / bin_width))))
    o = binned(others.select(*key, "start", "end")).select(*key, "_bin", F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = binned(rows.select(*key, "start", "end").distinct()).join(o, [*key, "_bin"]).where("start < _e and _s < end")
    return rows.join(hit.select(*key, "start", "end").distinct(), [*key, "start", "end"], "left_anti").select(*rows.columns)


def after_move(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Reads (event = 'read') whose latest earlier 'move' or 'write' of the key is a move."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("event") != "read", F.col("event")), ignorenulls=True).over(w)
    return events.withColumn("_state", state).where("event = 'read' and _state = 'move'").drop("_state")


def first_rebind(regions: DataFrame, writes: DataFrame, key: list[str], bin_width: int) -> DataFrame:
    """regions (key, start, end) cut off at the first write (key, pos) inside them."""
    hit = contained(writes.withColumnRenamed("pos", "pos"), regions, key, bin_width).groupBy(*key, "start", "end").agg(F.min("pos").alias("cut"))
    return regions.join(hit, [*key, "start", "end"], "left").withColumn("stop", F.coalesce("cut", "end"))
