"""Values derived from other files' values, kept with the seal of what they were derived from.

A change reaches the readers of what changed; of those only the ones whose seal moved are derived again, and only where the
value moved too does the change go on. So a round costs its frontier, not the view. requires: reader, provider (repeated rows
count once). values: key, value, of providers and readers alike; seals: key, seal, of what has been derived.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from factloom.operators.graph import cut

Derive = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class View:
    """values, seals; derived: key, round of what was derived again; settled: whether the rounds came to an end."""

    values: DataFrame
    seals: DataFrame
    derived: DataFrame
    settled: bool


def sealed(requires: DataFrame, values: DataFrame, readers: DataFrame | None = None) -> DataFrame:
    """key, seal: of each reader, or of those in readers (key), what all its providers say now; a provider without a value counts too."""
    r = requires.select(F.col("reader").alias("key"), F.col("provider")).distinct()
    if readers is not None:
        r = r.join(readers, "key", "left_semi")
    says = r.join(values.select(F.col("key").alias("provider"), "value"), "provider", "left")
    return says.groupBy("key").agg(F.sum(F.xxhash64("provider", F.col("value").isNull(), "value").cast("decimal(38,0)")).alias("seal"))


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new, "key", "left_anti").unionByName(new)


def refresh(requires: DataFrame, values: DataFrame, seals: DataFrame, changed: DataFrame, derive: Derive, max_rounds: int = 20) -> View:
    """Bring a view up to date after the values of changed (key) moved; values already holds what they are now.

    derive takes the keys to derive (key) and all values, and gives (key, value) for those keys; a key that it leaves out has
    no value any more. A view whose values chase each other in a circle isn't settled after max_rounds.
    """
    frontier, derived = changed.select("key").distinct(), None
    for n in range(1, max_rounds + 1):
        readers = requires.join(frontier.select(F.col("key").alias("provider")), "provider", "left_semi").select(F.col("reader").alias("key")).distinct()
        now = sealed(requires, values, readers)
        moved = cut(now.join(seals.withColumnRenamed("seal", "before"), "key", "left").where(~F.col("seal").eqNullSafe(F.col("before"))).select("key", "seal"))
        done = moved.select("key", F.lit(n).alias("round"))
        derived = done if derived is None else derived.unionByName(done)
        if moved.isEmpty():
            return View(values, seals, derived, True)
        new = cut(moved.select("key").join(derive(moved.select("key"), values), "key", "left"))
        frontier = cut(new.join(values.withColumnRenamed("value", "before"), "key", "left").where(~F.col("value").eqNullSafe(F.col("before"))).select("key"))
        values, seals = cut(replaced(values, new)), cut(replaced(seals, moved))
    return View(values, seals, derived, frontier.isEmpty())
