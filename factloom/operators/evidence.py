"""Folding a bag of typed evidence per key into one type: each reducer is a set of aggregates that combine before the shuffle.

Witness rows carry type (null for an undef arm or for counter-evidence), priority and seq (push order; later wins ties).
Types are strings: Numeric, Bool, String, HashRef, Hash{…}, ArrayRef, Sequence(…), Class:name, …; Optional<T> wraps one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OVERRIDE_PRIORITY, ANNOTATION_PRIORITY, DEFAULT_PRIORITY = 100, 20, 10


def is_hash(t: Column) -> Column:
    return t.startswith("Hash")


def is_array(t: Column) -> Column:
    return t.startswith("Array") | t.startswith("Sequence")


def is_class(t: Column) -> Column:
    return t.startswith("Class:")


def latest(t: Column, seq: Column, where: Column | None = None) -> Column:
    """The last pushed type."""
    there = t.isNotNull() if where is None else t.isNotNull() & where
    return F.max_by(t, F.when(there, seq))


def override(t: Column, priority: Column, seq: Column) -> Column:
    """The type of the highest priority above the default; ties go to the last pushed."""
    return F.max_by(t, F.when(t.isNotNull() & (priority > DEFAULT_PRIORITY), F.struct(priority.alias("p"), seq.alias("s"))))


def agreement(t: Column, seq: Column) -> Column:
    """One type that all agree on, or a coarser one, or the object that absorbs hashes; else null."""
    return (
        F.when(F.min(t) == F.max(t), F.min(t))
        .when(F.bool_and(is_hash(t)), F.lit("HashRef"))
        .when(F.bool_and(is_array(t)), F.lit("ArrayRef"))
        .when(F.bool_and(t.isin("Bool", "Numeric")), F.lit("Numeric"))
        .when(F.bool_and(is_class(t) | is_hash(t)), latest(t, seq, is_class(t)))
    )


def lifted(base: Column, undef: Column) -> Column:
    """Optional<T> where some arm was undef and the others agree on a T that isn't optional."""
    return F.when(undef & base.isNotNull() & ~base.startswith("Optional<"), F.concat(F.lit("Optional<"), base, F.lit(">"))).otherwise(base)


def return_arms(t: Column, seq: Column) -> Column:
    return lifted(agreement(t, seq), F.bool_or(t.isNull()))


def slot(t: Column, seq: Column) -> Column:
    """Agreement, unless two different classes were written."""
    of = F.when(is_class(t), t)
    return F.when(F.min(of) == F.max(of), agreement(t, seq)).when(F.min(of).isNull(), agreement(t, seq))


def branch_arms(t: Column, seq: Column, fallback: Column) -> Column:
    """Strict agreement of two arms at least; with fallback arms their agreement with the rest, else the first fallback."""
    floor = F.min_by(t, F.when(t.isNotNull() & fallback, seq))
    agreed = F.when(F.min(t) == F.max(t), F.min(t))
    strict = F.when(F.count("*") >= 2, lifted(agreed, F.bool_or(t.isNull())))
    return F.when(floor.isNotNull(), F.coalesce(agreed, floor)).otherwise(strict)


def majority(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, winner, n, total: the strict majority of all rows (null values count against it), of two rows at least; ties go to the smallest name."""
    votes = rows.groupBy(*key, value).agg(F.count("*").alias("n"))
    # the most votes, then the smallest value: counts are negated so that one minimum does both
    best = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col("n")).alias("m"), F.col(value).alias("winner")))).alias("x")
    out = votes.groupBy(*key).agg(best, F.sum("n").alias("total")).select(*key, "x.winner", (-F.col("x.m")).alias("n"), "total")
    return out.where((F.col("total") >= 2) & (F.col("n") * 2 > F.col("total")))


def ladder(t: Column, priority: Column, seq: Column) -> Column:
    """The reducers in their order; the first that answers wins."""
    return F.coalesce(override(t, priority, seq), return_arms(t, seq), latest(t, seq))


def arity_guard(kind: Column, n: Column, hint: Column) -> Column:
    """Whether a guard (empty, exact n, at least n, at most n, any) takes a call of hint arguments; an unknown number satisfies any only."""
    known = F.when(kind == "empty", hint == 0).when(kind == "exact", hint == n).when(kind == "at_least", hint >= n).when(kind == "at_most", hint <= n)
    return (kind == "any") | F.coalesce(known, F.lit(False))


def arity_fit(argc: Column, total: Column, required: Column, variadic: Column) -> Column:
    """0 exact, 1 within defaults, 2 by a variadic tail, 3 none."""
    return F.when(argc == total, 0).when((argc >= required) & (argc < total), 1).when(variadic & (argc >= required), 2).otherwise(3)
