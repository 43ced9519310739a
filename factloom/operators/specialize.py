"""Specialised templates, loader configuration and query-time hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, functions as F

ANY = "*"


def matching_specs(instances: DataFrame, patterns: DataFrame, args: list[str], instance_id: str, pattern_id: str) -> DataFrame:
    """instance_id, pattern_id, fixed: the patterns each instance meets with most arguments fixed; ANY takes every argument.

    A pattern belongs to one choice of fixed arguments, and each choice is an equi-join of its own: no wildcard is compared.
    """
    found = None
    for fixed in product((True, False), repeat=len(args)):
        of = patterns
        for a, f in zip(args, fixed, strict=True):
            of = of.where((F.col(a) != ANY) if f else (F.col(a) == ANY))
        on = [a for a, f in zip(args, fixed, strict=True) if f]
        of = of.select(pattern_id, *on)
        hit = instances.join(of, on) if on else instances.join(F.broadcast(of.agg(F.min(pattern_id).alias(pattern_id)).where(F.col(pattern_id).isNotNull())))  # the primary template: one row
        hit = hit.select(instance_id, pattern_id, F.lit(len(on)).alias("fixed"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(instance_id).agg(F.max("fixed").alias("fixed"))
    return found.join(best, [instance_id, "fixed"], "left_semi")


def loader_parameters(loads: DataFrame, configs: DataFrame, parameters: DataFrame) -> DataFrame:
    """parameters (class, name, type) typed by whoever loads the class: loads (class, loader), configs (loader, name, type).

    A type of its own stays; loaders that disagree leave the parameter untyped.
    """
    given = loads.join(configs, "loader").groupBy("class", "name").agg(F.when(F.min("type") == F.max("type"), F.min("type")).alias("given"))
    return parameters.join(given, ["class", "name"], "left").select("class", "name", F.coalesce("type", "given").alias("type"))


@dataclass(frozen=True)
class HookAnswer:
    """What a query-time hook adds to a question's answer; exclusive answers stand alone."""

    rows: DataFrame
    exclusive: bool = False


def answer(question: str, own: DataFrame, hooks: Iterable[Callable[[str], HookAnswer | None]]) -> DataFrame:
    """The engine's own rows with what hooks add; the first exclusive hook answers alone, and a hook that has nothing is skipped."""
    out = own
    for hook in hooks:
        got = hook(question)
        if got is None:
            continue
        if got.exclusive:
            return got.rows
        out = out.unionByName(got.rows)
    return out.dropDuplicates()
