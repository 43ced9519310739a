"""Names of the engine's queries, each with its DataFrame plan and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator that adds a query under a name, with its oracle where SQL can express it."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_ORACLES)


def load() -> None:
    """Import every module that registers queries."""
    from factloom.plans import q_drivers, q_evidence, q_extension, q_extract, q_frameworks, q_graph, q_macros, q_navigate, q_outlines, q_reducers, q_relational, q_reports, q_scalar, q_spans, q_specialize, q_streaming, q_targets, q_upkeep, q_verbs, q_warehouse  # noqa: F401
