"""The opN_ queries of this subpackage and their oracles."""

from __future__ import annotations

from factloom.llm import q_licenses, q_passages, q_quality, q_records, q_text, q_vectors

MODULES = [q_text, q_records, q_quality, q_licenses, q_passages, q_vectors]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
