"""The queries over the test tables, with their DuckDB SQL."""

from __future__ import annotations

from .plans import agent, answers, indexes, memories, records, requests, retrieval, stores, texts

FLAGSHIP = "v9_hybrid_fusion"


PLANS = (retrieval, indexes, records, agent, texts, stores, answers, memories, requests)


def queries() -> dict:
    return {name: q for plan in PLANS for name, q in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
