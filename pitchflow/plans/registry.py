"""Queries of the analytics library by name, with their SQL."""

from __future__ import annotations

from . import documents, evidence, files, fused, league, load, match, names, reports, retrieval, teams

MODULES = (match, load, league, fused, files, documents, teams, retrieval, reports, evidence, names)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
