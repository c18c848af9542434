"""All queries of the core and their SQL."""

from __future__ import annotations

from ravelin.plans import analytics, documents, graphs, problems, questions

MODULES = [problems, documents, graphs, analytics, questions]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.queries().items()}


def sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.sql().items()}
