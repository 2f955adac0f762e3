"""All registered queries."""

from __future__ import annotations

from checks import engine, layouts, reading, reports

MODULES = (engine, reading, layouts, reports)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.ORACLE.items()}
