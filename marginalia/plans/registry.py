"""All registered queries of the core library with their SQL oracles."""

from __future__ import annotations

from marginalia.plans import governance, knowledge, learning, records, relations, tables, text  # noqa: F401  (they register their queries)
from marginalia.plans.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
