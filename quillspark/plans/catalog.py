"""The registered queries of the search engine itself and their SQL."""

from __future__ import annotations

from . import page_queries, search_queries, table_queries  # noqa: F401  (each registers its queries)
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
