"""All queries of the image-analytics operators and the SQL they are checked against."""

from __future__ import annotations

from .plans import bank_queries, file_queries, grid_queries, synthesis_queries, table_queries  # noqa: F401
from .plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
