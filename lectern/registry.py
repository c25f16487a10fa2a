"""Registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import library_queries, repair_queries, source_queries  # noqa: F401  they register their queries
from .plans.queries import QUERIES, SQL

FLAGSHIP = "top01_cosine_topk"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
