"""All queries over the library's own operators, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import eval_queries, file_queries, maintenance_queries, search_queries
from .plans.registry import Query

_ALL = [file_queries.query, search_queries.query, maintenance_queries.query, eval_queries.query]
QUERIES: dict[str, Query] = {name: f for group in _ALL for name, f in group.functions.items()}
ORACLE_SQL: dict[str, str] = {name: sql for group in _ALL for name, sql in group.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.r07_hybrid(spark, sf_dir)
