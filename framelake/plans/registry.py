"""Every registered query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalog, filter_queries, join_queries, model_queries, search_queries, source_queries, stat_queries, stream_queries  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship search: exact cosine top-k, second pass, scene and folder de-duplication."""
    return search_queries.search(spark, sf_dir)


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
