"""All queries of the core library with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The fixture tables of one folder, read as they are used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register ``fn(tables)`` under its name, with the SQL that gives the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


from . import queries_bindings, queries_curation, queries_datasets, queries_items, queries_lineage, queries_protocol, queries_ranking, queries_release, queries_reports, queries_review, queries_scoring, queries_text, queries_validation  # noqa: E402, F401
