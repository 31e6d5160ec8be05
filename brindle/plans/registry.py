"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_PLANS = ("retrieval", "scopes", "rerank", "windows", "joins", "aggregates", "gates", "decisions", "texts", "language", "guards", "files", "ingest", "streams", "parts")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` is DuckDB SQL for the same rows."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for plan in _PLANS:
        import_module(f"brindle.plans.{plan}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["J1_J3_hybrid_retrieval"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
