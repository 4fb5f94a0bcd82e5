"""The registered queries: a Spark plan each, with the SQL that has to agree where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixtures, duckdb_text

PLANS: dict[str, tuple[Callable[[Fixtures], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = (fn, sql)
        return fn

    return add


def _runner(fn) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(fn) for name, (fn, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: duckdb_text(sql) for name, (_, sql) in PLANS.items() if sql}
