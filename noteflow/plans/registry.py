"""The registered queries over the fixtures: name, tables, DataFrame and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noteflow.plans import fixtures

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def query(name: str, *tables: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register ``build(table)`` as a query; ``sql`` is its text over the fixtures ``fx_<table>`` and the driver's tables."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda table: fixtures.table(spark, sf_dir, table))

        QUERIES[name] = run
        if sql is not None:
            used = [t for t in tables if t in fixtures.ALL]
            body = sql.strip()
            if used and body.startswith("WITH RECURSIVE "):
                body = "WITH RECURSIVE " + fixtures.ctes(*used).rstrip()[5:] + ",\n" + body[15:]
            elif used and body.startswith("WITH "):
                body = fixtures.ctes(*used).rstrip() + ",\n" + body[5:]
            elif used:
                body = fixtures.ctes(*used) + body
            ORACLE_SQL[name] = body
        return build

    return register
