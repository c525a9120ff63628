"""A registry of named queries and, where SQL can express them, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.oracle[name] = sql
            return f

        return add

    def sql(self, name: str, spark_sql: str, duck_sql: str | None = None, tables: str = "") -> None:
        """A query that is one SQL text; ``tables`` lists the tables it reads, which become temporary views."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(spark_sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()})

        self.queries[name] = run
        self.oracle[name] = duck_sql or spark_sql.replace("{", "").replace("}", "")
