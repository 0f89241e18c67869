"""Table access and registration shared by the query families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries by name, and the DuckDB SQL of those that have one."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, sql: str | None = None):
        def take(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return take


def sql_value(x) -> str:
    return "NULL" if x is None else "true" if x is True else "false" if x is False else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def cases_sql(cases: list[tuple], table: str, key: str, columns: dict[str, str]) -> str:
    """Each row of ``table`` with what is expected of the case that its key picks: cases are (input, expected ...), stated by hand.

    ``columns``: name → SQL type of the expected values.
    """
    rows = ", ".join(f"({i}, {', '.join(map(sql_value, c[1:]))})" for i, c in enumerate(cases))
    picked = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in columns.items())
    return f"WITH c(i, {', '.join(columns)}) AS (VALUES {rows}) SELECT {key}, {picked} FROM {table} JOIN c ON {key} % {len(cases)} = c.i"


def case_input(cases: list[tuple], key: str) -> Column:
    """The input of the case that a row's key picks."""
    return F.element_at(F.array(*[F.lit(c[0]).cast("string") for c in cases]), (F.col(key) % len(cases) + 1).cast("int"))
