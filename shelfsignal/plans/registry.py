"""A catalogue of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..context import Context
from .bindings import context, prelude


def r(expression: str, digits: int = 4) -> str:
    """SQL for a figure as it is compared: double precision, rounded; the small term lets both engines see a tie alike."""
    return f"round(CAST({expression} AS DOUBLE) + CAST(1e-9 AS DOUBLE), {digits})"


def tidy(df: DataFrame) -> DataFrame:
    """Figures as they are compared: whole numbers as long, others as double rounded to four digits."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + F.lit(1e-9), 4)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        columns.append(c.alias(f.name))
    return df.select(*columns)


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, operator: Callable[[Context], DataFrame], sql: str | None = None, thresholds: dict | None = None, **renamed: str) -> None:
        """``operator`` over the canonical tables, with other thresholds or tables if wanted, and its oracle."""
        self.queries[name] = lambda spark, sf_dir: tidy(operator(context(spark, sf_dir, thresholds, **renamed)))
        if sql:
            self.sql[name] = sql

    def oracle(self) -> dict[str, str]:
        return {name: prelude(sql) for name, sql in self.sql.items()}
