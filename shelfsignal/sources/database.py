"""Tables of a database: read in parts, with filters and columns left to it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a part of a read is meant to have, and connections at most.
ROWS, PARTS = 500_000, 64


def read_table(spark: SparkSession, url: str, table: str, number: str | None = None, rows: int = ROWS, parts: int = PARTS, options: Mapping[str, str] | None = None) -> DataFrame:
    """A table, or a query in parentheses with an alias, as a lazy frame: what is selected and filtered from it reaches the database.

    ``number`` names a whole-number or date column by whose range the read is
    cut into parts, one connection each; its bounds and the number of rows are
    asked of the database first (one row). Without it one task reads all. Rows
    without a number are in the first part. Parts are as even as the numbers.
    """
    source = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", 10_000).options(**(options or {}))
    whole = source.load()
    if number is None:
        return whole
    low, high, n = whole.agg(F.min(number), F.max(number), F.count("*")).first()
    wanted = min(parts, -(-n // rows))
    if low is None or low == high or wanted < 2:
        return whole
    return source.option("partitionColumn", number).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", wanted).load()


def write_table(df: DataFrame, url: str, table: str, options: Mapping[str, str] | None = None) -> None:
    """``df`` as a new table, text columns of a bounded length where a database needs one."""
    kinds = ", ".join(f'"{f.name}" VARCHAR(4000)' for f in df.schema.fields if isinstance(f.dataType, T.StringType))
    out = df.write.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {}))
    (out.option("createTableColumnTypes", kinds.replace('"', "")) if kinds else out).mode("errorifexists").save()
