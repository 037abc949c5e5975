"""Named queries over the driver's tables, each with DuckDB SQL that gives the same rows where SQL can express it.

Doubles are rounded on both sides, since the engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | None = None):
    """Register ``f(spark, sf_dir)``; ``digits`` rounds its double columns, as the SQL does by itself."""

    def keep(f):
        QUERIES[name] = f if digits is None else lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
