"""Table loading, sinks, and the builder of regular series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.options(header=True, **options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = (), mode: str = "error") -> None:
    df.write.mode(mode).format(kind).partitionBy(*by).save(path)


def regular_series(df: DataFrame, time: str, value: Column, unit: str = "day", by: Sequence[str] = (), fill: float | None = None) -> DataFrame:
    """Sum ``value`` over each calendar unit and number the units: ``by...``, ``period``, ``t`` from 0, ``y``.

    :param fill: value of units without rows between a series' first and last; None leaves them out
    """
    buckets = df.groupBy(*by, F.date_trunc(unit, F.col(time)).alias("period")).agg(F.sum(value).alias("y"))
    if fill is not None:
        span = buckets.groupBy(*by).agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
        step = F.expr(f"interval 1 {unit}")
        grid = span.select(*by, F.explode(F.sequence("lo", "hi", step)).alias("period"))
        buckets = grid.join(buckets, [*by, "period"], "left").withColumn("y", F.coalesce("y", F.lit(float(fill))))
    order = W.partitionBy(*by).orderBy("period") if by else W.partitionBy(F.lit(0)).orderBy("period")
    return buckets.withColumn("t", F.row_number().over(order) - 1).select(*by, "period", "t", "y")


def daily_series(events: DataFrame) -> DataFrame:
    """Daily sums of ``value`` by ``event_type``, t from 0."""
    return regular_series(events, "ts", F.col("value"), "day", ["event_type"])
