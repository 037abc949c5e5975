"""Tables put together: below one another, side by side, products of coordinate matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all tables, by column name; a column that a table lacks is null there."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def zip_by_position(left: DataFrame, right: DataFrame, by: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The n-th rows of each group side by side: ``by...``, ``position`` from 0, then the other columns; the longer side's rest is dropped.

    A group is one window partition, so its rows must fit in a task's sort, which spills.
    """

    def numbered(df, order):
        return df.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)

    return numbered(left, left_order).join(numbered(right, right_order), [*by, "position"])


def product(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Product of coordinate matrices (``by...``, i, j, value), key by key; absent cells are 0."""
    right = b.select(*by, F.col("i").alias("__k"), F.col("j").alias("__j"), F.col("value").alias("__v"))
    both = a.withColumn("__k", F.col("j")).join(right, [*by, "__k"])
    return both.groupBy(*by, "i", F.col("__j").alias("j")).agg(F.sum(F.col("value") * F.col("__v")).alias("value"))


def transposed(a: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return a.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "value")
