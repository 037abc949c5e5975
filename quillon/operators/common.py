"""Windows, missing values and small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered(by: Sequence[str], order: Sequence[str]):
    """Rows of a group in their order."""
    return (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(*order)


def running(by: Sequence[str], order: Sequence[str]):
    """From a group's first row to the current one."""
    return ordered(by, order).rowsBetween(W.unboundedPreceding, 0)


def missing(df: DataFrame, cols: Sequence[str], policy: str = "drop") -> DataFrame:
    """Apply a policy for missing values once: ``none``, ``raise`` or ``drop``.  NaN and null are both missing."""
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))})
    if policy == "none":
        return df
    if policy == "drop":
        return df.dropna(subset=list(cols))
    if policy == "raise":
        return df.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"missing value in {c}")).cast("double")) for c in cols})
    raise ValueError(f"unknown missing-value policy {policy!r}")


def per_group(df: DataFrame, by: Sequence[str], order: Sequence[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, cols: Sequence[str]) -> DataFrame:
    """One kernel call per group over its rows in order.

    For recursions that are sequential along one series: a group is one task's work, so its length must fit in
    memory.  The result has the group's columns first.  Groups are dealt over all shuffle partitions: kernels are long
    on work and short on bytes, so that merging small partitions would run them one after the other.

    :param run: gets the group's rows, gives rows without the group's columns
    """
    keys = list(by)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    full = f"{kinds}, {schema}" if kinds else schema

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable") if order else pdf
        out = run(pdf)
        for i, k in enumerate(keys):
            out.insert(i, k, [pdf[k].iloc[0]] * len(out))
        return out

    some = df.select(*keys, *[c for c in dict.fromkeys([*order, *cols]) if c not in keys])
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = some.repartition(tasks, *keys).groupBy(*keys) if keys else some.withColumn("__all", F.lit("all")).groupBy("__all")
    return grouped.applyInPandas(call, full)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; null where a column is constant (the built-in one fails there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
