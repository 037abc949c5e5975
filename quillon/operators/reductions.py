"""Vector reductions, element-wise arithmetic, distances and moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dot, ordered, running


def reductions(df: DataFrame, col: str, by: Sequence[str] = (), delta: float = 0.0) -> DataFrame:
    """Sum, mean, extremes, norms, squared deviations from ``delta``, biased deviation and a test for infinities, in one pass."""
    x = F.col(col).cast("double")
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.sum(F.abs(x)).alias("l1"), F.sqrt(F.sum(x * x)).alias("l2"), F.max(F.abs(x)).alias("max_abs"),
        F.sum((x - delta) * (x - delta)).alias("sum_sq"), F.stddev_pop(x).alias("std"), F.max(F.abs(x) == float("inf")).alias("has_inf"),
    )


def array_norms(x: Column) -> dict[str, Column]:
    """Norms of an array column."""
    fold = lambda f, g=lambda s, v: s + v: F.aggregate(F.transform(x, f), F.lit(0.0), g)
    return {"l1": fold(F.abs), "l2": F.sqrt(fold(lambda v: v * v)), "max_abs": fold(F.abs, lambda s, v: F.greatest(s, v))}


def distances(a: Column, b: Column) -> dict[str, Column]:
    """Inner product and L1, L2, largest-component distances of two array columns."""
    gap = F.zip_with(a, b, lambda u, v: F.abs(u - v))
    fold = lambda f, g=lambda s, v: s + v: F.aggregate(F.transform(gap, f), F.lit(0.0), g)
    return {"dot": dot(a, b), "l1": fold(lambda v: v), "l2": F.sqrt(fold(lambda v: v * v)), "linf": fold(lambda v: v, lambda s, v: F.greatest(s, v))}


def axpy(a: float | Column, x: Column, y: Column) -> Column:
    """a * x + y of array columns."""
    return F.zip_with(x, y, lambda u, v: u * a + v)


def scale(x: Column, a: float | Column) -> Column:
    return F.transform(x, lambda v: v * a)


def add_const(x: Column, a: float | Column) -> Column:
    return F.transform(x, lambda v: v + a)


def divide(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda u, v: u / v)


def cumulative_sum(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str], name: str = "cumsum") -> DataFrame:
    return df.withColumn(name, F.sum(col).over(running(by, order)))


def cumulative_product(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str], name: str = "cumprod") -> DataFrame:
    """Running product from logarithms; a zero makes it zero from there on and the signs are counted."""
    w, x = running(by, order), F.col(col)
    size = F.exp(F.sum(F.when(x != 0, F.log(F.abs(x))).otherwise(0.0)).over(w))
    negative = F.sum((x < 0).cast("int")).over(w) % 2 == 1
    zero = F.max((x == 0).cast("int")).over(w) == 1
    return df.withColumn(name, F.when(zero, 0.0).when(negative, -size).otherwise(size))


def moments(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, biased deviation, skewness m3 / m2**1.5 and raw kurtosis m4 / m2**2."""
    x = F.col(col).cast("double")
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("skewness"), (F.kurtosis(x) + 3).alias("kurtosis")
    )


def lagged(df: DataFrame, col: str, lags: Sequence[int], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Columns ``col_lagK``; null before a group's K-th row."""
    w = ordered(by, order)
    return df.withColumns({f"{col}_lag{k}": F.lag(col, k).over(w) for k in lags})


def differenced(df: DataFrame, col: str, by: Sequence[str], order: Sequence[str], d: int = 1, seasonal: int = 0, period: int = 1, name: str = "diff") -> DataFrame:
    """``d`` simple and ``seasonal`` seasonal differences; null where a term is missing."""
    w = ordered(by, order)
    df = df.withColumn(name, F.col(col))
    for step in [1] * d + [period] * seasonal:
        df = df.withColumn(name, F.col(name) - F.lag(name, step).over(w))
    return df


def trend_columns(df: DataFrame, by: Sequence[str], order: Sequence[str], trend: str = "ct") -> DataFrame:
    """Columns const, trend, trend_squared for ``n``, ``c``, ``ct`` or ``ctt``; time starts at 1."""
    if trend not in ("n", "c", "ct", "ctt"):
        raise ValueError("trend must be n, c, ct or ctt")
    t = F.row_number().over(ordered(by, order)).cast("double")
    cols = {"const": F.lit(1.0), "trend": t, "trend_squared": t * t}
    return df.withColumns({k: cols[k] for k in list(cols)[: len(trend) if trend != "n" else 0]})


def slice_rows(df: DataFrame, start: int, stop: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows ``start`` to ``stop`` - 1 of each group, counted from 0."""
    row = F.row_number().over(ordered(by, order)) - 1
    return df.withColumn("__row", row).where((F.col("__row") >= start) & (F.col("__row") < stop)).drop("__row")


def box_cox(x: Column, lam: float) -> Column:
    """(x**lam - 1) / lam, or log x for 0; null unless x is positive."""
    return F.when(x > 0, F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / lam)


def moving_average(df: DataFrame, col: str, width: int, by: Sequence[str], order: Sequence[str], name: str = "average") -> DataFrame:
    """Average of ``width`` neighbouring rows, placed at the first; null where fewer are left."""
    w = ordered(by, order).rowsBetween(0, width - 1)
    return df.withColumn(name, F.when(F.count(col).over(w) == width, F.avg(col).over(w)))
