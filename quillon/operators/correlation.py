"""Correlation and serial dependence."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dist
from .common import corr, ordered, per_group


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation, clamped to [-1, 1]; null for a constant column."""
    some = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return some.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), corr(x, y).alias("r")).withColumn("r", F.when(F.col("r").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "r"))))


def pearson_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """All pairs in one aggregation, as rows: ``by...``, i, j, value."""
    pairs = list(combinations_with_replacement(cols, 2))
    wide = df.groupBy(*by).agg(*[(F.lit(1.0) if a == b else corr(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(u).alias("i"), F.lit(v).alias("j"), F.col(f"c{i}").alias("value")) for i, (a, b) in enumerate(pairs) for u, v in dict.fromkeys([(a, b), (b, a)])]
    return wide.select(*by, F.explode(F.array(*cells)).alias("m")).select(*by, "m.*")


def average_rank(col: str | Column, by: Sequence[str] = ()) -> Column:
    """Ranks from 1, tied values sharing their average."""
    c = F.col(col) if isinstance(col, str) else col
    order = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(c)
    ties = W.partitionBy(*by, c)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of average ranks."""
    some = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = some.select(*by, average_rank(x, by).alias("__rx"), average_rank(y, by).alias("__ry"))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), corr("__rx", "__ry").alias("rho"))


def kendall(df: DataFrame, x: str, y: str, by: Sequence[str] = (), variant: str = "b") -> DataFrame:
    """Kendall's tau-b or tau-c by counting inversions; one group is one task's work, n log n.

    The p-value is the tie-adjusted normal approximation.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = pdf[[x, y]].dropna()
        return pd.DataFrame([kendall_tau(ok[x].to_numpy(), ok[y].to_numpy(), variant)], columns=["n", "tau", "p_value"])

    return per_group(df, by, [], run, "n long, tau double, p_value double", [x, y])


def inversions(values: np.ndarray) -> int:
    """Pairs that are in the wrong order, by merging blocks of doubling length."""
    a, n, total, width = np.asarray(values).copy(), len(values), 0, 1
    while width < n:
        for lo in range(0, n - width, 2 * width):
            left, right = a[lo : lo + width], a[lo + width : lo + 2 * width]
            total += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            a[lo : lo + 2 * width] = np.sort(a[lo : lo + 2 * width], kind="stable")
        width *= 2
    return total


def kendall_tau(x: np.ndarray, y: np.ndarray, variant: str = "b") -> tuple[int, float, float]:
    n = len(x)
    if n < 2:
        return n, np.nan, np.nan
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    _, ry = np.unique(y, return_inverse=True)
    discordant = inversions(ry)
    size = lambda *c: np.unique(np.column_stack(c), axis=0, return_counts=True)[1].astype(float)
    tx, ty, txy = size(x), size(y), size(x, y)
    pairs = n * (n - 1) / 2
    tied = lambda t: float((t * (t - 1) / 2).sum())
    score = pairs - tied(tx) - tied(ty) + tied(txy) - 2 * discordant
    if pairs in (tied(tx), tied(ty)):
        return n, np.nan, np.nan
    if variant == "b":
        tau = score / np.sqrt((pairs - tied(tx)) * (pairs - tied(ty)))
    else:
        m = min(len(tx), len(ty))
        tau = 2 * score * m / (n * n * (m - 1))
    three = lambda t: float((t * (t - 1) * (t - 2)).sum())
    five = lambda t: float((t * (t - 1) * (2 * t + 5)).sum())
    var = (n * (n - 1) * (2 * n + 5) - five(tx) - five(ty)) / 18 + 2 * tied(tx) * tied(ty) / (n * (n - 1))
    if n > 2:
        var += three(tx) * three(ty) / (9 * n * (n - 1) * (n - 2))
    return n, float(np.clip(tau, -1, 1)), float(2 * dist.normal_sf(abs(score) / np.sqrt(var)))


def kendall_matrix(df: DataFrame, cols: Sequence[str], variant: str = "b") -> DataFrame:
    """Kendall's tau of all pairs, as rows i, j, value."""
    out = None
    for a, b in combinations_with_replacement(cols, 2):
        part = kendall(df, a, b, variant=variant).select(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col("tau").alias("value")) if a != b else df.sparkSession.createDataFrame([(a, a, 1.0)], "i string, j string, value double")
        out = part if out is None else out.unionByName(part)
    return out


def _lag_rows(df: DataFrame, x: str, y: str, lags: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per group and lag k: sum over t of (x_t - mean x) * (y_{t-k} - mean y), with n and biased deviations, from one window pass."""
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    a = F.col(x) - F.avg(x).over(whole)
    b = F.col(y) - F.avg(y).over(whole)
    w = ordered(by, order)
    centred = df.select(*by, *order, a.alias("__a"), b.alias("__b"))
    products = centred.select(*by, "__a", "__b", *[(F.col("__a") * F.lag("__b", k).over(w)).alias(f"__p{k}") for k in range(lags + 1)])
    sums = products.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("__a") * F.col("__a"))).alias("sx"), F.sqrt(F.avg(F.col("__b") * F.col("__b"))).alias("sy"),
        F.array(*[F.coalesce(F.sum(f"__p{k}"), F.lit(0.0)) for k in range(lags + 1)]).alias("p"),
    )
    return sums.select(*by, "n", "sx", "sy", F.posexplode("p").alias("lag", "p")).where("lag < n")


def autocovariance(df: DataFrame, x: str, lags: int, by: Sequence[str] = (), order: Sequence[str] = ("t",), adjusted: bool = False) -> DataFrame:
    """``by...``, lag, value: divided by n, or by n - lag if adjusted."""
    rows = _lag_rows(df, x, x, lags, by, order)
    return rows.select(*by, "lag", (F.col("p") / (F.col("n") - (F.col("lag") if adjusted else 0))).alias("value"))


def autocorrelation(df: DataFrame, x: str, lags: int, by: Sequence[str] = (), order: Sequence[str] = ("t",), adjusted: bool = False, z: float = 1.959963984540054) -> DataFrame:
    """``by...``, lag, value, ci_low, ci_high (Bartlett's formula), q_stat (Ljung-Box)."""
    rows = _lag_rows(df, x, x, lags, by, order)
    scale = F.col("n") / (F.col("n") - F.col("lag")) if adjusted else F.lit(1.0)
    rows = rows.withColumn("value", F.try_divide(F.col("p"), F.col("n") * F.col("sx") * F.col("sx")) * scale)
    before = ordered(by, ["lag"]).rowsBetween(W.unboundedPreceding, -1)
    square = F.when(F.col("lag") > 0, F.col("value") * F.col("value")).otherwise(0.0)
    rows = rows.withColumn("se", F.when(F.col("lag") == 0, 0.0).otherwise(F.sqrt((1 + 2 * F.coalesce(F.sum(square).over(before), F.lit(0.0))) / F.col("n"))))
    upto = ordered(by, ["lag"]).rowsBetween(W.unboundedPreceding, 0)
    q = F.when(F.col("lag") > 0, F.col("n") * (F.col("n") + 2) * F.sum(square / (F.col("n") - F.col("lag"))).over(upto))
    return rows.select(*by, "lag", "value", (F.col("value") - z * F.col("se")).alias("ci_low"), (F.col("value") + z * F.col("se")).alias("ci_high"), q.alias("q_stat"))


def cross_covariance(df: DataFrame, x: str, y: str, lags: int, by: Sequence[str] = (), order: Sequence[str] = ("t",), adjusted: bool = True) -> DataFrame:
    """Covariance of x at t with y at t - lag."""
    rows = _lag_rows(df, x, y, lags, by, order)
    return rows.select(*by, "lag", (F.col("p") / (F.col("n") - (F.col("lag") if adjusted else 0))).alias("value"))


def cross_correlation(df: DataFrame, x: str, y: str, lags: int, by: Sequence[str] = (), order: Sequence[str] = ("t",), adjusted: bool = True) -> DataFrame:
    """Cross-covariance over the biased deviations."""
    rows = _lag_rows(df, x, y, lags, by, order)
    return rows.select(*by, "lag", F.try_divide(F.col("p") / (F.col("n") - (F.col("lag") if adjusted else 0)), F.col("sx") * F.col("sy")).alias("value"))


def levinson_durbin(acov: np.ndarray, order: int) -> tuple[np.ndarray, float, np.ndarray]:
    """AR coefficients, innovation variance and partial autocorrelations from autocovariances."""
    phi, sigma, pacf = np.zeros(0), float(acov[0]), [1.0]
    for k in range(1, order + 1):
        r = (acov[k] - phi @ acov[k - 1 : 0 : -1][: len(phi)]) / sigma if sigma else np.nan
        phi = np.r_[phi - r * phi[::-1], r]
        sigma *= 1 - r * r
        pacf.append(r)
    return phi, sigma, np.array(pacf)


def from_pacf(pacf: np.ndarray) -> np.ndarray:
    """AR coefficients with given partial autocorrelations (from lag 1)."""
    phi = np.zeros(0)
    for r in pacf:
        phi = np.r_[phi - r * phi[::-1], r]
    return phi


def acov(x: np.ndarray, lags: int, adjusted: bool = False) -> np.ndarray:
    x, n = x - x.mean(), len(x)
    f = np.fft.rfft(x, 1 << (2 * n - 1).bit_length())
    c = np.fft.irfft(f * np.conj(f))[: lags + 1]
    return c / (n - np.arange(lags + 1)) if adjusted else c / n


def pacf_values(x: np.ndarray, lags: int, method: str = "yw_adjusted") -> np.ndarray:
    """Partial autocorrelations by yw_adjusted, yw_mle, ld_adjusted, ld_biased, burg, ols or ols_inefficient."""
    x, n = np.asarray(x, float), len(x)
    if method in ("yw_adjusted", "ld_adjusted", "yw_mle", "ld_biased"):
        return levinson_durbin(acov(x, lags, method.endswith("adjusted")), lags)[2]
    if method == "burg":
        x = x - x.mean()
        d, out, u, v = 2 * float(x @ x), [1.0], x[::-1].copy(), x[::-1].copy()
        for i in range(1, lags + 1):
            if i == 1:
                d -= u[0] ** 2 + v[-1] ** 2
            else:
                d = d * (1 - out[-1] ** 2) - u[0] ** 2 - v[-1] ** 2
            r = 2 * float(v[1:] @ u[:-1]) / d
            out.append(r)
            u, v = u[:-1] - r * v[1:], v[1:] - r * u[:-1]
        return np.array(out)
    if method == "ols":
        out = [1.0]
        for k in range(1, lags + 1):
            cols = [np.ones(n - k), *[x[k - j : n - j] for j in range(1, k + 1)]]
            out.append(np.linalg.lstsq(np.column_stack(cols), x[k:], rcond=None)[0][-1])
        return np.array(out)
    if method == "ols_inefficient":
        x, out = x - x.mean(), [1.0]
        for k in range(1, lags + 1):
            cols = [x[lags - j : n - j] for j in range(1, k + 1)]
            out.append(np.linalg.lstsq(np.column_stack(cols), x[lags:], rcond=None)[0][-1])
        return np.array(out)
    raise ValueError(f"unknown method {method!r}")


def partial_autocorrelation(df: DataFrame, x: str, lags: int | None = None, by: Sequence[str] = (), order: Sequence[str] = ("t",), method: str = "yw_adjusted", z: float = 1.959963984540054) -> DataFrame:
    """``by...``, lag, value, ci_low, ci_high; lags default to min(10 log10 n, n/2 - 1)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[x].to_numpy(float)
        n = len(v)
        k = lags if lags is not None else max(1, min(int(10 * np.log10(n)), n // 2 - 1))
        p = pacf_values(v, k, method)
        half = np.r_[0.0, np.full(k, z / np.sqrt(n))]
        return pd.DataFrame({"lag": np.arange(k + 1), "value": p, "ci_low": p - half, "ci_high": p + half})

    return per_group(df, by, order, run, "lag int, value double, ci_low double, ci_high double", [x])


def correlate(a: np.ndarray, b: np.ndarray, mode: str = "full") -> np.ndarray:
    """Sliding inner products of two sequences: full, same or valid."""
    return np.correlate(a, b, mode)


def correlate_rows(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Full cross-correlation of two indexed columns (t, y): value at k is the sum of a_{t+k} * b_t."""
    left = a.select(*by, F.col("t").alias("i"), F.col("y").alias("u"))
    right = b.select(*by, F.col("t").alias("j"), F.col("y").alias("v"))
    pairs = left.join(right, list(by)) if by else left.join(right, F.lit(True))
    return pairs.groupBy(*by, (F.col("i") - F.col("j")).alias("k")).agg(F.sum(F.col("u") * F.col("v")).alias("value"))


def _tail(p_greater: Column, alternative: str) -> Column:
    if alternative == "greater":
        return p_greater
    if alternative == "less":
        return 1 - p_greater
    if alternative == "two_sided":
        return 2 * F.least(p_greater, 1 - p_greater)
    raise ValueError(f"unknown alternative {alternative!r}")


def pearson_test(df: DataFrame, x: str, y: str, by: Sequence[str] = (), alternative: str = "two_sided") -> DataFrame:
    """r and its p-value; under no correlation (r + 1) / 2 has a Beta(n/2 - 1, n/2 - 1) distribution.  Two rows give p = 1, a constant column null."""
    out = pearson(df, x, y, by)
    half = (F.greatest(F.col("n"), F.lit(3)) / 2 - 1).cast("double")
    p = _tail(dist.column("beta", "sf", (F.col("r") + 1) / 2, half, half), alternative)
    return out.withColumn("p_value", F.when(F.col("r").isNull(), None).when(F.col("n") <= 2, 1.0).otherwise(p))


def spearman_test(df: DataFrame, x: str, y: str, by: Sequence[str] = (), alternative: str = "two_sided") -> DataFrame:
    """rho and its p-value from t = rho sqrt((n - 2) / (1 - rho**2))."""
    out = spearman(df, x, y, by)
    free = F.greatest(F.col("n") - 2, F.lit(1)).cast("double")
    t = F.col("rho") * F.sqrt(free / F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-300)))
    return out.withColumn("p_value", F.when(F.col("rho").isNull() | (F.col("n") <= 2), None).otherwise(_tail(dist.column("students_t", "sf", t, free), alternative)))


def kendall_exact_p(n: int, discordant: int) -> float:
    """Two-sided p-value without ties: the share of orders with as few, or as many, discordant pairs."""
    counts = np.ones(1)
    for k in range(2, n + 1):
        counts = np.convolve(counts, np.ones(k) / k)
    tail = min(discordant, n * (n - 1) // 2 - discordant)
    return float(min(1.0, 2 * counts[: tail + 1].sum()))


def autocovariance_values(x: np.ndarray, lags: int, adjusted: bool = False, missing: str = "none") -> np.ndarray:
    """Autocovariances under a policy for NaN: none (NaN spreads), raise, drop (time closes up) or conservative (zero after
    demeaning, divisors count the observed pairs)."""
    x = np.asarray(x, float)
    seen = ~np.isnan(x)
    if missing == "raise" and not seen.all():
        raise ValueError("missing values")
    if missing == "drop":
        x, seen = x[seen], np.ones(int(seen.sum()), bool)
    n = len(x)
    z = np.where(seen, x - (x[seen].mean() if missing == "conservative" else x.mean()), 0.0 if missing == "conservative" else np.nan)
    sums = np.array([(z[k:] * z[: n - k]).sum() for k in range(lags + 1)])
    if not adjusted:
        return sums / (seen.sum() if missing == "conservative" else n)
    pairs = np.array([(seen[k:] & seen[: n - k]).sum() for k in range(lags + 1)]) if missing == "conservative" else n - np.arange(lags + 1)
    return np.divide(sums, pairs, out=sums.copy(), where=pairs > 0)
