"""Hypothesis tests on series and residuals.

Tests that are sums over rows are aggregations and windows; those with a search over lags or an eigenproblem are
one kernel call per series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dist
from .common import corr, ordered, per_group, running
from .correlation import autocorrelation
from .regression import coefficients, lstsq, ols, residuals


def durbin_watson(df: DataFrame, e: str, by: Sequence[str] = (), order: Sequence[str] = ("t",)) -> DataFrame:
    step = F.col(e) - F.lag(e).over(ordered(by, order))
    return df.select(*by, F.col(e).alias("__e"), step.alias("__d")).groupBy(*by).agg(F.try_divide(F.sum(F.col("__d") * F.col("__d")), F.sum(F.col("__e") * F.col("__e"))).alias("statistic"))


def jarque_bera(df: DataFrame, e: str, by: Sequence[str] = ()) -> DataFrame:
    """Population moments; chi-square with 2 degrees of freedom, whose tail is exp(-x / 2)."""
    m = df.groupBy(*by).agg(F.count(e).alias("n"), F.skewness(e).alias("skew"), (F.kurtosis(e) + 3).alias("kurtosis"))
    m = m.withColumn("statistic", F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.pow(F.col("kurtosis") - 3, 2) / 4))
    return m.select(*by, "statistic", F.exp(-F.col("statistic") / 2).alias("p_value"), "skew", "kurtosis")


def omnibus(df: DataFrame, e: str, by: Sequence[str] = ()) -> DataFrame:
    """D'Agostino and Pearson's test: Johnson's transform of skewness and Anscombe and Glynn's of kurtosis; null below 8 rows."""
    m = df.groupBy(*by).agg(F.count(e).alias("n"), F.skewness(e).alias("s"), (F.kurtosis(e) + 3).alias("k"))
    n = F.col("n").cast("double")
    y = F.col("s") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    delta, alpha = 1 / F.sqrt(F.log(F.sqrt(w2))), F.sqrt(2 / (w2 - 1))
    zs = delta * F.log(y / alpha + F.sqrt(F.pow(y / alpha, 2) + 1))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("k") - mean) / F.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + F.sqrt(1 + 4 / (b1 * b1)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    zk = (1 - 2 / (9 * a) - F.signum(d) * F.pow((1 - 2 / a) / F.abs(d), 1 / 3)) / F.sqrt(2 / (9 * a))
    m = m.withColumn("statistic", F.when(n >= 8, zs * zs + zk * zk))
    return m.select(*by, "statistic", F.exp(-F.col("statistic") / 2).alias("p_value"))


def cusum(df: DataFrame, e: str, by: Sequence[str] = (), order: Sequence[str] = ("t",), ddof: int = 0) -> DataFrame:
    """Largest absolute running sum of residuals, scaled; Kolmogorov's limit gives the p-value."""
    run = df.select(*by, F.col(e).alias("__e"), F.sum(e).over(running(by, order)).alias("__s"))
    n = F.count("__e")
    scale = F.sqrt(F.sum(F.col("__e") * F.col("__e")) * (n / (n - ddof) if ddof else F.lit(1.0)))
    out = run.groupBy(*by).agg(F.try_divide(F.max(F.abs("__s")), scale).alias("statistic"))
    return out.withColumn("p_value", dist.column("kolmogorov_smirnov", "sf", "statistic", 1.0))


def break_variance(df: DataFrame, e: str, by: Sequence[str] = (), order: Sequence[str] = ("t",), subset: float = 1 / 3, alternative: str = "two_sided") -> DataFrame:
    """Ratio of the last to the first h squared residuals, h = subset of the rows rounded half up, with its F test."""
    w = ordered(by, order)
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    rows = df.select(*by, F.col(e).alias("__e"), F.row_number().over(w).alias("__i"), F.count(F.lit(1)).over(whole).alias("__n"))
    h = F.round(F.col("__n") * subset) if subset <= 1 else F.lit(float(subset))
    square = F.col("__e") * F.col("__e")
    first, last = F.col("__i") <= h, F.col("__i") > F.col("__n") - h
    sums = rows.groupBy(*by).agg(
        F.sum(F.when(last, square)).alias("hi"), F.sum(F.when(first, square)).alias("lo"), F.count_if(last & F.col("__e").isNotNull()).cast("double").alias("df_num"), F.count_if(first & F.col("__e").isNotNull()).cast("double").alias("df_den")
    )
    sums = sums.withColumn("statistic", F.try_divide(F.col("hi"), F.col("lo")))
    up, down = dist.column("fisher_f", "sf", "statistic", F.col("df_num"), F.col("df_den")), dist.column("fisher_f", "cdf", "statistic", F.col("df_num"), F.col("df_den"))
    p = {"increasing": up, "decreasing": down, "two_sided": 2 * F.least(up, down)}[alternative]
    return sums.withColumn("p_value", p).select(*by, "statistic", "p_value", "df_num", "df_den")


def box(df: DataFrame, x: str, lags: int, by: Sequence[str] = (), order: Sequence[str] = ("t",), adjust_df: int = 0) -> DataFrame:
    """Ljung-Box and Box-Pierce statistics for lags 1 to ``lags``: ``by...``, lag, lb_stat, bp_stat, lb_p, bp_p."""
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    rows = autocorrelation(df.withColumn("__n", F.count(F.lit(1)).over(whole)), x, lags, by, order).where("lag > 0")
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(counts, list(by)) if by else rows.crossJoin(counts)
    upto = ordered(by, ["lag"]).rowsBetween(W.unboundedPreceding, 0)
    r2 = F.col("value") * F.col("value")
    rows = rows.withColumn("lb_stat", F.col("n") * (F.col("n") + 2) * F.sum(r2 / (F.col("n") - F.col("lag"))).over(upto)).withColumn("bp_stat", F.col("n") * F.sum(r2).over(upto))
    free = F.greatest(F.col("lag") - adjust_df, F.lit(0)).cast("double")
    p = lambda c: F.when(F.col("lag") > adjust_df, dist.column("chi_square", "sf", c, F.greatest(free, F.lit(1.0))))
    return rows.withColumn("lb_p", p("lb_stat")).withColumn("bp_p", p("bp_stat")).select(*by, "lag", "lb_stat", "bp_stat", "lb_p", "bp_p")


def _auxiliary(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The fit of an auxiliary regression, one row per group."""
    return ols(df, y, xs, by).where(F.col("term") == "const").select(*by, "n_obs", "rank", "ssr", "tss", "r2", "f_stat", "f_p")


def _lm(aux: DataFrame, by: Sequence[str], lost: int = 0) -> DataFrame:
    """LM = n R2 of an auxiliary regression, chi-square with rank - 1 degrees of freedom."""
    aux = aux.withColumn("statistic", (F.col("n_obs") - lost) * F.col("r2")).withColumn("df_num", (F.col("rank") - 1).cast("double"))
    return aux.withColumn("p_value", dist.column("chi_square", "sf", "statistic", F.col("df_num"))).select(*by, "statistic", "p_value", "df_num", "f_stat", "f_p")


def breusch_pagan(df: DataFrame, e: str, xs: Sequence[str], by: Sequence[str] = (), robust: bool = True) -> DataFrame:
    """Squared residuals on the regressors; LM = n R2, or half the explained sum of scaled squares if not robust."""
    squared = df.withColumn("__e2", F.col(e) * F.col(e))
    aux = _auxiliary(squared, "__e2", xs, by)
    if robust:
        return _lm(aux, by)
    mean = squared.groupBy(*by).agg(F.avg("__e2").alias("__m"))
    aux = aux.join(mean, list(by)) if by else aux.crossJoin(mean)
    aux = aux.withColumn("statistic", (F.col("tss") - F.col("ssr")) / (2 * F.col("__m") * F.col("__m"))).withColumn("df_num", (F.col("rank") - 1).cast("double"))
    return aux.withColumn("p_value", dist.column("chi_square", "sf", "statistic", F.col("df_num"))).select(*by, "statistic", "p_value", "df_num", "f_stat", "f_p")


def white(df: DataFrame, e: str, xs: Sequence[str], by: Sequence[str] = (), cross: bool = True) -> DataFrame:
    """Squared residuals on the regressors, their squares and, if ``cross``, their products."""
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:] if cross or a == b]
    made = df.withColumns({"__e2": F.col(e) * F.col(e), **{f"__p{i}": F.col(a) * F.col(b) for i, (a, b) in enumerate(pairs)}})
    return _lm(_auxiliary(made, "__e2", [*xs, *[f"__p{i}" for i in range(len(pairs))]], by), by)


def reset(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), powers: Sequence[int] = (2, 3)) -> DataFrame:
    """Ramsey's test: do powers of the fitted values add to the fit?

    The powers 2, 3, ... to the last are those of the deviations from the fitted values' mean, which add the same: fitted
    values that move little about a large mean have squares that differ from a line by rounding alone.  What they add is
    the sum explained of the residuals.  Null where powers add no rank, no freedom is left or nothing is left to explain.
    """
    first = coefficients(df, y, xs, by).select(*by, F.col("beta").alias("__b"), F.col("centre").alias("__m"), F.col("rank").alias("__r"))
    rows = df.join(first, list(by)) if by else df.crossJoin(first)
    moved = sum((F.col("__b")[i] * (F.col(x) - F.col("__m")[i]) for i, x in enumerate(xs, 1)), F.lit(0.0))
    base = moved if set(powers) == set(range(2, max(powers) + 1)) else F.col("__m")[0] + moved
    made = rows.withColumns({"__e": F.col(y) - F.col("__m")[0] - moved, **{f"__f{p}": F.pow(base, F.lit(float(p))) for p in powers}})
    small = first.select(*by, "__r")
    large = _auxiliary(made, "__e", [*xs, *[f"__f{p}" for p in powers]], by)
    both = small.join(large, list(by)) if by else small.crossJoin(large)
    both = both.withColumn("df_num", (F.col("rank") - F.col("__r")).cast("double")).withColumn("df_den", (F.col("n_obs") - F.col("rank")).cast("double"))
    both = both.withColumn("statistic", F.try_divide(F.try_divide(F.col("tss") - F.col("ssr"), F.col("df_num")), F.try_divide(F.col("ssr"), F.col("df_den"))))
    return both.withColumn("p_value", dist.column("fisher_f", "sf", "statistic", F.col("df_num"), F.col("df_den"))).select(*by, "statistic", "p_value", "df_num", "df_den")


def arch_lm(df: DataFrame, e: str, lags: int, by: Sequence[str] = (), order: Sequence[str] = ("t",), squared: bool = True, ddof: int = 0) -> DataFrame:
    """Engle's test: squared residuals on their own lags; with ``squared`` false, residuals on theirs."""
    made = df.withColumn("__v", F.col(e) * F.col(e) if squared else F.col(e))
    w = ordered(by, order)
    made = made.withColumns({f"__l{k}": F.lag("__v", k).over(w) for k in range(1, lags + 1)})
    return _lm(_auxiliary(made, "__v", [f"__l{k}" for k in range(1, lags + 1)], by), by, ddof)


def breusch_godfrey(df: DataFrame, e: str, xs: Sequence[str], lags: int, by: Sequence[str] = (), order: Sequence[str] = ("t",)) -> DataFrame:
    """Residuals on regressors, a constant and lagged residuals (0 before the first): LM = n R2 on ``lags`` degrees of freedom."""
    w = ordered(by, order)
    made = df.withColumns({f"__l{k}": F.lag(e, k, 0.0).over(w) for k in range(1, lags + 1)})
    aux = _auxiliary(made, e, [*xs, *[f"__l{k}" for k in range(1, lags + 1)]], by).withColumn("statistic", F.col("n_obs") * F.col("r2"))
    return aux.withColumn("p_value", dist.column("chi_square", "sf", "statistic", float(lags))).select(*by, "statistic", "p_value", F.lit(float(lags)).alias("df_num"))


def granger(df: DataFrame, y: str, x: str, lags: int, by: Sequence[str] = (), order: Sequence[str] = ("t",)) -> DataFrame:
    """Does x help predict y?  Restricted and unrestricted fits with a constant for each number of lags: SSR F, SSR chi-square, LR."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, u, rows = pdf[y].to_numpy(float), pdf[x].to_numpy(float), []
        n = len(v)
        for p in range(1, lags + 1):
            if n <= 3 * p + 1:
                break
            own = np.column_stack([np.ones(n - p), *[v[p - j : n - j] for j in range(1, p + 1)]])
            both = np.column_stack([own, *[u[p - j : n - j] for j in range(1, p + 1)]])
            s0, s1 = lstsq(v[p:], own)[1], lstsq(v[p:], both)[1]
            m, free = n - p, n - p - 2 * p - 1
            f = (s0 - s1) / s1 / p * free
            chi, lr = m * (s0 - s1) / s1, m * math.log(s0 / s1)
            rows.append((p, f, float(dist.f_sf(f, p, free)), chi, float(dist.chi2_sf(chi, p)), lr, float(dist.chi2_sf(lr, p))))
        return pd.DataFrame(rows, columns=["lag", "ssr_f", "ssr_f_p", "ssr_chi2", "ssr_chi2_p", "lr", "lr_p"])

    return per_group(df, by, order, run, "lag int, ssr_f double, ssr_f_p double, ssr_chi2 double, ssr_chi2_p double, lr double, lr_p double", [y, x])


#: MacKinnon's response surfaces for one series (fixed values): bounds, switch points and polynomials of the p-value, and critical values by trend.
TAU = {
    "n": (-19.04, -1.04, math.inf, (0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066), ((-2.56574, -2.2358, -3.627), (-1.94100, -0.2686, -3.365, 31.223), (-1.61682, 0.2656, -2.714, 25.364))),
    "c": (-18.83, -1.61, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809))),
    "ct": (-16.18, -2.89, 0.7, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285), ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380))),
    "ctt": (-17.17, -3.21, 0.54, (4.0003, 1.658, 0.048288), (3.0778, 0.49529, -0.41477, -0.059359), ((-4.37113, -11.5882, -35.819, -334.047), (-3.83239, -5.9057, -12.490, -118.284), (-3.55326, -3.6596, -5.293, -63.559))),
}


def mackinnon_p(tau: float, trend: str) -> float:
    lo, switch, hi, small, large, _ = TAU[trend]
    if tau > hi:
        return 1.0
    if tau < lo:
        return 0.0
    return float(dist.REGISTRY["normal"].cdf(sum(c * tau**i for i, c in enumerate(small if tau <= switch else large)), 0.0, 1.0))


def mackinnon_critical(trend: str, n: float) -> tuple[float, float, float]:
    return tuple(sum(c / n**i for i, c in enumerate(row)) for row in TAU[trend][5])


def trend_matrix(n: int, trend: str) -> np.ndarray:
    t = np.arange(1.0, n + 1)
    return np.column_stack([np.ones(n), t, t * t])[:, : 0 if trend == "n" else len(trend)]


def adf_test(x: np.ndarray, max_lag: int | None = None, trend: str = "c", auto: str | None = "aic") -> dict:
    """Augmented Dickey-Fuller; the lag search uses one common sample, the final fit the longest."""
    n = len(x)
    if n == 0 or np.ptp(x) == 0:
        raise ValueError("the series is constant")
    k = 0 if trend == "n" else len(trend)
    if max_lag is None:
        max_lag = max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - k - 1))
    dx = np.diff(x)

    def design(lags: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        cols = [x[start:-1], *[dx[start - j : len(dx) - j] for j in range(1, lags + 1)]]
        m = len(dx) - start
        return dx[start:], np.column_stack([*cols, trend_matrix(m, trend)])

    best = max_lag
    if auto in ("aic", "bic"):
        scores = []
        for lag in range(max_lag + 1):
            v, m = design(lag, max_lag)
            _, ssr, rank, _ = lstsq(v, m)
            size = len(v)
            ll = -size / 2 * (math.log(2 * math.pi) + math.log(ssr / size) + 1)
            scores.append(-2 * ll + rank * (2 if auto == "aic" else math.log(size)))
        best = int(np.argmin(scores))
    elif auto == "t_stat":
        for best in range(max_lag, -1, -1):
            if best == 0:
                break
            v, m = design(best, max_lag)
            beta, ssr, rank, inv = lstsq(v, m)
            if abs(beta[best] / math.sqrt(inv[best, best] * ssr / (len(v) - rank))) >= 1.6448536269514722:
                break
    v, m = design(best, best)
    beta, ssr, rank, inv = lstsq(v, m)
    tau = beta[0] / math.sqrt(inv[0, 0] * ssr / (len(v) - rank))
    c1, c5, c10 = mackinnon_critical(trend, len(v))
    return {"statistic": tau, "p_value": mackinnon_p(tau, trend), "lags": best, "n_obs": len(v), "cv_1pct": c1, "cv_5pct": c5, "cv_10pct": c10}


def adf(df: DataFrame, x: str, by: Sequence[str] = (), order: Sequence[str] = ("t",), max_lag: int | None = None, trend: str = "c", auto: str | None = "aic") -> DataFrame:
    run = lambda pdf: pd.DataFrame([adf_test(pdf[x].to_numpy(float), max_lag, trend, auto)])
    return per_group(df, by, order, run, "statistic double, p_value double, lags int, n_obs long, cv_1pct double, cv_5pct double, cv_10pct double", [x])


#: Critical values of the KPSS statistic at 10, 5, 2.5 and 1 percent (fixed values).
KPSS_TABLE = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def kpss_test(x: np.ndarray, trend: str = "c", lags: int | str = "auto") -> dict:
    """KPSS with Bartlett weights; ``auto`` is Hobijn's lag rule, ``legacy`` ceil(12 (n / 100)**(1/4)); p is clamped to [0.01, 0.1]."""
    n = len(x)
    e = x - x.mean() if trend == "c" else x - trend_matrix(n, "ct") @ lstsq(x, trend_matrix(n, "ct"))[0]
    if lags == "legacy":
        k = min(int(math.ceil(12 * (n / 100) ** 0.25)), n - 1)
    elif lags == "auto":
        m = int(n ** (2 / 9))
        s0, s1 = float(e @ e) / n, 0.0
        for i in range(1, m + 1):
            c = 2 * float(e[i:] @ e[:-i]) / n
            s0, s1 = s0 + c, s1 + i * c
        k = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    else:
        k = int(lags)
    long_run = float(e @ e) / n + sum(2 * (1 - i / (k + 1)) * float(e[i:] @ e[:-i]) / n for i in range(1, k + 1))
    stat = float((np.cumsum(e) ** 2).sum()) / n**2 / long_run
    p = float(np.interp(stat, KPSS_TABLE[trend], (0.10, 0.05, 0.025, 0.01)))
    return {"statistic": stat, "p_value": p, "lags": k}


def kpss(df: DataFrame, x: str, by: Sequence[str] = (), order: Sequence[str] = ("t",), trend: str = "c", lags: int | str = "auto") -> DataFrame:
    run = lambda pdf: pd.DataFrame([kpss_test(pdf[x].to_numpy(float), trend, lags)])
    return per_group(df, by, order, run, "statistic double, p_value double, lags int", [x])


def kpss_fixed(df: DataFrame, x: str, lags: int, by: Sequence[str] = (), order: Sequence[str] = ("t",)) -> DataFrame:
    """KPSS about a constant with a given lag, in windows and sums alone: ``by...``, statistic."""
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    rows = df.select(*by, *order, (F.col(x) - F.avg(x).over(whole)).alias("__e"))
    w = ordered(by, order)
    rows = rows.select(*by, "__e", F.sum("__e").over(running(by, order)).alias("__s"), *[(F.col("__e") * F.lag("__e", k).over(w)).alias(f"__p{k}") for k in range(1, lags + 1)])
    n = F.count(F.lit(1))
    long_run = F.sum(F.col("__e") * F.col("__e")) / n
    for k in range(1, lags + 1):
        long_run = long_run + 2 * (1 - k / (lags + 1)) * F.sum(f"__p{k}") / n
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col("__s") * F.col("__s")) / (n * n), long_run).alias("statistic"))


def cointegration(df: DataFrame, y0: str, y1: str, by: Sequence[str] = (), order: Sequence[str] = ("t",), trend: str = "c") -> DataFrame:
    """Engle and Granger's statistic: ADF without trend on the residuals of y0 on y1 and the trend; -inf for a perfect fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[y0].to_numpy(float), pdf[y1].to_numpy(float)
        m = np.column_stack([b, trend_matrix(len(a), trend)])
        beta, ssr, _, _ = lstsq(a, m)
        tss = float(((a - a.mean()) ** 2).sum())
        if 1 - ssr / tss >= 1 - 100 * math.sqrt(np.finfo(float).eps):
            return pd.DataFrame([{"statistic": -math.inf, "lags": 0, "n_obs": len(a)}])
        r = adf_test(a - m @ beta, None, "n", "aic")
        return pd.DataFrame([{k: r[k] for k in ("statistic", "lags", "n_obs")}])

    return per_group(df, by, order, run, "statistic double, lags int, n_obs long", [y0, y1])


def johansen(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), order: Sequence[str] = ("t",), det_order: int = 0, k_ar_diff: int = 1) -> DataFrame:
    """Johansen's trace and maximal-eigenvalue statistics: ``by...``, rank, eigenvalue, trace, max_eigen."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[list(cols)].to_numpy(float)

        def detrend(z, d):
            if d < 0:
                return z
            m = np.vander(np.linspace(-1, 1, len(z)), d + 1)
            return z - m @ np.linalg.lstsq(m, z, rcond=None)[0]

        x = detrend(x, det_order)
        f = 0 if det_order > -1 else det_order
        dx = np.diff(x, axis=0)
        lags = np.column_stack([dx[k_ar_diff - j : len(dx) - j] for j in range(1, k_ar_diff + 1)]) if k_ar_diff else np.zeros((len(dx), 0))
        lags = detrend(lags, f) if lags.shape[1] else lags
        away = lambda z: z - lags @ np.linalg.lstsq(lags, z, rcond=None)[0] if lags.shape[1] else z
        r0, rk = away(detrend(dx[k_ar_diff:], f)), away(detrend(x[: len(x) - 1][k_ar_diff:] if k_ar_diff == 0 else x[1 : len(x) - k_ar_diff], f))
        n = len(rk)
        skk, sk0, s00 = rk.T @ rk / n, rk.T @ r0 / n, r0.T @ r0 / n
        low = np.linalg.cholesky(skk)
        inner = np.linalg.solve(low, sk0 @ np.linalg.solve(s00, sk0.T))
        eig = np.linalg.eigvalsh(np.linalg.solve(low, inner.T))[::-1]
        logs = -n * np.log(1 - eig)
        return pd.DataFrame({"rank": np.arange(len(eig)), "eigenvalue": eig, "trace": np.cumsum(logs[::-1])[::-1], "max_eigen": logs})

    return per_group(df, by, order, run, "rank int, eigenvalue double, trace double, max_eigen double", list(cols))


def instantaneous_causality(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """n r2 of two residual columns, chi-square with 1 degree of freedom."""
    ok = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    out = ok.groupBy(*by).agg((F.count(F.lit(1)) * F.pow(corr(a, b), 2)).alias("statistic"))
    return out.withColumn("p_value", dist.column("chi_square", "sf", "statistic", 1.0))
