"""Linear regression from sufficient statistics.

One aggregation gives each group's counts, means and centred cross products (stable, mergeable sums), and a
small solve per group gives everything else; rows are read once and only k*k numbers per group are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from .common import per_group


def gram(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per group: ``n``, ``w`` (sum of weights), ``m`` (means), ``c`` (centred cross products, upper triangle by rows), ``lw`` (sum of log weights)."""
    cols = list(cols)
    ok = df
    for c in [*cols, *([weight] if weight else [])]:
        ok = ok.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    if weight is None:
        return ok.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).cast("double").alias("w"), F.array(*[F.avg(c) for c in cols]).alias("m"),
            F.array(*[F.covar_pop(a, b) * F.count(F.lit(1)) for a, b in pairs]).alias("c"), F.lit(0.0).alias("lw"),
        )
    # weighted products about each group's plain means, moved to the weighted means afterwards
    means = ok.groupBy(*by).agg(F.array(*[F.avg(c) for c in cols]).alias("__m"))
    joined = ok.join(means, list(by)) if by else ok.crossJoin(means)
    shifted = {c: F.col(c) - F.col("__m")[i] for i, c in enumerate(cols)}
    w = F.col(weight)
    sums = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.first("__m").alias("__m"), F.array(*[F.sum(w * shifted[c]) for c in cols]).alias("__s"),
        F.array(*[F.sum(w * shifted[a] * shifted[b]) for a, b in pairs]).alias("__p"), F.sum(F.log(w)).alias("lw"),
    )
    at = {c: i for i, c in enumerate(cols)}
    return sums.select(
        *by, "n", "w", F.zip_with("__m", "__s", lambda m, s: m + s / F.col("w")).alias("m"),
        F.array(*[F.col("__p")[i] - F.col("__s")[at[a]] * F.col("__s")[at[b]] / F.col("w") for i, (a, b) in enumerate(pairs)]).alias("c"), "lw",
    )


class Fit:
    """A least-squares fit from a group's sufficient statistics; ``y`` is the first column."""

    def __init__(self, n: int, w: float, m, c, log_weights: float = 0.0, const: bool = True, has_const: bool | None = None):
        k = len(m)
        full = np.zeros((k, k))
        full[np.triu_indices(k)] = c
        full = full + np.triu(full, 1).T
        m = np.asarray(m, float)
        self.n, self.const = int(n), const
        if const:
            sxx, sxy, syy = full[1:, 1:], full[1:, 0], full[0, 0]
        else:
            raw = full + w * np.outer(m, m)
            sxx, sxy, syy = raw[1:, 1:], raw[1:, 0], raw[0, 0]
        scale = np.sqrt(np.where(np.diag(sxx) > 0, np.diag(sxx), 1.0))
        unit = sxx / np.outer(scale, scale)
        inverse = np.linalg.pinv(unit, rcond=1e-12, hermitian=True) / np.outer(scale, scale)
        self.rank = int(np.linalg.matrix_rank(unit, tol=1e-10, hermitian=True)) + const if k > 1 else int(const)
        slopes = inverse @ sxy
        if const:
            self.coef = np.r_[m[0] - m[1:] @ slopes, slopes]
            self.cov0 = np.zeros((k, k))
            self.cov0[1:, 1:] = inverse
            self.cov0[0, 1:] = self.cov0[1:, 0] = -inverse @ m[1:]
            self.cov0[0, 0] = 1 / w + m[1:] @ inverse @ m[1:]
        else:
            self.coef, self.cov0 = slopes, inverse
        self.ssr = float(max(syy - slopes @ sxy, 0.0))
        centred = const if has_const is None else has_const
        self.tss = float(full[0, 0] if centred else full[0, 0] + w * m[0] ** 2)
        self.df_model, self.df_resid = self.rank - int(centred), self.n - self.rank
        self.scale = self.ssr / self.df_resid if self.df_resid > 0 else math.nan
        self.log_weights = log_weights

    @property
    def r2(self) -> float:
        return 1 - self.ssr / self.tss if self.tss else math.nan

    @property
    def r2_adj(self) -> float:
        return 1 - (self.n - int(self.const)) / self.df_resid * (1 - self.r2) if self.df_resid > 0 else math.nan

    @property
    def log_likelihood(self) -> float:
        n = self.n
        return -n / 2 * math.log(self.ssr) - n / 2 * (1 + math.log(math.pi / (n / 2))) + self.log_weights / 2 if self.ssr > 0 else math.inf

    def errors(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov0) * self.scale, 0))

    def f_test(self) -> tuple[float, float]:
        if self.df_model <= 0 or self.df_resid <= 0 or self.scale <= 0:
            return math.nan, math.nan
        f = (self.tss - self.ssr) / self.df_model / self.scale
        return f, float(dist.f_sf(f, self.df_model, self.df_resid))


def criteria(log_likelihood: float, n: int, k: int) -> dict[str, float]:
    """Information criteria of a fit with k parameters."""
    return {
        "aic": 2 * k - 2 * log_likelihood, "aicc": 2 * k - 2 * log_likelihood + 2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.inf,
        "bic": k * math.log(n) - 2 * log_likelihood, "hqic": 2 * k * math.log(math.log(n)) - 2 * log_likelihood if n > 1 else math.nan,
    }


def _solve(stats: DataFrame, by: Sequence[str], make, schema: str) -> DataFrame:
    """Run ``make(row)``, giving rows of dicts, on the small table of sufficient statistics."""
    keys = ", ".join(f"`{k}` {stats.schema[k].dataType.simpleString()}" for k in by)

    def run(batches):
        for pdf in batches:
            rows = [{**{k: r[k] for k in by}, **out} for r in pdf.to_dict("records") for out in make(r)]
            names = [*by, *[c.strip().split(" ")[0] for c in schema.split(",")]]
            yield pd.DataFrame(rows, columns=names)

    return stats.mapInPandas(run, f"{keys}, {schema}" if keys else schema)


def ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), weight: str | None = None, const: bool = True) -> DataFrame:
    """Ordinary or weighted least squares: one row per group and term, with the group's fit beside it.

    :return: ``by...``, term, coef, std_err, t_stat, p_value, ci_low, ci_high, n_obs, rank, ssr, tss, r2, r2_adj, scale, log_likelihood, aic, bic, f_stat, f_p
    """
    stats = gram(df, [y, *xs], by, weight)

    def make(r):
        fit = Fit(r["n"], r["w"], r["m"], r["c"], r["lw"], const)
        err = fit.errors()
        f, fp = fit.f_test()
        ic = criteria(fit.log_likelihood, fit.n, fit.rank)
        for term, b, e in zip((["const"] if const else []) + list(xs), fit.coef, err, strict=True):
            t = b / e if e > 0 else math.nan
            half = float(dist.t_quantile(0.975, fit.df_resid)) * e if fit.df_resid > 0 else math.nan
            p = float(dist.t_two_sided(t, fit.df_resid)) if fit.df_resid > 0 else math.nan
            yield {
                "term": term, "coef": b, "std_err": e, "t_stat": t, "p_value": p, "ci_low": b - half, "ci_high": b + half, "n_obs": fit.n, "rank": fit.rank, "ssr": fit.ssr, "tss": fit.tss,
                "r2": fit.r2, "r2_adj": fit.r2_adj, "scale": fit.scale, "log_likelihood": fit.log_likelihood, "aic": ic["aic"], "bic": ic["bic"], "f_stat": f, "f_p": fp,
            }

    kinds = "term string, coef double, std_err double, t_stat double, p_value double, ci_low double, ci_high double, n_obs long, rank int, ssr double, tss double, r2 double, r2_adj double, scale double, log_likelihood double, aic double, bic double, f_stat double, f_p double"
    return _solve(stats, by, make, kinds)


def wls(df: DataFrame, y: str, xs: Sequence[str], weight: str, by: Sequence[str] = (), const: bool = True) -> DataFrame:
    """Weighted least squares; diagonal generalised least squares has weight 1 / variance."""
    return ols(df, y, xs, by, weight, const)


def coefficients(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), weight: str | None = None, const: bool = True) -> DataFrame:
    """``by...``, ``beta`` array (constant first), ``cov`` array of rows (scaled), ``scale``, ``df_resid``, ``rank`` and ``centre`` (means of y and xs): to be joined to rows."""
    stats = gram(df, [y, *xs], by, weight)

    def make(r):
        fit = Fit(r["n"], r["w"], r["m"], r["c"], r["lw"], const)
        yield {"beta": fit.coef.tolist(), "cov": (fit.cov0 * fit.scale).tolist(), "scale": fit.scale, "df_resid": fit.df_resid, "rank": fit.rank, "centre": list(r["m"])}

    return _solve(stats, by, make, "beta array<double>, cov array<array<double>>, scale double, df_resid int, rank int, centre array<double>")


def residuals(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), const: bool = True, name: str = "residual", fitted: str = "fitted") -> DataFrame:
    """Rows with their fitted values and residuals; coefficients are joined by group."""
    beta = coefficients(df, y, xs, by, const=const).select(*by, F.col("beta").alias("__beta"))
    joined = df.join(beta, list(by)) if by else df.crossJoin(beta)
    terms = [F.col("__beta")[i + int(const)] * F.col(x) for i, x in enumerate(xs)]
    fit = sum(terms, F.col("__beta")[0] if const else F.lit(0.0))
    return joined.withColumn(fitted, fit).withColumn(name, F.col(y) - F.col(fitted)).drop("__beta")


def predict(df: DataFrame, new: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), t: float | None = None) -> DataFrame:
    """Mean, its variance, and the interval of a new observation for each row of ``new``; ``t`` defaults to the 97.5 % point."""
    fit = coefficients(df, y, xs, by)
    joined = new.join(fit, list(by)) if by else new.crossJoin(fit)
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in xs])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    joined = joined.withColumn("mean", dot(x, F.col("beta"))).withColumn("param_var", dot(x, F.transform("cov", lambda row: dot(row, x))))
    half = (F.lit(t) if t is not None else dist.column("students_t", "quantile", F.lit(0.975), F.col("df_resid").cast("double"))) * F.sqrt(F.col("param_var") + F.col("scale"))
    return joined.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half}).drop("beta", "cov", "scale", "df_resid", "rank", "centre")


def lstsq(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, int, np.ndarray]:
    """Coefficients, residual sum of squares, rank and (X'X)^-1 of one small dense problem, by SVD."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    keep = s > (s[0] if len(s) else 0) * max(1e-15, max(x.shape) * np.finfo(float).eps)
    si = np.where(keep, 1 / np.where(keep, s, 1), 0.0)
    beta = vt.T @ (si * (u.T @ y))
    r = y - x @ beta
    return beta, float(r @ r), int(keep.sum()), (vt.T * si**2) @ vt


def gls(df: DataFrame, y: str, xs: Sequence[str], sigma: np.ndarray, by: Sequence[str] = (), order: Sequence[str] = ("t",)) -> DataFrame:
    """Generalised least squares with one full covariance for every group's rows in order; a group's n*n covariance is one task's work."""
    low = np.linalg.cholesky(np.asarray(sigma, float))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.linalg.solve(low, np.column_stack([np.ones(len(pdf)), pdf[list(xs)].to_numpy(float)]))
        v = np.linalg.solve(low, pdf[y].to_numpy(float))
        beta, ssr, rank, inv = lstsq(v, x)
        n = len(v)
        scale = ssr / (n - rank)
        err = np.sqrt(np.diag(inv) * scale)
        ll = -n / 2 * math.log(ssr) - n / 2 * (1 + math.log(math.pi / (n / 2))) - np.log(np.diag(low)).sum()
        return pd.DataFrame({"term": ["const", *xs], "coef": beta, "std_err": err, "t_stat": beta / err, "p_value": dist.t_two_sided(beta / err, n - rank), "log_likelihood": ll})

    return per_group(df, by, order, run, "term string, coef double, std_err double, t_stat double, p_value double, log_likelihood double", [y, *xs])
