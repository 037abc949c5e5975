"""Seasonal-trend decomposition by LOESS, for one or several periods."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import per_group


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, length: int, degree: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Local regression with tricube weights over the ``length`` nearest of sorted points."""
    n = len(x)
    q = min(length, n)
    start = np.clip(np.searchsorted(x, at) - q, 0, n - q)
    for _ in range(q):
        ok = start + q < n
        right = x[np.minimum(start + q, n - 1)] - at
        move = ok & (right < at - x[start])
        if not move.any():
            break
        start = start + move
    window = start[:, None] + np.arange(q)
    xs, ys = x[window], y[window]
    gap = np.abs(xs - at[:, None])
    h = gap.max(axis=1)
    if length > n:
        h = h + (length - n) // 2
    h = np.where(h > 0, h, 1.0)[:, None]
    w = np.where(gap <= 0.999 * h, np.where(gap > 0.001 * h, (1 - (gap / h) ** 3) ** 3, 1.0), 0.0)
    if weights is not None:
        w = w * weights[window]
    total = w.sum(axis=1, keepdims=True)
    w = np.divide(w, total, out=np.full_like(w, 1 / q), where=total > 0)
    if degree > 0:
        mean = (w * xs).sum(axis=1, keepdims=True)
        c = (w * (xs - mean) ** 2).sum(axis=1, keepdims=True)
        span = (x[-1] - x[0]) if n > 1 else 1.0
        fit = np.sqrt(c) > 0.001 * span
        w = np.where(fit, w * (1 + np.divide((at[:, None] - mean) * (xs - mean), c, out=np.zeros_like(xs), where=c > 0)), w)
    return (w * ys).sum(axis=1)


def smooth(y: np.ndarray, length: int, degree: int, jump: int, weights: np.ndarray | None = None, ends: int = 0) -> np.ndarray:
    """LOESS along a series; every ``jump``-th point is fitted and the rest interpolated; ``ends`` points are added on either side."""
    n = len(y)
    x = np.arange(1.0, n + 1)
    at = np.arange(1 - ends, n + ends + 1, dtype=float)
    if jump <= 1:
        return loess(x, y, at, length, degree, weights)
    some = np.unique(np.r_[at[::jump], at[-1], at[0]])
    return np.interp(at, some, loess(x, y, some, length, degree, weights))


def average(x: np.ndarray, k: int) -> np.ndarray:
    c = np.cumsum(np.r_[0.0, x])
    return (c[k:] - c[:-k]) / k


def odd(v: float) -> int:
    k = int(math.ceil(v))
    return k + 1 - k % 2


def stl_fit(
    y: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, low_pass: int | None = None, degrees: tuple[int, int, int] = (1, 1, 1),
    jumps: tuple[int, int, int] = (1, 1, 1), inner: int | None = None, outer: int | None = None, robust: bool = False,
) -> dict[str, np.ndarray]:
    """Trend, seasonal, residual and weights of one series; 5 inner rounds, or robust 2 inner and 15 outer."""
    y, n = np.asarray(y, float), len(y)
    if period < 2:
        raise ValueError("the period must be at least 2")
    if n < 2 * period:
        raise ValueError("the series must hold two periods")
    trend = trend or odd(1.5 * period / (1 - 1.5 / seasonal))
    low_pass = low_pass or odd(period + 1)
    inner = inner if inner is not None else 2 if robust else 5
    outer = outer if outer is not None else 15 if robust else 0
    t, s, w = np.zeros(n), np.zeros(n), np.ones(n)
    for rounds in range(outer + 1):
        use = w if rounds else None
        for _ in range(inner):
            free = y - t
            cycle = np.zeros(n + 2 * period)
            for k in range(period):
                part = free[k::period]
                cycle[k::period] = smooth(part, seasonal, degrees[0], jumps[0], use[k::period] if use is not None else None, ends=1)
            low = smooth(average(average(average(cycle, period), period), 3), low_pass, degrees[2], jumps[2])
            s = cycle[period : period + n] - low
            t = smooth(y - s, trend, degrees[1], jumps[1], use)
        if rounds < outer:
            r = np.abs(y - t - s)
            h = 6 * np.median(r)
            u = r / h if h > 0 else np.zeros(n)
            w = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u * u) ** 2, 0.0))
    return {"trend": t, "seasonal": s, "resid": y - t - s, "weight": w}


def mstl_fit(y: np.ndarray, periods: Sequence[int], windows: Sequence[int] | None = None, iterations: int = 2, lam: float | None = None, **how) -> dict:
    """Several seasons in turn, shortest first; periods of half the series or more are left out; Box-Cox first if ``lam`` is given."""
    y, n = np.asarray(y, float), len(y)
    if lam is not None:
        if (y <= 0).any():
            raise ValueError("Box-Cox needs positive data")
        y = np.log(y) if lam == 0 else (y**lam - 1) / lam
    windows = list(windows) if windows else [7 + 4 * (i + 1) for i in range(len(periods))]
    use = sorted((p, w) for p, w in zip(sorted(periods), windows, strict=True) if p < n / 2)
    if not use:
        raise ValueError("no period is shorter than half the series")
    seasons, rest = {p: np.zeros(n) for p, _ in use}, y.copy()
    for _ in range(1 if len(use) == 1 else iterations):
        for p, w in use:
            rest = rest + seasons[p]
            fit = stl_fit(rest, p, w, **how)
            seasons[p] = fit["seasonal"]
            rest = rest - seasons[p]
    return {"observed": y, "trend": fit["trend"], "seasonal": seasons, "resid": rest - fit["trend"], "weight": fit["weight"]}


def stl(df: DataFrame, y: str, period: int, by: Sequence[str] = (), order: Sequence[str] = ("t",), **how) -> DataFrame:
    """``by...``, order columns, observed, trend, seasonal, resid, weight."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = stl_fit(pdf[y].to_numpy(float), period, **how)
        return pd.DataFrame({**{c: pdf[c].to_numpy() for c in order}, "observed": pdf[y].to_numpy(float), **{k: fit[k] for k in ("trend", "seasonal", "resid", "weight")}})

    return per_group(df, by, order, run, f"{kinds}, observed double, trend double, seasonal double, resid double, weight double", [y])


def mstl(df: DataFrame, y: str, periods: Sequence[int], by: Sequence[str] = (), order: Sequence[str] = ("t",), **how) -> DataFrame:
    """One row per time and period: ``by...``, order columns, period, observed, trend, seasonal, resid."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = mstl_fit(pdf[y].to_numpy(float), periods, **how)
        return pd.concat([pd.DataFrame({**{c: pdf[c].to_numpy() for c in order}, "period": p, "observed": fit["observed"], "trend": fit["trend"], "seasonal": s, "resid": fit["resid"]}) for p, s in fit["seasonal"].items()])

    return per_group(df, by, order, run, f"{kinds}, period int, observed double, trend double, seasonal double, resid double", [y])
