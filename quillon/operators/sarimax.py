"""(Seasonal) ARIMA with regressors, and vector ARMA, by maximum likelihood in state space form; one fit per series."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import dist
from . import optimise as O
from .common import per_group
from .correlation import from_pacf
from .regression import criteria, lstsq
from .statespace import Filtered, Model, kalman_filter, log_likelihood, kalman_smooth
from .statespace import simulate as simulate_states


def _poly(coefs: np.ndarray, step: int = 1) -> np.ndarray:
    out = np.zeros(len(coefs) * step + 1)
    out[0] = 1.0
    out[step::step] = coefs
    return out


def _difference_poly(d: int, seasonal: int, s: int) -> np.ndarray:
    p = np.ones(1)
    for _ in range(d):
        p = np.convolve(p, [1.0, -1.0])
    for _ in range(seasonal):
        p = np.convolve(p, _poly(np.r_[np.zeros(s - 1), -1.0]) if s > 1 else [1.0, -1.0])
    return p


def constrain(u: np.ndarray) -> np.ndarray:
    """Any numbers to stationary AR coefficients, through partial autocorrelations u / sqrt(1 + u*u)."""
    return from_pacf(u / np.sqrt(1 + u * u)) if len(u) else u


def unconstrain(phi: np.ndarray) -> np.ndarray:
    """Inverse of ``constrain``; zeros if the coefficients aren't stationary."""
    phi = np.asarray(phi, float)
    out = np.zeros(len(phi))
    cur = phi.copy()
    for k in range(len(phi), 0, -1):
        r = cur[k - 1]
        if abs(r) >= 1:
            return np.zeros(len(phi))
        out[k - 1] = r
        cur = (cur[: k - 1] + r * cur[: k - 1][::-1]) / (1 - r * r)
    return out / np.sqrt(1 - out * out)


@dataclass(frozen=True)
class Spec:
    """Orders and options.  ``trend`` is n, c, ct or ctt (powers of time on the differenced, ARMA-filtered side)."""

    order: tuple[int, int, int] = (1, 0, 0)
    seasonal: tuple[int, int, int, int] = (0, 0, 0, 0)
    trend: str = "n"
    measurement_error: bool = False
    stationary: bool = True
    invertible: bool = True

    def __post_init__(self):
        if min(self.order) < 0 or min(self.seasonal) < 0 or (any(self.seasonal[:3]) and self.seasonal[3] < 2):
            raise ValueError("orders must not be negative, and a season must be at least 2")


@dataclass
class Fitted:
    spec: Spec
    params: np.ndarray
    names: list[str]
    loglik: float
    model: Model
    y: np.ndarray
    exog: np.ndarray | None
    filtered: Filtered
    cov: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def table(self) -> pd.DataFrame:
        err = np.sqrt(np.maximum(np.diag(self.cov), 0)) if len(self.cov) else np.full(len(self.params), np.nan)
        with np.errstate(all="ignore"):
            z = self.params / err
        half = 1.959963984540054 * err
        return pd.DataFrame({"term": self.names, "coef": self.params, "std_err": err, "t_stat": z, "p_value": 2 * dist.normal_sf(np.abs(z)), "ci_low": self.params - half, "ci_high": self.params + half})

    def criteria(self) -> dict[str, float]:
        return criteria(self.loglik, int((~np.isnan(self.y)).sum()), len(self.params))

    def residuals(self) -> np.ndarray:
        return self.filtered.error[:, 0]

    def forecast(self, steps: int, exog: np.ndarray | None = None, level: float = 0.95) -> pd.DataFrame:
        x = None if self.exog is None else np.vstack([self.exog, np.asarray(exog, float)])
        n = len(self.y)
        m, shift = build(self.spec, self.params, n + steps, x)
        f = kalman_filter(m, np.r_[self.y - shift[:n], np.full(steps, np.nan)])
        mean, se = f.forecast[n:, 0] + shift[n:], np.sqrt(f.error_cov[n:, 0, 0])
        z = float(dist.REGISTRY["normal"].quantile(0.5 + level / 2, 0.0, 1.0))
        return pd.DataFrame({"h": np.arange(1, steps + 1), "mean": mean, "se": se, "ci_low": mean - z * se, "ci_high": mean + z * se})

    def append(self, y: np.ndarray, exog: np.ndarray | None = None) -> Fitted:
        """The same parameters with more observations after the sample."""
        x = None if self.exog is None else np.vstack([self.exog, exog])
        return evaluate(self.spec, self.params, np.r_[self.y, y], x, self.names, self.cov)

    def simulate(self, steps: int, seed: int = 0) -> np.ndarray:
        _, obs = simulate_states(self.model, steps, np.random.default_rng(seed), self.filtered.predicted[-1])
        return obs[:, 0]


def layout(spec: Spec, exog: int) -> list[str]:
    p, _, q = spec.order
    sp, _, sq, _ = spec.seasonal
    k = 0 if spec.trend == "n" else len(spec.trend)
    names = [("intercept", "drift", "trend_2")[i] for i in range(k)] + [f"x{i + 1}" for i in range(exog)]
    names += [f"ar{i + 1}" for i in range(p)] + [f"ma{i + 1}" for i in range(q)] + [f"seasonal_ar{i + 1}" for i in range(sp)] + [f"seasonal_ma{i + 1}" for i in range(sq)]
    return names + (["measurement_var"] if spec.measurement_error else []) + ["sigma2"]


def split(spec: Spec, params: np.ndarray, exog: int) -> dict[str, np.ndarray]:
    p, _, q = spec.order
    sp, _, sq, _ = spec.seasonal
    sizes = {"trend": 0 if spec.trend == "n" else len(spec.trend), "exog": exog, "ar": p, "ma": q, "sar": sp, "sma": sq, "h": int(spec.measurement_error), "s2": 1}
    out, at = {}, 0
    for k, n in sizes.items():
        out[k], at = params[at : at + n], at + n
    return out


def build(spec: Spec, params: np.ndarray, n: int, exog: np.ndarray | None) -> tuple[Model, np.ndarray]:
    """State space form (differences kept as diffuse states) and the part of y that regressors and trend explain."""
    v = split(spec, params, 0 if exog is None else exog.shape[1])
    _, d, _ = spec.order
    _, sd, _, s = spec.seasonal
    s = max(s, 1)
    ar = np.convolve(_poly(-v["ar"]), _poly(-v["sar"], s))
    ma = np.convolve(_poly(v["ma"]), _poly(v["sma"], s))
    diff = _difference_poly(d, sd, s)
    k = max(len(ar) - 1, len(ma), 1)
    phi, theta = np.zeros(k), np.zeros(k)
    phi[: len(ar) - 1], theta[: len(ma)] = -ar[1:], ma
    nd = len(diff) - 1
    size = nd + k
    t, r, z = np.zeros((size, size)), np.zeros((size, 1)), np.zeros((1, size))
    arma = slice(nd, size)
    t[arma, arma] = np.diag(np.ones(k - 1), 1)
    t[nd:, nd] = phi
    r[nd:, 0] = theta
    z[0, nd] = 1.0
    if nd:
        t[0, :nd], t[0, nd] = -diff[1:], 1.0
        t[1:nd, : nd - 1] = np.eye(nd - 1)
        z[0, :nd] = -diff[1:]
    q = np.array([[max(float(v["s2"][0]), 1e-300)]])
    h = np.array([[float(v["h"][0]) if len(v["h"]) else 0.0]])
    cov, diffuse = np.zeros((size, size)), np.zeros(size)
    from .decomposition import discrete_lyapunov

    try:
        cov[arma, arma] = discrete_lyapunov(t[arma, arma], r[arma] @ q @ r[arma].T)
    except np.linalg.LinAlgError:  # no stationary start
        cov[arma, arma] = np.eye(k) * 1e6
    diffuse[:nd] = 1.0
    shift = np.zeros(n) if exog is None else exog @ v["exog"]
    if len(v["trend"]):
        time = np.arange(1.0, n + 1)
        drift = sum(c * time**i for i, c in enumerate(v["trend"]))
        extra = np.zeros(n)
        full = np.convolve(ar, diff)
        for i in range(n):
            past = full[1 : i + 1]
            extra[i] = drift[i] - past @ extra[i - len(past) : i][::-1] if len(past) else drift[i]
        shift = shift + extra
    return Model(z, h, t, r, q, np.zeros(size), cov, diffuse), shift


def evaluate(spec: Spec, params: np.ndarray, y: np.ndarray, exog, names, cov=None) -> Fitted:
    m, shift = build(spec, params, len(y), exog)
    f = kalman_filter(m, y - shift)
    return Fitted(spec, params, names, float(f.total), m, y, exog, f, np.zeros((0, 0)) if cov is None else cov)


def start_params(spec: Spec, y: np.ndarray, exog: np.ndarray | None) -> np.ndarray:
    """Regression for trend and regressors, then two-stage least squares for ARMA terms (Hannan and Rissanen)."""
    p, d, q = spec.order
    sp, sd, sq, s = spec.seasonal
    diff = _difference_poly(d, sd, max(s, 1))
    filled = pd.Series(y).interpolate(limit_direction="both").to_numpy()
    w = np.convolve(filled, diff, "valid")
    k = 0 if spec.trend == "n" else len(spec.trend)
    cols = [np.arange(1.0, len(w) + 1) ** i for i in range(k)]
    if exog is not None:
        cols += [np.convolve(exog[:, i], diff, "valid") for i in range(exog.shape[1])]
    beta = lstsq(w, np.column_stack(cols))[0] if cols else np.zeros(0)
    if cols:
        w = w - np.column_stack(cols) @ beta
    lags = sorted({*range(1, p + 1)}), [s * i for i in range(1, sp + 1)], sorted({*range(1, q + 1)}), [s * i for i in range(1, sq + 1)]
    parts = [np.zeros(len(x)) for x in lags]
    sigma = float(np.var(w)) or 1.0
    top = max([0, *[v for x in lags for v in x]])
    long = min(max(2 * top, 1), max(len(w) // 3, 1))
    if top and len(w) > 2 * top + 5:
        x = np.column_stack([w[long - j : len(w) - j] for j in range(1, long + 1)])
        e = np.r_[np.zeros(long), w[long:] - x @ lstsq(w[long:], x)[0]]
        cut = max(top, 1)
        design = [w[cut - j : len(w) - j] for x in lags[:2] for j in x] + [e[cut - j : len(w) - j] for x in lags[2:] for j in x]
        b, ssr, _, _ = lstsq(w[cut:], np.column_stack(design))
        at = 0
        for i, x in enumerate(lags):
            parts[i], at = b[at : at + len(x)], at + len(x)
        sigma = max(ssr / (len(w) - cut), 1e-8)
    for i in range(4):
        sign = 1.0 if i < 2 else -1.0
        if len(parts[i]) and not np.any(unconstrain(sign * parts[i])):
            parts[i] = np.zeros(len(parts[i]))
    ar, sar, ma, sma = parts
    mean = beta.copy()
    if k and len(mean):
        mean[:k] *= (1 - ar.sum()) * (1 - sar.sum())
    return np.r_[mean, ar, ma, sar, sma, [sigma * 0.1] if spec.measurement_error else [], sigma]


def _transform(spec: Spec, u: np.ndarray, exog: int, inverse: bool = False) -> np.ndarray:
    v = split(spec, u, exog)
    f = unconstrain if inverse else constrain
    ar = (lambda x: f(x)) if spec.stationary else (lambda x: x)
    ma = (lambda x: (f(-x) if inverse else -f(x))) if spec.invertible else (lambda x: x)
    var = (lambda x: np.sqrt(np.maximum(x, 1e-12))) if inverse else np.square
    return np.r_[v["trend"], v["exog"], ar(v["ar"]), ma(v["ma"]), ar(v["sar"]), ma(v["sma"]), var(v["h"]), var(v["s2"])]


def fit(y: np.ndarray, spec: Spec, exog: np.ndarray | None = None, covariance: bool = True, fixed: dict[str, float] | None = None) -> Fitted:
    """Maximise the exact likelihood over unconstrained parameters; ``fixed`` holds named ones at given values."""
    y = np.asarray(y, float)
    exog = None if exog is None else np.asarray(exog, float).reshape(len(y), -1)
    k = 0 if exog is None else exog.shape[1]
    names, first = layout(spec, k), start_params(spec, y, exog)
    size = np.nanstd(y) or 1.0
    held = np.array([(fixed or {}).get(nm, np.nan) for nm in names])
    free = np.isnan(held)

    def full(u):
        return np.where(free, _transform(spec, u, k), held)

    def cost(u):
        try:
            m, shift = build(spec, full(u), len(y), exog)
            v = log_likelihood(m, y - shift)
            return -v / len(y) if math.isfinite(v) else 1e10
        except (np.linalg.LinAlgError, FloatingPointError, ValueError):
            return 1e10

    u0 = _transform(spec, first, k, inverse=True)
    r = O.lbfgsb(cost, u0, gtol=1e-6, ftol=1e-12, iterations=200, evaluations=6000)
    if r.cost >= 1e9:
        r = O.nelder_mead(cost, u0 * 0 + np.r_[np.zeros(len(u0) - 1), size], 0.5)
    params, cov = full(r.x), np.zeros((0, 0))
    if covariance:
        step = lambda p: log_likelihood(*(lambda m, s: (m, y - s))(*build(spec, p, len(y), exog)))
        try:
            h = O.hessian(step, params)
            cov = np.full((len(params), len(params)), np.nan)
            cov[np.ix_(free, free)] = np.linalg.pinv(-h[np.ix_(free, free)])
        except np.linalg.LinAlgError:
            cov = np.full((len(params), len(params)), np.nan)
    return evaluate(spec, params, y, exog, names, cov)


def diagnostics(f: Fitted, lags: int = 10) -> dict[str, float]:
    """Normality, heteroskedasticity (last against first third) and serial correlation of standardised errors."""
    e = (f.filtered.error[:, 0] / np.sqrt(f.filtered.error_cov[:, 0, 0]))[len(_difference_poly(f.spec.order[1], f.spec.seasonal[1], max(f.spec.seasonal[3], 1))) - 1 :]
    e = e[~np.isnan(e)]
    c = e - e.mean()
    m2 = (c**2).mean()
    jb = len(e) / 6 * (((c**3).mean() / m2**1.5) ** 2 + ((c**4).mean() / m2**2 - 3) ** 2 / 4)
    h = int(math.floor(len(e) / 3 + 0.5))
    ratio = (e[-h:] ** 2).sum() / (e[:h] ** 2).sum()
    up = float(dist.f_sf(ratio, h, h))
    r = np.array([(c[k:] * c[:-k]).sum() for k in range(1, lags + 1)]) / (c * c).sum()
    q = len(e) * (len(e) + 2) * (r**2 / (len(e) - np.arange(1, lags + 1))).sum()
    df = max(lags - f.spec.order[0] - f.spec.order[2], 1)
    return {"jb": jb, "jb_p": math.exp(-jb / 2), "het": ratio, "het_p": 2 * min(up, 1 - up), "lb": q, "lb_p": float(dist.chi2_sf(q, df))}


def fit_series(df: DataFrame, y: str, spec: Spec, by: Sequence[str] = (), order: Sequence[str] = ("t",), exog: Sequence[str] = ()) -> DataFrame:
    """Parameter table of each series' fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = fit(pdf[y].to_numpy(float), spec, pdf[list(exog)].to_numpy(float) if exog else None)
        ic = f.criteria()
        return f.table().assign(loglik=f.loglik, aic=ic["aic"], bic=ic["bic"])

    return per_group(df, by, order, run, "term string, coef double, std_err double, t_stat double, p_value double, ci_low double, ci_high double, loglik double, aic double, bic double", [y, *exog])


def forecast_series(df: DataFrame, y: str, spec: Spec, steps: int, by: Sequence[str] = (), order: Sequence[str] = ("t",)) -> DataFrame:
    """Forecasts of each series: ``by...``, h, mean, se, ci_low, ci_high."""
    run = lambda pdf: fit(pdf[y].to_numpy(float), spec, covariance=False).forecast(steps)
    return per_group(df, by, order, run, "h int, mean double, se double, ci_low double, ci_high double", [y])


# --- vector ARMA ---


def var_least_squares(y: np.ndarray, p: int, const: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intercepts, coefficient matrices (p, k, k) and residual covariance by least squares."""
    n, k = y.shape
    x = np.column_stack([np.ones(n - p), *[y[p - j : n - j] for j in range(1, p + 1)]])
    x = x if const else x[:, 1:]
    b = np.linalg.lstsq(x, y[p:], rcond=None)[0]
    e = y[p:] - x @ b
    c = b[0] if const else np.zeros(k)
    a = b[int(const) :].reshape(p, k, k).transpose(0, 2, 1)
    return c, a, e.T @ e / len(e)


def varma_model(c: np.ndarray, a: np.ndarray, m: np.ndarray, sigma: np.ndarray, h: np.ndarray | None = None) -> Model:
    """Companion form of a vector ARMA; ``a`` and ``m`` are (lags, k, k)."""
    k = len(c)
    p, q = len(a), len(m)
    r = max(p, q + 1)
    t, sel = np.zeros((k * r, k * r)), np.zeros((k * r, k))
    for i in range(p):
        t[i * k : (i + 1) * k, :k] = a[i]
    t[: k * (r - 1), k:] = np.eye(k * (r - 1))
    sel[:k] = np.eye(k)
    for j in range(q):
        sel[(j + 1) * k : (j + 2) * k] = m[j]
    z = np.hstack([np.eye(k), np.zeros((k, k * (r - 1)))])
    intercept = np.r_[c, np.zeros(k * (r - 1))]
    return Model(z, np.zeros((k, k)) if h is None else h, t, sel, sigma, state_intercept=intercept)


def varmax_fit(y: np.ndarray, p: int = 1, q: int = 0, diagonal: bool = False) -> tuple[Model, float, np.ndarray]:
    """Vector ARMA by maximum likelihood from least-squares starts: model, log likelihood, parameters (intercepts, AR, MA, Cholesky factor)."""
    y = np.asarray(y, float)
    k = y.shape[1]
    c, a, s = var_least_squares(np.nan_to_num(y, nan=0.0) if np.isnan(y).any() else y, max(p, 1))
    a = a[:p]
    low = np.linalg.cholesky(s)
    tri = np.diag_indices(k) if diagonal else np.tril_indices(k)
    u0 = np.r_[c, a.ravel(), np.zeros(q * k * k), low[tri]]

    def make(u):
        at = k
        aa = u[at : at + p * k * k].reshape(p, k, k)
        at += p * k * k
        mm = u[at : at + q * k * k].reshape(q, k, k)
        g = np.zeros((k, k))
        g[tri] = u[at + q * k * k :]
        return varma_model(u[:k], aa, mm, g @ g.T)

    def cost(u):
        try:
            m = make(u)
            if np.abs(np.linalg.eigvals(m.transition)).max() >= 0.9999:
                return 1e10
            v = float(kalman_filter(m, y).total)
            return -v / len(y) if math.isfinite(v) else 1e10
        except (np.linalg.LinAlgError, ValueError):
            return 1e10

    r = O.lbfgsb(cost, u0, gtol=1e-5, ftol=1e-10, iterations=60, evaluations=3000)
    return make(r.x), -r.cost * len(y), r.x


def varmax_series(df: DataFrame, cols: Sequence[str], p: int, q: int, steps: int, by: Sequence[str] = (), order: Sequence[str] = ("t",)) -> DataFrame:
    """Forecasts of vector series: ``by...``, h, equation, mean, se, loglik."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[list(cols)].to_numpy(float)
        m, ll, _ = varmax_fit(y, p, q)
        f = kalman_filter(m, np.vstack([y, np.full((steps, y.shape[1]), np.nan)]))
        n = len(y)
        return pd.DataFrame([(h + 1, c, f.forecast[n + h, i], math.sqrt(f.error_cov[n + h, i, i]), ll) for h in range(steps) for i, c in enumerate(cols)], columns=["h", "equation", "mean", "se", "loglik"])

    return per_group(df, by, order, run, "h int, equation string, mean double, se double, loglik double", list(cols))


def smooth_fitted(f: Fitted) -> np.ndarray:
    """Smoothed states of a fit."""
    return kalman_smooth(f.model, f.y)[0]
