"""Linear Gaussian state space models: filter, smoother, simulation, forecasts, initial states.

y_t = d + Z a_t + e_t, e ~ N(0, H);  a_{t+1} = c + T a_t + R n_t, n ~ N(0, Q).  NaN observations are missing.
Observations are taken one component at a time (with H diagonalised first), which needs no inverse and starts
diffuse states exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import per_group
from .decomposition import discrete_lyapunov

LOG2PI = math.log(2 * math.pi)


@dataclass
class Model:
    """System matrices; ``mean``, ``cov`` and ``diffuse`` (a diagonal of ones for diffuse states) are the initial state's."""

    design: np.ndarray
    obs_cov: np.ndarray
    transition: np.ndarray
    selection: np.ndarray
    state_cov: np.ndarray
    mean: np.ndarray | None = None
    cov: np.ndarray | None = None
    diffuse: np.ndarray | None = None
    obs_intercept: np.ndarray | None = None
    state_intercept: np.ndarray | None = None

    def __post_init__(self):
        k, p = self.transition.shape[0], self.design.shape[0]
        kind = np.result_type(self.design, self.transition, self.state_cov, self.obs_cov, float)
        self.obs_intercept = np.zeros(p, kind) if self.obs_intercept is None else np.asarray(self.obs_intercept)
        self.state_intercept = np.zeros(k, kind) if self.state_intercept is None else np.asarray(self.state_intercept)
        if self.mean is None and self.cov is None and self.diffuse is None:
            self.stationary()
        self.mean = np.zeros(k, kind) if self.mean is None else np.asarray(self.mean)
        self.cov = np.zeros((k, k), kind) if self.cov is None else np.asarray(self.cov)
        self.diffuse = np.zeros(k) if self.diffuse is None else np.asarray(self.diffuse, float)

    def stationary(self) -> None:
        k = len(self.transition)
        self.mean = np.linalg.solve(np.eye(k) - self.transition, self.state_intercept)
        self.cov = discrete_lyapunov(self.transition, self.selection @ self.state_cov @ self.selection.T)
        self.diffuse = np.zeros(k)

    def approximate_diffuse(self, variance: float = 1e6) -> Model:
        self.mean, self.cov, self.diffuse = np.zeros(len(self.transition)), np.eye(len(self.transition)) * variance, np.zeros(len(self.transition))
        return self


@dataclass
class Filtered:
    loglik: np.ndarray
    predicted: np.ndarray
    predicted_cov: np.ndarray
    filtered: np.ndarray
    filtered_cov: np.ndarray
    forecast: np.ndarray
    error: np.ndarray
    error_cov: np.ndarray
    steps: list = field(default_factory=list)
    scale: float = 1.0

    @property
    def total(self) -> float:
        return self.loglik.sum()


def kalman_filter(m: Model, y: np.ndarray, method: str = "univariate", burn: int = 0, concentrated: bool = False) -> Filtered:
    """Univariate treatment with exact diffuse start, or the conventional filter (no diffuse states).

    ``concentrated`` estimates a common scale from the standardised errors and applies it to all variances.
    """
    y = np.asarray(y)
    y = y[:, None] if y.ndim == 1 else y
    n, p, k = len(y), m.design.shape[0], len(m.transition)
    kind = np.result_type(m.design, m.transition, m.state_cov, m.obs_cov, m.cov, float)
    rqr = m.selection @ m.state_cov @ m.selection.T
    z, h, d = m.design.astype(kind), m.obs_cov.astype(kind), m.obs_intercept.astype(kind)
    a, pst, pinf = m.mean.astype(kind), m.cov.astype(kind), np.diag(m.diffuse)
    out = Filtered(np.zeros(n, kind), np.zeros((n + 1, k), kind), np.zeros((n + 1, k, k), kind), np.zeros((n, k), kind), np.zeros((n, k, k), kind), np.full((n, p), np.nan, kind), np.full((n, p), np.nan, kind), np.full((n, p, p), np.nan, kind))
    out.predicted[0], out.predicted_cov[0] = a, pst
    squares, logs, seen = 0.0, 0.0, 0
    diagonal = np.count_nonzero(h - np.diag(np.diag(h))) == 0
    for t in range(n):
        ok = ~np.isnan(y[t].real)
        fc = z @ a + d
        out.forecast[t], out.error_cov[t] = fc, z @ pst @ z.T + h
        out.error[t, ok] = y[t, ok] - fc[ok]
        zz, hh, v0 = z[ok], h[np.ix_(ok, ok)], y[t, ok] - d[ok]
        if method == "conventional" and ok.any():
            f = zz @ pst @ zz.T + hh
            low = np.linalg.cholesky(f) if kind == float else None
            v = v0 - zz @ a
            g = np.linalg.solve(f, np.column_stack([v, zz @ pst]))
            logdet = 2 * np.log(np.diag(low)).sum() if low is not None else np.log(np.linalg.det(f))
            q = v @ g[:, 0]
            if t >= burn:
                out.loglik[t] = -0.5 * (len(v) * LOG2PI + logdet + q)
                squares, logs, seen = squares + q, logs + logdet, seen + len(v)
            a = a + pst @ zz.T @ g[:, 0]
            pst = pst - pst @ zz.T @ g[:, 1:]
        elif ok.any():
            if not diagonal and len(v0) > 1:
                low = np.linalg.cholesky(hh)
                zz, v0 = np.linalg.solve(low, zz), np.linalg.solve(low, v0)
                var = np.ones(len(v0), kind)
                if t >= burn:
                    out.loglik[t] -= np.log(np.diag(low)).sum()
                    logs += 2 * np.log(np.diag(low)).sum()
            else:
                var = np.diag(hh)
            for i in range(len(v0)):
                zi = zz[i]
                v, mst, minf = v0[i] - zi @ a, pst @ zi, pinf @ zi
                f, finf = zi @ mst + var[i], float(np.real(zi @ minf))
                out.steps.append((t, zi, v, f, finf, mst, minf))
                if finf > 1e-10:
                    k0 = minf / finf
                    a = a + k0 * v
                    pst = pst + np.outer(k0, k0) * f - np.outer(mst, k0) - np.outer(k0, mst)
                    pinf = pinf - np.outer(k0, minf)
                    if t >= burn:
                        out.loglik[t] -= 0.5 * (LOG2PI + math.log(finf))
                        logs, seen = logs + math.log(finf), seen + 1
                elif np.real(f) > 1e-19:
                    a = a + mst * (v / f)
                    pst = pst - np.outer(mst, mst) / f
                    if t >= burn:
                        out.loglik[t] -= 0.5 * (LOG2PI + np.log(f) + v * v / f)
                        squares, logs, seen = squares + v * v / f, logs + np.log(f), seen + 1
        out.filtered[t], out.filtered_cov[t] = a, pst
        a = m.state_intercept + m.transition @ a
        pst = m.transition @ pst @ m.transition.T + rqr
        pst = (pst + pst.T) / 2
        pinf = m.transition @ pinf @ m.transition.T if pinf.any() else pinf
        if np.abs(pinf).max(initial=0.0) < 1e-12:
            pinf = np.zeros_like(pinf)
        out.predicted[t + 1], out.predicted_cov[t + 1] = a, pst
    if concentrated and seen:
        scale = squares / seen
        out.scale = float(np.real(scale))
        out.loglik = out.loglik * 0
        out.loglik[-1] = -0.5 * (seen * LOG2PI + logs + seen * np.log(scale) + seen)
        for x in (out.predicted_cov, out.filtered_cov, out.error_cov):
            x *= scale
    return out


def log_likelihood(m: Model, y: np.ndarray) -> float:
    """Total log likelihood of one series, with exact diffuse start; nothing is kept.

    Once the predicted covariance no longer changes (and nothing is missing any more), only means are carried on.
    """
    z, h, t = m.design[0], float(m.obs_cov[0, 0]), m.transition
    v0 = np.asarray(y, float).ravel() - m.obs_intercept[0]
    c, rqr, tt = m.state_intercept, m.selection @ m.state_cov @ m.selection.T, m.transition.T
    a, p, inf = m.mean.astype(float), m.cov.astype(float), np.diag(m.diffuse).astype(float)
    diffuse, total, seen, before = bool(inf.any()), 0.0, ~np.isnan(v0), np.full_like(p, np.inf)
    last_gap, moves = (np.flatnonzero(~seen)[-1] if not seen.all() else -1), bool(c.any())
    for i, x in enumerate(v0):
        if seen[i]:
            v, mst = x - z @ a, p @ z
            f = z @ mst + h
            if diffuse:
                minf = inf @ z
                finf = z @ minf
            if diffuse and finf > 1e-10:
                k0 = minf / finf
                a = a + k0 * v
                p = p + np.outer(k0, k0) * f - np.outer(mst, k0) - np.outer(k0, mst)
                inf = inf - np.outer(k0, minf)
                total -= 0.5 * (LOG2PI + math.log(finf))
            elif f > 1e-19:
                g = mst / f
                a = a + g * v
                p = p - g[:, None] * mst
                total -= 0.5 * (LOG2PI + math.log(f) + v * v / f)
        a = t @ a + c if moves else t @ a
        new = t @ p @ tt + rqr
        if diffuse:
            inf = t @ inf @ tt
            if np.abs(inf).max() < 1e-12:
                diffuse = False
        elif i > last_gap and seen[i] and np.abs(new - before).max() <= 1e-15 * (1.0 + np.abs(new).max()):
            mst = new @ z
            f = z @ mst + h
            gain, rest = t @ (mst / f), v0[i + 1 :]
            for x in rest.tolist():
                v = x - z @ a
                a = t @ a + c + gain * v
                total -= 0.5 * (LOG2PI + math.log(f) + v * v / f)
            return total
        p = before = new
    return total


def kalman_smooth(m: Model, y: np.ndarray, f: Filtered | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed states and covariances, by a fixed-interval backward pass over filtered moments (states diffuse at the start need a finite stand-in)."""
    if m.diffuse.any():
        m = Model(m.design, m.obs_cov, m.transition, m.selection, m.state_cov, m.mean, m.cov + np.diag(m.diffuse) * 1e7, None, m.obs_intercept, m.state_intercept)
        f = None
    f = f or kalman_filter(m, y)
    n = len(f.filtered)
    s, v = f.filtered.copy(), f.filtered_cov.copy()
    for t in range(n - 2, -1, -1):
        gain = f.filtered_cov[t] @ m.transition.T @ np.linalg.pinv(f.predicted_cov[t + 1])
        s[t] = f.filtered[t] + gain @ (s[t + 1] - f.predicted[t + 1])
        v[t] = f.filtered_cov[t] + gain @ (v[t + 1] - f.predicted_cov[t + 1]) @ gain.T
    return s, v


def simulate(m: Model, n: int, rng: np.random.Generator, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States and observations of one path."""
    root = lambda c: np.linalg.cholesky(c + 1e-14 * np.eye(len(c))) if len(c) else c
    a = m.mean + root(m.cov) @ rng.standard_normal(len(m.mean)) if start is None else start
    q, h = root(m.state_cov), root(m.obs_cov)
    states, obs = [], []
    for _ in range(n):
        states.append(a)
        obs.append(m.obs_intercept + m.design @ a + h @ rng.standard_normal(len(h)))
        a = m.state_intercept + m.transition @ a + m.selection @ q @ rng.standard_normal(len(q))
    return np.array(states), np.array(obs)


def simulation_smoother(m: Model, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A draw of the states given the data: an unconditional path plus the smoothed difference (Durbin and Koopman)."""
    y = np.asarray(y, float)
    y = y[:, None] if y.ndim == 1 else y
    path, obs = simulate(m, len(y), rng)
    fake = np.where(np.isnan(y), np.nan, y - obs)
    flat = Model(m.design, m.obs_cov, m.transition, m.selection, m.state_cov, np.zeros_like(m.mean), m.cov, m.diffuse)
    return path + kalman_smooth(flat, fake)[0]


def smoothed_weights(m: Model, y: np.ndarray) -> np.ndarray:
    """How much each observation adds to each smoothed state: (t, state, s, component), by smoothing unit impulses."""
    y = np.asarray(y, float)
    y = y[:, None] if y.ndim == 1 else y
    flat = Model(m.design, m.obs_cov, m.transition, m.selection, m.state_cov, np.zeros_like(m.mean), m.cov, m.diffuse)
    out = np.zeros((len(y), len(m.transition), *y.shape))
    for s, c in np.argwhere(~np.isnan(y)):
        unit = np.where(np.isnan(y), np.nan, 0.0)
        unit[s, c] = 1.0
        out[:, :, s, c] = kalman_smooth(flat, unit)[0]
    return out


def forecast(m: Model, y: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of the next observations: filtering on over missing ones."""
    y = np.asarray(y, float)
    y = y[:, None] if y.ndim == 1 else y
    f = kalman_filter(m, np.vstack([y, np.full((steps, y.shape[1]), np.nan)]))
    n = len(y)
    return f.forecast[n:], f.error_cov[n:]


def impulse_response(m: Model, steps: int, orthogonal: bool = False, cumulative: bool = False) -> np.ndarray:
    """(step, response, shock) for unit or Cholesky-orthogonalised shocks; steps + 1 rows."""
    shock = m.selection @ (np.linalg.cholesky(m.state_cov) if orthogonal else np.eye(len(m.state_cov)))
    out, power = [], np.eye(len(m.transition))
    for _ in range(steps + 1):
        out.append(m.design @ power @ shock)
        power = m.transition @ power
    return np.cumsum(out, axis=0) if cumulative else np.array(out)


def variance_shares(m: Model, steps: int) -> np.ndarray:
    """Each shock's share of the squared orthogonalised response at each step (not summed over steps)."""
    sq = impulse_response(m, steps, True) ** 2
    total = sq.sum(axis=2, keepdims=True)
    return np.divide(sq, total, out=np.full_like(sq, np.nan), where=total > 0)


def news(m: Model, old: np.ndarray, new: np.ndarray, at: int) -> pd.DataFrame:
    """What each new or revised observation changes in the smoothed signal at time ``at``: t, component, news, weight, impact."""
    old, new = (np.asarray(v, float).reshape(len(v), -1) for v in (old, new))
    n = max(len(old), len(new), at + 1)
    grow = lambda v: np.vstack([v, np.full((n - len(v), v.shape[1]), np.nan)])
    old, new = grow(old), grow(new)
    s, _ = kalman_smooth(m, old)
    expected = s @ m.design.T + m.obs_intercept
    w = smoothed_weights(m, new)
    rows = []
    for t, c in np.argwhere(~np.isnan(new)):
        base = old[t, c] if not np.isnan(old[t, c]) else expected[t, c]
        if new[t, c] != base:
            weight = float(m.design[0] @ w[at, :, t, c])
            rows.append((int(t), int(c), new[t, c] - base, weight, weight * (new[t, c] - base)))
    return pd.DataFrame(rows, columns=["t", "component", "news", "weight", "impact"])


def local_level(level_var: float, obs_var: float, diffuse: bool = True, mean: float = 0.0, var: float = 0.0) -> Model:
    one = np.eye(1)
    return Model(one, one * obs_var, one, one, one * level_var, np.array([mean]), one * var, np.ones(1) if diffuse else np.zeros(1))


def filter_series(df: DataFrame, y: str, model: Model, by: Sequence[str] = (), order: Sequence[str] = ("t",), smooth: bool = True) -> DataFrame:
    """Filter each series with one model: ``by...``, order columns, component, predicted, filtered, smoothed, variance, loglik."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[y].to_numpy(float)
        f = kalman_filter(model, v)
        s = kalman_smooth(model, v)[0] if smooth else np.full_like(f.filtered, np.nan)
        return pd.concat([
            pd.DataFrame({**{c: pdf[c].to_numpy() for c in order}, "component": i, "predicted": f.predicted[:-1, i], "filtered": f.filtered[:, i], "smoothed": s[:, i], "variance": f.filtered_cov[:, i, i], "loglik": f.loglik})
            for i in range(f.filtered.shape[1])
        ])

    return per_group(df, by, order, run, f"{kinds}, component int, predicted double, filtered double, smoothed double, variance double, loglik double", [y])
