"""Initial value problems: explicit Runge-Kutta pairs, BDF and Radau, events and dense output; one trajectory per parameter row."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Butcher tableaux (fixed values): nodes, rows, weights, error weights, order of the error.
RK23 = (np.array([0, 1 / 2, 3 / 4, 1]), [[], [1 / 2], [0, 3 / 4], [2 / 9, 1 / 3, 4 / 9]], np.array([2 / 9, 1 / 3, 4 / 9, 0]), np.array([5 / 72, -1 / 12, -1 / 9, 1 / 8]), 2)
RK45 = (
    np.array([0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1]),
    [[], [1 / 5], [3 / 40, 9 / 40], [44 / 45, -56 / 15, 32 / 9], [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729], [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656], [35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84]],
    np.array([35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84, 0]), np.array([-71 / 57600, 0, 71 / 16695, -71 / 1920, 17253 / 339200, -22 / 525, 1 / 40]), 4,
)


@dataclass
class Trajectory:
    t: np.ndarray
    y: np.ndarray  # (time, component)
    slopes: np.ndarray
    status: str
    evaluations: int
    events: list = field(default_factory=list)  # (event, time, state)

    def at(self, t) -> np.ndarray:
        """Dense output: cubic Hermite interpolation between steps."""
        t = np.atleast_1d(np.asarray(t, float))
        forward = self.t[-1] >= self.t[0]
        i = np.clip(np.searchsorted(self.t if forward else -self.t, t if forward else -t, side="right") - 1, 0, len(self.t) - 2)
        h = (self.t[i + 1] - self.t[i])[:, None]
        s = ((t - self.t[i]) / h[:, 0])[:, None]
        return (1 + 2 * s) * (1 - s) ** 2 * self.y[i] + s * (1 - s) ** 2 * h * self.slopes[i] + s * s * (3 - 2 * s) * self.y[i + 1] + s * s * (s - 1) * h * self.slopes[i + 1]


@dataclass(frozen=True)
class Event:
    """A sign change of f(t, y): rising, falling or either; the run ends at the ``stop``-th."""

    f: Callable
    trigger: str = "either"
    stop: int | None = None


def _norm(e: np.ndarray, a: np.ndarray, b: np.ndarray, rtol: float, atol) -> float:
    return float(np.sqrt(np.mean((e / (np.asarray(atol) + rtol * np.maximum(np.abs(a), np.abs(b)))) ** 2)))


def solve(f: Callable, t0: float, t1: float, y0: Sequence[float], method: str = "rk45", rtol: float = 1e-3, atol: float | Sequence[float] = 1e-6, events: Sequence[Event] = (), jac: Callable | None = None, max_step: float = math.inf, max_steps: int = 100_000) -> Trajectory:
    """Integrate y' = f(t, y) by rk23, rk45, dop853, bdf or radau."""
    y, t, count = np.asarray(y0, float), float(t0), 0
    sign = math.copysign(1.0, t1 - t0)

    def rhs(s, v):
        nonlocal count
        count += 1
        return np.asarray(f(s, v), float)

    k = rhs(t, y)
    ts, ys, ks, seen = [t], [y], [k], {i: 0 for i in range(len(events))}
    found: list = []
    d0, d1 = np.sqrt(np.mean((y / (np.asarray(atol) + rtol * np.abs(y))) ** 2)), np.sqrt(np.mean((k / (np.asarray(atol) + rtol * np.abs(y))) ** 2))
    h = min(abs(t1 - t0), max_step, 0.01 * d0 / d1 if d0 > 1e-5 and d1 > 1e-5 else 1e-6) or 1e-6
    stepper = {"rk23": _explicit(RK23), "rk45": _explicit(RK45), "dop853": _extrapolated, "radau": _radau(jac), "bdf": _bdf(jac)}[method]
    state: dict = {}
    status = "success"
    for _ in range(max_steps):
        if sign * (t1 - t) <= 1e-14 * max(1.0, abs(t1)):
            break
        h = min(h, abs(t1 - t), max_step)
        if h < 1e-14 * max(1.0, abs(t)):
            status = "failed"
            break
        new, err, order = stepper(rhs, t, y, k, sign * h, rtol, atol, state)
        if new is None or not np.isfinite(new).all() or err > 1:
            h *= 0.3 if new is None or not math.isfinite(err) else max(0.2, 0.9 * err ** (-1 / (order + 1)))
            state["rejected"] = True
            continue
        tn, kn = t + sign * h, rhs(t + sign * h, new)
        part = Trajectory(np.array([t, tn]), np.array([y, new]), np.array([k, kn]), "", 0)
        stop_at = None
        for i, e in enumerate(events):
            a, b = e.f(t, y), e.f(tn, new)
            if (a < 0 <= b and e.trigger in ("rising", "either")) or (a > 0 >= b and e.trigger in ("falling", "either")):
                lo, hi = t, tn
                for _ in range(60):
                    mid = (lo + hi) / 2
                    same = e.f(mid, part.at(mid)[0]) * a > 0
                    lo, hi = (mid, hi) if same else (lo, mid)
                found.append((i, hi, part.at(hi)[0]))
                seen[i] += 1
                if e.stop is not None and seen[i] >= e.stop:
                    stop_at = hi
        if stop_at is not None:
            tn, new = stop_at, part.at(stop_at)[0]
            kn = rhs(tn, new)
        ts.append(tn)
        ys.append(new)
        ks.append(kn)
        t, y, k = tn, new, kn
        if stop_at is not None:
            status = "event"
            break
        grow = 0.9 * max(err, 1e-10) ** (-1 / (order + 1))
        h *= min(1.0 if state.pop("rejected", False) else 10.0, max(0.2, grow))
    else:
        status = "failed"
    return Trajectory(np.array(ts), np.array(ys), np.array(ks), status, count, found)


def _explicit(tableau):
    c, a, b, e, order = tableau

    def step(f, t, y, k0, h, rtol, atol, state):
        k = [k0]
        for i in range(1, len(c)):
            k.append(f(t + c[i] * h, y + h * sum(w * v for w, v in zip(a[i], k, strict=True))))
        k = np.array(k)
        new = y + h * b @ k
        return new, _norm(h * (e @ k), y, new, rtol, atol), order

    return step


def _extrapolated(f, t, y, k0, h, rtol, atol, state):
    """Order 8 by extrapolating the modified midpoint rule; the error is against order 6."""
    table: list = []
    for j, n in enumerate((2, 4, 6, 8)):
        s = h / n
        a, b = y, y + s * k0
        for i in range(1, n):
            a, b = b, a + 2 * s * f(t + i * s, b)
        row = [(a + b + s * f(t + h, b)) / 2]
        for m in range(1, j + 1):
            row.append(row[m - 1] + (row[m - 1] - table[j - 1][m - 1]) / ((n / (n - 2 * m)) ** 2 - 1))
        table.append(row)
    new = table[-1][-1]
    return new, _norm(new - table[-1][-2], y, new, rtol, atol), 7


def _numeric_jacobian(f, t, y):
    base, n = f(t, y), len(y)
    h = 1.5e-8 * np.maximum(1.0, np.abs(y))
    return np.column_stack([(f(t, y + h[i] * np.eye(n)[i]) - base) / h[i] for i in range(n)])


#: Radau IIA of order 5 (fixed values).
S6 = math.sqrt(6)
RADAU_C = np.array([(4 - S6) / 10, (4 + S6) / 10, 1])
RADAU_A = np.array([[(88 - 7 * S6) / 360, (296 - 169 * S6) / 1800, (-2 + 3 * S6) / 225], [(296 + 169 * S6) / 1800, (88 + 7 * S6) / 360, (-2 - 3 * S6) / 225], [(16 - S6) / 36, (16 + S6) / 36, 1 / 9]])


def _radau(jac):
    def step(f, t, y, k0, h, rtol, atol, state):
        n = len(y)
        j = jac(t, y) if jac else _numeric_jacobian(f, t, y)
        m = np.eye(3 * n) - h * np.kron(RADAU_A, j)
        z = np.zeros((3, n))
        for it in range(12):
            fz = np.array([f(t + c * h, y + z[i]) for i, c in enumerate(RADAU_C)])
            d = np.linalg.solve(m, (h * RADAU_A @ fz - z).ravel()).reshape(3, n)
            z = z + d
            if _norm(d.ravel(), np.tile(y, 3), np.tile(y, 3), rtol, np.tile(np.broadcast_to(atol, n), 3)) < 1e-3:
                break
        else:
            return None, math.inf, 3
        e = np.array([-13 - 7 * S6, -13 + 7 * S6, -1]) / 3
        err = np.linalg.solve(np.eye(n) * 3.6378342527444957 / h - j, k0 + e @ z / h)
        return y + z[2], _norm(err, y, y + z[2], rtol, atol), 3

    return step


def _bdf(jac):
    """Variable order 1 to 5 on the last accepted points, by interpolating them at the current spacing."""

    def step(f, t, y, k0, h, rtol, atol, state):
        past = state.setdefault("past", [])
        if not past or past[-1][0] != t:
            past.append((t, y))
            del past[:-6]
        order = min(len(past), state.get("order", 5), 5)
        j = jac(t + h, y) if jac else _numeric_jacobian(f, t, y)

        def attempt(q):
            s = np.array([t + h, *[p[0] for p in past[::-1][:q]]])
            w = np.array([sum(1 / (s[0] - s[m]) for m in range(1, q + 1)) if i == 0 else math.prod((s[0] - s[m]) for m in range(1, q + 1) if m != i) / math.prod((s[i] - s[m]) for m in range(q + 1) if m != i) for i in range(q + 1)])
            old = sum(wi * p[1] for wi, p in zip(w[1:], past[::-1], strict=False))
            v = y + h * k0
            mat = w[0] * np.eye(len(y)) - j
            for _ in range(10):
                d = np.linalg.solve(mat, f(t + h, v) - w[0] * v - old)
                v = v + d
                if _norm(d, y, v, rtol, atol) < 1e-3:
                    return v
            return None

        new = attempt(order)
        if new is None:
            state["order"] = 1
            return None, math.inf, 1
        low = attempt(order - 1) if order > 1 else y + h * k0
        state["order"] = 5
        err = math.inf if low is None else _norm(new - low, y, new, rtol, atol) / (1 if order > 1 else 2)
        return new, err, max(order - 1, 1)

    return step


def solve_many(f: Callable, t0: float, t1: float, y0: np.ndarray, eval_at: Sequence[float], method: str = "rk45", rtol: float = 1e-3, atol: float = 1e-6, max_steps: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Many problems at once, each with steps of its own: values (problem, time, component) at ``eval_at``, and whether each got to the end.

    Steps end at the wanted times, so that values there have the method's own accuracy.

    :param f: f(t, y, which) for the problems ``which``: t (m,), y (m, n) to slopes (m, n)
    :param method: rk23, rk45 or radau
    """
    y, sign, span = np.array(y0, float), math.copysign(1.0, t1 - t0), abs(t1 - t0)
    m, n = y.shape
    stops = (np.asarray(eval_at, float) - t0) * sign
    out = np.full((m, len(stops), n), np.nan)
    out[:, stops == 0] = y[:, None]
    t, live, ok = np.zeros(m), np.arange(m), np.zeros(m, dtype=bool)  # time since the start
    at = lambda w, s: t0 + sign * s
    k = f(at(live, t), y, live)
    size = lambda v, scale: np.sqrt(np.mean((v / (atol + rtol * np.abs(scale))) ** 2, axis=1))
    d0, d1 = size(y, y), size(k, y)
    h = np.minimum(span, np.where((d0 > 1e-5) & (d1 > 1e-5), 0.01 * d0 / np.maximum(d1, 1e-300), 1e-6))
    step = _radau_many if method == "radau" else _explicit_many({"rk23": RK23, "rk45": RK45}[method])
    for _ in range(max_steps):
        if not len(live):
            break
        ahead = np.where(stops > t[live][:, None] + 1e-13 * span, stops, np.inf).min(axis=1)
        h_now = np.minimum(h[live], np.minimum(ahead, span) - t[live])
        new, err, order = step(lambda c, v, w=live: f(at(w, t[w] + c), v, w), y[live], k[live], sign, h_now, rtol, atol)
        good = np.isfinite(new).all(axis=1) & (err <= 1)
        w = live[good]
        if len(w):
            k[w] = f(at(w, t[w] + h_now[good]), new[good], w)
            t[w], y[w] = t[w] + h_now[good], new[good]
            row, col = np.nonzero(np.abs(stops - t[w][:, None]) <= 1e-13 * span)
            out[w[row], col] = y[w[row]]
        with np.errstate(all="ignore"):
            factor = np.where(np.isfinite(err), 0.9 * np.maximum(err, 1e-10) ** (-1 / (order + 1)), 0.3)
        grown = h_now * np.where(good, np.clip(factor, 0.2, 10.0), np.clip(factor, 0.2, 0.9))
        h[live] = np.where(good & (h_now < h[live]), np.maximum(h[live], grown), grown)  # a step cut short says little
        ok[live] |= span - t[live] <= 1e-14 * max(1.0, span)
        live = live[~ok[live] & (h[live] > 1e-14 * max(1.0, span))]
    return out, ok


def _explicit_many(tableau):
    c, a, b, e, order = tableau

    def step(f, y, k0, sign, h, rtol, atol):
        k, hs = [k0], sign * h[:, None]
        for i in range(1, len(c)):
            k.append(f(c[i] * h, y + hs * sum(w * v for w, v in zip(a[i], k, strict=True))))
        new = y + hs * sum(w * v for w, v in zip(b, k, strict=True))
        err = hs * sum(w * v for w, v in zip(e, k, strict=True))
        return new, np.sqrt(np.mean((err / (atol + rtol * np.maximum(np.abs(y), np.abs(new)))) ** 2, axis=1)), order

    return step


def _radau_many(f, y, k0, sign, h, rtol, atol):
    m, n = y.shape
    hs = sign * h
    move = 1.5e-8 * np.maximum(1.0, np.abs(y))
    base = f(np.zeros(m), y)
    jac = np.stack([(f(np.zeros(m), y + move[:, [i]] * np.eye(n)[i]) - base) / move[:, [i]] for i in range(n)], axis=2)
    inverse = np.linalg.inv(np.eye(3 * n) - hs[:, None, None] * np.einsum("ab,mij->maibj", RADAU_A, jac).reshape(m, 3 * n, 3 * n))
    z, scale, settled = np.zeros((m, 3, n)), atol + rtol * np.abs(y), np.zeros(m, dtype=bool)
    for _ in range(12):
        fz = np.stack([f(c * h, y + z[:, i]) for i, c in enumerate(RADAU_C)], axis=1)
        d = np.einsum("mij,mj->mi", inverse, (hs[:, None, None] * np.einsum("ab,mbi->mai", RADAU_A, fz) - z).reshape(m, 3 * n)).reshape(m, 3, n)
        z = np.where(settled[:, None, None], z, z + d)
        settled |= np.sqrt(np.mean((d / scale[:, None]) ** 2, axis=(1, 2))) < 1e-3
        if settled.all():
            break
    e = np.array([-13 - 7 * S6, -13 + 7 * S6, -1]) / 3
    err = np.linalg.solve(np.eye(n) * (3.6378342527444957 / hs)[:, None, None] - jac, (k0 + np.einsum("a,mai->mi", e, z) / hs[:, None])[..., None])[..., 0]
    size = np.sqrt(np.mean((err / (atol + rtol * np.maximum(np.abs(y), np.abs(y + z[:, 2])))) ** 2, axis=1))
    return y + z[:, 2], np.where(settled, size, np.inf), 3


def trajectories_many(params: DataFrame, rhs: Callable[[pd.DataFrame], Callable], y0: Callable[[pd.DataFrame], np.ndarray], t0: float, t1: float, eval_at: Sequence[float], key: str, **how) -> DataFrame:
    """One trajectory per row of parameters, a batch of rows at a time: key, t, component, y, status.

    :param rhs: of a batch, f(t, y, which) as in ``solve_many``
    :param y0: of a batch, first values (row, component)
    """

    def run(batches):
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            if not len(pdf):
                continue
            y, ok = solve_many(rhs(pdf), t0, t1, y0(pdf), eval_at, **how)
            m, times, n = y.shape
            yield pd.DataFrame(
                {
                    key: np.repeat(pdf[key].to_numpy(), times * n), "t": np.tile(np.repeat(np.asarray(eval_at, float), n), m), "component": np.tile(np.arange(n, dtype=np.int32), m * times),
                    "y": y.ravel(), "status": np.repeat(np.where(ok, "success", "failed"), times * n),
                }
            )

    kind = params.schema[key].dataType.simpleString()
    return params.mapInPandas(run, f"`{key}` {kind}, t double, component int, y double, status string")


def trajectories(params: DataFrame, rhs: Callable[[pd.Series], Callable], y0: Callable[[pd.Series], Sequence[float]], t0: float, t1: float, eval_at: Sequence[float], key: str, **how) -> DataFrame:
    """One trajectory per row of parameters: key, t, component, y, status."""

    def run(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                tr = solve(rhs(r), t0, t1, y0(r), **how)
                for t, v in zip(eval_at, tr.at(eval_at), strict=True):
                    rows += [(r[key], float(t), i, float(x), tr.status) for i, x in enumerate(v)]
            yield pd.DataFrame(rows, columns=[key, "t", "component", "y", "status"])

    kind = params.schema[key].dataType.simpleString()
    return params.mapInPandas(run, f"`{key}` {kind}, t double, component int, y double, status string")
