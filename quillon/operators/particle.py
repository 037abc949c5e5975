"""Sequential Monte Carlo: particle filters, smoothers, samplers, resampling and quasi-random points."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import per_group


def log_sum_exp(w: np.ndarray) -> float:
    top = w.max()
    return top + math.log(np.exp(w - top).sum()) if np.isfinite(top) else -math.inf


def normalise(logw: np.ndarray) -> np.ndarray:
    """Weights that sum to 1; equal ones if all are zero."""
    top = logw.max()
    w = np.exp(logw - top) if np.isfinite(top) else np.ones(len(logw))
    return w / w.sum()


def ess(w: np.ndarray) -> float:
    return 1.0 / float((w * w).sum())


def resample(w: np.ndarray, m: int, rng: np.random.Generator, scheme: str = "systematic") -> np.ndarray:
    """Ancestors by systematic, stratified, multinomial, residual, ssp or killing."""
    n, total = len(w), np.cumsum(w)
    total[-1] = 1.0
    if scheme == "systematic":
        return np.searchsorted(total, (rng.random() + np.arange(m)) / m)
    if scheme == "stratified":
        return np.searchsorted(total, (rng.random(m) + np.arange(m)) / m)
    if scheme == "multinomial":
        gaps = np.cumsum(-np.log(rng.random(m + 1)))
        return np.searchsorted(total, gaps[:-1] / gaps[-1])
    if scheme == "residual":
        whole = np.floor(m * w).astype(int)
        out, rest = np.repeat(np.arange(n), whole), m - int(whole.sum())
        if rest:
            frac = m * w - whole
            out = np.r_[out, resample(frac / frac.sum(), rest, rng, "multinomial")]
        return out
    if scheme == "ssp":
        xi = m * w
        whole = np.floor(xi).astype(int)
        frac, i, j = xi - whole, 0, 1
        while j < n:
            a, b = frac[i], frac[j]
            up, down = min(b, 1 - a), min(a, 1 - b)
            if up + down == 0:
                move = True
            else:
                move = rng.random() < down / (up + down)
            step = up if move else -down
            frac[i], frac[j] = a + step, b - step
            loser, keep = (i, j) if (frac[i] >= 1 - 1e-12 or frac[i] <= 1e-12) else (j, i)
            whole[loser] += int(frac[loser] > 0.5)
            i, j = keep, j + 1
        whole[i] += int(round(m - whole.sum()))
        return np.repeat(np.arange(n), np.maximum(whole, 0))[:m]
    if scheme == "killing":
        keep = rng.random(n) * w.max() < w
        out = np.arange(n)
        out[~keep] = np.searchsorted(total, rng.random(int((~keep).sum())))
        return out
    raise ValueError(f"unknown scheme {scheme!r}")


@dataclass
class StateModel:
    """A hidden Markov model: starting cloud, transition and observation density; the rest is optional."""

    start: Callable  # (rng, n) -> x
    move: Callable  # (rng, t, x) -> x
    log_obs: Callable  # (t, x, y) -> log weights
    log_move: Callable | None = None  # (t, x_prev, x) -> log density
    propose: Callable | None = None  # (rng, t, x_prev, y) -> x, log q;  x_prev None at the start
    look_ahead: Callable | None = None  # (t, x, y_next) -> log weights
    log_start: Callable | None = None


def linear_gauss(rho: float = 0.9, sx: float = 1.0, sy: float = 0.2) -> StateModel:
    s0 = sx / math.sqrt(1 - rho * rho) if abs(rho) < 1 else sx
    norm = lambda r, s: -0.5 * (r / s) ** 2 - math.log(s) - 0.5 * math.log(2 * math.pi)

    def propose(rng, t, prev, y):
        m, v = (np.zeros(1), s0 * s0) if prev is None else (rho * prev, sx * sx)
        pv = 1 / (1 / v + 1 / sy**2)
        pm = pv * (m / v + y / sy**2)
        x = pm + math.sqrt(pv) * rng.standard_normal(len(pm))
        return x, norm(x - pm, math.sqrt(pv))

    return StateModel(lambda rng, n: s0 * rng.standard_normal(n), lambda rng, t, x: rho * x + sx * rng.standard_normal(len(x)), lambda t, x, y: norm(y - x, sy), lambda t, p, x: norm(x - rho * p, sx), propose,
                      lambda t, x, y: norm(y - rho * x, math.sqrt(sx**2 + sy**2)), lambda x: norm(x, s0))


def stochastic_volatility(mu: float = -1.0, rho: float = 0.95, sigma: float = 0.3, leverage: float = 0.0) -> StateModel:
    norm = lambda r, s: -0.5 * (r / s) ** 2 - np.log(s) - 0.5 * math.log(2 * math.pi)
    return StateModel(lambda rng, n: mu + sigma / math.sqrt(1 - rho * rho) * rng.standard_normal(n), lambda rng, t, x: mu + rho * (x - mu) + sigma * rng.standard_normal(len(x)), lambda t, x, y: norm(y, np.exp(x / 2)), lambda t, p, x: norm(x - mu - rho * (p - mu), sigma))


def gordon(sx: float = math.sqrt(10), sy: float = 1.0) -> StateModel:
    mean = lambda t, x: 0.5 * x + 25 * x / (1 + x * x) + 8 * math.cos(1.2 * t)
    norm = lambda r, s: -0.5 * (r / s) ** 2 - math.log(s) - 0.5 * math.log(2 * math.pi)
    return StateModel(lambda rng, n: sx * rng.standard_normal(n), lambda rng, t, x: mean(t, x) + sx * rng.standard_normal(len(x)), lambda t, x, y: norm(y - x * x / 20, sy), lambda t, p, x: norm(x - mean(t, p), sx))


def theta_logistic(t0: float = 0.15, t1: float = 0.12, t2: float = 0.1, sx: float = 0.47, sy: float = 0.39) -> StateModel:
    mean = lambda x: x + t0 - t1 * np.exp(np.minimum(t2 * x, 50))
    norm = lambda r, s: -0.5 * (r / s) ** 2 - math.log(s) - 0.5 * math.log(2 * math.pi)
    return StateModel(lambda rng, n: rng.standard_normal(n), lambda rng, t, x: mean(x) + sx * rng.standard_normal(len(x)), lambda t, x, y: norm(y - x, sy), lambda t, p, x: norm(x - mean(p), sx))


def discrete_cox(mu: float = 0.0, rho: float = 0.9, sigma: float = 0.5) -> StateModel:
    norm = lambda r, s: -0.5 * (r / s) ** 2 - math.log(s) - 0.5 * math.log(2 * math.pi)
    return StateModel(lambda rng, n: mu + sigma / math.sqrt(1 - rho * rho) * rng.standard_normal(n), lambda rng, t, x: mu + rho * (x - mu) + sigma * rng.standard_normal(len(x)), lambda t, x, y: y * x - np.exp(np.minimum(x, 50)) - math.lgamma(y + 1), lambda t, p, x: norm(x - mu - rho * (p - mu), sigma))


def bearings_only(sx: float = 2e-4, sy: float = 1e-3, start: Sequence[float] = (3e-3, -3e-3, 1.0, 1.0)) -> StateModel:
    """Four states: two velocities and two positions; the observation is an angle."""

    def move(rng, t, x):
        v = x[:, :2] + sx * rng.standard_normal((len(x), 2))
        return np.column_stack([v, x[:, 2:] + x[:, :2]])

    norm = lambda r, s: -0.5 * (r / s) ** 2 - math.log(s) - 0.5 * math.log(2 * math.pi)
    return StateModel(lambda rng, n: np.asarray(start) + np.array([sx, sx, 0.1, 0.1]) * rng.standard_normal((n, 4)), move, lambda t, x, y: norm(y - np.arctan2(x[:, 3], x[:, 2]), sy))


@dataclass
class Run:
    loglik: np.ndarray
    ess: np.ndarray
    resampled: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    x: np.ndarray
    w: np.ndarray
    history: list = field(default_factory=list)  # per step: particles, log weights, ancestors

    @property
    def total(self) -> float:
        return float(self.loglik.sum())


def particle_filter(model: StateModel, ys: Sequence, n: int = 1000, weighting: str = "bootstrap", scheme: str = "systematic", essr_min: float = 0.5, seed: int = 0, keep: int | None = 0) -> Run:
    """bootstrap, guided or auxiliary; resamples when ESS < essr_min * n.  ``keep`` steps of history (None: all)."""
    rng = np.random.default_rng(seed)
    x, logw, eta = None, np.full(n, -math.log(n)), np.zeros(n)
    out = Run(*(np.zeros(len(ys)) for _ in range(2)), np.zeros(len(ys), bool), [], [], None, None)
    for t, y in enumerate(ys):
        ancestors, again = np.arange(n), False
        if t:
            w = normalise(logw + eta)
            again = ess(w) < essr_min * n
            if again:
                ancestors = resample(w, n, rng, scheme)
                logw = -eta[ancestors] + (log_sum_exp(logw + eta) - math.log(n))
        prev = None if x is None else x[ancestors]
        seen = y is not None and not (np.isscalar(y) and math.isnan(y))
        if weighting == "guided" and model.propose and seen:
            x, logq = model.propose(rng, t, np.zeros(n) if prev is None else prev, y) if prev is not None else _first(model, rng, n, y)
            step = model.log_obs(t, x, y) + (model.log_start(x) if prev is None else model.log_move(t, prev, x)) - logq
        else:
            x = model.start(rng, n) if prev is None else model.move(rng, t, prev)
            step = model.log_obs(t, x, y) if seen else np.zeros(n)
        before = log_sum_exp(logw)
        logw = logw + step
        out.loglik[t] = log_sum_exp(logw) - before
        w = normalise(logw)
        logw = np.log(np.maximum(w, 1e-300))
        out.ess[t], out.resampled[t] = ess(w), again
        flat = x if x.ndim > 1 else x[:, None]
        m = w @ flat
        out.mean.append(m)
        out.variance.append(w @ (flat - m) ** 2)
        eta = model.look_ahead(t + 1, x, ys[t + 1]) if weighting == "auxiliary" and model.look_ahead and t + 1 < len(ys) else np.zeros(n)
        if keep is None or keep > 0:
            out.history.append((x, logw, ancestors))
            if keep:
                out.history = out.history[-keep:]
    out.mean, out.variance, out.x, out.w = np.array(out.mean), np.array(out.variance), x, normalise(logw)
    return out


def _first(model, rng, n, y):
    return model.propose(rng, 0, None, y) if False else ((x := model.start(rng, n)), model.log_start(x))


def ffbs(model: StateModel, run: Run, paths: int, seed: int = 1) -> np.ndarray:
    """Backward-sampled trajectories (path, t) from a filter with full history."""
    rng = np.random.default_rng(seed)
    x, logw, _ = run.history[-1]
    out = [x[rng.choice(len(x), paths, p=normalise(logw))]]
    for t in range(len(run.history) - 2, -1, -1):
        x, logw, _ = run.history[t]
        lw = logw[None, :] + model.log_move(t + 1, x[None, :], out[-1][:, None])
        p = np.exp(lw - lw.max(axis=1, keepdims=True))
        c = np.cumsum(p, axis=1)
        out.append(x[np.minimum((c < rng.random(paths)[:, None] * c[:, -1:]).sum(axis=1), len(x) - 1)])
    return np.array(out[::-1]).T


def genealogy(run: Run) -> np.ndarray:
    """Each final particle's path through its ancestors: (t, particle)."""
    idx, out = np.arange(len(run.history[-1][0])), []
    for x, _, anc in reversed(run.history):
        out.append(x[idx])
        idx = anc[idx]
    return np.array(out[::-1])


def fixed_lag_means(model: StateModel, ys: Sequence, lag: int, n: int = 1000, seed: int = 0) -> np.ndarray:
    """Smoothed means from paths of the last ``lag`` steps."""
    run = particle_filter(model, ys, n, seed=seed, keep=None)
    out = np.zeros(len(ys))
    for t in range(len(ys)):
        last = min(t + lag, len(ys) - 1)
        idx = np.arange(n)
        for s in range(last, t, -1):
            idx = run.history[s][2][idx]
        out[t] = normalise(run.history[last][1]) @ run.history[t][0][idx]
    return out


def paris_sum(model: StateModel, ys: Sequence, f: Callable, n: int = 300, draws: int = 2, seed: int = 0) -> float:
    """Smoothed expectation of a sum of f(t, x_prev, x) by PaRIS: a few backward draws per particle and step."""
    rng = np.random.default_rng(seed)
    run = particle_filter(model, ys, n, seed=seed, keep=None)
    tau = np.zeros(n)
    for t in range(1, len(ys)):
        (xp, wp, _), (x, _, _) = run.history[t - 1], run.history[t]
        lw = wp[None, :] + model.log_move(t, xp[None, :], x[:, None])
        p = np.exp(lw - lw.max(axis=1, keepdims=True))
        c = np.cumsum(p, axis=1)
        new = np.zeros(n)
        for _ in range(draws):
            j = np.minimum((c < rng.random(n)[:, None] * c[:, -1:]).sum(axis=1), n - 1)
            new += tau[j] + f(t, xp[j], x)
        tau = new / draws
    return float(normalise(run.history[-1][1]) @ tau)


def two_filter_means(model: StateModel, ys: Sequence, n: int = 500, seed: int = 0) -> np.ndarray:
    """Smoothed means by reweighting forward particles with a backward pass of transition densities."""
    run = particle_filter(model, ys, n, seed=seed, keep=None)
    w = normalise(run.history[-1][1])
    out = [w @ run.history[-1][0]]
    for t in range(len(ys) - 2, -1, -1):
        (x, lw, _), nxt = run.history[t], run.history[t + 1][0]
        k = np.exp(model.log_move(t + 1, x[:, None], nxt[None, :]))
        f = normalise(lw)
        w = f * (k @ (w / np.maximum(f @ k, 1e-300)))
        w = w / w.sum()
        out.append(w @ x)
    return np.array(out[::-1])


# --- samplers over parameters ---


def random_walk(log_post: Callable, x0: np.ndarray, steps: int, scale: float | np.ndarray = 0.1, seed: int = 0, adapt: bool = True) -> tuple[np.ndarray, float]:
    """Metropolis chain with vanishing adaptation of the proposal's covariance; also its acceptance rate."""
    rng, x = np.random.default_rng(seed), np.asarray(x0, float)
    d = len(x)
    cov, mean, lp, hits, out = np.eye(d) * np.square(scale), x.copy(), log_post(x), 0, []
    for i in range(steps):
        low = np.linalg.cholesky(cov * (2.38**2 / d if adapt and i > 50 else 1.0) + 1e-12 * np.eye(d))
        new = x + low @ rng.standard_normal(d)
        ln = log_post(new)
        if math.log(rng.random() + 1e-300) < ln - lp:
            x, lp, hits = new, ln, hits + 1
        out.append(x)
        if adapt:
            g = min(0.5, 1 / (i + 1) ** 0.6)
            r = x - mean
            mean = mean + g * r
            cov = cov + g * (np.outer(r, r) - cov)
    return np.array(out), hits / steps


def pmmh(make: Callable, log_prior: Callable, ys: Sequence, theta0: np.ndarray, steps: int = 200, n: int = 200, scale: float = 0.1, seed: int = 0) -> tuple[np.ndarray, float]:
    """Particle marginal Metropolis-Hastings: the likelihood is a particle filter's estimate."""
    k = iter(range(10**9))

    def post(th):
        p = log_prior(th)
        return p + particle_filter(make(th), ys, n, seed=seed + next(k)).total if math.isfinite(p) else -math.inf

    return random_walk(post, theta0, steps, scale, seed)


def conditional_smc(model: StateModel, ys: Sequence, path: np.ndarray, n: int = 100, seed: int = 0) -> np.ndarray:
    """One conditional SMC sweep with backward sampling: a new path given an old one."""
    rng = np.random.default_rng(seed)
    xs, ws = [], []
    for t, y in enumerate(ys):
        if t == 0:
            x = model.start(rng, n)
        else:
            a = rng.choice(n, n, p=normalise(ws[-1]))
            x = model.move(rng, t, xs[-1][a])
        x[0] = path[t]
        xs.append(x)
        ws.append(model.log_obs(t, x, y))
    out = np.zeros(len(ys))
    out[-1] = rng.choice(xs[-1], p=normalise(ws[-1]))
    for t in range(len(ys) - 2, -1, -1):
        out[t] = rng.choice(xs[t], p=normalise(ws[t] + model.log_move(t + 1, xs[t], out[t + 1])))
    return out


def particle_gibbs(make: Callable, draw_theta: Callable, ys: Sequence, theta0, sweeps: int = 100, n: int = 100, seed: int = 0) -> list:
    """Alternate parameters given the path and a conditional SMC path given parameters."""
    rng, theta = np.random.default_rng(seed), theta0
    path, out = particle_filter(make(theta), ys, n, seed=seed).mean[:, 0], []
    for i in range(sweeps):
        path = conditional_smc(make(theta), ys, path, n, seed + i + 1)
        theta = draw_theta(rng, path)
        out.append(theta)
    return out


def _move(x: np.ndarray, w: np.ndarray, log_target: Callable, rng: np.random.Generator, rounds: int, waste_free: bool = False) -> np.ndarray:
    """Resample and move by random-walk Metropolis with the cloud's own covariance."""
    n, d = x.shape
    m = w @ x
    low = np.linalg.cholesky(2.38**2 / d * ((x - m).T * w) @ (x - m) + 1e-10 * np.eye(d))
    x = x[resample(w, n // (rounds + 1) if waste_free else n, rng)]
    lp, kept = log_target(x), [x]
    for _ in range(rounds):
        new = x + rng.standard_normal(x.shape) @ low.T
        ln = log_target(new)
        hit = np.log(rng.random(len(x))) < ln - lp
        x, lp = np.where(hit[:, None], new, x), np.where(hit, ln, lp)
        kept.append(x)
    return np.vstack(kept) if waste_free else x


def tempering(log_prior: Callable, log_lik: Callable, prior: Callable, n: int = 1000, rounds: int = 5, schedule: Sequence[float] | None = None, target: float = 0.5, seed: int = 0, waste_free: bool = False) -> tuple[np.ndarray, float]:
    """SMC from prior to posterior along fixed exponents, or ones chosen to keep ESS at ``target``; also the log evidence."""
    rng = np.random.default_rng(seed)
    x, beta, evidence, k = prior(rng, n), 0.0, 0.0, 0
    while beta < 1:
        ll = log_lik(x)
        if schedule is not None:
            new = schedule[k]
            k += 1
        else:
            lo, hi = beta, 1.0
            if ess(normalise((1 - beta) * ll)) < target * len(x):
                for _ in range(60):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if ess(normalise((mid - beta) * ll)) > target * len(x) else (lo, mid)
            new = hi
        inc = (new - beta) * ll
        evidence += log_sum_exp(inc) - math.log(len(x))
        beta = new
        x = _move(x, normalise(inc), lambda v, b=beta: log_prior(v) + b * log_lik(v), rng, rounds, waste_free)
    return x, evidence


def ibis(log_prior: Callable, log_obs: Callable, prior: Callable, ys: Sequence, n: int = 1000, rounds: int = 5, essr_min: float = 0.5, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Data one at a time into a cloud of parameters: particles, weights, log evidence."""
    rng = np.random.default_rng(seed)
    x, logw, evidence = prior(rng, n), np.full(n, -math.log(n)), 0.0
    for t in range(len(ys)):
        step = log_obs(x, ys[: t + 1], t)
        evidence += log_sum_exp(logw + step)
        w = normalise(logw + step)
        logw = np.log(np.maximum(w, 1e-300))
        if ess(w) < essr_min * n:
            x = _move(x, w, lambda v, t=t: log_prior(v) + sum(log_obs(v, ys[: s + 1], s) for s in range(t + 1)), rng, rounds)
            logw = np.full(n, -math.log(n))
    return x, normalise(logw), evidence


def smc2(make: Callable, log_prior: Callable, prior: Callable, ys: Sequence, n_theta: int = 50, n: int = 100, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """A cloud of parameters, each with a particle filter's likelihood of the data so far; moved by PMMH when degenerate."""
    rng = np.random.default_rng(seed)
    theta = prior(rng, n_theta)
    logw, evidence = np.full(n_theta, -math.log(n_theta)), 0.0
    ll = np.array([particle_filter(make(th), ys, n, seed=seed + i).loglik for i, th in enumerate(theta)])
    for t in range(len(ys)):
        evidence += log_sum_exp(logw + ll[:, t])
        w = normalise(logw + ll[:, t])
        logw = np.log(np.maximum(w, 1e-300))
        if ess(w) < 0.5 * n_theta:
            m = w @ theta
            low = np.linalg.cholesky(((theta - m).T * w) @ (theta - m) + 1e-8 * np.eye(theta.shape[1]))
            idx = resample(w, n_theta, rng)
            theta, ll = theta[idx], ll[idx]
            for i in range(n_theta):
                new = theta[i] + low @ rng.standard_normal(theta.shape[1])
                if math.isfinite(log_prior(new)):
                    ln = particle_filter(make(new), ys, n, seed=seed + 1000 * (t + 1) + i).loglik
                    if math.log(rng.random()) < log_prior(new) - log_prior(theta[i]) + ln[: t + 1].sum() - ll[i, : t + 1].sum():
                        theta[i], ll[i] = new, ln
            logw = np.full(n_theta, -math.log(n_theta))
    return theta, normalise(logw), evidence


def nested_sampling(log_lik: Callable, prior: Callable, log_prior: Callable, live: int = 200, steps: int = 20, tol: float = 1e-3, seed: int = 0) -> tuple[float, np.ndarray]:
    """Log evidence and the discarded points, by random walks above the rising likelihood bound."""
    rng = np.random.default_rng(seed)
    x = prior(rng, live)
    ll, z, logx, dead = log_lik(x), -math.inf, 0.0, []
    for i in range(100 * live):
        k = int(ll.argmin())
        nxt = -(i + 1) / live
        logw = ll[k] + logx + math.log1p(-math.exp(nxt - logx))
        z = np.logaddexp(z, logw)
        dead.append(np.r_[x[k], ll[k], logw])
        bound, j = ll[k], int(rng.integers(live))
        cur, sd = x[j].copy(), x.std(axis=0)
        for _ in range(steps):
            new = cur + sd * rng.standard_normal(len(cur)) * 0.5
            if log_lik(new[None])[0] > bound and math.log(rng.random()) < log_prior(new[None])[0] - log_prior(cur[None])[0]:
                cur = new
        x[k], ll[k], logx = cur, log_lik(cur[None])[0], nxt
        if ll.max() + logx < z + math.log(tol):
            break
    return float(np.logaddexp(z, log_sum_exp(ll) - math.log(live) + logx)), np.array(dead)


def mcmc_variance(chain: np.ndarray, method: str = "initial_sequence") -> float:
    """Asymptotic variance of a chain's mean, by positive pairs of autocovariances or a Tukey-Hanning window."""
    x, n = chain - chain.mean(), len(chain)
    f = np.fft.rfft(x, 2 * n)
    c = np.fft.irfft(f * np.conj(f))[:n] / n
    if method == "initial_sequence":
        g = c[0 : n - n % 2 : 2] + c[1 : n - n % 2 + 1 : 2][: len(c[0 : n - n % 2 : 2])]
        stop = int(np.argmax(g < 0)) if (g < 0).any() else len(g)
        return float(-c[0] + 2 * g[:stop].sum())
    m = int(n**0.5)
    k = np.arange(1, m)
    return float(c[0] + ((1 + np.cos(math.pi * k / m)) * c[k]).sum())


# --- quasi-random points ---


def radical_inverse(i: np.ndarray, base: int) -> np.ndarray:
    i, out, f = np.asarray(i).copy(), np.zeros(len(i)), 1.0 / base
    while i.any():
        out, i, f = out + f * (i % base), i // base, f / base
    return out


PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47)


def halton(n: int, d: int, seed: int | None = None) -> np.ndarray:
    u = np.column_stack([radical_inverse(np.arange(1, n + 1), PRIMES[k]) for k in range(d)])
    return u if seed is None else (u + np.random.default_rng(seed).random(d)) % 1.0


#: Sobol' direction numbers of Joe and Kuo for dimensions 2 to 8 (fixed values): degree, polynomial, initial numbers.
JOE_KUO = ((1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17)))


def sobol(n: int, d: int, seed: int | None = None) -> np.ndarray:
    """Sobol' points for up to 8 dimensions, from 0 on; a seed shifts them digitally."""
    bits = 32
    out = np.zeros((n, d))
    for k in range(d):
        if k == 0:
            v = [1 << (bits - 1 - i) for i in range(bits)]
        else:
            s, a, m = JOE_KUO[k - 1]
            v = [m[i] << (bits - 1 - i) for i in range(s)]
            for i in range(s, bits):
                x = v[i - s] ^ (v[i - s] >> s)
                for j in range(1, s):
                    x ^= ((a >> (s - 1 - j)) & 1) * v[i - j]
                v.append(x)
        x = 0 if seed is None else int(np.random.default_rng(seed + k).integers(1 << bits))
        for i in range(n):
            if i:
                x ^= v[((i - 1) ^ i).bit_length() - 1 if False else (i & -i).bit_length() - 1]
            out[i, k] = x / 2**bits
    return out


def latin_hypercube(n: int, d: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.column_stack([(rng.permutation(n) + rng.random(n)) / n for _ in range(d)])


def hilbert_order(points: np.ndarray, bits: int = 10) -> np.ndarray:
    """Order of points along a Hilbert curve (Skilling's transform)."""
    x = points - points.min(axis=0)
    top = x.max(axis=0)
    q = np.minimum((x / np.where(top > 0, top, 1) * (1 << bits)).astype(np.int64), (1 << bits) - 1)
    n, d = q.shape
    keys = []
    for row in q.tolist():
        m = 1 << (bits - 1)
        while m > 1:
            p = m - 1
            for i in range(d):
                if row[i] & m:
                    row[0] ^= p
                else:
                    t = (row[0] ^ row[i]) & p
                    row[0] ^= t
                    row[i] ^= t
            m >>= 1
        for i in range(1, d):
            row[i] ^= row[i - 1]
        t, m = 0, 1 << (bits - 1)
        while m > 1:
            if row[d - 1] & m:
                t ^= m - 1
            m >>= 1
        row = [v ^ t for v in row]
        keys.append(sum(((row[i] >> b) & 1) << (b * d + d - 1 - i) for b in range(bits) for i in range(d)))
    return np.argsort(keys, kind="stable")


def filter_series(df: DataFrame, y: str, make: Callable[[], StateModel], by: Sequence[str] = (), order: Sequence[str] = ("t",), n: int = 500, seed: int = 0, **how) -> DataFrame:
    """Particle filter of each series: ``by...``, order columns, mean, variance, ess, loglik."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = particle_filter(make(), pdf[y].to_numpy(float), n, seed=seed, **how)
        return pd.DataFrame({**{c: pdf[c].to_numpy() for c in order}, "mean": r.mean[:, 0], "variance": r.variance[:, 0], "ess": r.ess, "loglik": r.loglik})

    return per_group(df, by, order, run, f"{kinds}, mean double, variance double, ess double, loglik double", [y])


# --- more models, variance estimates and online smoothing ---


def leveraged_volatility(mu: float = -1.0, rho: float = 0.95, sigma: float = 0.3, phi: float = -0.5) -> Callable[[Sequence[float]], StateModel]:
    """Stochastic volatility whose next shock goes with the last return; made for a series, whose returns drive it."""
    norm = lambda r, s: -0.5 * (r / s) ** 2 - np.log(s) - 0.5 * math.log(2 * math.pi)

    def make(ys: Sequence[float]) -> StateModel:
        mean = lambda t, x: mu + rho * (x - mu) + sigma * phi * ys[t - 1] * np.exp(-x / 2)
        sd = sigma * math.sqrt(1 - phi * phi)
        return StateModel(lambda rng, n: mu + sigma / math.sqrt(1 - rho * rho) * rng.standard_normal(n), lambda rng, t, x: mean(t, x) + sd * rng.standard_normal(len(x)), lambda t, x, y: norm(y, np.exp(x / 2)), lambda t, p, x: norm(x - mean(t, p), sd))

    return make


def multivariate_volatility(mu: np.ndarray, rho: np.ndarray, cov: np.ndarray, corr: np.ndarray) -> StateModel:
    """Log volatilities in d dimensions with correlated shocks; observations are normal with correlation ``corr``."""
    mu, rho, d = np.asarray(mu, float), np.asarray(rho, float), len(mu)
    low = np.linalg.cholesky(cov)
    start = np.linalg.cholesky(cov / (1 - np.outer(rho, rho)))
    inv, logdet = np.linalg.inv(corr), np.linalg.slogdet(corr)[1]

    def log_obs(t, x, y):
        z = np.asarray(y) * np.exp(-x / 2)
        return -0.5 * (np.einsum("ni,ij,nj->n", z, inv, z) + x.sum(axis=1) + logdet + d * math.log(2 * math.pi))

    return StateModel(lambda rng, n: mu + rng.standard_normal((n, d)) @ start.T, lambda rng, t, x: mu + rho * (x - mu) + rng.standard_normal(x.shape) @ low.T, log_obs)


def genealogy_variance(run: Run, f: Callable = lambda x: x) -> float:
    """Variance of a filter's estimate from how many final particles share a first ancestor (needs full history)."""
    first = np.arange(len(run.history[0][0]))
    for _, _, ancestors in run.history[1:]:
        first = first[ancestors]
    v = f(run.x)
    r = run.w * (v - run.w @ v)
    return float((np.bincount(first, weights=r, minlength=len(v)) ** 2).sum())


def online_smoothed_sum(model: StateModel, ys: Sequence, f: Callable, n: int = 300, method: str = "paths", seed: int = 0) -> np.ndarray:
    """After each observation the smoothed expectation of the sum of f(t, x_prev, x): along surviving paths, or ``exact`` over all
    pairs of particles (n squared)."""
    run = particle_filter(model, ys, n, seed=seed, keep=None)
    tau, out = np.zeros(n), [0.0]
    for t in range(1, len(ys)):
        (xp, wp, _), (x, lw, ancestors) = run.history[t - 1], run.history[t]
        if method == "paths":
            tau = tau[ancestors] + f(t, xp[ancestors], x)
        else:
            k = wp[None, :] + model.log_move(t, xp[None, :], x[:, None])
            p = np.exp(k - k.max(axis=1, keepdims=True))
            tau = ((p / p.sum(axis=1, keepdims=True)) * (tau[None, :] + f(t, xp[None, :], x[:, None]))).sum(axis=1)
        out.append(float(normalise(lw) @ tau))
    return np.array(out)
