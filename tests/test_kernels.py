"""Numerical kernels: identities, closed forms and brute force."""

import math

import numpy as np
import pytest

from quillon.operators import correlation as C
from quillon.operators import decomposition as M
from quillon.operators import fourier, ode, particle, quadrature, sarimax, statespace, stl
from quillon.operators import hypothesis as H
from quillon.operators import optimise as O
from quillon.operators import regression as G

RNG = np.random.default_rng(42)


def test_quadrature():
    assert quadrature.adaptive(math.exp, 0, 1).value == pytest.approx(math.e - 1, rel=1e-12)
    assert quadrature.lobatto(math.exp, 0, 1).value == pytest.approx(math.e - 1, rel=1e-9)
    assert quadrature.double_exponential(lambda x: 1 / math.sqrt(x), 0, 1).value == pytest.approx(2, rel=1e-7)
    assert quadrature.double_exponential(lambda x: math.exp(-x), 0, math.inf).value == pytest.approx(1, rel=1e-9)
    assert quadrature.double_exponential(lambda x: math.exp(-x * x), -math.inf, math.inf).value == pytest.approx(math.sqrt(math.pi), rel=1e-9)
    assert quadrature.improper(lambda x: 1 / (1 + x * x), "whole_line").value == pytest.approx(math.pi, rel=1e-8)
    assert quadrature.oscillatory(lambda x: 1 / (1 + x * x), 0.0, 1.0).value == pytest.approx(math.pi / 2 * math.exp(-1), rel=1e-6)
    assert quadrature.filon(lambda x: x * x, 0, 1, 50.0) == pytest.approx(math.sin(50) / 50 + 2 * math.cos(50) / 2500 - 2 * math.sin(50) / 125000, rel=1e-8)
    assert quadrature.principal_value(lambda x: 1.0, -1, 2, 0.5).value == pytest.approx(0, abs=1e-10)
    assert quadrature.endpoint_singular(lambda x: 1.0, 0, 1, "algebraic", -0.5, -0.5) == pytest.approx(math.pi)
    assert quadrature.endpoint_singular(lambda x: 1.0, 0, 1, "log_left") == pytest.approx(-1, rel=1e-8)
    x = np.linspace(0, 1, 17)
    assert quadrature.romberg_samples(np.exp(x), 1 / 16) == pytest.approx(math.e - 1, rel=1e-12)


@pytest.mark.parametrize(("kind", "a", "b", "f", "want"), [("legendre", 0, 0, lambda x: x**4, 2 / 5), ("laguerre", 0.5, 0, lambda x: x, math.gamma(2.5)), ("hermite", 0, 0, lambda x: x**4, 0.75 * math.sqrt(math.pi)), ("hermite", 1, 0, lambda x: np.ones_like(x), math.sqrt(math.pi) / 2), ("jacobi", 0.5, -0.5, lambda x: np.ones_like(x), math.pi)])
def test_gauss_rules(kind, a, b, f, want):
    x, w = quadrature.gauss_rule(kind, 12, a, b)
    assert (w * f(x)).sum() == pytest.approx(want, rel=1e-10)


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_cosine_and_sine_transforms_invert(kind):
    x = RNG.standard_normal(13)
    assert np.allclose(fourier.idct(fourier.dct(x, kind), kind), x) and np.allclose(fourier.idst(fourier.dst(x, kind), kind), x)
    assert np.allclose(fourier.hartley(fourier.hartley(x)) / 13, x)


def test_decompositions():
    a = RNG.standard_normal((5, 5))
    s = a @ a.T + 5 * np.eye(5)
    low, up, p = M.lu(a)
    assert np.allclose(low @ up, a[p])
    low, d = M.ldl(s)
    assert np.allclose(low * d @ low.T, s)
    q, r, p = M.qr_pivoted(a)
    assert np.allclose(q @ r, a[:, p]) and (np.abs(np.diag(r))[:-1] >= np.abs(np.diag(r))[1:] - 1e-12).all()
    t, z = M.schur(a)
    assert np.allclose(z @ t @ z.conj().T, a) and np.allclose(np.tril(t, -1), 0)
    x = M.lyapunov(a - 5 * np.eye(5), s)
    assert np.allclose((a - 5 * np.eye(5)) @ x + x @ (a - 5 * np.eye(5)).T, -s)
    b = a / (np.abs(np.linalg.eigvals(a)).max() * 1.2)
    x = M.discrete_lyapunov(b, s)
    assert np.allclose(x, b @ x @ b.T + s)
    w, v = M.generalised_eigen(a + a.T, s)
    assert np.allclose((a + a.T) @ v, s @ v * w)
    al, be, v = M.generalised_pencil(a, s)
    assert np.allclose(a @ v * be, s @ v * al)
    g = M.gsvd(a, s)
    assert np.allclose(g["u"] * g["alpha"] @ g["x"].T, a) and np.allclose(g["v"] * g["beta"] @ g["x"].T, s)
    basis = M.stable_subspace(a, "lhp")
    assert np.allclose(basis @ (basis.T @ a @ basis), a @ basis)


def dense_loglik(m, y):
    n, p = y.shape
    k = len(m.transition)
    cov = np.zeros((n * k, n * k))
    v = [m.cov]
    for _ in range(n - 1):
        v.append(m.transition @ v[-1] @ m.transition.T + m.selection @ m.state_cov @ m.selection.T)
    for i in range(n):
        block = v[i]
        for j in range(i, n):
            cov[j * k : (j + 1) * k, i * k : (i + 1) * k], cov[i * k : (i + 1) * k, j * k : (j + 1) * k] = block, block.T
            block = m.transition @ block
    z = np.kron(np.eye(n), m.design)
    c = z @ cov @ z.T + np.kron(np.eye(n), m.obs_cov)
    f = y.ravel()
    ok = ~np.isnan(f)
    c, f = c[np.ix_(ok, ok)], f[ok]
    smooth = cov @ z.T[:, ok] @ np.linalg.solve(c, f)
    return -0.5 * (len(f) * math.log(2 * math.pi) + np.linalg.slogdet(c)[1] + f @ np.linalg.solve(c, f)), smooth.reshape(n, k)


def test_kalman_against_dense_normal():
    m = statespace.Model(np.array([[1.0, 0.2], [0.3, 1.0]]), np.array([[0.5, 0.1], [0.1, 0.4]]), np.array([[0.7, 0.2], [0.0, 0.5]]), np.eye(2), np.array([[1.0, 0.3], [0.3, 0.8]]))
    _, y = statespace.simulate(m, 12, np.random.default_rng(0))
    y[3, 0] = y[5] = np.nan
    want, states = dense_loglik(m, y)
    for method in ("univariate", "conventional"):
        assert statespace.kalman_filter(m, y, method).total == pytest.approx(want)
    assert np.allclose(statespace.kalman_smooth(m, y)[0], states)
    w = statespace.smoothed_weights(m, y)
    assert np.allclose(np.einsum("tksc,sc->tk", w, np.nan_to_num(y)), states)
    draws = np.mean([statespace.simulation_smoother(m, y, np.random.default_rng(i)) for i in range(300)], axis=0)
    assert np.abs(draws - states).max() < 0.35


def test_exact_diffuse_is_the_limit():
    y = np.cumsum(RNG.standard_normal(30)) + RNG.standard_normal(30)
    exact = statespace.kalman_filter(statespace.local_level(1.0, 1.0), y)
    big = statespace.kalman_filter(statespace.local_level(1.0, 1.0, False, 0.0, 1e9), y)
    assert np.allclose(exact.filtered, big.filtered, atol=1e-5) and exact.total == pytest.approx(big.total + 0.5 * math.log(1e9), abs=1e-5)


def test_arma_likelihood_and_fit():
    rng = np.random.default_rng(3)
    e = rng.standard_normal(400)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.6 * y[t - 1] + e[t] + 0.3 * e[t - 1]
    f = sarimax.fit(y, sarimax.Spec((1, 0, 1)))
    assert f.params[0] == pytest.approx(0.6, abs=0.15) and f.params[1] == pytest.approx(0.3, abs=0.2) and f.params[2] == pytest.approx(1.0, abs=0.2)
    best = f.loglik
    for p in ([0.5, 0.3, 1.0], [0.7, 0.2, 1.1]):
        assert sarimax.evaluate(sarimax.Spec((1, 0, 1)), np.array(p), y, None, []).loglik <= best + 1e-6
    out = f.forecast(5)
    assert (np.diff(out["se"]) >= -1e-9).all()
    assert set(sarimax.diagnostics(f)) == {"jb", "jb_p", "het", "het_p", "lb", "lb_p"}


def test_differenced_and_seasonal_forms():
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.standard_normal(120)) + 3 * np.sin(np.arange(120) * 2 * np.pi / 4)
    f = sarimax.fit(y, sarimax.Spec((1, 1, 0), (0, 1, 1, 4)), covariance=False)
    assert math.isfinite(f.loglik) and len(f.forecast(8)) == 8
    plain = sarimax.evaluate(sarimax.Spec((1, 0, 0)), np.array([0.4, 1.3]), np.diff(y), None, [])
    with_states = sarimax.evaluate(sarimax.Spec((1, 1, 0)), np.array([0.4, 1.3]), y, None, [])
    assert with_states.loglik == pytest.approx(plain.loglik - 0.5 * math.log(2 * math.pi), abs=1e-6)


def test_constraint_round_trip():
    u = np.array([0.4, -1.2, 0.7])
    phi = sarimax.constrain(u)
    assert (np.abs(np.roots(np.r_[1, -phi])) < 1).all() and np.allclose(sarimax.unconstrain(phi), u)


def test_var_and_irf():
    rng = np.random.default_rng(8)
    a = np.array([[0.5, 0.1], [0.0, 0.4]])
    y = np.zeros((300, 2))
    for t in range(1, 300):
        y[t] = a @ y[t - 1] + rng.standard_normal(2)
    c, ahat, s = sarimax.var_least_squares(y, 1)
    assert np.abs(ahat[0] - a).max() < 0.15
    irf = statespace.impulse_response(sarimax.varma_model(c, ahat, np.zeros((0, 2, 2)), s), 3)
    assert np.allclose(irf[2], ahat[0] @ ahat[0])
    m, ll, _ = sarimax.varmax_fit(y[:120], 1, 0)
    assert math.isfinite(ll) and np.abs(m.transition[:2, :2] - a).max() < 0.3


def test_stl():
    t = np.arange(120)
    y = 0.1 * t + 5 * np.sin(2 * np.pi * t / 12) + 0.1 * RNG.standard_normal(120)
    f = stl.stl_fit(y, 12)
    assert np.allclose(f["trend"] + f["seasonal"] + f["resid"], y) and np.abs(f["resid"]).max() < 0.6 and np.abs(f["trend"] - 0.1 * t).max() < 0.6
    y[40] += 50
    r = stl.stl_fit(y, 12, robust=True)
    assert r["weight"][40] < 0.01 and abs(r["resid"][40]) > 40
    m = stl.mstl_fit(y, [12, 5])
    assert np.allclose(m["trend"] + sum(m["seasonal"].values()) + m["resid"], y)


def test_particle_filters_against_kalman():
    k = statespace.Model(np.eye(1), np.eye(1) * 0.04, np.eye(1) * 0.9, np.eye(1), np.eye(1))
    _, y = statespace.simulate(k, 40, np.random.default_rng(1))
    y = y[:, 0]
    exact, smooth = statespace.kalman_filter(k, y), statespace.kalman_smooth(k, y)[0][:, 0]
    model = particle.linear_gauss()
    for weighting, n in (("bootstrap", 4000), ("guided", 1000), ("auxiliary", 2000)):
        r = particle.particle_filter(model, y, n, weighting, keep=None)
        assert r.total == pytest.approx(exact.total, abs=1.5) and np.abs(r.mean[:, 0] - exact.filtered[:, 0]).max() < 0.15
    paths = particle.ffbs(model, particle.particle_filter(model, y, 800, "guided", keep=None), 400)
    assert np.abs(paths.mean(axis=0) - smooth).max() < 0.15
    assert np.abs(particle.fixed_lag_means(model, y, 3, 3000) - smooth).max() < 0.3
    assert np.abs(particle.two_filter_means(model, y, 800) - smooth).max() < 0.3
    assert particle.paris_sum(model, y, lambda t, a, b: b, 400) == pytest.approx(smooth[1:].sum(), abs=1.5)


@pytest.mark.parametrize("scheme", ["systematic", "stratified", "multinomial", "residual", "ssp", "killing"])
def test_resampling_is_unbiased(scheme):
    rng = np.random.default_rng(2)
    w = np.array([0.5, 0.25, 0.15, 0.07, 0.03])
    counts = np.mean([np.bincount(particle.resample(w, 5, rng, scheme), minlength=5) for _ in range(4000)], axis=0)
    assert np.abs(counts - 5 * w).max() < 0.08


def test_samplers():
    prior = lambda rng, n: rng.standard_normal((n, 1)) * 3
    log_prior = lambda x: -0.5 * (np.atleast_2d(x)[:, 0] / 3) ** 2 - math.log(3) - 0.5 * math.log(2 * math.pi)
    log_lik = lambda x: -0.5 * (np.atleast_2d(x)[:, 0] - 2) ** 2 - 0.5 * math.log(2 * math.pi)
    want = -0.5 * 4 / 10 - 0.5 * math.log(2 * math.pi * 10)
    x, z = particle.tempering(log_prior, log_lik, prior, 2000)
    assert z == pytest.approx(want, abs=0.15) and x.mean() == pytest.approx(1.8, abs=0.15)
    assert particle.nested_sampling(log_lik, prior, log_prior, 150)[0] == pytest.approx(want, abs=0.4)
    chain, rate = particle.random_walk(lambda v: float(log_prior(v[None])[0] + log_lik(v[None])[0]), np.zeros(1), 4000, 1.0)
    assert chain[500:].mean() == pytest.approx(1.8, abs=0.2) and 0.1 < rate < 0.9 and particle.mcmc_variance(chain[:, 0]) > 0


def test_quasi_random_points():
    s = particle.sobol(256, 5)
    assert all(sorted((s[:, k] * 256).astype(int)) == list(range(256)) for k in range(5))
    assert np.allclose(particle.halton(3, 2)[:, 0], [0.5, 0.25, 0.75])
    h = particle.latin_hypercube(50, 3)
    assert all(sorted((h[:, k] * 50).astype(int)) == list(range(50)) for k in range(3))
    grid = np.array([[i, j] for i in range(8) for j in range(8)], float)
    path = grid[particle.hilbert_order(grid, 3)]
    assert np.abs(np.diff(path, axis=0)).sum(axis=1).max() == 1


def test_minimisers():
    rosen = lambda x: 100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2
    assert np.allclose(O.lbfgsb(rosen, [-1.2, 1.0], ftol=1e-14).x, 1, atol=1e-3)
    assert np.allclose(O.lbfgsb(rosen, [-1.2, 1.0], bounds=[(None, 0.5), (None, None)]).x, [0.5, 0.25], atol=1e-3)
    assert np.allclose(O.nelder_mead(rosen, [-1.2, 1.0]).x, 1, atol=1e-3) and np.allclose(O.subplex(rosen, [-1.2, 1.0]).x, 1, atol=1e-2)
    assert np.allclose(O.cmaes(rosen, [-1.2, 1.0]).x, 1, atol=1e-3) and np.allclose(O.cmaes(rosen, [-1.2, 1.0], separable=True, iterations=3000).x, 1, atol=0.2)
    r = O.slsqp(lambda x: (x[0] - 1) ** 2 + (x[1] - 2.5) ** 2, [2.0, 0.0], inequalities=[lambda x: x[0] - 2 * x[1] + 2, lambda x: -x[0] - 2 * x[1] + 6, lambda x: -x[0] + 2 * x[1] + 2], bounds=[(0, None), (0, None)])
    assert np.allclose(r.x, [1.4, 1.7], atol=1e-3)
    r = O.slsqp(lambda x: x @ x, [1.0, 1.0], equalities=[lambda x: x[0] + x[1] - 1])
    assert np.allclose(r.x, 0.5, atol=1e-4)
    a, b = RNG.standard_normal((20, 4)), RNG.standard_normal(20)
    x = O.nnls(a, b)
    g = a.T @ (a @ x - b)
    assert (x >= 0).all() and (g >= -1e-8).all() and abs(g @ x) < 1e-8


def test_least_squares_losses():
    t = np.linspace(0, 3, 40)
    y = 2 * np.exp(-1.3 * t)
    y[5] += 3
    f = lambda p: p[0] * np.exp(-p[1] * t) - y
    for loss in ("soft_l1", "huber", "cauchy", "arctan"):
        assert np.allclose(O.least_squares(f, [1.0, 1.0], loss=loss, scale=0.05).x, [2, 1.3], atol=0.06)
    assert O.least_squares(f, [1.0, 1.0], bounds=[(0, 1.5), (None, None)]).x[0] <= 1.5


def test_roots_and_derivatives():
    assert O.brentq(lambda x: math.cos(x) - x, 0, 1).x[0] == pytest.approx(0.7390851332151607)
    f = lambda x: np.array([x[0] ** 2 + x[1] ** 2 - 4, x[0] - x[1]])
    assert np.allclose(np.abs(O.hybrid(f, [1.0, 0.5]).x), math.sqrt(2)) and np.allclose(np.abs(O.broyden(f, [1.0, 0.5]).x), math.sqrt(2))
    assert O.newton(lambda x: x * x - 2, lambda x: 2 * x, 1.0).x[0] == pytest.approx(math.sqrt(2)) and O.halley(lambda x: x * x - 2, lambda x: 2 * x, lambda x: 2.0, 1.0).x[0] == pytest.approx(math.sqrt(2))
    g = lambda x: math.exp(x[0]) * x[1] ** 3
    x = np.array([0.3, 1.2])
    want = [g(x), 3 * math.exp(0.3) * 1.44]
    for scheme, tol in (("forward", 1e-6), ("backward", 1e-6), ("central", 1e-8), ("five_point", 1e-9)):
        assert np.allclose(O.gradient(g, x, scheme), want, rtol=tol)
    assert np.allclose(O.hessian(g, x), [[g(x), want[1]], [want[1], 6 * math.exp(0.3) * 1.2]], rtol=1e-5)


@pytest.mark.parametrize("method", ["rk23", "rk45", "dop853", "radau", "bdf"])
def test_ode(method):
    tr = ode.solve(lambda t, y: [y[1], -y[0]], 0, 5, [1.0, 0.0], method, rtol=1e-6, atol=1e-8)
    assert tr.status == "success" and np.allclose(tr.y[-1], [math.cos(5), -math.sin(5)], atol=5e-4)
    assert np.allclose(tr.at([1.0, 2.0])[:, 0], np.cos([1.0, 2.0]), atol=2e-3)


def test_stiff_and_events():
    tr = ode.solve(lambda t, y: [-1000 * (y[0] - math.cos(t))], 0, 1, [0.0], "radau", rtol=1e-5)
    assert tr.y[-1, 0] == pytest.approx(math.cos(1), abs=2e-3) and len(tr.t) < 500
    fall = ode.solve(lambda t, y: [y[1], -9.81], 0, 10, [10.0, 0.0], "rk45", rtol=1e-8, events=[ode.Event(lambda t, y: y[0], "falling", 1)])
    assert fall.status == "event" and fall.t[-1] == pytest.approx(math.sqrt(20 / 9.81), rel=1e-6)


def test_serial_dependence():
    x = np.cumsum(RNG.standard_normal(200)) * 0.1 + RNG.standard_normal(200)
    a = C.acov(x, 5)
    assert a[3] == pytest.approx(((x - x.mean())[3:] * (x - x.mean())[:-3]).sum() / 200)
    phi, s, pacf = C.levinson_durbin(a, 3)
    toeplitz = np.array([[a[abs(i - j)] for j in range(3)] for i in range(3)])
    assert np.allclose(toeplitz @ phi, a[1:4]) and np.allclose(C.from_pacf(pacf[1:]), phi)
    base = C.pacf_values(x, 4)
    for method in ("yw_mle", "burg", "ols", "ols_inefficient"):
        assert np.abs(C.pacf_values(x, 4, method) - base).max() < 0.1
    assert C.kendall_tau(np.array([1, 2, 3, 4.0]), np.array([1, 3, 2, 4.0]))[1] == pytest.approx(4 / 6)
    assert C.inversions(np.array([3, 1, 2])) == 2


def test_unit_root_tests():
    rng = np.random.default_rng(9)
    noise, walk = rng.standard_normal(300), np.cumsum(rng.standard_normal(300))
    assert H.adf_test(noise)["p_value"] < 0.01 and H.adf_test(walk)["p_value"] > 0.05
    assert H.kpss_test(noise + 0.02 * np.arange(300))["p_value"] == pytest.approx(0.01) and H.kpss_test(noise)["p_value"] == 0.1
    assert H.kpss_test(noise + 0.02 * np.arange(300), "ct")["p_value"] == 0.1
    assert H.mackinnon_critical("c", 1e9)[1] == pytest.approx(-2.86154, abs=1e-4) and H.mackinnon_p(-2.86154, "c") == pytest.approx(0.05, abs=2e-3)


def test_fit_from_statistics():
    x = RNG.standard_normal((60, 2))
    y = 1 + x @ [2.0, -1.0] + 0.1 * RNG.standard_normal(60)
    full = np.column_stack([y, x])
    z = full - full.mean(axis=0)
    c = (z.T @ z)[np.triu_indices(3)]
    fit = G.Fit(60, 60.0, full.mean(axis=0), c)
    beta, ssr, rank, inv = G.lstsq(y, np.column_stack([np.ones(60), x]))
    assert np.allclose(fit.coef, beta) and fit.ssr == pytest.approx(ssr) and fit.rank == rank == 3 and np.allclose(fit.cov0, inv)
    flat = G.Fit(60, 60.0, full.mean(axis=0), c, const=False)
    assert np.allclose(flat.coef, G.lstsq(y, x)[0])


def test_missing_values_in_autocovariances():
    x = np.array([1.0, 2.0, np.nan, 4.0, 3.0])
    seen = x[~np.isnan(x)]
    assert np.isnan(C.autocovariance_values(x, 1)).all()
    assert C.autocovariance_values(x, 1, missing="drop")[0] == pytest.approx(seen.var())
    z = np.array([-1.5, -0.5, 0, 1.5, 0.5])
    assert C.autocovariance_values(x, 1, True, "conservative")[1] == pytest.approx((z[1:] * z[:-1]).sum() / 2)
    with pytest.raises(ValueError, match="missing"):
        C.autocovariance_values(x, 1, missing="raise")


def test_exact_kendall():
    from itertools import permutations

    inv = [C.inversions(np.array(p)) for p in permutations(range(5))]
    assert C.kendall_exact_p(5, 2) == pytest.approx(2 * sum(i <= 2 for i in inv) / 120)


def test_more_particle_tools():
    k = statespace.Model(np.eye(1), np.eye(1) * 0.04, np.eye(1) * 0.9, np.eye(1), np.eye(1))
    _, y = statespace.simulate(k, 25, np.random.default_rng(4))
    y, smooth = y[:, 0], statespace.kalman_smooth(k, y)[0][:, 0]
    m = particle.linear_gauss()
    for method in ("paths", "exact"):
        assert particle.online_smoothed_sum(m, y, lambda t, a, b: b + 0 * a, 600, method)[-1] == pytest.approx(smooth[1:].sum(), abs=1.5)
    runs = [particle.particle_filter(m, y, 300, seed=s, keep=None) for s in range(30)]
    spread = np.var([r.mean[-1, 0] for r in runs])
    assert 0.2 < np.mean([particle.genealogy_variance(r) for r in runs]) / spread < 5
    r = RNG.standard_normal(30) * 0.6
    assert math.isfinite(particle.particle_filter(particle.leveraged_volatility()(r), r, 200).total)
    mv = particle.multivariate_volatility(np.zeros(2), np.full(2, 0.9), np.eye(2) * 0.1, np.array([[1, 0.3], [0.3, 1]]))
    assert math.isfinite(particle.particle_filter(mv, list(RNG.standard_normal((20, 2))), 200).total)


@pytest.mark.parametrize("method", ["rk23", "rk45", "radau"])
def test_many_problems_at_once(method):
    r = np.arange(40) % 5 + 1.0
    y, ok = ode.solve_many(lambda t, y, w: r[w][:, None] * y * (1 - y), 0.0, 2.0, np.full((40, 1), 0.1), [0.0, 0.5, 2.0], method, 1e-7, 1e-9)
    assert ok.all() and np.abs(y[:, :, 0] - 1 / (1 + 9 * np.exp(-r[:, None] * np.array([0.0, 0.5, 2.0])))).max() < 1e-6
    back, _ = ode.solve_many(lambda t, y, w: np.stack([y[:, 1], -y[:, 0]], 1), 0.0, -3.0, np.array([[1.0, 0.0]]), [-1.0, -3.0], method, 1e-7, 1e-9)
    assert np.allclose(back[0, :, 0], np.cos([-1.0, -3.0]), atol=1e-4)


def test_stiff_problem():
    y, ok = ode.solve_many(lambda t, y, w: np.stack([y[:, 1], 1000 * (1 - y[:, 0] ** 2) * y[:, 1] - y[:, 0]], 1), 0.0, 500.0, np.array([[2.0, 0.0]]), [500.0], "radau", 1e-6, 1e-8)
    assert ok.all() and y[0, 0, 0] == pytest.approx(1.5968, abs=1e-3)


def test_likelihood_without_states_is_the_filter_s():
    rng = np.random.default_rng(1)
    for spec, n in ((sarimax.Spec((1, 0, 1), trend="c"), 60), (sarimax.Spec((2, 1, 1), (1, 0, 1, 7)), 80)):
        y = np.cumsum(rng.standard_normal(n))
        y[[5, 17]] = np.nan
        m, shift = sarimax.build(spec, sarimax.start_params(spec, y, None), n, None)
        assert statespace.log_likelihood(m, y - shift) == pytest.approx(float(statespace.kalman_filter(m, y - shift).total), rel=1e-10)


def test_unstable_transitions_have_no_stationary_start():
    with pytest.raises(np.linalg.LinAlgError):
        M.discrete_lyapunov(np.array([[1.5]]), np.eye(1))
