"""Special functions and distributions: published values, identities, inverses."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions import dist as D
from quillon.functions import special as S

#: Published values (Abramowitz and Stegun, DLMF).
VALUES = [
    (S.bessel_j(0, 1.0), 0.7651976865579666), (S.bessel_y(0, 1.0), 0.08825696421567697), (S.bessel_i(0, 1.0), 1.2660658777520084), (S.bessel_k(0, 1.0), 0.42102443824070834),
    (S.bessel_j(0.5, 2.0), math.sqrt(1 / math.pi) * math.sin(2)), (S.airy("ai", 1.0), 0.13529241631288141), (S.airy("bi", -1.0), 0.10399738949694461), (S.airy("ai'", 0.0), -0.2588194037928068),
    (S.digamma(1.0), -np.euler_gamma), (S.trigamma(1.0), math.pi**2 / 6), (S.zeta(2.0), math.pi**2 / 6), (S.zeta(-1.0), -1 / 12), (S.expint(1, 1.0), 0.21938393439552029), (S.expint_ei(1.0), 1.8951178163559368),
    (S.lambert_w(1.0), 0.5671432904097838), (S.lambert_w(-0.1, -1), -3.577152063957297), (S.ellip_k(0.5), 1.685750354812596), (S.ellip_e(0.5), 1.4674622093394272), (S.owens_t(1.0, 0.5), 0.04306469112078537),
    (S.carlson_rj(0, 1, 2, 3), 0.7768862377858232), (S.carlson_rc(0, 0.25), math.pi), (S.carlson_rf(1, 2, 0), 1.3110287771461), (S.carlson_rd(0, 2, 1), 1.7972103521034), (S.carlson_rg(0, 16, 16), math.pi),
    (S.hyp_1f1(1.0, 2.0, -3.0), (1 - math.exp(-3)) / 3), (S.hyp_0f1(0.5, -0.25), math.cos(1.0)), (S.erf_inv(0.5), 0.4769362762044699), (S.lanczos_gamma(4.5), math.gamma(4.5)), (S.bessel_zeros("j", 0, 2)[1], 5.520078110286311),
    (S.theta(3, 0.0, 0.1), 1.2002000020000003), (S.spherical_bessel(1, 2.0), 0.4353977749799916), (S.bessel_derivative("j", 0, 1.0), -0.44005058574493355), (S.hyp_pfq([1, 1], [2], 0.5), 2 * math.log(2)),
]


@pytest.mark.parametrize("i", range(len(VALUES)))
def test_published_values(i):
    got, want = VALUES[i]
    assert float(got) == pytest.approx(want, rel=1e-11, abs=1e-12)


@settings(max_examples=50, deadline=None)
@given(st.floats(0.2, 30), st.floats(0.2, 30), st.floats(0.001, 0.999))
def test_incomplete_functions_invert(a, b, p):
    assert float(S.gamma_p(a, S.gamma_p_inv(a, p))) == pytest.approx(p, rel=1e-9)
    assert float(S.ibeta(a, b, S.ibeta_inv(a, b, p))) == pytest.approx(p, rel=1e-7)
    assert float(S.gamma_p(a, b) + S.gamma_q(a, b)) == pytest.approx(1, abs=1e-12)
    assert float(S.ibeta(a, b, p) + S.ibeta(b, a, 1 - p)) == pytest.approx(1, abs=1e-10)


@settings(max_examples=30, deadline=None)
@given(st.floats(-3, 3), st.floats(0.0, 0.95))
def test_jacobi_identities(u, k):
    sn, cn, dn = S.jacobi(u, k)
    assert float(sn**2 + cn**2) == pytest.approx(1, abs=1e-12) and float(dn**2 + k * k * sn**2) == pytest.approx(1, abs=1e-12)
    if abs(u) < 1.5:
        assert float(S.ellip_f(np.arctan2(sn, cn), k)) == pytest.approx(u, abs=1e-10)


def test_wronskian():
    x = np.linspace(0.5, 10, 20)
    assert np.allclose(S.bessel_j(1.3, x) * S.bessel_derivative("y", 1.3, x) - S.bessel_derivative("j", 1.3, x) * S.bessel_y(1.3, x), 2 / (np.pi * x), rtol=1e-9)
    assert np.allclose(S.bessel_i(0.7, x) * S.bessel_k(1.7, x) + S.bessel_i(1.7, x) * S.bessel_k(0.7, x), 1 / x, rtol=1e-9)


PARAMS = {
    "arcsine": (0, 2), "beta": (2, 3), "cauchy": (0, 1), "chi_square": (3,), "exponential": (2,), "gumbel": (0, 1), "fisher_f": (4, 7), "gamma": (2.5, 1.5), "inverse_chi_square": (4, 1.5), "inverse_gamma": (3, 2), "inverse_gaussian": (1.5, 2),
    "kolmogorov_smirnov": (5,), "laplace": (0, 1), "lognormal": (0, 0.5), "logistic": (0, 1), "noncentral_beta": (2, 3, 1.0), "noncentral_chi_square": (3, 2.0), "noncentral_f": (4, 7, 1.5), "noncentral_t": (5, 1.0), "normal": (0, 1), "pareto": (1, 3),
    "rayleigh": (1.5,), "skew_normal": (0, 1, 2.0), "students_t": (5,), "triangular": (0, 1, 3), "truncated_normal": (0, 1, -1, 2), "uniform": (0, 2), "weibull": (1.5, 2),
}
DISCRETE = {"bernoulli": (0.3,), "binomial": (10, 0.3), "discrete_uniform": (1, 6), "geometric": (0.3,), "hypergeometric": (5, 6, 20), "negative_binomial": (3, 0.4), "poisson": (2.5,)}


@pytest.mark.parametrize("name", PARAMS)
def test_continuous(name):
    d, p = D.REGISTRY[name], PARAMS[name]
    q = np.array([0.1, 0.37, 0.5, 0.9])
    x = d.quantile(q, *p)
    assert np.allclose(d.cdf(x, *p), q, atol=1e-8) and np.allclose(d.sf(x, *p), 1 - q, atol=1e-8)
    assert np.allclose((d.cdf(x + 1e-5, *p) - d.cdf(x - 1e-5, *p)) / 2e-5, d.pdf(x, *p), atol=1e-4)


@pytest.mark.parametrize("name", DISCRETE)
def test_discrete(name):
    d, p = D.REGISTRY[name], DISCRETE[name]
    k = np.arange(0.0, 200)
    pmf = np.nan_to_num(d.pdf(k, *p))
    assert pmf.sum() == pytest.approx(1, abs=1e-9) and np.allclose(np.cumsum(pmf), d.cdf(k, *p), atol=1e-9)
    assert (pmf * k).sum() == pytest.approx(d.mean(*p)) and (pmf * k * k).sum() - d.mean(*p) ** 2 == pytest.approx(d.variance(*p))
    q = np.array([0.05, 0.4, 0.95])
    x = d.quantile(q, *p)
    assert (d.cdf(x, *p) >= q - 1e-9).all() and (d.cdf(x - 1, *p) < q + 1e-9).all()


def test_known_tails():
    assert float(D.chi2_sf(3.841458820694124, 1)) == pytest.approx(0.05) and float(D.f_sf(4.9646027437307, 1, 10)) == pytest.approx(0.05, rel=1e-6)
    assert float(D.t_quantile(0.975, 10)) == pytest.approx(2.2281388519649385) and float(D.ks_sf(1.3580986393225505)) == pytest.approx(0.05)


def test_mixtures_and_transforms():
    assert float(D.hyperexponential("cdf", 1.0, [1, 1], [1.0, 2.0])) == pytest.approx(1 - (math.exp(-1) + math.exp(-2)) / 2)
    assert D.categorical("quantile", [0.1, 0.5, 0.99], [0.2, 0.3, 0.5]).tolist() == [0, 1, 2]
    x = np.array([0.5, 1.0, 2.0])
    assert np.allclose(D.transformed("normal", "log", "pdf", x, 0.0, 0.5), D.REGISTRY["lognormal"].pdf(x, 0.0, 0.5))
    cov = np.array([[2.0, 0.3], [0.3, 1.0]])
    v = np.array([0.4, -0.2])
    want = -0.5 * v @ np.linalg.solve(cov, v) - 0.5 * math.log(np.linalg.det(cov)) - math.log(2 * math.pi)
    assert D.mv_normal_log_pdf(v, np.zeros(2), cov)[0] == pytest.approx(want)
    assert D.mv_student_log_pdf(v, 1e7, np.zeros(2), cov)[0] == pytest.approx(want, abs=1e-5)


def test_columns(spark):
    df = spark.createDataFrame([(0.5,), (None,), (2.0,)], "x double")
    rows = df.select(D.column("gamma", "cdf", "x", 2.0, 1.0).alias("g"), D.expression("exponential", "cdf", "x", 1.0).alias("e"), S.apply(S.lgamma, "x").alias("l")).collect()
    assert rows[1]["g"] is None and rows[1]["e"] is None and rows[0]["e"] == pytest.approx(1 - math.exp(-0.5)) and rows[2]["g"] == pytest.approx(float(S.gamma_p(2.0, 2.0)))


def exact_j(n, x):
    """J of a whole order by its power series in enough decimal digits."""
    from decimal import Decimal, getcontext

    getcontext().prec = int(x) + 60
    z, k = Decimal(x), 0
    term = (z / 2) ** n
    for i in range(1, n + 1):
        term /= i
    total = term
    while k <= x or abs(term) > abs(total) * Decimal(10) ** -25:
        k += 1
        term = -term * (z * z / 4) / (k * (k + n))
        total += term
    return float(total)


def test_bessel_j_at_all_sizes():
    for n in (0, 1, 2, 5, 30, 100):
        for x in (0.1, 3.0, 12.5, 20.0, 24.9, 25.1, 60.0, 300.0, 1000.0, 2000.0):
            want = exact_j(n, x)
            size = max(abs(want), np.sqrt(2 / (np.pi * x)) if x > n else 0.0)
            assert abs(S.bessel_j(float(n), x) - want) < 2e-13 * size


def test_bessel_wronskians():
    v, x = np.meshgrid([0, 1 / 3, 0.5, 1, 2.7, 7, 15.3], [1e-3, 0.1, 1, 5, 20, 24, 30, 100, 500, 1e4, 1e6])
    assert np.abs((S.bessel_j(v + 1, x) * S.bessel_y(v, x) - S.bessel_j(v, x) * S.bessel_y(v + 1, x)) * np.pi * x / 2 - 1).max() < 1e-12
    assert np.abs((S.bessel_i(v, x, True) * S.bessel_k(v + 1, x, True) + S.bessel_i(v + 1, x, True) * S.bessel_k(v, x, True)) * x - 1).max() < 1e-12


def test_bessel_known_values():
    assert S.bessel_j(0.0, 1000.0) == pytest.approx(0.02479, abs=5e-6) and S.bessel_y(0.0, 1000.0) == pytest.approx(0.00472, abs=5e-6)
    x = np.array([50.0, 1e4, 1e6])  # half orders are elementary
    assert np.allclose(S.bessel_j(0.5, x), np.sqrt(2 / (np.pi * x)) * np.sin(x), rtol=1e-12, atol=0) and np.allclose(S.bessel_y(0.5, x), -np.sqrt(2 / (np.pi * x)) * np.cos(x), rtol=1e-12, atol=0)
    assert S.bessel_j(-2.0, 3.0) == pytest.approx(float(S.bessel_j(2.0, 3.0))) and S.bessel_y(1.0, np.array([0.0]))[0] == -np.inf
    assert S.bessel_zeros("j", 0, 3) == pytest.approx([2.404825557695773, 5.520078110286311, 8.653727912911013], rel=1e-12)
    assert S.airy("ai", 1.0) == pytest.approx(0.1352924163128814, rel=1e-12)
