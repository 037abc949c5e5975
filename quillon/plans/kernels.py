"""Queries of distributions, integration, transforms, state space, models and decompositions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dist
from ..functions import special as S
from ..operators import decomposition as D
from ..operators import fourier, ode, particle, quadrature, sarimax, statespace, stl
from ..operators import optimise as O
from .registry import query, table
from .statistics import DAILY, _pair, daily

PI = "3.141592653589793"

#: Closed forms: name -> parameters, x and p on lineitem, and DuckDB's pdf, cdf and quantile.
CLOSED = {
    "exponential": ((0.5,), "0.5 * exp(-0.5 * x)", "1 - exp(-0.5 * x)", "-ln(1 - p) / 0.5"),
    "weibull": ((1.5, 20.0), "1.5 / 20 * pow(x / 20, 0.5) * exp(-pow(x / 20, 1.5))", "1 - exp(-pow(x / 20, 1.5))", "20 * pow(-ln(1 - p), 1 / 1.5::DOUBLE)"),
    "logistic": ((25.0, 5.0), "exp(-(x - 25) / 5) / (5 * (1 + exp(-(x - 25) / 5)) ** 2)", "1 / (1 + exp(-(x - 25) / 5))", "25 + 5 * ln(p / (1 - p))"),
    "laplace": ((25.0, 5.0), "exp(-abs(x - 25) / 5) / 10", "CASE WHEN x < 25 THEN exp((x - 25) / 5) / 2 ELSE 1 - exp(-(x - 25) / 5) / 2 END", "25 - 5 * sign(p - 0.5) * ln(1 - 2 * abs(p - 0.5))"),
    "cauchy": ((25.0, 5.0), f"1 / ({PI}::DOUBLE * 5 * (1 + ((x - 25) / 5) ** 2))", f"0.5 + atan((x - 25) / 5) / {PI}::DOUBLE", f"25 + 5 * tan({PI}::DOUBLE * (p - 0.5))"),
    "pareto": ((1.0, 2.5), "CASE WHEN x < 1 THEN 0 ELSE 2.5 / pow(x, 3.5) END", "CASE WHEN x < 1 THEN 0 ELSE 1 - pow(1 / x, 2.5) END", "1 / pow(1 - p, 1 / 2.5::DOUBLE)"),
    "rayleigh": ((15.0,), "x / 225 * exp(-x * x / 450)", "1 - exp(-x * x / 450)", "15 * sqrt(-2 * ln(1 - p))"),
    "uniform": ((0.0, 40.0), "CASE WHEN x > 40 THEN 0 ELSE 1 / 40::DOUBLE END", "CASE WHEN x > 40 THEN 1 ELSE x / 40 END", "40 * p"),
    "triangular": ((0.0, 20.0, 50.0), "CASE WHEN x > 50 THEN 0 WHEN x < 20 THEN 2 * x / (50 * 20) ELSE 2 * (50 - x) / (50 * 30) END", "CASE WHEN x > 50 THEN 1 WHEN x <= 20 THEN x * x / 1000 ELSE 1 - (50 - x) ** 2 / 1500 END", "CASE WHEN p < 0.4 THEN sqrt(p * 1000) ELSE 50 - sqrt((1 - p) * 1500) END"),
    "gumbel": ((20.0, 8.0), "exp(-(x - 20) / 8 - exp(-(x - 20) / 8)) / 8", "exp(-exp(-(x - 20) / 8))", "20 - 8 * ln(-ln(p))"),
    "arcsine": ((0.0, 60.0), f"1 / ({PI}::DOUBLE * sqrt(x * (60 - x)))", f"2 / {PI}::DOUBLE * asin(sqrt(x / 60))", f"60 * sin({PI}::DOUBLE / 2 * p) ** 2"),
    "geometric": ((0.1,), "0.1 * pow(0.9::DOUBLE, x)", "1 - pow(0.9::DOUBLE, floor(x) + 1)", "greatest(0, ceil(ln(1 - p) / ln(0.9::DOUBLE)) - 1)"),
    "bernoulli": ((0.3,), "CASE WHEN x = 1 THEN 0.3 WHEN x = 0 THEN 0.7 ELSE 0 END", "CASE WHEN x < 1 THEN 0.7 ELSE 1 END", "CASE WHEN p <= 0.7 THEN 0 ELSE 1 END"),
    "discrete_uniform": ((1.0, 30.0), "CASE WHEN x > 30 THEN 0 ELSE 1 / 30::DOUBLE END", "CASE WHEN x > 30 THEN 1 ELSE (floor(x) - 1 + 1) / 30 END", "greatest(1, least(30, 1 + ceil(p * 30) - 1))"),
}
POINTS = "(SELECT DISTINCT l_quantity AS x, (l_quantity - 0.5) / 50 AS p FROM lineitem)"


def points(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), ((F.col("l_quantity") - 0.5) / 50).alias("p")).distinct()


def _closed(name, params):
    def run(spark, d):
        made = [dist.expression(name, m, c, *params).cast("double").alias(m) for m, c in (("pdf", "x"), ("cdf", "x"), ("quantile", "p"))]
        return points(spark, d).select("x", *made)

    return run


for _name, (_params, _pdf, _cdf, _q) in CLOSED.items():
    query(f"dist_{_name}", f"SELECT x, round(({_pdf})::DOUBLE, 9) AS pdf, round(({_cdf})::DOUBLE, 9) AS cdf, round(({_q})::DOUBLE, 7) AS quantile FROM {POINTS}")(
        lambda spark, d, f=_closed(_name, _params): f(spark, d).withColumns({"pdf": F.round("pdf", 9), "cdf": F.round("cdf", 9), "quantile": F.round("quantile", 7)})
    )

DENSITIES = {
    "gamma": ((2.5, 8.0), "exp(1.5 * ln(x) - x / 8 - 2.5 * ln(8) - lgamma(2.5))"), "poisson": ((20.0,), "exp(x * ln(20) - 20 - lgamma(x + 1))"),
    "beta": ((2.0, 3.0), "12 * p * (1 - p) ** 2"), "students_t": ((5.0,), f"exp(lgamma(3) - lgamma(2.5) - 0.5 * ln(5 * {PI}::DOUBLE) - 3 * ln(1 + x * x / 5))"),
    "normal": ((25.0, 10.0), f"exp(-0.5 * pow((x - 25) / 10, 2)) / (10 * sqrt(2 * {PI}::DOUBLE))"), "chi_square": ((20.0,), "exp(9 * ln(x) - x / 2 - 10 * ln(2) - lgamma(10))"),
    "binomial": ((50.0, 0.4), "exp(lgamma(51) - lgamma(x + 1) - lgamma(51 - x) + x * ln(0.4) + (50 - x) * ln(0.6))"), "negative_binomial": ((5.0, 0.2), "exp(lgamma(x + 5) - lgamma(x + 1) - lgamma(5) + 5 * ln(0.2) + x * ln(0.8))"),
    "lognormal": ((3.0, 0.5), f"exp(-((ln(x) - 3) ** 2) / 0.5) / (x * 0.5 * sqrt(2 * {PI}::DOUBLE))"), "inverse_gamma": ((3.0, 20.0), "exp(3 * ln(20) - lgamma(3) - 4 * ln(x) - 20 / x)"),
}
for _name, (_params, _pdf) in DENSITIES.items():
    _x = "p" if _name == "beta" else "x"
    query(f"dist_{_name}_pdf", f"SELECT x, round(({_pdf})::DOUBLE, 9) AS pdf FROM {POINTS}", 9)(lambda spark, d, n=_name, q=_params, x=_x: points(spark, d).select("x", dist.column(n, "pdf", x, *q).alias("pdf")))

#: The same over every row of lineitem; the queries above keep to their SQL's distinct quantities.
ROWS = "(SELECT l_orderkey, l_linenumber, l_quantity AS x, (l_quantity - 0.5) / 50 AS p FROM lineitem)"
KEY = ("l_orderkey", "l_linenumber")


def rows(spark, d):
    return table(spark, d, "lineitem").select(*KEY, F.col("l_quantity").alias("x"), ((F.col("l_quantity") - 0.5) / 50).alias("p"))


for _name, (_params, _pdf, _cdf, _q) in CLOSED.items():
    query(f"dist_{_name}_rows", f"SELECT l_orderkey, l_linenumber, x, round(({_pdf})::DOUBLE, 9) AS pdf, round(({_cdf})::DOUBLE, 9) AS cdf, round(({_q})::DOUBLE, 7) AS quantile FROM {ROWS}")(
        lambda spark, d, n=_name, q=_params: rows(spark, d).select(*KEY, "x", *[F.round(dist.expression(n, m, c, *q).cast("double"), k).alias(m) for m, c, k in (("pdf", "x", 9), ("cdf", "x", 9), ("quantile", "p", 7))])
    )
for _name, (_params, _pdf) in DENSITIES.items():
    _x = "p" if _name == "beta" else "x"
    query(f"dist_{_name}_pdf_rows", f"SELECT l_orderkey, l_linenumber, x, round(({_pdf})::DOUBLE, 9) AS pdf FROM {ROWS}")(lambda spark, d, n=_name, q=_params, x=_x: rows(spark, d).select(*KEY, "x", F.round(dist.column(n, "pdf", x, *q), 9).alias("pdf")))

UNITS = {
    "binomial": (50, 0.4), "chi_square": (20,), "fisher_f": (4, 7), "gamma": (2.5, 8), "hypergeometric": (20, 30, 60), "inverse_chi_square": (4, 10), "inverse_gamma": (3, 20), "inverse_gaussian": (20, 30), "lognormal": (3, 0.5),
    "negative_binomial": (5, 0.2), "noncentral_beta": (2, 3, 1), "noncentral_chi_square": (10, 5), "noncentral_f": (4, 7, 1.5), "noncentral_t": (5, 1), "normal": (25, 10), "poisson": (20,), "skew_normal": (20, 10, 2), "students_t": (5,),
    "truncated_normal": (25, 10, 5, 45), "kolmogorov_smirnov": (5,), "dirac": (25,), "beta": (2, 3), "flat_normal": (),
}


#: So many different values are worked out in a task for each distribution, and go to the rows as a broadcast.
FEW = 4096


@query("dist_all_special")
def dist_all_special(spark, d):
    """pdf, cdf, sf and the quantile of p of every distribution without a closed form, for every row of lineitem.

    Each different x of the table is worked out once, and rows take their values by a join on x; of many different values
    each task has its share, and the join is Spark's to choose.
    """
    base = rows(spark, d).drop("p")
    each = base.select("x").distinct()
    few = each.count() <= FEW
    each, made = (each.coalesce(1) if few else each).withColumn("p", (F.col("x") - 0.5) / 50), None
    for n, q in UNITS.items():
        x = "p" if n in ("beta", "noncentral_beta") else "x"
        part = each.select(F.lit(n).alias("name"), F.col("x").alias("__x"), *[dist.column(n, m, c, *q).alias(m) for m, c in (("pdf", x), ("cdf", x), ("sf", x), ("quantile", "p"))])
        made = part if made is None else made.unionByName(part)
    return base.join(F.broadcast(made) if few else made, F.col("x").eqNullSafe(F.col("__x"))).select("name", *KEY, "x", "pdf", "cdf", "sf", "quantile")


@query("special_functions")
def special_functions(spark, d):
    """The special functions on one column, for every row of lineitem."""
    u = (F.col("x") / 10).cast("double")
    made = {
        "lgamma": S.lgamma, "tgamma": S.tgamma, "digamma": S.digamma, "trigamma": S.trigamma, "erf": S.erf, "erfc": S.erfc, "zeta2": lambda v: S.zeta(v + 1.5), "e1": lambda v: S.expint(1, v), "ei": S.expint_ei, "lambert_w": S.lambert_w,
        "j0": lambda v: S.bessel_j(0.0, v), "y1": lambda v: S.bessel_y(1.0, v), "i0": lambda v: S.bessel_i(0.0, v), "k1": lambda v: S.bessel_k(1.0, v), "ai": lambda v: S.airy("ai", v), "bi": lambda v: S.airy("bi", v),
        "gamma_p": lambda v: S.gamma_p(2.5, v), "ibeta": lambda v: S.ibeta(2.0, 3.0, v / 6), "ellip_k": lambda v: S.ellip_k(v / 6), "ellip_e": lambda v: S.ellip_e(v / 6), "sn": lambda v: S.jacobi(v, 0.5)[0], "lanczos": lambda v: S.lanczos_gamma(v + 1), "heuman": lambda v: S.heuman_lambda(v / 6, 0.5),
        "theta3": lambda v: S.theta(3, v, 0.1), "owens_t": lambda v: S.owens_t(v, 0.5), "hyp_1f1": lambda v: S.hyp_1f1(1.0, 2.5, -v), "rf": lambda v: S.carlson_rf(v, 1.0, 2.0),
    }
    return rows(spark, d).select(*KEY, "x", *[S.apply(f, u).alias(k) for k, f in made.items()])


@query("dist_normal_cdf")
def dist_normal_cdf(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dist.column("normal", "cdf", "l_quantity", 25.0, 10.0).alias("cdf"))


# --- integration ---


@query("trapz_daily", f"WITH {DAILY}, p AS (SELECT event_type, (y + lag(y) OVER (PARTITION BY event_type ORDER BY t)) / 2 AS a FROM d) SELECT event_type, round(sum(a), 5) AS value FROM p GROUP BY 1", 5)
def trapz_daily(spark, d):
    return quadrature.trapezoid(daily(spark, d), "y", ["event_type"])


@query("cumtrapz_daily", f"WITH {DAILY}, p AS (SELECT event_type, t, coalesce((y + lag(y) OVER (PARTITION BY event_type ORDER BY t)) / 2, 0) AS a FROM d) SELECT event_type, t, round(sum(a) OVER (PARTITION BY event_type ORDER BY t), 5) AS cumulative FROM p", 5)
def cumtrapz_daily(spark, d):
    return quadrature.cumulative_trapezoid(daily(spark, d), "y", ["event_type"]).select("event_type", "t", "cumulative")


@query("simpson_daily", f"""WITH {DAILY}, c AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM d), m AS (SELECT *, CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END AS m FROM c)
SELECT event_type, round(sum(CASE WHEN t >= m THEN 0 WHEN t = 0 OR t = m - 1 THEN y / 3 WHEN t % 2 = 1 THEN 4 * y / 3 ELSE 2 * y / 3 END + CASE WHEN n % 2 = 1 THEN 0 WHEN t = n - 1 THEN 5 * y / 12 WHEN t = n - 2 THEN 8 * y / 12 WHEN t = n - 3 THEN -y / 12 ELSE 0 END), 5) AS value FROM m GROUP BY 1""", 5)
def simpson_daily(spark, d):
    return quadrature.simpson(daily(spark, d), "y", ["event_type"])


@query("cumsimpson_daily", f"""WITH {DAILY}, p AS (SELECT event_type, t, y, lag(y) OVER w AS a, lag(y, 2) OVER w AS b, lead(y) OVER w AS c FROM d WINDOW w AS (PARTITION BY event_type ORDER BY t)),
s AS (SELECT event_type, t, CASE WHEN a IS NULL THEN 0 WHEN b IS NULL THEN (5 * a + 8 * y - c) / 12 ELSE (-b + 8 * a + 5 * y) / 12 END AS s FROM p) SELECT event_type, t, round(sum(s) OVER (PARTITION BY event_type ORDER BY t), 5) AS cumulative FROM s""", 5)
def cumsimpson_daily(spark, d):
    return quadrature.cumulative_simpson(daily(spark, d), "y", ["event_type"]).select("event_type", "t", "cumulative")


_X8, _W8 = quadrature.gauss_rule("legendre", 8)
NODES = ", ".join(f"({float(x)!r}::DOUBLE, {float(w)!r}::DOUBLE)" for x, w in zip(_X8, _W8, strict=True))


@query("gauss_legendre", f"WITH n(x, w) AS (VALUES {NODES}) SELECT p_partkey, round(p_size / 2.0::DOUBLE * sum(w * exp(-(p_size / 2.0::DOUBLE * (1 + x)) / 10)), 8) AS value FROM part, n GROUP BY p_partkey, p_size", 8)
def gauss_legendre(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("b"))
    return quadrature.gauss_integral(rows, lambda x: F.exp(-x / 10), F.lit(0.0), F.col("b")).select("p_partkey", "value")


@query("quadrature_rules")
def quadrature_rules(spark, d):
    """Adaptive, double-exponential, improper, oscillatory, singular and principal-value integrals of a parameter per row."""

    def run(batches):
        for pdf in batches:
            k = pdf["s_suppkey"] % 7 + 1.0
            pdf["adaptive"] = [quadrature.adaptive(lambda x, a=a: math.exp(-a * x), 0, 2).value for a in k]
            pdf["tanh_sinh"] = [quadrature.double_exponential(lambda x, a=a: x ** (-0.5) * a, 0, 1).value for a in k]
            pdf["upper"] = [quadrature.improper(lambda x, a=a: math.exp(-a * x * x), "upper").value for a in k]
            pdf["cosine"] = [quadrature.oscillatory(lambda x: 1 / (1 + x * x), 0.0, a).value for a in k]
            pdf["filon"] = [quadrature.filon(lambda x: x * x, 0, 1, 10 * a) for a in k]
            pdf["jacobi"] = [quadrature.endpoint_singular(lambda x, a=a: math.exp(a * x), 0, 1, "algebraic", -0.5, -0.5) for a in k]
            pdf["principal"] = [quadrature.principal_value(lambda x, a=a: math.exp(x / a), -1, 2, 0.5).value for a in k]
            yield pdf

    return table(spark, d, "supplier").select("s_suppkey").mapInPandas(run, "s_suppkey long, adaptive double, tanh_sinh double, upper double, cosine double, filon double, jacobi double, principal double")


# --- transforms ---


@query("dft_power", f"WITH {DAILY}, k AS (SELECT unnest(range(0, 30))::INT AS k) SELECT event_type, k, round(sum(y * cos(-2 * pi() * k * t / 30)), 4) AS re, round(sum(y * sin(-2 * pi() * k * t / 30)), 4) AS im, round(sum(y * cos(-2 * pi() * k * t / 30)) ** 2 + sum(y * sin(-2 * pi() * k * t / 30)) ** 2, 0) AS power FROM d, k GROUP BY 1, 2")
def dft_power(spark, d):
    out = fourier.spectrum_by_sums(daily(spark, d), "y", None, ["event_type"])
    return out.withColumns({"re": F.round("re", 4), "im": F.round("im", 4), "power": F.round("power", 0)})


@query("dct2", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64)) AS i FROM embeddings), k AS (SELECT unnest(range(0, 4))::INT AS k) SELECT vec_id, k, round(sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / 64.0::DOUBLE) * sum(x * cos(pi() * (2 * i + 1) * k / 128)), 6) AS value FROM e, k GROUP BY 1, 2", 6)
def dct2(spark, d):
    x = F.col("embedding").cast("array<double>")
    made = F.array(*[F.struct(F.lit(k).alias("k"), c.alias("value")) for k, c in enumerate(fourier.dct2_array(x, 64)[:4])])
    return table(spark, d, "embeddings").select("vec_id", F.explode(made).alias("m")).select("vec_id", "m.*")


@query("dct2_full", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i, len(embedding) AS n FROM embeddings), k AS (SELECT vec_id, unnest(range(0, len(embedding)))::INT AS k FROM embeddings) SELECT vec_id, k, round(sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / any_value(n)::DOUBLE) * sum(x * cos(pi() * (2 * i + 1) * k / (2 * n))), 6) AS value FROM e JOIN k USING (vec_id) GROUP BY 1, 2", 6)
def dct2_full(spark, d):
    """All coefficients; dct2 keeps to its SQL's first four."""
    return fourier.dct_rows(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id", "v")


@query("fft_full", f"WITH {DAILY}, n AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM d), k AS (SELECT event_type, t::INT AS k FROM d), s AS (SELECT event_type, k, sum(y * cos(2 * pi() * k * t / n)) AS re, sum(-y * sin(2 * pi() * k * t / n)) AS im FROM n JOIN k USING (event_type) GROUP BY 1, 2) SELECT event_type, k, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im, round(re * re + im * im, 0) AS power FROM s")
def fft_full(spark, d):
    out = fourier.transform(daily(spark, d), "y", "fft", ["event_type"])
    return out.withColumns({"re": F.round("re", 4) + 0.0, "im": F.round("im", 4) + 0.0, "power": F.round("power", 0)})


@query("hartley_daily", f"WITH {DAILY}, k AS (SELECT unnest(range(0, 30))::INT AS k) SELECT event_type, k, round(sum(y * (cos(2 * pi() * k * t / 30) + sin(2 * pi() * k * t / 30))), 4) AS re FROM d, k GROUP BY 1, 2", 4)
def hartley_daily(spark, d):
    return fourier.transform(daily(spark, d), "y", "hartley", ["event_type"]).select("event_type", "k", "re")


@query("dst_daily", f"WITH {DAILY}, k AS (SELECT unnest(range(0, 30))::INT AS k) SELECT event_type, k, round(sqrt(2 / 31.0::DOUBLE) * sum(y * sin(pi() * (k + 1) * (t + 1) / 31)), 4) AS re FROM d, k GROUP BY 1, 2", 4)
def dst_daily(spark, d):
    return fourier.transform(daily(spark, d), "y", "dst1", ["event_type"]).select("event_type", "k", "re")


# --- matrices ---


@query("gram_matrix", "WITH e AS (SELECT vec_id, unnest(embedding[1:8])::DOUBLE AS x, unnest(range(0, 8))::INT AS i FROM embeddings) SELECT a.i AS i, b.i AS j, round(sum(a.x * b.x), 6) AS value FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2", 6)
def gram_matrix(spark, d):
    return D.gram_matrix(table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v")), "v", 8)


@query("matmul_coo", "WITH e AS (SELECT vec_id, unnest(embedding[1:8])::DOUBLE AS x, unnest(range(0, 8))::INT AS i FROM embeddings), g AS (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) AS v FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2) SELECT e.vec_id AS i, g.j AS j, round(sum(e.x * g.v), 5) AS value FROM e JOIN g ON e.i = g.i GROUP BY 1, 2", 5)
def matmul_coo(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    a = v.select(F.col("vec_id").alias("i"), F.posexplode(F.slice("v", 1, 8)).alias("j", "value"))
    return D.matmul(a, D.gram_matrix(v, "v", 8))


FULL = "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INT AS i FROM embeddings)"


@query("gram_matrix_full", f"{FULL} SELECT a.i AS i, b.i AS j, round(sum(a.x * b.x), 6) AS value FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2", 6)
def gram_matrix_full(spark, d):
    """Over all components; gram_matrix keeps to its SQL's first eight."""
    return D.gram(table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v")), "v")


@query("matmul_coo_full", f"{FULL}, g AS (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) AS v FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2) SELECT e.vec_id AS i, g.j AS j, round(sum(e.x * g.v), 5) AS value FROM e JOIN g ON e.i = g.i GROUP BY 1, 2", 5)
def matmul_coo_full(spark, d):
    """All components times their whole Gram matrix; matmul_coo keeps to its SQL's first eight."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    a = v.select(F.col("vec_id").alias("i"), F.posexplode("v").alias("j", "value"))
    return D.matmul(a, F.broadcast(D.gram(v, "v")))


def _blocks(spark, d):
    """The Gram matrix of all components per label; singular where a label has fewer vectors than components."""
    return D.gram(table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")), "v", ["label"])


for _kind in ("lu", "qr", "lq", "svd", "cholesky", "ldl", "eigh", "eig", "schur"):
    query(f"decompose_{_kind}")(lambda spark, d, k=_kind: D.decompose(_blocks(spark, d), k, ["label"]))


# --- series models ---

LEVEL = f"""WITH RECURSIVE {DAILY}, k AS (
SELECT event_type, t, y, y AS a, 1e6::DOUBLE AS p, 0.0::DOUBLE AS ll, 0.0::DOUBLE AS fc FROM d WHERE false UNION ALL
SELECT event_type, t, y, 5000 + (1e8 / (1e8 + 1e5)) * (y - 5000), 1e8 * (1 - 1e8 / (1e8 + 1e5)) , -0.5 * (ln(2 * pi()) + ln(1e8 + 1e5) + (y - 5000) ** 2 / (1e8 + 1e5)), 5000.0::DOUBLE FROM d WHERE t = 0 UNION ALL
SELECT d.event_type, d.t, d.y, k.a + (k.p + 1e4) / (k.p + 1e4 + 1e5) * (d.y - k.a), (k.p + 1e4) * (1 - (k.p + 1e4) / (k.p + 1e4 + 1e5)), -0.5 * (ln(2 * pi()) + ln(k.p + 1e4 + 1e5) + (d.y - k.a) ** 2 / (k.p + 1e4 + 1e5)), k.a FROM k JOIN d ON d.event_type = k.event_type AND d.t = k.t + 1)
SELECT event_type, t, 0::INT AS component, round(fc, 4) AS predicted, round(a, 4) AS filtered, round(p, 3) AS variance, round(ll, 8) AS loglik FROM k"""


@query("kalman_local_level", LEVEL)
def kalman_local_level(spark, d):
    m = statespace.local_level(1e4, 1e5, diffuse=False, mean=5000.0, var=1e8)
    out = statespace.filter_series(daily(spark, d), "y", m, ["event_type"], smooth=False).drop("smoothed")
    return out.withColumns({"predicted": F.round("predicted", 4), "filtered": F.round("filtered", 4), "variance": F.round("variance", 3), "loglik": F.round("loglik", 8)})


@query("kalman_smooth_daily")
def kalman_smooth_daily(spark, d):
    return statespace.filter_series(daily(spark, d), "y", statespace.local_level(1e4, 1e5), ["event_type"])


@query("stl_daily")
def stl_daily(spark, d):
    return stl.stl(daily(spark, d), "y", 7, ["event_type"])


@query("mstl_daily")
def mstl_daily(spark, d):
    return stl.mstl(daily(spark, d), "y", [5, 7], ["event_type"])


@query("sarimax_fit")
def sarimax_fit(spark, d):
    return sarimax.fit_series(daily(spark, d), "y", sarimax.Spec((1, 0, 1), trend="c"), ["event_type"])


@query("sarimax_forecast")
def sarimax_forecast(spark, d):
    return sarimax.forecast_series(daily(spark, d), "y", sarimax.Spec((1, 1, 1)), 5, ["event_type"])


@query("varmax_forecast")
def varmax_forecast(spark, d):
    return sarimax.varmax_series(_pair(spark, d), ["a", "b"], 1, 0, 5)


@query("impulse_responses")
def impulse_responses(spark, d):
    """Responses and per-step variance shares of the least-squares VAR(1) of two daily series."""
    from ..operators.common import per_group

    def run(pdf):
        import pandas as pd

        c, a, s = sarimax.var_least_squares(pdf[["a", "b"]].to_numpy(float), 1)
        m = sarimax.varma_model(c, a, np.zeros((0, 2, 2)), s)
        irf, share = statespace.impulse_response(m, 6, True), statespace.variance_shares(m, 6)
        return pd.DataFrame([(h, "ab"[i], "ab"[j], irf[h, i, j], share[h, i, j]) for h in range(7) for i in range(2) for j in range(2)], columns=["step", "response", "impulse", "value", "share"])

    return per_group(_pair(spark, d), [], ["t"], run, "step int, response string, impulse string, value double, share double", ["a", "b"])


@query("particle_loglik")
def particle_loglik(spark, d):
    s = daily(spark, d)
    w = W.partitionBy("event_type")
    z = s.withColumn("z", (F.col("y") - F.avg("y").over(w)) / F.stddev_pop("y").over(w))
    return particle.filter_series(z, "z", lambda: particle.linear_gauss(0.5, 0.8, 0.6), ["event_type"], n=300)


@query("ode_decay", "SELECT s_suppkey, t, 0 AS component, round(1 / (1 + 9 * exp(-(s_suppkey % 5 + 1) * t)), 6) AS y, 'success' AS status, m AS method FROM supplier, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) AS times(t), (VALUES ('rk45'), ('radau')) AS methods(m)", 6)
def ode_decay(spark, d):
    """Logistic growth from each supplier's key as a parameter, by two methods."""
    p = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5 + 1).cast("double").alias("r"))

    def rhs(pdf):
        r = pdf["r"].to_numpy()[:, None]
        return lambda t, y, which: r[which] * y * (1 - y)

    made = [ode.trajectories_many(p, rhs, lambda pdf: np.full((len(pdf), 1), 0.1), 0.0, 2.0, [0.5, 1.0, 2.0], "s_suppkey", method=m, rtol=1e-10, atol=1e-12).withColumn("method", F.lit(m)) for m in ("rk45", "radau")]
    return made[0].unionByName(made[1])


@query("minimise_over_rows")
def minimise_over_rows(spark, d):
    """A robust line fitted by L-BFGS-B whose objective and gradient are aggregations."""
    rows = table(spark, d, "part").select((F.col("p_retailprice") / 1000).alias("y"), (F.col("p_size") / 50).alias("x")).persist()
    r = O.minimise_over(rows, lambda a, b: F.sqrt(1 + F.pow(F.col("y") - a - b * F.col("x"), 2)) - 1, ["a", "b"], [0.0, 0.0], iterations=15)
    rows.unpersist()
    return spark.createDataFrame([(n, float(v), r.cost, r.status) for n, v in zip(("a", "b"), r.x, strict=True)], "term string, coef double, cost double, status string")


@query("root_per_row")
def root_per_row(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 9 + 1).cast("double").alias("c"))
    return O.per_row(rows, lambda r: O.brentq(lambda x: x**3 + x - r["c"], 0.0, 10.0))
