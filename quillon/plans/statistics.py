"""Queries of reductions, correlation, regression and tests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import correlation as C
from ..operators import hypothesis as H
from ..operators import reductions as R
from ..operators import regression as G
from ..sources import daily_series
from .registry import query, table

#: Daily sums of events by type, and events' deviations from their type's mean, in order.
DAILY = "d AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY p) - 1 AS t, y FROM (SELECT event_type, date_trunc('day', ts) AS p, sum(value) AS y FROM events GROUP BY 1, 2))"
RESID = "r AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS e, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS t, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


def daily(spark, d):
    return daily_series(table(spark, d, "events"))


def resid(spark, d):
    e = table(spark, d, "events")
    w = W.partitionBy("event_type")
    return e.select("event_type", (F.col("value") - F.avg("value").over(w)).alias("e"), F.row_number().over(w.orderBy("ts", "event_id")).alias("t"))


@query("vec_reductions", """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS sum, round(avg(l_quantity), 8) AS mean, min(l_quantity) AS min, max(l_quantity) AS max,
round(sum(abs(l_quantity)), 4) AS l1, round(sqrt(sum(l_quantity * l_quantity)), 6) AS l2, max(abs(l_quantity)) AS max_abs, round(sum((l_quantity - 25) * (l_quantity - 25)), 4) AS sum_sq, round(stddev_pop(l_quantity), 8) AS std, false AS has_inf FROM lineitem GROUP BY 1""")  # fmt: skip
def vec_reductions(spark, d):
    out = R.reductions(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"], 25.0)
    return out.withColumns({c: F.round(c, n) for c, n in (("sum", 4), ("mean", 8), ("l1", 4), ("l2", 6), ("sum_sq", 4), ("std", 8))})


@query("vec_norms", "SELECT vec_id, round(list_sum([abs(x::DOUBLE) FOR x IN embedding]), 6) AS l1, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])), 6) AS l2, round(list_max([abs(x::DOUBLE) FOR x IN embedding]), 6) AS max_abs FROM embeddings", 6)
def vec_norms(spark, d):
    x = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", *[c.alias(k) for k, c in R.array_norms(x).items()])


@query("vec_distances", """SELECT a.vec_id, round(list_sum([x[1]::DOUBLE * x[2]::DOUBLE FOR x IN list_zip(a.embedding, b.embedding)]), 6) AS dot, round(list_sum([abs(x[1]::DOUBLE - x[2]::DOUBLE) FOR x IN list_zip(a.embedding, b.embedding)]), 6) AS l1,
round(sqrt(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) ** 2 FOR x IN list_zip(a.embedding, b.embedding)])), 6) AS l2, round(list_max([abs(x[1]::DOUBLE - x[2]::DOUBLE) FOR x IN list_zip(a.embedding, b.embedding)]), 6) AS linf FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""", 6)  # fmt: skip
def vec_distances(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = e.alias("a").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")).alias("b"), "vec_id")
    return pairs.select("vec_id", *[c.alias(k) for k, c in R.distances(F.col("v"), F.col("w")).items()])


@query("vec_elementwise", "SELECT vec_id, round(2 * embedding[1]::DOUBLE + embedding[2]::DOUBLE, 6) AS axpy, round(3 * embedding[1]::DOUBLE, 6) AS scaled, round(embedding[1]::DOUBLE + 1, 6) AS shifted, CASE WHEN embedding[2] <> 0 THEN round(embedding[1]::DOUBLE / embedding[2]::DOUBLE, 4) END AS divided FROM embeddings")
def vec_elementwise(spark, d):
    v = F.col("embedding").cast("array<double>")
    u, w = F.slice(v, 1, 1), F.slice(v, 2, 1)
    at = lambda c, n=6: F.round(F.get(c, F.lit(0)), n)
    return table(spark, d, "embeddings").select("vec_id", at(R.axpy(2.0, u, w)).alias("axpy"), at(R.scale(u, 3.0)).alias("scaled"), at(R.add_const(u, 1.0)).alias("shifted"), F.when(F.get(w, F.lit(0)) != 0, at(R.divide(u, w), 4)).alias("divided"))


@query("vec_elementwise_full", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(list_concat(embedding[2:], embedding[1:1]))::DOUBLE AS y, unnest(range(0, len(embedding)))::INT AS i FROM embeddings)
SELECT vec_id, i, round(2 * x + y, 6) AS axpy, round(3 * x, 6) AS scaled, round(x + 1, 6) AS shifted, CASE WHEN y <> 0 THEN round(x / y, 4) END AS divided FROM e""")
def vec_elementwise_full(spark, d):
    """Whole arrays, each with itself rotated by one; vec_elementwise keeps to its SQL's first two components."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("u"))
    e = e.where(F.size("u") > 0).withColumn("w", F.concat(F.slice("u", F.lit(2), F.size("u")), F.slice("u", 1, 1)))
    u, w = F.col("u"), F.col("w")
    made = {"axpy": (R.axpy(2.0, u, w), 6), "scaled": (R.scale(u, 3.0), 6), "shifted": (R.add_const(u, 1.0), 6), "divided": (R.divide(u, F.transform(w, lambda x: F.when(x != 0, x))), 4)}
    rows = e.select("vec_id", F.posexplode(F.arrays_zip(*[c.alias(k) for k, (c, _) in made.items()])).alias("i", "m"))
    return rows.select("vec_id", "i", *[F.round(F.col(f"m.{k}"), n).alias(k) for k, (_, n) in made.items()])


@query("moments_by_flag", """WITH m AS (SELECT l_returnflag, avg(l_extendedprice) AS mu FROM lineitem GROUP BY 1), c AS (SELECT l.l_returnflag, m.mu, l_extendedprice - m.mu AS z FROM lineitem l JOIN m USING (l_returnflag)),
s AS (SELECT l_returnflag, any_value(mu) AS mean, count(*) AS n, avg(z * z) AS m2, avg(z * z * z) AS m3, avg(z * z * z * z) AS m4 FROM c GROUP BY 1)
SELECT l_returnflag, n, round(mean, 4) AS mean, round(sqrt(m2), 4) AS std, round(m3 / m2 ** 1.5, 6) AS skewness, round(m4 / (m2 * m2), 6) AS kurtosis FROM s""")
def moments_by_flag(spark, d):
    out = R.moments(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4), "skewness": F.round("skewness", 6), "kurtosis": F.round("kurtosis", 6)})


@query("cumsum_daily", f"WITH {DAILY} SELECT event_type, t, round(sum(y) OVER (PARTITION BY event_type ORDER BY t), 5) AS cumsum FROM d", 5)
def cumsum_daily(spark, d):
    return R.cumulative_sum(daily(spark, d), "y", ["event_type"], ["t"]).select("event_type", "t", "cumsum")


@query("cumprod_daily", f"WITH {DAILY} SELECT event_type, t, round(exp(sum(ln(1 + y / 100000)) OVER (PARTITION BY event_type ORDER BY t)), 8) AS cumprod FROM d", 8)
def cumprod_daily(spark, d):
    return R.cumulative_product(daily(spark, d).withColumn("g", 1 + F.col("y") / 100000), "g", ["event_type"], ["t"]).select("event_type", "t", "cumprod")


@query("differences_daily", f"WITH {DAILY}, x AS (SELECT event_type, t, y - lag(y) OVER w AS f FROM d WINDOW w AS (PARTITION BY event_type ORDER BY t)) SELECT event_type, t, round(f - lag(f, 7) OVER (PARTITION BY event_type ORDER BY t), 6) AS diff FROM x", 6)
def differences_daily(spark, d):
    return R.differenced(daily(spark, d), "y", ["event_type"], ["t"], 1, 1, 7).select("event_type", "t", "diff")


@query("lags_and_trend", f"WITH {DAILY} SELECT event_type, t, round(lag(y, 1) OVER w, 6) AS y_lag1, round(lag(y, 3) OVER w, 6) AS y_lag3, 1.0::DOUBLE AS const, (t + 1)::DOUBLE AS trend, ((t + 1) * (t + 1))::DOUBLE AS trend_squared FROM d WINDOW w AS (PARTITION BY event_type ORDER BY t)", 6)
def lags_and_trend(spark, d):
    out = R.trend_columns(R.lagged(daily(spark, d), "y", [1, 3], ["event_type"], ["t"]), ["event_type"], ["t"], "ctt")
    return out.drop("y", "period")


@query("slice_daily", f"WITH {DAILY} SELECT event_type, t, round(y, 6) AS y FROM d WHERE t >= 5 AND t < 12", 6)
def slice_daily(spark, d):
    return R.slice_rows(daily(spark, d), 5, 12, ["event_type"], ["t"]).drop("period")


@query("boxcox_orders", "SELECT o_orderkey, round((o_totalprice ** 0.5 - 1) / 0.5, 6) AS half, round(ln(o_totalprice), 8) AS log FROM orders WHERE o_totalprice > 0")
def boxcox_orders(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 0")
    return o.select("o_orderkey", F.round(R.box_cox(F.col("o_totalprice"), 0.5), 6).alias("half"), F.round(R.box_cox(F.col("o_totalprice"), 0), 8).alias("log"))


@query("moving_average_lowpass", f"WITH {DAILY} SELECT event_type, t, round(CASE WHEN count(*) OVER w = 7 THEN avg(y) OVER w END, 6) AS average FROM d WINDOW w AS (PARTITION BY event_type ORDER BY t ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)", 6)
def moving_average_lowpass(spark, d):
    return R.moving_average(daily(spark, d), "y", 7, ["event_type"], ["t"]).select("event_type", "t", "average")


COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("pearson_matrix", " UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS i, '{b}' AS j, " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 8)") + " AS value FROM lineitem GROUP BY 1" for a in COLS for b in COLS), 8)
def pearson_matrix(spark, d):
    return C.pearson_matrix(table(spark, d, "lineitem"), COLS, ["l_returnflag"])


@query("spearman_by_segment", """WITH j AS (SELECT c_mktsegment, c_acctbal, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY c_mktsegment, o_totalprice) - 1) / 2.0::DOUBLE AS b FROM j)
SELECT c_mktsegment, count(*) AS n, round(corr(a, b), 8) AS rho FROM k GROUP BY 1""", 8)
def spearman_by_segment(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return C.spearman(j, "c_acctbal", "o_totalprice", ["c_mktsegment"])


@query("kendall_tau_b", """WITH p AS (SELECT a.s_nationkey AS x1, b.s_nationkey AS x2, a.s_acctbal AS y1, b.s_acctbal AS y2 FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey),
s AS (SELECT sum(sign(x1 - x2) * sign(y1 - y2)) AS c, sum((x1 <> x2)::INT) AS nx, sum((y1 <> y2)::INT) AS ny FROM p) SELECT (SELECT count(*) FROM supplier) AS n, round(c / sqrt(nx::DOUBLE * ny), 8) AS tau FROM s""", 8)
def kendall_tau_b(spark, d):
    return C.kendall(table(spark, d, "supplier"), "s_nationkey", "s_acctbal").select("n", "tau")


LAGS = "c AS (SELECT event_type, t, y - avg(y) OVER (PARTITION BY event_type) AS z, count(*) OVER (PARTITION BY event_type) AS n FROM d), k AS (SELECT unnest(range(0, 7)) AS lag), p AS (SELECT a.event_type, k.lag, any_value(a.n) AS n, sum(a.z * b.z) AS p FROM c a CROSS JOIN k JOIN c b ON b.event_type = a.event_type AND b.t = a.t - k.lag GROUP BY 1, 2), v AS (SELECT event_type, p AS p0 FROM p WHERE lag = 0), a AS (SELECT event_type, lag::INT AS lag, n, p / p0 AS r FROM p JOIN v USING (event_type))"


@query("acovf_daily", f"WITH {DAILY}, {LAGS} SELECT event_type, lag::INT AS lag, round(p / (n - lag), 4) AS value FROM p", 4)
def acovf_daily(spark, d):
    return C.autocovariance(daily(spark, d), "y", 6, ["event_type"], adjusted=True)


@query("acf_daily", f"""WITH {DAILY}, {LAGS}, s AS (SELECT *, CASE WHEN lag = 0 THEN 0 ELSE sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN r * r ELSE 0 END) OVER (PARTITION BY event_type ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS se FROM a)
SELECT event_type, lag, round(r, 8) AS value, round(r - 1.959963984540054 * se, 8) AS ci_low, round(r + 1.959963984540054 * se, 8) AS ci_high, CASE WHEN lag > 0 THEN round(n * (n + 2) * sum(CASE WHEN lag > 0 THEN r * r / (n - lag) ELSE 0 END) OVER (PARTITION BY event_type ORDER BY lag), 8) END AS q_stat FROM s""", 8)
def acf_daily(spark, d):
    return C.autocorrelation(daily(spark, d), "y", 6, ["event_type"])


@query("ccf_daily", f"""WITH {DAILY}, w AS (SELECT event_type, t, y, lead(y) OVER (PARTITION BY event_type ORDER BY t) AS x FROM d), q AS (SELECT * FROM w WHERE x IS NOT NULL),
c AS (SELECT event_type, t, y - avg(y) OVER g AS zy, x - avg(x) OVER g AS zx, count(*) OVER g AS n FROM q WINDOW g AS (PARTITION BY event_type)), k AS (SELECT unnest(range(0, 5)) AS lag),
s AS (SELECT event_type, sqrt(avg(zx * zx)) AS sx, sqrt(avg(zy * zy)) AS sy FROM c GROUP BY 1)
SELECT a.event_type, k.lag::INT AS lag, round(sum(a.zx * b.zy) / (any_value(a.n) - k.lag) / (any_value(sx) * any_value(sy)), 8) AS value FROM c a CROSS JOIN k JOIN c b ON b.event_type = a.event_type AND b.t = a.t - k.lag JOIN s ON s.event_type = a.event_type GROUP BY a.event_type, k.lag""", 8)
def ccf_daily(spark, d):
    w = W.partitionBy("event_type").orderBy("t")
    both = daily(spark, d).withColumn("x", F.lead("y").over(w)).where("x is not null")
    return C.cross_correlation(both, "x", "y", 4, ["event_type"])


@query("pacf_daily")
def pacf_daily(spark, d):
    return C.partial_autocorrelation(daily(spark, d), "y", 6, ["event_type"])


BOX = f"WITH {DAILY}, {LAGS} SELECT event_type, lag, round(n * (n + 2) * sum(r * r / (n - lag)) OVER w, 8) AS lb_stat, round(n * sum(r * r) OVER w, 8) AS bp_stat FROM a WHERE lag > 0 WINDOW w AS (PARTITION BY event_type ORDER BY lag)"


@query("ljung_box_daily", BOX, 8)
def ljung_box_daily(spark, d):
    return H.box(daily(spark, d), "y", 6, ["event_type"]).drop("lb_p", "bp_p")


@query("durbin_watson", f"WITH {RESID}, s AS (SELECT event_type, e, e - lag(e) OVER (PARTITION BY event_type ORDER BY t) AS x FROM r) SELECT event_type, round(sum(x * x) / sum(e * e), 8) AS statistic FROM s GROUP BY 1", 8)
def durbin_watson(spark, d):
    return H.durbin_watson(resid(spark, d), "e", ["event_type"])


MOM = f"WITH {RESID}, z AS (SELECT event_type, e - avg(e) OVER (PARTITION BY event_type) AS z FROM r), m AS (SELECT event_type, count(*) AS n, avg(z * z) AS m2, avg(z ** 3) AS m3, avg(z ** 4) AS m4 FROM z GROUP BY 1), k AS (SELECT event_type, n::DOUBLE AS n, m3 / m2 ** 1.5 AS s, m4 / (m2 * m2) AS k FROM m)"


@query("jarque_bera", f"{MOM}, j AS (SELECT *, n / 6 * (s * s + (k - 3) ** 2 / 4) AS jb FROM k) SELECT event_type, round(jb, 6) AS statistic, round(exp(-jb / 2), 6) AS p_value, round(s, 6) AS skew, round(k, 6) AS kurtosis FROM j", 6)
def jarque_bera(spark, d):
    return H.jarque_bera(resid(spark, d), "e", ["event_type"])


@query("omnibus", f"""{MOM}, a AS (SELECT *, s * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2, 3 * (n - 1) / (n + 1) AS mu, 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS v,
6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1 FROM k), b AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, (k - mu) / sqrt(v) AS x, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS q FROM a),
c AS (SELECT *, 1 / sqrt(ln(sqrt(w2))) AS delta, sqrt(2 / (w2 - 1)) AS alpha, 1 + x * sqrt(2 / (q - 4)) AS den FROM b),
zz AS (SELECT event_type, delta * ln(y / alpha + sqrt((y / alpha) ** 2 + 1)) AS zs, (1 - 2 / (9 * q) - sign(den) * pow((1 - 2 / q) / abs(den), 1.0::DOUBLE / 3)) / sqrt(2 / (9 * q)) AS zk FROM c)
SELECT event_type, round(zs * zs + zk * zk, 6) AS statistic, round(exp(-(zs * zs + zk * zk) / 2), 6) AS p_value FROM zz""", 6)
def omnibus(spark, d):
    return H.omnibus(resid(spark, d), "e", ["event_type"])


@query("cusum_stat", f"WITH {RESID}, s AS (SELECT event_type, e, sum(e) OVER (PARTITION BY event_type ORDER BY t) AS c FROM r) SELECT event_type, round(max(abs(c)) / sqrt(sum(e * e)), 6) AS statistic FROM s GROUP BY 1", 6)
def cusum_stat(spark, d):
    return H.cusum(resid(spark, d), "e", ["event_type"]).select("event_type", "statistic")


@query("break_variance", f"WITH {RESID}, h AS (SELECT *, round(n / 3.0) AS h FROM r) SELECT event_type, round(sum(CASE WHEN t > n - h THEN e * e END) / sum(CASE WHEN t <= h THEN e * e END), 6) AS statistic, sum((t > n - h)::INT)::DOUBLE AS df_num, sum((t <= h)::INT)::DOUBLE AS df_den FROM h GROUP BY 1", 6)
def break_variance(spark, d):
    return H.break_variance(resid(spark, d), "e", ["event_type"]).drop("p_value")


@query("ols_simple", "SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, count(*) AS n_obs FROM lineitem GROUP BY 1")
def ols_simple(spark, d):
    fit = G.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    pick = lambda t: F.max(F.when(F.col("term") == t, F.col("coef")))
    return fit.groupBy("l_returnflag").agg(F.round(pick("const"), 4).alias("intercept"), F.round(pick("l_quantity"), 4).alias("slope"), F.round(F.max("r2"), 8).alias("r2"), F.max("n_obs").alias("n_obs"))


TWO = """WITH s AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_discount, l_discount) AS c,
covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q, covar_pop(l_extendedprice, l_extendedprice) AS v FROM lineitem GROUP BY 1),
f AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS b1, (q * a - p * b) / (a * c - b * b) AS b2 FROM s), k AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (b1 * p + b2 * q) / v AS r2 FROM f),
e AS (SELECT l_returnflag AS g, l_extendedprice - b0 - b1 * l_quantity - b2 * l_discount AS e, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS t FROM lineitem JOIN k ON k.g = l_returnflag),
x AS (SELECT g, e, e - lag(e) OVER (PARTITION BY g ORDER BY t) AS de, e - avg(e) OVER (PARTITION BY g) AS z FROM e), m AS (SELECT g, count(*) AS n, sum(de * de) / sum(e * e) AS dw, avg(z * z) AS m2, avg(z ** 3) AS m3, avg(z ** 4) AS m4 FROM x GROUP BY 1)
SELECT k.g AS l_returnflag, round(b0, 3) AS b_const, round(b1, 3) AS b_quantity, round(b2, 3) AS b_discount, round(r2, 8) AS r2, round(dw, 6) AS durbin_watson, round(m.n / 6.0::DOUBLE * ((m3 / m.m2 ** 1.5) ** 2 + (m4 / (m.m2 * m.m2) - 3) ** 2 / 4), 3) AS jarque_bera FROM k JOIN m ON m.g = k.g"""


@query("ols_two_regressors", TWO)
def ols_two_regressors(spark, d):
    """The flagship: a regression per flag with Durbin-Watson and Jarque-Bera of its residuals in order."""
    rows, xs, by = table(spark, d, "lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"]
    fit = G.ols(rows, "l_extendedprice", xs, by)
    pick = lambda t: F.round(F.max(F.when(F.col("term") == t, F.col("coef"))), 3)
    wide = fit.groupBy("l_returnflag").agg(pick("const").alias("b_const"), pick("l_quantity").alias("b_quantity"), pick("l_discount").alias("b_discount"), F.round(F.max("r2"), 8).alias("r2"))
    e = G.residuals(rows, "l_extendedprice", xs, by)
    dw = H.durbin_watson(e, "residual", by, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_returnflag", F.round("statistic", 6).alias("durbin_watson"))
    jb = H.jarque_bera(e, "residual", by).select("l_returnflag", F.round("statistic", 3).alias("jarque_bera"))
    return wide.join(dw, "l_returnflag").join(jb, "l_returnflag")


@query("wls_simple", """WITH s AS (SELECT l_returnflag, sum(l_quantity) AS w, sum(l_quantity * l_discount) / sum(l_quantity) AS mx, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS my FROM lineitem GROUP BY 1),
b AS (SELECT l.l_returnflag, any_value(mx) AS mx, any_value(my) AS my, sum(l_quantity * (l_discount - mx) * (l_extendedprice - my)) / sum(l_quantity * (l_discount - mx) ** 2) AS b FROM lineitem l JOIN s USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, round(my - b * mx, 3) AS intercept, round(b, 3) AS slope FROM b""")
def wls_simple(spark, d):
    fit = G.wls(table(spark, d, "lineitem"), "l_extendedprice", ["l_discount"], "l_quantity", ["l_returnflag"])
    pick = lambda t: F.round(F.max(F.when(F.col("term") == t, F.col("coef"))), 3)
    return fit.groupBy("l_returnflag").agg(pick("const").alias("intercept"), pick("l_discount").alias("slope"))


@query("ols_predict", """WITH f AS (SELECT p_brand, regr_intercept(p_retailprice, p_size) AS a, regr_slope(p_retailprice, p_size) AS b, count(*) AS n, avg(p_size) AS mx, regr_sxx(p_retailprice, p_size) AS sxx, regr_syy(p_retailprice, p_size) AS syy, regr_sxy(p_retailprice, p_size) AS sxy FROM part GROUP BY 1),
g AS (SELECT *, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM f), h AS (SELECT p_partkey, a + b * p_size AS mean, s2 * (1.0::DOUBLE / n + (p_size - mx) ** 2 / sxx) AS pv, s2 FROM part JOIN g USING (p_brand))
SELECT p_partkey, round(mean, 4) AS mean, round(pv, 4) AS param_var, round(mean - 2 * sqrt(pv + s2), 4) AS ci_low, round(mean + 2 * sqrt(pv + s2), 4) AS ci_high FROM h""", 4)
def ols_predict(spark, d):
    p = table(spark, d, "part")
    return G.predict(p, p, "p_retailprice", ["p_size"], ["p_brand"], t=2.0).select("p_partkey", "mean", "param_var", "ci_low", "ci_high")


SIMPLE = "b AS (SELECT l_returnflag, regr_intercept(l_extendedprice, l_quantity) AS i, regr_slope(l_extendedprice, l_quantity) AS s FROM lineitem GROUP BY 1), e AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, i + s * l_quantity AS f, l_extendedprice - i - s * l_quantity AS e FROM lineitem JOIN b USING (l_returnflag))"


def _simple(spark, d):
    return G.residuals(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_returnflag"])


@query("bp_lm", f"WITH {SIMPLE} SELECT l_returnflag, round(count(*) * regr_r2(e * e, x), 4) AS statistic FROM e GROUP BY 1", 4)
def bp_lm(spark, d):
    return H.breusch_pagan(_simple(spark, d), "residual", ["l_quantity"], ["l_returnflag"]).select("l_returnflag", "statistic")


R2 = "(({p} * {p} * {c} - 2 * {p} * {q} * {b} + {q} * {q} * {a}) / ({a} * {c} - {b} * {b}) / {v})".format(a="covar_pop(u, u)", b="covar_pop(u, w)", c="covar_pop(w, w)", p="covar_pop(u, z)", q="covar_pop(w, z)", v="covar_pop(z, z)")


@query("white_lm_squares", f"WITH {SIMPLE}, k AS (SELECT l_returnflag, x AS u, x * x AS w, e * e AS z FROM e) SELECT l_returnflag, round(count(*) * {R2}, 4) AS statistic FROM k GROUP BY 1", 4)
def white_lm_squares(spark, d):
    return H.white(_simple(spark, d), "residual", ["l_quantity"], ["l_returnflag"], cross=False).select("l_returnflag", "statistic")


@query("reset_one_power", f"WITH {SIMPLE}, k AS (SELECT l_returnflag, x AS u, f * f AS w, y AS z FROM e), r AS (SELECT l_returnflag, count(*) AS n, {R2} AS r1, regr_r2(z, u) AS r0 FROM k GROUP BY 1) SELECT l_returnflag, round((r1 - r0) / (1 - r1) * (n - 3), 4) AS statistic FROM r", 4)
def reset_one_power(spark, d):
    return H.reset(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_returnflag"], (2,)).select("l_returnflag", "statistic")


@query("arch_lm1", f"WITH {RESID}, k AS (SELECT event_type, e * e AS z, lag(e * e) OVER (PARTITION BY event_type ORDER BY t) AS u FROM r) SELECT event_type, round(count(u) * regr_r2(z, u), 6) AS statistic FROM k GROUP BY 1", 6)
def arch_lm1(spark, d):
    return H.arch_lm(resid(spark, d), "e", 1, ["event_type"]).select("event_type", "statistic")


@query("bg_lm1", f"WITH {RESID}, k AS (SELECT event_type, e AS z, coalesce(lag(e) OVER (PARTITION BY event_type ORDER BY t), 0) AS u FROM r) SELECT event_type, round(count(*) * regr_r2(z, u), 6) AS statistic FROM k GROUP BY 1", 6)
def bg_lm1(spark, d):
    return H.breusch_godfrey(resid(spark, d), "e", [], 1, ["event_type"]).select("event_type", "statistic")


@query("granger_lag1_ssr", f"""WITH {DAILY}, j AS (SELECT a.t, a.y AS z, lag(a.y) OVER (ORDER BY a.t) AS u, lag(b.y) OVER (ORDER BY a.t) AS w FROM d a JOIN d b USING (t) WHERE a.event_type = 'click' AND b.event_type = 'view'),
k AS (SELECT * FROM j WHERE u IS NOT NULL), r AS (SELECT count(*) AS n, {R2} AS r1, regr_r2(z, u) AS r0 FROM k) SELECT 1::INT AS lag, round((r1 - r0) / (1 - r1) * (n - 3), 6) AS ssr_f, round(n * (r1 - r0) / (1 - r1), 6) AS ssr_chi2 FROM r""", 6)
def granger_lag1_ssr(spark, d):
    s = daily(spark, d)
    j = s.where("event_type = 'click'").select("t", F.col("y").alias("a")).join(s.where("event_type = 'view'").select("t", F.col("y").alias("b")), "t")
    return H.granger(j, "a", "b", 1).select("lag", "ssr_f", "ssr_chi2")


@query("adf_nolag_stat", f"""WITH {DAILY}, k AS (SELECT event_type, y - lag(y) OVER w AS z, lag(y) OVER w AS u FROM d WINDOW w AS (PARTITION BY event_type ORDER BY t)), s AS (SELECT event_type, regr_slope(z, u) AS b, regr_sxx(z, u) AS sxx, regr_syy(z, u) AS syy, regr_sxy(z, u) AS sxy, count(u) AS n FROM k WHERE u IS NOT NULL GROUP BY 1)
SELECT event_type, round(b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) AS statistic FROM s""", 6)
def adf_nolag_stat(spark, d):
    return H.adf(daily(spark, d), "y", ["event_type"], max_lag=0, auto=None).select("event_type", "statistic")


@query("adf_daily")
def adf_daily(spark, d):
    return H.adf(daily(spark, d), "y", ["event_type"])


@query("kpss_fixed_lag", f"""WITH {DAILY}, c AS (SELECT event_type, t, y - avg(y) OVER (PARTITION BY event_type) AS e FROM d), s AS (SELECT event_type, e, sum(e) OVER w AS s, e * lag(e, 1) OVER w AS p1, e * lag(e, 2) OVER w AS p2, e * lag(e, 3) OVER w AS p3 FROM c WINDOW w AS (PARTITION BY event_type ORDER BY t))
SELECT event_type, round(sum(s * s) / (count(*) * count(*)) / ((sum(e * e) + 1.5 * sum(p1) + 1.0 * sum(p2) + 0.5 * sum(p3)) / count(*)), 6) AS statistic FROM s GROUP BY 1""", 6)
def kpss_fixed_lag(spark, d):
    return H.kpss_fixed(daily(spark, d), "y", 3, ["event_type"])


@query("kpss_daily")
def kpss_daily(spark, d):
    return H.kpss(daily(spark, d), "y", ["event_type"])


@query("instantaneous_causality", f"WITH {DAILY}, j AS (SELECT a.y AS a, b.y AS b FROM d a JOIN d b USING (t) WHERE a.event_type = 'click' AND b.event_type = 'view') SELECT round(count(*) * corr(a, b) ** 2, 6) AS statistic FROM j", 6)
def instantaneous_causality(spark, d):
    return H.instantaneous_causality(_pair(spark, d), "a", "b").select("statistic")


def _pair(spark, d):
    s = daily(spark, d)
    return s.where("event_type = 'click'").select("t", F.col("y").alias("a")).join(s.where("event_type = 'view'").select("t", F.col("y").alias("b")), "t")


@query("cointegration")
def cointegration(spark, d):
    return H.cointegration(_pair(spark, d), "a", "b")


@query("johansen")
def johansen(spark, d):
    return H.johansen(_pair(spark, d), ["a", "b"])
