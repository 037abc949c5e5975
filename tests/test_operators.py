"""Operators on DataFrames: groups, missing values, sources, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon import sources
from quillon.operators import correlation as C
from quillon.operators import hypothesis as H
from quillon.operators import optimise as O
from quillon.operators import particle, quadrature, statespace
from quillon.operators import reductions as R
from quillon.operators import regression as G
from quillon.operators.common import missing, per_group
from quillon.streaming import online


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    rows = [(g, t, float(v)) for g, scale in (("a", 1.0), ("b", 3.0)) for t, v in enumerate(scale * np.cumsum(rng.standard_normal(40)))]
    return spark.createDataFrame(rows, "g string, t int, y double")


def test_missing_policies(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert missing(df, ["x"]).count() == 1 and missing(df, ["x"], "none").where("x is null").count() == 2
    with pytest.raises(Exception, match="missing value in x"):
        missing(df, ["x"], "raise").collect()
    with pytest.raises(ValueError):
        missing(df, ["x"], "guess")


def test_groups_and_no_groups(series):
    grouped = C.partial_autocorrelation(series, "y", 3, ["g"]).collect()
    whole = C.partial_autocorrelation(series.where("g = 'a'"), "y", 3).collect()
    assert [r["value"] for r in grouped if r["g"] == "a"] == pytest.approx([r["value"] for r in whole])
    assert per_group(series, ["g"], ["t"], lambda p: p.head(1)[["y"]], "y double", ["y"]).count() == 2


def test_weighted_regression_repeats_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(float(x), float(2 * x + 1 + rng.standard_normal()), int(w)) for x, w in zip(rng.standard_normal(50), rng.integers(1, 4, 50), strict=True)]
    df = spark.createDataFrame(rows, "x double, y double, w int")
    weighted = {r["term"]: r["coef"] for r in G.wls(df, "y", ["x"], "w").collect()}
    repeated = {r["term"]: r["coef"] for r in G.ols(df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w")))), "y", ["x"]).collect()}
    assert weighted == pytest.approx(repeated)
    same = {r["term"]: r["coef"] for r in G.gls(df.withColumn("t", F.monotonically_increasing_id()), "y", ["x"], np.eye(50)).collect()}
    assert same == pytest.approx({r["term"]: r["coef"] for r in G.ols(df, "y", ["x"]).collect()})


def test_collinear_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 3.0 * i + (-1) ** i) for i in range(20)], "x double, z double, y double")
    row = G.ols(df, "y", ["x", "z"]).first()
    assert row["rank"] == 2 and 0.98 < row["r2"] <= 1


def test_residual_tests(series):
    e = G.residuals(series, "y", ["t"], ["g"])
    assert H.durbin_watson(e, "residual", ["g"]).count() == 2
    assert all(0 <= r["p_value"] <= 1 for r in H.cusum(e, "residual", ["g"]).collect())
    for made in (H.breusch_pagan(e, "residual", ["t"], ["g"], robust=False), H.white(e, "residual", ["t"], ["g"]), H.arch_lm(e, "residual", 2, ["g"]), H.breusch_godfrey(e, "residual", ["t"], 2, ["g"]), H.break_variance(e, "residual", ["g"])):
        assert all(0 <= r["p_value"] <= 1 for r in made.collect())


def test_correlations_agree(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.integers(0, 8, (60, 2))], "x double, y double")
    pairs = df.alias("a").crossJoin(df.alias("b"))
    sign = F.sum(F.signum(F.col("a.x") - F.col("b.x")) * F.signum(F.col("a.y") - F.col("b.y")))
    nx, ny = F.count_if(F.col("a.x") != F.col("b.x")), F.count_if(F.col("a.y") != F.col("b.y"))
    want = pairs.agg((sign / F.sqrt(nx.cast("double") * ny)).alias("t")).first()["t"]
    assert C.kendall(df, "x", "y").first()["tau"] == pytest.approx(want)
    assert C.kendall_matrix(df, ["x", "y"]).where("i <> j").first()["value"] == pytest.approx(want)
    assert abs(C.spearman(df, "x", "y").first()["rho"]) <= 1
    full = C.correlate_rows(df.select(F.monotonically_increasing_id().alias("t"), F.col("x").alias("y")).limit(3), df.select(F.monotonically_increasing_id().alias("t"), "y").limit(3))
    assert full.count() >= 3


def test_sampled_integrals_match_functions(spark):
    x = np.linspace(0, 1, 21)
    df = spark.createDataFrame([(i, float(v**3)) for i, v in enumerate(x)], "t int, y double")
    assert quadrature.simpson(df, "y", dx=0.05).first()["value"] == pytest.approx(0.25)
    assert quadrature.trapezoid(df, "y", dx=0.05).first()["value"] == pytest.approx(0.25, abs=1e-3)
    assert quadrature.cumulative_simpson(df, "y", dx=0.05).orderBy("t").collect()[-1]["cumulative"] == pytest.approx(0.25, abs=1e-4)
    assert quadrature.gauss_table(spark, "legendre", 5).agg(F.sum("w")).first()[0] == pytest.approx(2)


def test_regular_series_fills_gaps(spark):
    df = spark.createDataFrame([("2024-01-01 05:00", 1.0), ("2024-01-04 01:00", 2.0), ("2024-01-04 03:00", 3.0)], "ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    out = sources.regular_series(df, "ts", F.col("v"), fill=0.0).orderBy("t").collect()
    assert [r["y"] for r in out] == [1.0, 0.0, 0.0, 5.0] and [r["t"] for r in out] == [0, 1, 2, 3]


def test_sources_and_sinks(spark, series, tmp_path):
    for kind, read in (("csv", sources.read_csv), ("json", sources.read_json), ("parquet", sources.read_parquet)):
        path = str(tmp_path / kind)
        if kind == "csv":
            series.write.option("header", True).csv(path)
        else:
            sources.write(series, path, kind)
        assert read(spark, path).count() == 80


def test_cumulative_product_signs(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([2.0, -3.0, 0.5, 0.0, 4.0])], "t int, x double")
    out = [r["cumprod"] for r in R.cumulative_product(df, "x", [], ["t"]).orderBy("t").collect()]
    assert out == pytest.approx([2, -6, -3, 0, 0])


def test_minimise_over_rows(spark):
    df = spark.range(200).select((F.col("id") / 100).alias("x")).withColumn("y", 3 * F.col("x") - 1)
    r = O.minimise_over(df, lambda a, b: F.pow(F.col("y") - a - b * F.col("x"), 2), ["a", "b"], [0.0, 0.0])
    assert r.ok and np.allclose(r.x, [-1, 3], atol=1e-3)


def run_stream(spark, tmp_path, make, name):
    rng = np.random.default_rng(1)
    rows = [("k" if i % 2 else "j", i, float(v)) for i, v in enumerate(np.cumsum(rng.standard_normal(40)))]
    df = spark.createDataFrame(rows, "g string, t int, y double")
    for part in range(2):
        df.where(f"t % 40 between {part * 20} and {part * 20 + 19}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df, spark.table(name).toPandas()


def test_online_kalman_equals_batch(spark, tmp_path):
    model = statespace.local_level(1.0, 0.5, False, 0.0, 10.0)
    df, got = run_stream(spark, tmp_path, lambda s: online.online_kalman(s, model, "g", "t", "y"), "kalman_out")
    want = statespace.filter_series(df, "y", model, ["g"], smooth=False).toPandas()
    both = got.merge(want, on=["g", "t"], suffixes=("", "_w"))
    assert len(both) == 40 and np.allclose(both["filtered"], both["filtered_w"]) and np.allclose(both["loglik"], both["loglik_w"])


def test_online_particles(spark, tmp_path):
    _, got = run_stream(spark, tmp_path, lambda s: online.online_particles(s, lambda: particle.linear_gauss(0.95, 1.0, 0.7), "g", "t", "y", 300), "particles_out")
    assert len(got) == 40 and got["ess"].between(1, 300).all() and math.isfinite(got["loglik"].sum())


def test_correlation_p_values(spark):
    rng = np.random.default_rng(12)
    rows = [("a", float(u), float(u + 3 * v)) for u, v in rng.standard_normal((40, 2))] + [("b", 1.0, float(v)) for v in range(5)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = {r["g"]: r for r in C.pearson_test(df, "x", "y", ["g"]).collect()}
    r, n = out["a"]["r"], 40
    from quillon.functions import dist

    assert out["a"]["p_value"] == pytest.approx(float(dist.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)), rel=1e-6) and out["b"]["p_value"] is None
    up, down = (C.spearman_test(df.where("g = 'a'"), "x", "y", alternative=a).first()["p_value"] for a in ("greater", "less"))
    assert up + down == pytest.approx(1)


def test_constant_columns_give_null(spark):
    df = spark.createDataFrame([("a", i, 2.0, float(i)) for i in range(12)], "g string, t int, x double, y double")
    assert C.pearson(df, "x", "y", ["g"]).first()["r"] is None and C.spearman(df, "x", "y", ["g"]).first()["rho"] is None
    assert C.autocorrelation(df, "x", 2, ["g"]).where("value is not null").count() == 0
    zero = df.withColumn("e", F.col("x") - 2)
    assert H.durbin_watson(zero, "e", ["g"]).first()["statistic"] is None and H.cusum(zero, "e", ["g"]).first()["statistic"] is None
    assert H.break_variance(zero, "e", ["g"]).first()["statistic"] is None and H.kpss_fixed(df, "x", 2, ["g"]).first()["statistic"] is None


def test_reset_where_fitted_values_hardly_move(spark):
    """A slope of 0.001 about 50,000: squares of the fitted values are a line but for 1e-13, and still add what x squared adds."""
    x = np.repeat(np.arange(1.0, 51.0), 2)
    y = 50_000 + 0.001 * x + np.where(np.arange(100) % 2, 1, -1) * (3 + x % 7) + 0.01 * ((x - 25.5) ** 2 - 208.25)
    u = x - x.mean()
    ssr = [((y - y.mean() - np.vander(u, k) @ np.linalg.lstsq(np.vander(u, k), y - y.mean(), rcond=None)[0]) ** 2).sum() for k in (2, 3)]
    got = H.reset(spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)], "g string, x double, y double"), "y", ["x"], ["g"], (2,)).collect()[0]
    assert math.isclose(got.statistic, (ssr[0] - ssr[1]) / ssr[1] * 97, rel_tol=1e-6) and (got.df_num, got.df_den) == (1, 97) and 0 < got.p_value < 1


def test_reset_is_null_where_powers_add_nothing(spark):
    groups = {"one value": [(5.0, float(i)) for i in range(8)], "two values": [(1.0 + i % 2, float(i * i % 7)) for i in range(9)], "no freedom": [(1.0, 2.0), (2.0, 5.0), (4.0, 7.0)], "flat": [(float(i), 3.0) for i in range(9)], "good": [(float(i), float(i * i % 7)) for i in range(9)]}
    got = {r.g: r.statistic for r in H.reset(spark.createDataFrame([(g, *r) for g, rows in groups.items() for r in rows], "g string, x double, y double"), "y", ["x"], ["g"], (2,)).collect()}
    assert {g for g, v in got.items() if v is None} == set(groups) - {"good"} and math.isclose(got["good"], 4.6519, abs_tol=1e-4)


def test_reset_powers_with_gaps(spark):
    """Powers that leave one out are those of the fitted values themselves."""
    x = np.arange(40.0)
    y = 3 + 2 * x + np.sin(x) + 0.001 * x**2
    f = np.polyval(np.polyfit(x, y, 1), x) / 80
    fit = [((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum() for m in (np.vander(f, 2), np.column_stack([np.vander(f, 2), f**3]))]
    got = H.reset(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double"), "y", ["x"], (), (3,)).collect()[0]
    assert math.isclose(got.statistic, (fit[0] - fit[1]) / fit[1] * 37, rel_tol=1e-6)
