"""Functions of a lineitem column give a value for every row."""

import math

import pytest

from quillon.functions import dist
from quillon.plans import kernels
from quillon.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "each"), [("dist_exponential_rows", 1), ("dist_beta_pdf_rows", 1), ("special_functions", 1), ("dist_all_special", 23)])
def test_every_row(spark, name, each):
    keys = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    made = QUERIES[name](spark, SF)
    assert made.count() == each * keys.count() and made.select("l_orderkey", "l_linenumber").exceptAll(keys.crossJoin(spark.range(each)).select(*keys.columns)).isEmpty()


@pytest.mark.parametrize("few", [4096, 0])
def test_different_values_are_worked_out_once(spark, tmp_path, monkeypatch, few):
    """Rows, repeated keys and nulls among them, take the values of their quantity, whether it goes to them as a broadcast or not."""
    units = {"normal": (25, 10), "beta": (2, 3), "poisson": (20,)}
    monkeypatch.setattr(kernels, "UNITS", units)
    monkeypatch.setattr(kernels, "FEW", few, raising=False)
    given = [(k // 2, 1, None if k % 9 == 0 else float(k % 4 + 1)) for k in range(60)]
    spark.createDataFrame(given, "l_orderkey long, l_linenumber int, l_quantity double").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = QUERIES["dist_all_special"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == plan.count("Aggregate [") == len(units)  # Python sees no row twice
    got = sorted(((r.name, r.l_orderkey, r.x if r.x is not None else -1.0, r.pdf, r.quantile) for r in made.collect()), key=lambda r: r[:3])
    want = sorted(((n, k, -1.0 if x is None else x) for n in units for k, _, x in given))
    assert [r[:3] for r in got] == want
    for n, _, x, pdf, quantile in got:
        if x < 0:
            assert pdf is None and quantile is None
        else:
            p = (x - 0.5) / 50
            assert math.isclose(pdf, dist.REGISTRY[n].pdf(p if n == "beta" else x, *units[n])) and math.isclose(quantile, dist.REGISTRY[n].quantile(p, *units[n]), rel_tol=1e-9, abs_tol=1e-9)
