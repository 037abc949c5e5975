"""Spectra of series of any length."""

import datetime

import numpy as np

from quillon.plans.queries import QUERIES


def test_spectrum_takes_each_series_own_length(spark, tmp_path):
    rng = np.random.default_rng(5)
    series = {"a": rng.standard_normal(41), "b": rng.standard_normal(7)}
    day = datetime.datetime(2024, 1, 1)
    rows = [(k, day + datetime.timedelta(days=i), float(v)) for k, y in series.items() for i, v in enumerate(y)]
    spark.createDataFrame(rows, "event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    made = QUERIES["dft_power"](spark, str(tmp_path)).toPandas()
    for k, y in series.items():
        own = made[made["event_type"] == k].sort_values("k")
        assert len(own) == len(y) and np.allclose(own["re"] + 1j * own["im"], np.fft.fft(y), atol=1e-4)
