"""Online filters: each key's filter state lives in Structured Streaming state and advances with its rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.particle import StateModel, log_sum_exp, normalise, resample
from ..operators.statespace import Model


def _stateful(rows: DataFrame, key: str, time: str, value: str, first: Callable, advance: Callable, schema: str) -> DataFrame:
    """Rows of a micro-batch go through ``advance(state, t, y)`` in time order; the state is carried, pickled, between batches."""
    kind = f"{key} {rows.schema[key].dataType.simpleString()}, t {rows.schema[time].dataType.simpleString()}, {schema}"
    names = [key, "t", *[c.strip().split(" ")[0] for c in schema.split(",")]]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        current = pickle.loads(bytes(state.get[0])) if state.exists else first(k[0])
        pdf = pd.concat(list(parts)).sort_values(time, kind="stable")
        out = []
        for t, y in zip(pdf[time], pdf[value].astype(float), strict=True):
            current, row = advance(current, y)
            out.append((k[0], t, *row))
        state.update((pickle.dumps(current),))
        yield pd.DataFrame(out, columns=names)

    some = rows.select(key, time, value)
    return some.groupBy(key).applyInPandasWithState(run, kind, "state binary", "append", GroupStateTimeout.NoTimeout)


def online_kalman(rows: DataFrame, model: Model, key: str, time: str, value: str) -> DataFrame:
    """Scalar-observation Kalman filter: key, t, predicted, filtered, variance, loglik."""
    z, h = model.design[0], float(model.obs_cov[0, 0])
    rqr = model.selection @ model.state_cov @ model.selection.T

    def first(_):
        return model.mean.copy(), model.cov + np.diag(model.diffuse) * 1e7

    def advance(state, y):
        a, p = state
        f, forecast, ll = float(z @ p @ z + h), float(z @ a), 0.0
        if not np.isnan(y):
            v, g = y - forecast, p @ z / f
            a, p = a + g * v, p - np.outer(g, p @ z)
            ll = -0.5 * (np.log(2 * np.pi * f) + v * v / f)
        row = (forecast, float(z @ a), float(z @ p @ z), float(ll))
        return (model.transition @ a + model.state_intercept, model.transition @ p @ model.transition.T + rqr), row

    return _stateful(rows, key, time, value, first, advance, "predicted double, filtered double, variance double, loglik double")


def online_particles(rows: DataFrame, make: Callable[[], StateModel], key: str, time: str, value: str, n: int = 500, seed: int = 0, essr_min: float = 0.5) -> DataFrame:
    """Bootstrap particle filter: key, t, mean, ess, loglik."""

    def first(_):
        return 0, None, np.full(n, -np.log(n)), np.random.default_rng(seed)

    def advance(state, y):
        model = make()
        t, x, logw, rng = state
        if x is None:
            x = model.start(rng, n)
        else:
            w = normalise(logw)
            if 1 / (w * w).sum() < essr_min * n:
                x, logw = x[resample(w, n, rng)], np.full(n, -np.log(n))
            x = model.move(rng, t, x)
        before = log_sum_exp(logw)
        logw = logw + (model.log_obs(t, x, y) if not np.isnan(y) else 0.0)
        ll = log_sum_exp(logw) - before
        w = normalise(logw)
        return (t + 1, x, np.log(np.maximum(w, 1e-300)), rng), (float(w @ x), float(1 / (w * w).sum()), float(ll))

    return _stateful(rows, key, time, value, first, advance, "mean double, ess double, loglik double")


def windowed_series(events: DataFrame, time: str, value: str, by: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Tumbling-window sums with a watermark: the regular series that online filters read."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.sum(value).alias("y"), F.count(F.lit(1)).alias("n")).select(*by, F.col("window.start").alias("start"), "y", "n")


def session_counts(events: DataFrame, time: str, by: list[str], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions that end after a gap without rows."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
