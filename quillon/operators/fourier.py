"""Fourier-type transforms of series: spectra in sums for short ones, fast transforms per series for long ones."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import per_group


def spectrum_by_sums(df: DataFrame, y: str, n: int | None = None, by: Sequence[str] = (), t: str = "t") -> DataFrame:
    """Discrete Fourier transform of series as sums over rows: ``by...``, k, re, im, power.

    :param n: rows of every series; None counts those of each, which takes a window and n rows a row
    """
    if n is None:
        size, k = "__n", "__k"
        w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
        rows = df.withColumn(size, F.count(F.lit(1)).over(w)).withColumn(k, F.explode(F.sequence(F.lit(0), F.col(size).cast("int") - 1)))
        angle = F.col(t) * F.col(k) * F.lit(-2 * math.pi) / F.col(size)
        out = rows.groupBy(*by, F.col(k).alias("k")).agg(F.sum(F.col(y) * F.cos(angle)).alias("re"), F.sum(F.col(y) * F.sin(angle)).alias("im"))
        return out.withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    angle = lambda k: F.col(t) * F.lit(-2 * math.pi * k / n)
    sums = [F.struct(F.lit(k).alias("k"), F.sum(F.col(y) * F.cos(angle(k))).alias("re"), F.sum(F.col(y) * F.sin(angle(k))).alias("im")) for k in range(n)]
    return df.groupBy(*by).agg(F.array(*sums).alias("s")).select(*by, F.explode("s").alias("s")).select(*by, "s.*", (F.col("s.re") * F.col("s.re") + F.col("s.im") * F.col("s.im")).alias("power"))


def dct2_array(x: Column, n: int) -> list[Column]:
    """Orthonormal DCT-II of an array column of n values, as n columns' expressions."""
    out = []
    for k in range(n):
        weights = F.array(*[F.lit(math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n))) for i in range(n)])
        out.append(F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return out


def dct_rows(df: DataFrame, key: str, vector: str, kind: int = 2) -> DataFrame:
    """All coefficients of the orthonormal cosine transform of each array row, of any length: ``key``, k, value.  Null and empty arrays give no rows."""

    def run(batches):
        for pdf in batches:
            sizes = pdf[vector].map(len)
            for n in sizes.unique():
                part = pdf[sizes == n]
                made = dct(np.stack(part[vector].to_list()), kind)
                yield pd.DataFrame({key: part[key].repeat(n).to_numpy(), "k": np.tile(np.arange(n), len(part)), "value": made.ravel()})

    return df.select(key, vector).where(F.size(vector) > 0).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, k int, value double")


def dct(x: np.ndarray, kind: int = 2) -> np.ndarray:
    """Orthonormal discrete cosine transform, types 1 to 4, along the last axis."""
    return np.asarray(x, float) @ _dct_matrix(np.shape(x)[-1], kind).T


def dst(x: np.ndarray, kind: int = 2) -> np.ndarray:
    """Orthonormal discrete sine transform, types 1 to 4."""
    return np.asarray(x, float) @ _dst_matrix(np.shape(x)[-1], kind).T


def idct(x: np.ndarray, kind: int = 2) -> np.ndarray:
    return dct(x, {1: 1, 2: 3, 3: 2, 4: 4}[kind])


def idst(x: np.ndarray, kind: int = 2) -> np.ndarray:
    return dst(x, {1: 1, 2: 3, 3: 2, 4: 4}[kind])


def _dct_matrix(n: int, kind: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    if kind == 1:
        edge = np.where((np.arange(n) == 0) | (np.arange(n) == n - 1), math.sqrt(0.5), 1.0)
        return math.sqrt(2 / (n - 1)) * edge[:, None] * edge[None, :] * np.cos(math.pi * k * i / (n - 1))
    if kind == 4:
        return math.sqrt(2 / n) * np.cos(math.pi * (2 * k + 1) * (2 * i + 1) / (4 * n))
    m = math.sqrt(2 / n) * np.cos(math.pi * (2 * i + 1) * k / (2 * n))
    m[0] *= math.sqrt(0.5)
    return m if kind == 2 else m.T


def _dst_matrix(n: int, kind: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    if kind == 1:
        return math.sqrt(2 / (n + 1)) * np.sin(math.pi * (k + 1) * (i + 1) / (n + 1))
    if kind == 4:
        return math.sqrt(2 / n) * np.sin(math.pi * (2 * k + 1) * (2 * i + 1) / (4 * n))
    m = math.sqrt(2 / n) * np.sin(math.pi * (2 * i + 1) * (k + 1) / (2 * n))
    m[-1] *= math.sqrt(0.5)
    return m if kind == 2 else m.T


def hartley(x: np.ndarray) -> np.ndarray:
    """Sum of x cos + x sin: real minus imaginary part of the Fourier transform."""
    f = np.fft.fft(x)
    return f.real - f.imag


def nd(x: np.ndarray, kind: str = "fft", axes: Sequence[int] | None = None) -> np.ndarray:
    """Transforms over several axes: fft, ifft, rfft, irfft or the separable hartley."""
    if kind == "hartley":
        for a in axes if axes is not None else range(np.ndim(x)):
            x = np.apply_along_axis(hartley, a, x)
        return x
    return {"fft": np.fft.fftn, "ifft": np.fft.ifftn, "rfft": np.fft.rfftn, "irfft": np.fft.irfftn}[kind](x, axes=axes)


TRANSFORMS = {
    "fft": np.fft.fft, "ifft": np.fft.ifft, "rfft": np.fft.rfft, "hartley": hartley,
    **{f"dct{k}": (lambda x, k=k: dct(x, k)) for k in (1, 2, 3, 4)}, **{f"dst{k}": (lambda x, k=k: dst(x, k)) for k in (1, 2, 3, 4)},
}


def transform(df: DataFrame, y: str, kind: str = "fft", by: Sequence[str] = (), order: Sequence[str] = ("t",)) -> DataFrame:
    """Any transform of each series: ``by...``, k, re, im, power.  Inverse transforms are scaled by 1 / n, cosine and sine ones orthonormal."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = TRANSFORMS[kind](pdf[y].to_numpy(float))
        return pd.DataFrame({"k": np.arange(len(z)), "re": np.real(z), "im": np.imag(z), "power": np.abs(z) ** 2})

    return per_group(df, by, order, run, "k int, re double, im double, power double", [y])
