"""Matrix products and decompositions: coordinate tables and sufficient statistics at scale, dense kernels per key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_group


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two coordinate matrices (i, j, value)."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("value").alias("u")), b.select(F.col("i").alias("k"), "j", F.col("value").alias("v"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("value"))


def gram_matrix(df: DataFrame, vector: str, width: int, centred: bool = False) -> DataFrame:
    """X'X, or the covariance, of array rows as i, j, value: width squared sums in one pass."""
    x = [F.get(vector, F.lit(i)) for i in range(width)]
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    cell = lambda i, j: F.covar_samp(x[i], x[j]) if centred else F.sum(x[i] * x[j])
    wide = df.agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), cell(i, j).alias("value")) for i, j in pairs]).alias("m"))
    half = wide.select(F.explode("m").alias("m")).select("m.*")
    return half.unionByName(half.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def gram(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """X'X of array rows of one length, over all components: ``by...``, i, j, value.

    Each task adds up its own rows' products, so half a matrix per task and key is shuffled.  Null arrays have no part in it;
    a null component makes its cells NaN, and arrays of several lengths are an error.
    """
    keys = list(by)
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)

    def cells(sums: dict, schema: pa.Schema) -> pa.RecordBatch:
        rows = {k: [] for k in [*keys, "i", "j", "value"]}
        for key, m in sums.items():
            i, j = np.triu_indices(len(m))
            for k, v in zip(keys, key, strict=True):
                rows[k] += [v] * len(i)
            rows["i"] += i.tolist()
            rows["j"] += j.tolist()
            rows["value"] += m[i, j].tolist()
        kind = {"i": pa.int32(), "j": pa.int32(), "value": pa.float64()}
        return pa.RecordBatch.from_arrays([pa.array(v, kind.get(k) or schema.field(k).type) for k, v in rows.items()], names=list(rows))

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            lengths = pc.min_max(pc.list_value_length(b.column(vector))).as_py()
            if lengths["min"] != lengths["max"]:
                raise ValueError(f"arrays of several lengths: {lengths}")
            x = b.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            codes: dict[tuple, int] = {}
            own = zip(*[b.column(k).to_pylist() for k in keys], strict=True) if keys else [()] * b.num_rows
            code = np.array([codes.setdefault(k, len(codes)) for k in own])
            for key, c in codes.items():
                part = x[code == c]
                if key in sums and sums[key].shape[0] != x.shape[1]:
                    raise ValueError(f"arrays of several lengths: {sums[key].shape[0]}, {x.shape[1]}")
                sums[key] = sums.get(key, 0.0) + part.T @ part
            if len(sums) > 256:
                yield cells(sums, b.schema)
                sums = {}
            schema = b.schema
        if sums:
            yield cells(sums, schema)

    some = df.select(*keys, vector).where(F.col(vector).isNotNull())
    half = some.mapInArrow(run, f"{kinds}i int, j int, value double").groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"))
    cell = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select(*keys, F.explode(cell).alias("c"), "value").select(*keys, "c.i", "c.j", "value")


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L, U and the row order, with partial pivoting."""
    u, n = np.array(a, float), len(a)
    low, order = np.eye(n), np.arange(n)
    for k in range(n - 1):
        p = k + int(np.abs(u[k:, k]).argmax())
        if u[p, k] == 0:
            continue
        if p != k:
            u[[k, p], k:], low[[k, p], :k], order[[k, p]] = u[[p, k], k:], low[[p, k], :k], order[[p, k]]
        low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :, k:] -= np.outer(low[k + 1 :, k], u[k, k:])
        u[k + 1 :, k] = 0.0
    return low, u, order


def _noise(a: np.ndarray) -> float:
    """What rounding leaves of a zero in a matrix of this size."""
    return len(a) * np.finfo(float).eps * float(np.abs(a).max(initial=0.0))


def ldl(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit lower triangle and diagonal of a symmetric matrix; a pivot that is zero, as is all below it, has a zero column."""
    a, n = np.array(a, float), len(a)
    low, d, zero = np.eye(n), np.zeros(n), 8 * _noise(a)
    for j in range(n):
        d[j] = a[j, j] - (low[j, :j] ** 2 * d[:j]).sum()
        rest = a[j + 1 :, j] - (low[j + 1 :, :j] * low[j, :j] * d[:j]).sum(axis=1)
        if abs(d[j]) <= zero and (np.abs(rest) <= zero).all():
            d[j] = 0.0
        else:
            low[j + 1 :, j] = rest / d[j]
    return low, d


def cholesky(a: np.ndarray) -> np.ndarray:
    """L of A = L L', also where a positive semidefinite A is singular; an indefinite A is an error."""
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        w, v = np.linalg.eigh(a)
        if w.min() < -8 * _noise(a):
            raise
    r = np.linalg.qr(np.sqrt(w.clip(min=0))[:, None] * v.T, mode="r")
    return (r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]).T


def qr_pivoted(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Q, R and column order by Householder steps on the column of largest remaining norm."""
    r = np.array(a, float)
    m, n = r.shape
    q, order = np.eye(m), np.arange(n)
    for k in range(min(m, n)):
        p = k + int((r[k:, k:] ** 2).sum(axis=0).argmax())
        r[:, [k, p]], order[[k, p]] = r[:, [p, k]], order[[p, k]]
        v = r[k:, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            break
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        r[k:] -= 2 * np.outer(v, v @ r[k:])
        q[:, k:] -= 2 * np.outer(q[:, k:] @ v, v)
    return q[:, : min(m, n)], np.triu(r[: min(m, n)]), order


def lq(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, r = np.linalg.qr(np.asarray(a).T)
    return r.T, q.T


def schur(a: np.ndarray, iterations: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Complex Schur form A = Z T Z* by shifted QR steps with deflation."""
    t = np.array(a, complex)
    n = len(t)
    z, hi, least = np.eye(n, dtype=complex), n - 1, np.finfo(float).eps * np.linalg.norm(t)
    for _ in range(iterations):
        while hi > 0 and np.abs(t[hi, :hi]).max() <= max(least, 1e-15 * (abs(t[hi, hi]) + abs(t[hi - 1, hi - 1]))):
            t[hi, :hi] = 0
            hi -= 1
        if hi == 0:
            break
        w = np.linalg.eigvals(t[hi - 1 : hi + 1, hi - 1 : hi + 1])
        shift = w[np.abs(w - t[hi, hi]).argmin()]
        q, r = np.linalg.qr(t[: hi + 1, : hi + 1] - shift * np.eye(hi + 1))
        t[: hi + 1, : hi + 1] = r @ q + shift * np.eye(hi + 1)
        t[: hi + 1, hi + 1 :] = q.conj().T @ t[: hi + 1, hi + 1 :]
        z[:, : hi + 1] = z[:, : hi + 1] @ q
    else:
        raise np.linalg.LinAlgError("no Schur form after the given iterations")
    return np.triu(t), z


def stable_subspace(a: np.ndarray, inside: str = "lhp") -> np.ndarray:
    """An orthonormal basis of the invariant subspace of eigenvalues in the left or right half plane, or inside or outside the unit circle."""
    w, v = np.linalg.eig(a)
    pick = {"lhp": w.real < 0, "rhp": w.real > 0, "iuc": np.abs(w) < 1, "ouc": np.abs(w) > 1}[inside]
    q, _ = np.linalg.qr(np.column_stack([v[:, pick].real, v[:, pick].imag]))
    u, s, _ = np.linalg.svd(np.column_stack([v[:, pick].real, v[:, pick].imag]), full_matrices=False)
    return u[:, : int(pick.sum())] if len(s) else q


def lyapunov(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """X with A X + X A' = -Q, by Kronecker's product."""
    n = len(a)
    k = np.kron(np.eye(n), a) + np.kron(a, np.eye(n))
    return np.linalg.solve(k, -np.asarray(q).ravel(order="F")).reshape(n, n, order="F")


def discrete_lyapunov(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """X with X = A X A' + Q, by doubling; LinAlgError if A isn't stable."""
    x, b = np.array(q), np.array(a)
    for _ in range(60):
        if not np.abs(b).max(initial=0.0) < 1e70:
            raise np.linalg.LinAlgError("the transition has a root on or outside the unit circle")
        step = b @ x @ b.conj().T
        x = x + step
        b = b @ b
        if np.abs(step).max() <= 1e-16 * max(1.0, np.abs(x).max()):
            break
    return (x + x.conj().T) / 2


def generalised_eigen(a: np.ndarray, b: np.ndarray, kind: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric-definite problems A v = w B v (1), A B v = w v (2), B A v = w v (3), reduced by Cholesky."""
    low = np.linalg.cholesky(b)
    if kind == 1:
        inner = np.linalg.solve(low, np.linalg.solve(low, np.asarray(a).T).T)
        w, y = np.linalg.eigh((inner + inner.T) / 2)
        return w, np.linalg.solve(low.T, y)
    w, y = np.linalg.eigh(low.T @ a @ low)
    return w, np.linalg.solve(low.T, y) if kind == 2 else low @ y


def generalised_pencil(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """alpha, beta and right vectors of A v beta = alpha B v; infinite eigenvalues have beta 0."""
    rng = np.random.default_rng(7)
    s, c = rng.standard_normal(2)
    w, v = np.linalg.eig(np.linalg.solve(c * np.asarray(b) + s * np.asarray(a), np.asarray(a)))  # w = alpha / (c beta + s alpha)
    return w, (1 - s * w) / c, v


def gsvd(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Generalised singular values of (A, B) with A = U diag(alpha) X', B = V diag(beta) X', from QR and the CS decomposition."""
    q, r = np.linalg.qr(np.vstack([a, b]))
    u, alpha, wt = np.linalg.svd(q[: len(a)], full_matrices=False)
    q2 = q[len(a) :] @ wt.T
    beta = np.linalg.norm(q2, axis=0)
    v = q2 / np.where(beta > 1e-14, beta, 1.0)
    return {"u": u, "v": v, "x": (wt @ r).T, "alpha": alpha, "beta": beta, "sigma": alpha / np.where(beta > 0, beta, np.nan)}


def decompose(df: DataFrame, kind: str, by: Sequence[str] = (), size: tuple[str, str, str] = ("i", "j", "value")) -> DataFrame:
    """Decompose each key's coordinate matrix: ``by...``, part, i, j, value.  A key's matrix must fit in one task.

    :param kind: lu, qr, lq, svd, cholesky, ldl, eigh, eig, schur (real and imaginary parts as ``part_re``, ``part_im``)
    """
    ci, cj, cv = size

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf[ci].max()) + 1, int(pdf[cj].max()) + 1))
        a[pdf[ci].to_numpy(int), pdf[cj].to_numpy(int)] = pdf[cv].to_numpy(float)
        if kind == "lu":
            low, up, order = lu(a)
            parts = {"l": low, "u": up, "p": order.astype(float)}
        elif kind == "qr":
            parts = dict(zip("qr", np.linalg.qr(a), strict=True))
        elif kind == "lq":
            parts = dict(zip("lq", lq(a), strict=True))
        elif kind == "svd":
            parts = dict(zip(("u", "s", "vt"), np.linalg.svd(a, full_matrices=False), strict=True))
        elif kind == "cholesky":
            parts = {"l": cholesky(a)}
        elif kind == "ldl":
            parts = dict(zip(("l", "d"), ldl(a), strict=True))
        elif kind == "eigh":
            parts = dict(zip(("values", "vectors"), np.linalg.eigh(a), strict=True))
        elif kind == "eig":
            w, v = np.linalg.eig(a)
            parts = {"values_re": w.real, "values_im": w.imag, "vectors_re": v.real, "vectors_im": v.imag}
        elif kind == "schur":
            t, z = schur(a)
            parts = {"t_re": t.real, "t_im": t.imag, "z_re": z.real, "z_im": z.imag}
        else:
            raise ValueError(f"unknown decomposition {kind!r}")
        rows = []
        for name, m in parts.items():
            m = m[:, None] if m.ndim == 1 else m
            i, j = np.indices(m.shape)
            rows.append(pd.DataFrame({"part": name, "i": i.ravel(), "j": j.ravel(), "value": m.ravel()}))
        return pd.concat(rows)

    return per_group(df, by, [], run, "part string, i int, j int, value double", [ci, cj, cv])
