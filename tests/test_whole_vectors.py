"""Vector queries over every component, not over a prefix."""

import numpy as np
import pytest

from quillon.operators import decomposition as D
from quillon.operators import fourier
from quillon.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    pdf = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    return np.stack(pdf["embedding"].to_list()).astype(float), pdf["label"].to_numpy(), pdf["vec_id"].to_numpy()


def dense(pdf, i="i", j="j"):
    out = np.full((pdf[i].max() + 1, pdf[j].max() + 1), np.nan)
    out[pdf[i], pdf[j]] = pdf["value"]
    return out


def test_transforms_and_products(spark, vectors):
    x, _, ids = vectors
    made = QUERIES["dct2_full"](spark, SF).toPandas()
    assert len(made) == x.size and np.allclose(dense(made, "vec_id", "k")[ids], fourier.dct(x), atol=1e-6)
    assert np.allclose(dense(QUERIES["gram_matrix_full"](spark, SF).toPandas()), x.T @ x, atol=1e-6)
    assert np.allclose(dense(QUERIES["matmul_coo_full"](spark, SF).toPandas())[ids], x @ (x.T @ x), atol=1e-5)
    e = QUERIES["vec_elementwise_full"](spark, SF).toPandas().sort_values(["vec_id", "i"])
    x = x[np.argsort(ids)]
    assert len(e) == x.size and np.allclose(e["axpy"].to_numpy().reshape(x.shape), 2 * x + np.roll(x, -1, axis=1), atol=1e-6)


def test_decompositions_use_all_components(spark, vectors):
    x, label, _ = vectors
    for kind, build in (("cholesky", lambda p: p["l"] @ p["l"].T), ("ldl", lambda p: p["l"] * p["d"].T @ p["l"].T), ("svd", lambda p: p["u"] * p["s"].T @ p["vt"]), ("schur", lambda p: ((z := p["z_re"] + 1j * p["z_im"]) @ (p["t_re"] + 1j * p["t_im"]) @ z.conj().T).real)):
        made = QUERIES[f"decompose_{kind}"](spark, SF).toPandas()
        for k in np.unique(label):
            own = made[made["label"] == k]
            got = build({p: dense(own[own["part"] == p]) for p in own["part"].unique()})
            assert got.shape == (64, 64) and np.allclose(got, x[label == k].T @ x[label == k], atol=1e-9), (kind, k)


def test_singular_and_indefinite():
    a = np.random.default_rng(1).standard_normal((3, 6))
    s = a.T @ a
    low, d = D.ldl(s)
    assert np.allclose(D.cholesky(s) @ D.cholesky(s).T, s) and np.allclose(low * d @ low.T, s) and np.allclose(np.triu(D.cholesky(s), 1), 0)
    with pytest.raises(np.linalg.LinAlgError):
        D.cholesky(np.diag([1.0, -1.0]))
