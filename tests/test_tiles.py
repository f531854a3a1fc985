"""Cross-products by tiles against NumPy on whole matrices, for more rows than columns and the other way round."""

import numpy as np
import pandas as pd
import pytest

from exprlake.operators import tiles as ti
from exprlake.operators import vectors as ve


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key int, vec array<double>").repartition(3)


@pytest.fixture(params=[(40, 7, 5), (9, 14, 11), (12, 20, 3)])
def both(request, spark, monkeypatch):
    monkeypatch.setattr(ti, "TILE", 4)
    monkeypatch.setattr(ve, "NARROW", 2)
    n, p, q = request.param
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, p)) * rng.exponential(size=p) + 3
    y = np.hstack([x[:, :2], rng.normal(size=(n, q))])[:, :q] + 0.3 * rng.normal(size=(n, q))
    return x - x.mean(0), y - y.mean(0), vectors(spark, x), vectors(spark, y)


def test_cka(both):
    x, y, a, b = both
    got = ve.linear_cka(a, b).first()
    want = np.square(x.T @ y).sum() / np.sqrt(np.square(x.T @ x).sum() * np.square(y.T @ y).sum())
    assert got["shared"] == len(x) and got["linear_cka"] == pytest.approx(want)


def test_procrustes(both):
    x, y, a, b = both
    got = ve.procrustes(a, b).first()
    u, s, vt = np.linalg.svd(x.T @ y, full_matrices=False)
    assert got["nuclear_norm"] == pytest.approx(s.sum()) and got["shared"] == len(x)
    if len(x) > max(x.shape[1], y.shape[1]):
        r = x @ (u @ vt)
        cos = (r * y).sum(1) / np.linalg.norm(r, axis=1) / np.linalg.norm(y, axis=1)
        assert got["mean_cosine"] == pytest.approx(cos.mean()) and got["median_cosine"] == pytest.approx(np.median(cos))
    assert -1 <= got["mean_cosine"] <= 1


def test_cca(both):
    x, y, a, b = both
    ux, uy = (np.linalg.svd(m, full_matrices=False) for m in (x, y))
    ux, uy = (u[:, s > 1e-6 * s.max()] for u, s, _ in (ux, uy))
    want = np.clip(np.linalg.svd(ux.T @ uy, compute_uv=False), 0, 1).mean()
    assert ve.mean_cca(a, b).first()["mean_cca"] == pytest.approx(want)


def test_pca(both):
    x, _, a, _ = both
    coords, ratio = ve.pca(a, 2)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    load = vt[:2] * np.sign(vt[np.arange(2), np.abs(vt[:2]).argmax(1)])[:, None]
    got = coords.toPandas().sort_values("key")
    assert np.allclose(np.stack(got["vec"].to_numpy()), x @ load.T, atol=1e-8) and np.allclose(ratio, (s**2 / (s**2).sum())[:2])


def test_matrix_width(spark):
    """16,055 columns: nothing is refused, and no row holds a product of columns."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 16_055))
    y = x[:, ::-1] + rng.normal(size=x.shape)
    a, b = vectors(spark, x), vectors(spark, y)
    xc, yc = x - x.mean(0), y - y.mean(0)
    k, m = xc @ xc.T, yc @ yc.T
    assert ve.linear_cka(a, b).first()["linear_cka"] == pytest.approx((k * m).sum() / np.sqrt((k * k).sum() * (m * m).sum()))
    assert ve.procrustes(a, b).first()["nuclear_norm"] == pytest.approx(np.linalg.svd(np.linalg.cholesky(k + 1e-9 * np.eye(30)).T @ np.linalg.cholesky(m + 1e-9 * np.eye(30)), compute_uv=False).sum(), rel=1e-3)
    assert ve.mean_cca(a, b).first()["mean_cca"] == pytest.approx(1.0)
    coords, ratio = ve.pca(a, 2)
    s = np.linalg.svd(xc, compute_uv=False)
    assert np.allclose(ratio, (s**2 / (s**2).sum())[:2]) and coords.count() == 30


def test_column_moments(spark):
    x = np.random.default_rng(1).normal(size=(20, 3)) + 1e6
    df = spark.createDataFrame(pd.DataFrame({"v": list(x)}))
    n, (mean,), (square,) = ti.column_moments(df, ["v"])
    assert n == 20 and np.allclose(mean, x.mean(0)) and np.allclose(square, ((x - x.mean(0)) ** 2).sum(0))
