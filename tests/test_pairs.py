"""Vectors of pairs."""

import numpy as np

from exprlake.operators import joins as jn
from exprlake.operators import vectors as ve


def test_uncovered_edges_leave_before_vectors_join(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "key bigint, vec array<float>")
    edges = spark.createDataFrame([(0, 1, 1), (2, 3, 0), (1, 9, 1), (9, 1, 0)], "a bigint, b bigint, label int")
    met = jn.pair_vectors(edges, vectors)
    assert {(r["a"], r["b"], r["label"], tuple(r["vec_a"]), tuple(r["vec_b"])) for r in met.collect()} == {
        (0, 1, 1, (0.0, 1.0), (1.0, 1.0)), (2, 3, 0, (2.0, 1.0), (3.0, 1.0))}
    assert met._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2


def test_models_meet_a_pair_at_once(spark):
    """Keys that one model lacks drop out of its pairs; the edges are read once for all models."""
    rng = np.random.default_rng(2)
    x = {m: rng.normal(size=(12, 3)) for m in "AB"}
    rows = [(i, m, [float(v) for v in x[m][i]]) for m in "AB" for i in range(12) if (m, i) != ("B", 5)]
    vectors = spark.createDataFrame(rows, "key int, model string, vec array<double>")
    pairs = [(i, j) for i in range(12) for j in range(i)]
    edges = spark.createDataFrame(pairs, "a int, b int")
    out = ve.model_similarity(edges, vectors, ["A", "B"])
    kept = [(i, j) for i, j in pairs if 5 not in (i, j)]
    cos = [[x[m][i] @ x[m][j] / np.linalg.norm(x[m][i]) / np.linalg.norm(x[m][j]) for i, j in kept] for m in "AB"]
    assert np.isclose(out.first()["correlation"], np.corrcoef(*cos)[0, 1])
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
