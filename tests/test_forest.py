"""Forests of all folds grown together."""

import numpy as np
import pandas as pd

from exprlake.operators import forest as fo
from exprlake.plans.catalog import REGISTRY


def table(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.random((n, 6))
    x[:, 5] = 1.0  # never changes
    y = (x[:, 2] > 0.4).astype(int)
    frame = pd.DataFrame({"id": range(n), "features": x.tolist(), "label": y, "fold": np.arange(n) % 3})
    rows = spark.createDataFrame(frame).selectExpr("id", "features", "if(id = 7, null, label) AS label", "cast(fold AS int) AS fold")
    return rows, x, y


def grown(rows):
    got, importances = fo.forest_out_of_fold(rows, "id", folds=3, trees=12, depth=4)
    return got.toPandas().sort_values("id"), np.array(importances)


def test_out_of_fold(spark):
    rows, _, y = table(spark)
    got, importances = grown(rows)
    assert got["id"].tolist() == list(range(400)) and got["fold"].tolist() == [i % 3 for i in range(400)]
    p = np.stack(got["probabilities"])
    assert np.allclose(p.sum(axis=1), 1.0) and np.isnan(got["label"].iloc[7])
    assert ((p[:, 1] > 0.5) == y).mean() > 0.95
    assert importances.shape == (3, 6) and np.allclose(importances.sum(axis=1), 1.0)
    assert (importances.argmax(axis=1) == 2).all() and (importances[:, 5] == 0).all()


def test_the_dealing_does_not_show(spark, monkeypatch):
    """One block whose trees are shared out, many blocks with a few trees' counts a row: the same forests."""
    rows, _, _ = table(spark)
    one, imp = grown(rows.coalesce(1))
    monkeypatch.setattr(fo, "BLOCK_BYTES", 6 * 25)
    monkeypatch.setattr(fo, "CELLS", 3 * 32 * 2)
    many, imp2 = grown(rows.repartition(5))
    assert np.array_equal(np.stack(one["probabilities"]), np.stack(many["probabilities"])) and np.array_equal(imp, imp2)


def test_splits_by_hand():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 3, (9, 2, fo.BINS, 2))
    h[:, 1] = h[:, 0, ::-1]  # both features count the same rows
    w = np.array([0.7, 1.6])
    s, b, gain, whole, left = fo.best_splits(h, w, 2)

    def gini(n):
        q = n * w / max((n * w).sum(), 1e-300)
        return (n * w).sum() * (1 - (q * q).sum())

    for i in range(9):
        total = h[i, 0].sum(axis=0)
        tried = {}
        for f in range(2):
            for k in range(fo.BINS - 1):
                a = h[i, f, : k + 1].sum(axis=0)
                if min(a.sum(), (total - a).sum()) >= 2:
                    tried[f, k] = gini(total) - gini(a) - gini(total - a)
        assert np.isclose(gain[i], max(tried.values())) and np.isclose(tried[s[i], b[i]], gain[i])
        assert (whole[i] == total).all() and (left[i] == h[i, s[i], : b[i] + 1].sum(axis=0)).all()


def test_nothing_to_learn_from(spark):
    rows, _, _ = table(spark, 30)
    got, importances = grown(rows.filter("fold = 0"))
    assert len(got) == 10 and all(np.isnan(p).all() for p in got["probabilities"].map(lambda p: np.array(p, float)))
    assert (importances[0] == 0).all()
    assert grown(rows.limit(0))[0].empty


def test_jobs_do_not_grow_with_trees_and_folds(spark, small_dir):
    """300 trees of five folds take a few jobs a level; they took hundreds, each shuffling all nodes' sums."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("forests", "forests")
    try:
        REGISTRY["ml02_random_forest"].run(spark, small_dir)
        assert len(tracker.getJobIdsForGroup("forests")) < 80
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
