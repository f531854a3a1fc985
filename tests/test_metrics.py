import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from exprlake.operators import metrics as mt
from exprlake.operators import stats as st


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def brute_ap(y, s):
    total, out, last = y.sum(), 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall = y[hit].sum() / total
        out += (recall - last) * y[hit].mean()
        last = recall
    return out


@pytest.fixture(scope="module")
def pred():
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"g": rng.choice(["x", "y"], 300), "label": rng.integers(0, 2, 300), "score": np.round(rng.random(300), 2)})
    p["id"] = np.arange(300)
    one_class = pd.DataFrame({"g": "one", "label": [1, 1], "score": [0.1, 0.2], "id": [900, 901]})
    return pd.concat([p, one_class], ignore_index=True)


def test_auroc_and_auprc(spark, pred):
    got = mt.auroc_auprc(spark.createDataFrame(pred), ["g"]).toPandas().set_index("g")
    for g in ("x", "y"):
        part = pred[pred.g == g]
        assert got.loc[g, "auroc"] == pytest.approx(brute_auc(part.label.values, part.score.values))
        assert got.loc[g, "auprc"] == pytest.approx(brute_ap(part.label.values, part.score.values))
    assert pd.isna(got.loc["one", "auroc"]) and pd.isna(got.loc["one", "auprc"])


def test_auroc_of_negated_score(spark, pred):
    df = spark.createDataFrame(pred).filter("g <> 'one'")
    a = mt.auroc_auprc(df, ["g"]).toPandas().set_index("g").auroc
    b = mt.auroc_auprc(df.withColumn("score", -F.col("score")), ["g"]).toPandas().set_index("g").auroc
    assert np.allclose(a, 1 - b[a.index])


def test_shuffled_labels_keep_counts(spark, pred):
    df = spark.createDataFrame(pred)
    s = mt.shuffled_labels(df, ["g"], "id", "label", 1).toPandas()
    assert len(s) == len(pred)
    assert (s.groupby("g").shuffled.sum() == pred.groupby("g").label.sum()).all()


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", None, 1.0), ("b", float("nan"), 1.0)], "g string, x double, y double")
    got = {r["g"]: r["pearson"] for r in mt.pearson(df, ["g"], "x", "y").collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)
    got = {r["g"]: r["spearman"] for r in mt.spearman(df, ["g"], "x", "y").collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)


def test_classification_without_positives(spark):
    df = spark.createDataFrame([("a", 0, 0.2), ("a", 0, 0.7)], "g string, label int, p double")
    r = mt.binary_classification(df, ["g"], "label", "p").first()
    assert r["accuracy"] == 0.5 and r["balanced_accuracy"] is None and r["f1"] == 0.0


def test_hedges_g_zero_variance_and_small_arms(spark):
    df = spark.createDataFrame([("flat", 1, 2.0)] * 3 + [("flat", 0, 2.0)] * 2 + [("tiny", 1, 1.0), ("tiny", 0, 2.0)], "g string, label int, v double")
    r = st.hedges_g(df, ["g"], "label", "v").collect()
    assert [x["g"] for x in r] == ["flat"] and r[0]["hedges_g"] == 0.0 and r[0]["variance"] == pytest.approx(5 / 6)


def test_random_effects_single_cohort(spark):
    df = spark.createDataFrame([("p", 0.5, 0.04)], "term string, hedges_g double, variance double")
    r = st.random_effects(df, ["term"]).first()
    assert r["estimate"] == pytest.approx(0.5) and r["tau_squared"] == 0.0 and r["concordant"] == 1
    assert r["p_value"] == pytest.approx(math.erfc(2.5 / math.sqrt(2)))


def test_bh_is_monotone_and_at_least_p(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(60), 2)
    df = spark.createDataFrame(pd.DataFrame({"id": range(60), "p_value": p}))
    got = st.benjamini_hochberg(df, []).toPandas().sort_values("p_value")
    assert (got.q_value >= got.p_value - 1e-12).all() and got.q_value.is_monotonic_increasing
    order = np.argsort(p, kind="stable")
    adj = np.minimum.accumulate((p[order] * 60 / np.arange(1, 61))[::-1])[::-1]
    assert np.allclose(np.sort(np.minimum(adj, 1)), got.q_value)


def test_bootstrap_draws_add_up(spark, pred):
    df = spark.createDataFrame(pred).select("g", "id").distinct()
    got = st.bootstrap_counts(df, ["g"], "id", 5, 2).groupBy("g", "replicate").agg(F.sum("times").alias("n")).toPandas()
    sizes = pred.groupby("g").size()
    assert all(r.n == sizes[r.g] for r in got.itertuples()) and len(got) == 15


def test_logit_line_matches_newton(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(0.05, 0.95, 400)
    y = (rng.random(400) < p**1.5).astype(int)
    got = st.fit_logit_line(spark.createDataFrame(pd.DataFrame({"g": "a", "label": y, "p": p})), ["g"], "label", "p").first()
    x = np.log(p / (1 - p))
    a, b = got["intercept"], got["slope"]
    q = 1 / (1 + np.exp(-(a + b * x)))
    assert abs((q - y).sum()) < 1e-5 and abs(((q - y) * x).sum() + b) < 1e-5


def test_recalibration_offset_is_bounded(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.6)], "g string, label int, p double")
    r = st.recalibrate(df, df, ["g"], "label", "p").first()
    assert r["offset"] == pytest.approx(6.0)
