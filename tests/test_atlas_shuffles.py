"""Steps of atlas matching that share one shuffle by sample."""

import pandas as pd

from exprlake.operators.ranking import quota_top_k
from exprlake.plans import atlas as at

SETTINGS = at.AtlasSettings(minimum_shared=3, sparse_minimum=2)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_quotas_in_one_shuffle(spark):
    rows = [("a", "x", f"x{i}", 0.1 * i) for i in range(5)] + [("a", "y", f"y{i}", 0.9) for i in range(3)] + [("b", "z", f"z{i}", 0.5 - i) for i in range(4)]
    rows += [("c", None, "n", 0.2)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["sample_id", "kind", "reference_id", "similarity"])).repartition(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = quota_top_k(df, "kind", {"x": 2, "y": 1}, 3, "x")
        assert shuffles(got) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = [tuple(r) for r in got.orderBy("sample_id", "rank").select("sample_id", "rank", "kind", "reference_id").collect()]
    assert found == [
        ("a", 1, "x", "x4"), ("a", 2, "x", "x3"), ("a", 3, "y", "y0"), ("b", 1, "x", "z0"), ("b", 2, "x", "z1"), ("b", 3, "x", "z2"), ("c", 1, "x", "n"),
    ]


def test_overlap_and_scale_in_one_shuffle(spark):
    """A feature that is measured twice counts once for the overlap; each sample has its own scale."""
    rows = [("raw", "f1", 40.0), ("raw", "f2", 60.0), ("raw", "f3", 0.0), ("raw", "other", 7.0), ("few", "f1", 1.0), ("few", "f1", 2.0), ("few", "other", 3.0)]
    rows += [("log", "f1", 1.5), ("log", "f2", 2.5)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["sample_id", "feature", "value"])).repartition(3)
    vocabulary = at.in_order(df, ["f1", "f2", "f3"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = at.query_on_log_scale(at.overlapping(df, vocabulary.select("feature"), SETTINGS), 30.0, per_sample=True)
        assert shuffles(got) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = {(r["sample_id"], r["feature"]): round(r["value"], 4) for r in got.collect()}
    assert found == {("raw", "f1"): 12.8992, ("raw", "f2"): 13.3047, ("raw", "f3"): 0.0, ("log", "f1"): 1.5, ("log", "f2"): 2.5}
