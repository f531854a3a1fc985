"""The bucketed ranking kernel against pandas, with buckets so small that groups span many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from exprlake.operators import ordering as o


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    hot = pd.DataFrame({"g": "hot", "v": np.round(rng.exponential(3, 900), 1)})
    rest = pd.DataFrame({"g": rng.choice(list("abc"), 200), "v": np.round(rng.normal(size=200), 1)})
    one = pd.DataFrame({"g": ["single", "flat", "flat", "flat"], "v": [1.0, 2.0, 2.0, 2.0]})
    out = pd.concat([hot, rest, one], ignore_index=True)
    out["id"] = np.arange(len(out))
    return out


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("rows", [7, 10**6])
def test_cumulative(df, frame, rows):
    got = o.cumulative(df, ["g"], "v", {"w": F.col("id")}, rows_per_bucket=rows).toPandas()
    assert len(got) == frame.groupby(["g", "v"]).ngroups
    for r in got.sample(60, random_state=1).itertuples():
        grp = frame[frame.g == r.g]
        assert r.n == (grp.v == r.v).sum() and r.n_before == (grp.v < r.v).sum() and r.n_total == len(grp)
        assert r.w_before == grp[grp.v < r.v].id.sum() and r.w_total == grp.id.sum()


def test_average_rank(df, frame):
    got = o.average_rank(df, ["g"], "v").toPandas().set_index("id")
    want = frame.groupby("g").v.rank(method="average")
    assert np.allclose(got.avg_rank.sort_index(), want.values)


@pytest.mark.parametrize("rows", [5, 10**6])
def test_position_is_a_permutation(df, frame, rows):
    got = o.draw_position(df, ["g"], ["id"], 1, rows_per_bucket=rows).toPandas()
    for g, part in got.groupby("g"):
        assert sorted(part.position) == list(range(1, len(part) + 1)) and set(part.position_n) == {len(part)}


def test_position_does_not_depend_on_bucket_size(df):
    a = o.draw_position(df, ["g"], ["id"], 9, rows_per_bucket=5).select("id", "position").toPandas().sort_values("id")
    b = o.draw_position(df, ["g"], ["id"], 9).select("id", "position").toPandas().sort_values("id")
    assert (a.position.values == b.position.values).all()


@pytest.mark.parametrize("rows", [7, 10**6])
def test_exact_percentile(df, frame, rows):
    got = o.exact_percentile(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, rows_per_bucket=rows).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        for name, p in (("p10", 10), ("p50", 50), ("p99", 99)):
            assert got.loc[g, name] == pytest.approx(np.percentile(part.v, p))


def test_percentile_without_groups_and_lower(df, frame):
    got = o.exact_percentile(df, [], "v", {"m": 0.5}, interpolate=False).first()["m"]
    assert got == pytest.approx(np.sort(frame.v)[(len(frame) - 1) // 2])


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("a", float("inf")), ("a", 3.0)], "g string, v double")
    assert o.cumulative(df, ["g"], "v").agg(F.sum("n")).first()[0] == 2
    assert o.exact_percentile(df, ["g"], "v", {"m": 0.5}).first()["m"] == 2.0


def test_top_k_larger_than_group(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0)], "g string, id int, v double")
    got = o.top_k(df, ["g"], [F.col("v").desc(), F.col("id")], 5).collect()
    assert [(r["id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


def test_heavy_tails_spread_over_buckets(spark):
    rng = np.random.default_rng(8)
    for v in (rng.pareto(0.5, 4000), -rng.pareto(0.5, 4000), rng.standard_cauchy(4000), 1e6 + rng.random(4000)):
        df = spark.createDataFrame(pd.DataFrame({"v": v}))
        t = o.cumulative(df, [], "v", rows_per_bucket=40, keep_bucket=True)
        per = t.groupBy("_b").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c"), F.count("c")).first()
        assert per[0] < 1000 and per[1] > 20
        assert t.filter("n_before + n > n_total").count() == 0
