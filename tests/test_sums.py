"""Sums of vectors per key against NumPy: missing elements, ragged and null vectors, null keys, wide vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprlake.operators import aggregate as ag
from exprlake.operators import sums
from exprlake.operators.joins import map_and_average


@pytest.mark.parametrize("held", [4_000_000, 1])
def test_states_and_means(spark, monkeypatch, held):
    monkeypatch.setattr(sums, "HELD", held)
    rng = np.random.default_rng(0)
    rows = [(int(i % 5) if i % 11 else None, f"s{i % 2}", [None if rng.random() < 0.1 else float(v) for v in rng.normal(size=4 if i % 13 else 2)]) for i in range(200)]
    rows += [(1, "s0", None), (7, "s1", None), (8, "s1", []), (2, "s0", [float("nan"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "k int, s string, vec array<double>").repartition(6)
    want = {}
    for k, s, v in rows:
        want.setdefault((k, s), []).append(v)
    got = {(r["k"], r["s"]): r for r in ag.mean_vectors(df, ["k", "s"]).collect()}
    assert set(got) == set(want)
    for key, found in want.items():
        assert got[key]["n"] == len(found)
        width = max(len(v or []) for v in found)
        assert len(got[key]["vec"]) == width
        for i in range(width):
            seen = [v[i] for v in found if v and len(v) > i and v[i] is not None]
            x = got[key]["vec"][i]
            assert x is None if not seen else x == pytest.approx(np.mean(seen), nan_ok=True)
    states = ag.vector_state(df, ["k", "s"])
    merged = {r["k"]: r for r in ag.finish_state(ag.merge_states(states, ["k"])).collect()}
    plain = {r["k"]: r for r in ag.mean_vectors(df, ["k"]).collect()}
    assert {k: (r["count"], pytest.approx(r["vec"], nan_ok=True)) for k, r in merged.items() if r["vec"]} == {k: (r["n"], r["vec"]) for k, r in plain.items() if r["vec"]}
    assert ag.mean_vectors(df, []).first()["n"] == len(rows)
    assert ag.mean_vectors(df.filter("false"), ["k"]).count() == 0


def test_same_plan_for_every_width(spark):
    plans = []
    for width in (8, 16_055):
        df = spark.range(4).select((F.col("id") % 2).alias("k"), F.array_repeat(F.col("id").cast("float"), width).alias("vec"))
        out = ag.mean_vectors(df, ["k"])
        plans.append(out._jdf.queryExecution().executedPlan().toString().count("\n"))
        assert {r["k"]: (len(r["vec"]), r["vec"][0]) for r in out.collect()} == {0: (width, 1.0), 1: (width, 2.0)}
    assert plans[0] == plans[1]


def test_map_and_average(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 6.0]), ("c", [9.0, 9.0])], "key string, vec array<double>")
    m = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "src string, dst string")
    assert {r["key"]: (r["vec"], r["sources"]) for r in map_and_average(v, m).collect()} == {"x": ([2.0, 4.0], 2), "y": ([9.0, 9.0], 1)}
