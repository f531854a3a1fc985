"""Samples against term sets against plain Python, in pieces and blocks of all sizes."""

import numpy as np
import pytest

from exprlake.operators import joins as jn
from exprlake.operators import sets
from exprlake.operators import vectors as ve


@pytest.fixture(params=[(1 << 18, 1 << 21), (3, 2)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(sets, "CELLS", request.param[0])
    monkeypatch.setattr(sets, "PIECE", request.param[1] if request.param[1] > 2 else 2048)


def tables(spark):
    rng = np.random.default_rng(1)
    cells = [(i, f"f{j}", float(rng.integers(0, 5))) for i in range(11) for j in range(8) if rng.random() < 0.6]
    cells += [(11, "f0", None), (11, "f1", 4.0), (12, "f2", float("inf")), (12, "f3", 1.0), (13, "elsewhere", 1.0), (14, "f5", None)]
    members = [(f"t{t}", f"f{j}") for t in range(7) for j in range(8) if rng.random() < 0.4] + [("t0", "f1"), ("t0", "f1"), ("none", "absent"), ("all", "f5")]
    m = spark.createDataFrame(members, "term string, feature string")
    return cells, set(members), spark.createDataFrame(cells, "sample_id int, feature string, value double").repartition(3), m


def test_mean_of_members(spark, sizes):
    cells, members, df, m = tables(spark)
    want = {}
    for s, f, v in cells:
        for t, g in members:
            if f == g:
                want.setdefault((s, t), []).append(v)
    got = {(r["sample_id"], r["term"]): (r["score"], r["members"]) for r in ve.set_scores(df, m).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        known = [x for x in v if x is not None]
        assert got[k] == (pytest.approx(sum(known) / len(known)) if known else None, len(v))


def test_names_of_members(spark, sizes):
    cells, members, df, m = tables(spark)
    want = {}
    for s in {c[0] for c in cells}:
        top = sorted(((-v if v is not None else 1.0, f) for i, f, v in cells if i == s))[:3]
        for _, f in top:
            for t, g in members:
                if f == g:
                    want.setdefault((s, t), []).append(f)
    out = jn.top_feature_overlap(df, m, 3)
    got = {(r["sample_id"], r["term"]): (r["overlap"], r["features"]) for r in out.collect()}
    assert got == {k: (len(v), ",".join(sorted(v))) for k, v in want.items()}
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
