"""Models fitted together, and bootstrap replicates, against plain NumPy."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from exprlake.operators import bootstrap, fitting, stats
from exprlake.operators import models as mo


def table(spark, x, y, fold, parts=3):
    rows = [(i, [float(v) for v in a], [float(v) for v in np.atleast_1d(b)], None if f is None else str(f)) for i, (a, b, f) in enumerate(zip(x, y, fold, strict=True))]
    return spark.createDataFrame(rows, "id bigint, features array<double>, labels array<double>, fold string").repartition(parts)


def slope(g, x, y, use):
    """Largest component of the objective's gradient at a fitted model."""
    z = (x[use][:, g.columns] - x[use][:, g.columns].mean(0)) / np.where(x[use].std(0) > 1e-12, x[use].std(0), 1.0)[g.columns]
    t = y[use]
    w = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum()))) * g.spec.c
    r = w * (1 / (1 + np.exp(-(z @ g.coef[:-1] + g.coef[-1]))) - t)
    return max(np.abs(z.T @ r + g.coef[:-1]).max(), abs(r.sum()))


@pytest.mark.parametrize("width, state", [(32, 20_000_000), (0, 20_000_000), (0, 700), (32, 60)])
def test_both_ways_reach_the_optimum(spark, monkeypatch, width, state):
    """By curvature or by gradients, in one batch or in many."""
    monkeypatch.setattr(fitting, "NEWTON_WIDTH", width)
    monkeypatch.setattr(fitting, "MAX_STATE", state)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6)) * [1, 10, 0.1, 1, 5, 0] + 7
    y = np.column_stack([x[:, 0] + rng.normal(size=150) > 7, rng.random(150) < 0.2]).astype(float)
    fold = np.array(["a", "b", "c"])[np.arange(150) % 3]
    specs = [mo.Spec(f"{j}{f}{c}", j, (f,), (f,), c) for j in (0, 1) for f in "ab" for c in (0.01, 1.0, 100.0)]
    got = fitting.fit_many(table(spark, x, y, fold), specs, top_variance=4)
    for g in got:
        use = fold != g.spec.exclude[0]
        assert list(g.columns) == sorted(np.argsort(-x[use].var(0))[:4])
        assert slope(g, x, y[:, g.spec.label], use) < 2e-5


def test_matrix_width(spark):
    """16,055 columns of which each model keeps its 1,000 most variable: no refusal, and the optimum."""
    rng = np.random.default_rng(5)
    n, d = 45, 16_055
    x = rng.normal(size=(n, d)) * rng.exponential(size=d)
    y = (x[:, :40].sum(1) > 0).astype(float)
    fold = np.array(["p", "q", "r"])[np.arange(n) % 3]
    out = mo.leave_one_cohort_out(table(spark, x, y, fold), "id", top_variance=1000).toPandas()
    assert sorted(out["id"]) == list(range(n)) and out["probability"].between(0, 1).all()
    assert set(out["selected_c"]) <= {0.01, 0.1, 1.0, 10.0} and out["inner_auroc"].notna().all()
    specs = [mo.Spec(str(c), 0, ("p",), ("p",), c) for c in (0.01, 10.0)]
    for g in fitting.fit_many(table(spark, x, y, fold), specs, 1000):
        assert len(g.columns) == 1000 and slope(g, x, y, fold != "p") < 1e-4


def test_penalty_without_usable_inner_rounds(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = np.arange(60) % 2
    two = mo.leave_one_cohort_out(table(spark, x, y, np.where(np.arange(60) < 30, "a", "b")), "id").toPandas()
    # with one cohort left there is nothing to choose on: C is 1
    assert sorted(two["id"]) == list(range(60)) and set(two["selected_c"]) == {1.0} and two["inner_auroc"].isna().all()
    one = mo.leave_one_cohort_out(table(spark, x, y, ["a"] * 60), "id")
    assert one.count() == 0
    # cohort c has one class: it can't be tried on, so rounds without it decide
    fold = np.array(["a", "b", "c", "d"])[np.arange(60) % 4]
    y = np.where(fold == "c", 1, np.arange(60) // 4 % 2)
    three = mo.leave_one_cohort_out(table(spark, x, y, fold), "id", penalties=(0.1, 1.0)).toPandas()
    assert set(three["held_out"]) == set("abcd") and three["inner_auroc"].notna().all()
    empty = mo.leave_one_cohort_out(table(spark, x, y, fold).filter(F.lit(False)), "id")
    assert empty.count() == 0


def test_rows_without_a_fold_are_learned_from(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 2)), (np.arange(40) % 2).astype(float)
    fold = [None if i < 20 else "t" for i in range(40)]
    g = fitting.fit_many(table(spark, x, y, fold), [mo.Spec("m", 0, ("t",), ("t",))])[0]
    assert slope(g, x, y, np.arange(40) < 20) < 1e-6


def test_all_terms_are_probed(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(120, 5))
    vectors = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(v)], "key int, vec array<double>")
    rows = [(t, i) for j, t in enumerate("xyz") for i in range(120) if v[i, j] > 0] + [("everywhere", i) for i in range(120)] + [("single", 3)]
    out = mo.term_probes(vectors, spark.createDataFrame(rows, "term string, key int")).toPandas().set_index("term")
    assert {"x", "y", "z"} <= set(out.index) and "everywhere" not in out.index
    assert (out.loc[["x", "y", "z"], "auroc"] > 0.9).all()


def test_driver_sees_steps_and_no_curvatures(spark, monkeypatch):
    """Narrow models: what reaches the driver from a pass grows with their width, not with its square."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 20))
    y = (x[:, 0] + rng.normal(size=90) > 0).astype(float)
    fold = np.array(["a", "b", "c"])[np.arange(90) % 3]
    monkeypatch.setattr(fitting, "over_blocks", lambda *_: pytest.fail("the sums of a pass reached the driver whole"))
    specs = [mo.Spec(f"{f}{c}", 0, (f,), (f,), c) for f in "abc" for c in (0.1, 10.0)]
    for g in fitting.fit_many(table(spark, x, y, fold), specs):
        assert slope(g, x, y, fold != g.spec.exclude[0]) < 2e-5


def test_tasks_without_rows_to_learn_from(spark, monkeypatch):
    """More tasks than blocks, and a task that only has rows of a fold that every model leaves out."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 4))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(float)
    fold = np.array(["a", "b", "out"])[np.arange(60) // 20]
    whole = fitting.packed
    monkeypatch.setattr(fitting, "packed", lambda *a: (whole(*a)[0].repartition(6), True))
    specs = [mo.Spec(f, 0, (f, "out"), (f,), 1.0) for f in "ab"]
    rows = table(spark, x, y, fold).repartitionByRange(3, "fold")
    for g in fitting.fit_many(rows, specs):
        assert slope(g, x, y, (fold != g.spec.exclude[0]) & (fold != "out")) < 2e-5


# bootstrap ----------------------------------------------------------------------------------
def plain_auc(y, s, w):
    pos, cnt = (w * y).sum(), w.sum()
    if pos == 0 or pos == cnt:
        return None, None
    u = sum(w[i] * w[j] * (1.0 if s[i] > s[j] else 0.5 if s[i] == s[j] else 0.0) for i in range(len(y)) for j in range(len(y)) if y[i] and not y[j])
    ap = sum((w * y)[s == v].sum() * (w * y)[s >= v].sum() / w[s >= v].sum() for v in np.unique(s) if w[s >= v].sum())
    return u / (pos * (cnt - pos)), ap / pos


def plain_draws(n, prefix, replicates):
    out = np.zeros((replicates, n))
    for r in range(1, replicates + 1):
        for j in range(1, n + 1):
            out[r - 1, int(hashlib.md5(f"{prefix}:{r}:{j}".encode()).hexdigest()[:13], 16) % n] += 1
    return out


@pytest.mark.parametrize("places, draws, bucket", [(1024, 1 << 16, 50_000), (4, 3, 2)])
def test_replicates_equal_plain_resampling(spark, monkeypatch, places, draws, bucket):
    monkeypatch.setattr(bootstrap, "PLACES", places)
    monkeypatch.setattr(bootstrap, "DRAWS", draws)
    monkeypatch.setattr(bootstrap, "ROWS_PER_BUCKET", bucket)
    rng = np.random.default_rng(0)
    rows = [(m, i, int(rng.random() < 0.4), float(rng.integers(0, 8))) for m in ("a", "b") for i in range(17)] + [("one", i, 1, 0.5) for i in range(3)]
    rows += [("a", 99, None, 1.0), ("a", 98, 1, float("nan"))]
    df = spark.createDataFrame(rows, "method string, id int, y int, s double")
    got = stats.bootstrap_auc(df, ["method"], "id", "y", "s", 30, 7).toPandas()
    assert len(got) == 90
    frame = pd.DataFrame(rows, columns=["method", "id", "y", "s"])
    for m, part in frame.groupby("method"):
        part = part.sort_values("id").reset_index(drop=True)
        drawn = plain_draws(len(part), f"7:{m}", 30)
        good = part["y"].notna() & np.isfinite(part["s"])
        for r in range(30):
            row = got[(got["method"] == m) & (got["replicate"] == r + 1)].iloc[0]
            auroc, ap = plain_auc(part["y"][good].to_numpy(float), part["s"][good].to_numpy(), drawn[r][good.to_numpy()])
            if auroc is None:
                assert pd.isna(row["auroc"]) and pd.isna(row["auprc"])
            else:
                assert row["auroc"] == pytest.approx(auroc) and row["auprc"] == pytest.approx(ap)


def test_paired_replicates_share_draws(spark):
    rng = np.random.default_rng(6)
    rows = [(m, i, i % 2, float(rng.normal() + (i % 2) * (m == "a"))) for m in ("a", "b") for i in range(40)] + [("a", 77, 1, 0.0)]
    df = spark.createDataFrame(rows, "method string, id int, y int, s double")
    got = stats.paired_deltas(df, [], "id", "method", "y", "s", "a", "b", 25, 3, ["y"]).toPandas().set_index("replicate")
    frame = pd.DataFrame(rows[:-1], columns=["method", "id", "y", "s"]).pivot(index="id", columns="method", values="s")
    y = frame.index.to_numpy() % 2
    drawn = np.zeros((25, 40))
    for c in (0, 1):
        drawn[:, y == c] = plain_draws(20, f"3:{c}", 25)
    for r in range(25):
        a, b = (plain_auc(y.astype(float), frame[m].to_numpy(), drawn[r]) for m in "ab")
        assert got.loc[r + 1, "auroc"] == pytest.approx(a[0] - b[0]) and got.loc[r + 1, "auprc"] == pytest.approx(a[1] - b[1])


def test_draws_are_sent_by_their_number(spark, monkeypatch):
    """Two bytes a draw, however many blocks a unit of draws falls into; once every row carried a whole block."""
    monkeypatch.setattr(bootstrap, "PLACES", 4)
    monkeypatch.setattr(bootstrap, "DRAWS", 10)
    sizes = spark.createDataFrame([(0, "7:a", 500), (1, "7:b", 3)], "sid bigint, prefix string, n bigint")
    sent = bootstrap.draw_counts(sizes, 30).toPandas()
    assert sent["places"].map(len).sum() == 2 * 30 * 503
    got = np.zeros((30, 500))
    for r in sent[sent["sid"] == 0].itertuples():
        n = np.frombuffer(r.sizes, np.uint32)
        for i, p in zip(np.repeat(np.arange(len(n)), n), np.frombuffer(r.places, np.uint16), strict=True):
            got[r.first - 1 + i, r.block * 4 + p] += 1
    assert (got == plain_draws(500, "7:a", 30)).all()
