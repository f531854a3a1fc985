"""Atlas matching on a hand-made atlas, streaming against batch, and resume rules."""

import math
import tempfile

import pytest
from pyspark.sql import functions as F

from exprlake.plans import atlas as at
from exprlake.streaming import incremental as inc


@pytest.fixture(scope="module")
def tiny_atlas(spark):
    rows = [("human_liver", g, v) for g, v in zip("ABC", (4.0, 1.0, 0.0))] + [("mouse_brain", g, v) for g, v in zip("ABC", (0.0, 1.0, 4.0))]
    ref = spark.createDataFrame(rows, "reference_id string, feature string, value double")
    meta = spark.createDataFrame([("human_liver", "human", "liver"), ("mouse_brain", "mouse", "brain")], "reference_id string, species string, tissue string")
    return ref, meta


SETTINGS = at.AtlasSettings(minimum_shared=2, sparse_minimum=1)


def test_obvious_reference_comes_first(spark, tiny_atlas):
    q = spark.createDataFrame([("S1", g, math.expm1(v)) for g, v in zip("ABC", (4.0, 1.0, 0.0))], "sample_id string, feature string, value double")
    assert at.shared_names(q, tiny_atlas[0], SETTINGS) == ["A", "B", "C"]
    r = at.atlas_match(q, *tiny_atlas, SETTINGS).first()
    assert r["best_reference"] == "human_liver" and r["call"] == "human" and r["nearest_tumor"] is None


def test_too_little_overlap_is_refused(spark, tiny_atlas):
    q = spark.createDataFrame([("S1", f"X{i}", 1.0) for i in range(30)] + [("S1", "A", 1.0)], "sample_id string, feature string, value double")
    with pytest.raises(at.OverlapError):
        at.atlas_match(q, *tiny_atlas, SETTINGS)


def test_tie_is_indeterminate(spark, tiny_atlas):
    q = spark.createDataFrame([("S1", "A", 1.0), ("S1", "B", 0.0), ("S1", "C", 1.0)], "sample_id string, feature string, value double")
    r = at.atlas_match(q, *tiny_atlas, SETTINGS).first()
    assert r["call"] == "indeterminate" and r["margin"] == pytest.approx(0.0, abs=1e-9)


def test_stream_resumes_and_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    v = spark.createDataFrame([(i % 3, [float(i), float(2 * i)]) for i in range(30)], "k int, vec array<double>")
    v.filter("vec[0] < 10").write.parquet(f"{base}/in")

    def run():
        s = inc.stream_shards(spark, f"{base}/in", v.schema, 1)
        return inc.running_vector_mean(s, "k", "vec", f"{base}/out", f"{base}/ck", {"width": 2})

    run()
    v.filter("vec[0] >= 10").write.mode("append").parquet(f"{base}/in")
    got = {(r["k"], r["pos"]): (r["mean"], r["count"]) for r in run().collect()}
    want = v.select("k", F.posexplode("vec").alias("pos", "x")).groupBy("k", "pos").agg(F.avg("x"), F.count("x")).collect()
    assert got == {(r[0], r[1]): (pytest.approx(r[2]), r[3]) for r in want}
    # the result is read from one batch, which holds every key once
    kept = sorted(inc._children(spark, f"{base}/out/states"))
    newest = spark.read.parquet(f"{base}/out/states/batch={kept[-1]}")
    assert len(kept) <= 2 and sorted(r["key"] for r in newest.collect()) == [0, 1, 2]
    with pytest.raises(inc.StateMismatch):
        inc.check_state(spark, f"{base}/out", {"width": 3})


@pytest.mark.parametrize("files", [1, 6])
def test_arrivals_do_not_depend_on_their_batch(spark, tiny_atlas, files):
    """A sample of small values stays on its scale beside one of large values, and one of too few features is told so."""
    settings = at.AtlasSettings(minimum_shared=3, sparse_minimum=2)
    log = dict(zip("ABC", (4.0, 1.0, 0.0)))
    rows = [("raw", g, math.expm1(v) * 1e4) for g, v in log.items()] + [("scaled", g, v) for g, v in log.items()]
    rows += [("few", "A", 3.0), ("few", "X", 1.0), ("few", "Y", 1.0)] + [(f"more{i}", g, float(i + ord(g))) for i in range(4) for g in "ABC"]
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    measured = spark.createDataFrame(rows, "sample_id string, feature string, value double")
    measured.repartition(6, "sample_id").write.parquet(f"{path}/in")
    stream = inc.stream_shards(spark, f"{path}/in", measured.schema, files)
    found = inc.match_arrivals(stream, f"{path}/out", f"{path}/ck", lambda b: at.atlas_match(b, *tiny_atlas, settings, per_sample=True))
    got = {r["sample_id"]: r for r in found.collect()}
    assert set(got) == {r[0] for r in rows} and got["few"]["call"] == at.INSUFFICIENT and got["few"]["best_reference"] is None
    assert got["scaled"]["best_reference"] == got["raw"]["best_reference"] == "human_liver"
    assert got["scaled"]["best_similarity"] == pytest.approx(1.0, abs=1e-6)
    assert sum(r["call"] == at.INSUFFICIENT for r in got.values()) == 1
