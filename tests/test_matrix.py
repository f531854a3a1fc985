"""Cleaning, alignment, masking, interval and mapping edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprlake.operators import aggregate as ag
from exprlake.operators import align as al
from exprlake.operators import clean
from exprlake.operators import joins as jn
from exprlake.operators import normalize as nz
from exprlake.operators import ranking as rk
from exprlake.operators import splits as sp

M = "sample_id string, feature string, value double"


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "feature string, pos int")


def test_names_clean_and_collide(spark):
    df = spark.createDataFrame([("s", " tp53", 1.0), ("s", "TP53 ", 2.0), ("s", "nan", 3.0), ("s", "", 4.0)], M)
    out = al.collapse_features(clean.clean_features(df)).collect()
    assert [(r["feature"], r["value"]) for r in out] == [("TP53", 3.0)]


def test_align_fills_and_drops(spark, vocab):
    df = spark.createDataFrame([("s1", "A", 1.0), ("s1", "Z", 9.0), ("s2", "Z", 1.0), ("s3", "C", None)], M)
    got = {(r["sample_id"], r["feature"]): r["value"] for r in al.align(df, vocab).collect()}
    assert len(got) == 9 and got[("s1", "A")] == 1.0 and got[("s2", "B")] == 0.0 and got[("s3", "C")] == 0.0


def test_align_measured_treats_nan_as_missing(spark, vocab):
    df = spark.createDataFrame([("s1", "A", float("nan")), ("s1", "B", 0.0)], M)
    got = {r["feature"]: (r["value"], r["measured"]) for r in al.align_measured(df, vocab).collect()}
    assert got == {"A": (None, False), "B": (0.0, True), "C": (None, False)}


def test_pack_order_is_vocabulary_order(spark):
    v = spark.createDataFrame([("B", 0), ("A", 1)], "feature string, pos int")
    df = spark.createDataFrame([("s", "A", 1.0), ("s", "B", 2.0)], M)
    assert al.pack(df, v).first()["values"] == [2.0, 1.0]


def test_normalisation_guards(spark):
    zero = spark.createDataFrame([("s", "A", 0.0), ("s", "B", 0.0)], M)
    assert {r["value"] for r in nz.log1p_cpm(zero).collect()} == {0.0}
    assert {r["value"] for r in nz.fpkm_to_log1p_tpm(zero).collect()} == {None}
    assert nz.zero_total_samples(zero).count() == 1
    assert {r["value"] for r in nz.centre_unit_rows(zero).collect()} == {0.0}
    flat = spark.createDataFrame([("s", "A", 2.0), ("t", "A", 2.0)], M)
    assert {r["value"] for r in nz.zscore(flat).collect()} == {0.0}


def test_tpm_sums_to_a_million(spark):
    df = spark.createDataFrame([("s", "A", 5.0), ("s", "B", 7.0), ("s", "C", 0.0)], M)
    lens = spark.createDataFrame([("A", 1000.0), ("B", 0.0), ("C", 500.0)], "feature string, length double")
    total = nz.log1p_tpm(df, lens).agg(F.sum(F.expm1("value"))).first()[0]
    assert total == pytest.approx(1e6)


def test_median_fill_of_all_missing_feature(spark):
    df = spark.createDataFrame([("s", "A", None), ("t", "A", None), ("s", "B", 1.0), ("t", "B", None), ("u", "B", 3.0)], M)
    got = {(r["sample_id"], r["feature"]): r["value"] for r in nz.fill_median(df, 0.0).collect()}
    assert got[("s", "A")] == 0.0 and got[("t", "B")] == 2.0


def test_masks_have_exact_sizes(spark):
    v = spark.createDataFrame([(f"F{i}", i) for i in range(100)], "feature string, pos int")
    assert al.mask_features(v, 3).filter("masked").count() == 15
    cells = spark.createDataFrame([(f"s{i}", f"F{j}", 1.0) for i in range(4) for j in range(10)], M).withColumn("panel", F.lit("p"))
    m = al.mask_cells(cells, ["panel"], 3)
    assert m.filter("masked").count() == 6 and m.filter("masked and value is not null").count() == 0
    assert al.mask_per_sample(cells, 3, 1).filter("masked").groupBy("sample_id").count().filter("count <> 3").count() == 0


def test_completion_codes(spark):
    obs = spark.createDataFrame([("s", "A", 1.0), ("s", "B", None), ("s", "C", None)], M)
    pred = spark.createDataFrame([("s", "A", 9.0), ("s", "B", -2.0)], "sample_id string, feature string, prediction double")
    got = {r["feature"]: (r["value"], r["confidence"]) for r in al.complete(obs, pred).collect()}
    assert got == {"A": (1.0, 1.0), "B": (0.0, 0.5), "C": (None, 0.0)}


def test_impute_batches_and_refusal(spark, vocab):
    df = spark.createDataFrame([(f"s{i:02d}", "A", float(i)) for i in range(46)], M)
    sizes = []

    def predict(frame):
        assert len(frame) <= 32
        return frame

    out = al.impute(al.pack(df, vocab).coalesce(1), predict)
    assert out.count() == 46
    with pytest.raises(ValueError):
        al.impute(out, predict, can_impute=False)
    assert sizes == []


def test_violations(spark):
    bad = spark.createDataFrame([("s", "a", 1.0), ("s", "A ", -1.0), ("t", "B", float("nan"))], M)
    got = {r["rule"]: r["entries"] for r in clean.matrix_violations(bad, max_samples=1).collect()}
    assert got == {"duplicate_feature": 1, "negative_value": 1, "non_finite": 1, "too_many_samples": 1, "missing_cells": 2}
    good = spark.createDataFrame([("s", "A", 1.0)], M)
    assert clean.matrix_violations(good).count() == 0


def test_scale_inference_and_request(spark):
    df = spark.createDataFrame([("s", "A", 100.0), ("s", "B", 50.0)], M).withColumn("p", F.lit("x"))
    assert clean.infer_scale(df, ["p"]).first()["scale"] == "raw"
    assert clean.to_log_scale(df, ["p"]).agg(F.max("value")).first()[0] == pytest.approx(np.log1p(100.0))
    assert clean.to_log_scale(df, ["p"], "log1p").agg(F.max("value")).first()[0] == 100.0


def test_intervals_touching_and_nested(spark):
    rows = [("g", 1, 5), ("g", 6, 8), ("g", 2, 3), ("g", 20, 20), ("g", 19, 25), ("h", 10, 4)]
    df = spark.createDataFrame(rows, "feature string, s bigint, e bigint")
    for width in (3, 1000):
        assert [(r["feature"], r["length"]) for r in ag.union_length(df, ["feature"], "s", "e", width).collect()] == [("g", 15)]


def test_id_maps(spark):
    v = spark.createDataFrame([("a", [1.0, 3.0]), ("b", [3.0, 5.0]), ("c", [9.0, 9.0])], "key string, vec array<float>")
    m = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "2")], "src string, dst string")
    got = {r["key"]: list(r["vec"]) for r in jn.map_and_average(v, m).collect()}
    assert got == {"1": [2.0, 4.0], "2": [1.0, 3.0]}
    h = spark.createDataFrame([("1", "human", "A"), ("1", "mouse", "a"), ("2", "human", "B"), ("2", "mouse", "b"), ("2", "mouse", "b2")], "class string, species string, symbol string")
    assert [(r["src"], r["dst"]) for r in jn.one_to_one_orthologs(h, "human", "mouse").collect()] == [("A", "a")]


def test_cardinality_is_enforced(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    b = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(jn.CardinalityError):
        jn.checked_join(a, b, ["k"])
    assert jn.checked_join(a, b, ["k"], validate="many_to_one").count() == 2


def test_required_and_first_column(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert clean.first_available(df, ["x", "b"]) == "b" and clean.first_available(df, ["x"], "last") == "b"
    with pytest.raises(ValueError):
        clean.require_columns(df, ["a", "z"])


def test_reference_classes(spark):
    df = spark.createDataFrame([("tcga-brca",), ("Unlabelled cells",), ("unknown",), ("",), (None,), ("liver",)], "tissue string")
    got = [r["c"] for r in df.select(clean.reference_class("tissue").alias("c")).collect()]
    assert got == ["tumor_cohort", "unlabelled", "unknown", "healthy_tissue", "unknown", "healthy_tissue"]


def test_evenly_spaced_matches_linspace(spark):
    for n in (1, 2, 5, 16, 17, 100, 257):
        df = spark.range(n).select(F.lit("g").alias("g"), F.col("id"))
        got = sorted(r["id"] for r in rk.evenly_spaced(df, "g", "id", 16).collect())
        assert got == sorted(set(np.linspace(0, n - 1, min(16, n), dtype=int).tolist())), n


def test_quota_falls_back_when_nothing_is_labelled(spark):
    rows = [("s", "r1", "unlabelled", 0.9), ("s", "r2", "unlabelled", 0.8), ("t", "r1", "tumor_cohort", 0.1), ("t", "r2", "healthy_tissue", 0.05)]
    df = spark.createDataFrame(rows, "sample_id string, reference_id string, kind string, similarity double")
    got = [(r["sample_id"], r["rank"], r["reference_id"]) for r in rk.quota_top_k(df, "kind", {"healthy_tissue": 8, "tumor_cohort": 3}, 1).orderBy("sample_id", "rank").collect()]
    assert got == [("s", 1, "r1"), ("t", 1, "r2"), ("t", 2, "r1")]


def test_group_folds_do_not_leak(spark):
    df = spark.range(300).select("id", (F.col("id") % 17).alias("grp"), ((F.col("id") % 17) < 8).cast("int").alias("label"))
    out = sp.stratified_group_kfold(df, "grp", "label", 3, 1)
    assert out.groupBy("grp").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert out.select("fold").distinct().count() == 3 and out.count() == 300


def test_exact_counts_and_shards(spark):
    df = spark.range(100)
    got = {r["split"]: r["count"] for r in sp.exact_counts(df, "id", 1).groupBy("split").count().collect()}
    assert got == {"train": 80, "validate": 20}
    got = {r["split"]: r["count"] for r in sp.exact_counts(df, "id", 1, validate=10).groupBy("split").count().collect()}
    assert got == {"train": 90, "validate": 10}
    sh = spark.createDataFrame([("a", "h"), ("a", "m"), ("b", "h"), ("b", "h"), ("c", "h"), ("c", "h"), ("c", "m")], "shard string, k string")
    assert {r["shard"] for r in sp.balanced_shards(sh, "shard", "k", ("h", "m"), 0).collect()} == {"a"}
    assert {r["shard"] for r in sp.balanced_shards(sh, "shard", "k", ("h", "m"), 1).collect()} == {"a", "c"}


def test_empty_intersection(spark):
    s = spark.createDataFrame([("a", "X"), ("b", "Y")], "source string, feature string")
    assert al.shared_features(s, 2).count() == 0
