"""Keys of any type, repeated cells and missing labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprlake.operators.align import align, pack
from exprlake.operators.models import balanced_weights
from exprlake.operators.ordering import keyed_position
from exprlake.operators.ranking import dense_ids, evenly_spaced
from exprlake.operators.stats import bootstrap_auc, bootstrap_counts
from exprlake.operators.vectors import sample_pairs


def text_keys(n):
    return [f"Sample#{i:09d}" for i in range(n)]


@pytest.mark.parametrize("keys", [text_keys(3000), [5 * 10**11 + i for i in range(-1500, 1500)] + [0, 10**12]], ids=["common start", "packed middle"])
def test_positions_and_bucket_sizes(spark, keys):
    df = spark.createDataFrame([(k, i % 3) for i, k in enumerate(keys)], ["key", "g"]).repartition(5)
    got = keyed_position(df, ["g"], "key", rows_per_bucket=150, keep_bucket=True).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("key")
        assert part.position.tolist() == list(range(1, len(part) + 1)) and set(part.position_n) == {len(part)}
    assert got.groupby("_b").size().max() <= 300  # twice its share at most


def test_dense_ids_of_text(spark):
    df = spark.createDataFrame([(k,) for k in text_keys(50)], "feature string")
    assert [r["token_id"] for r in dense_ids(df, "feature").orderBy("feature").collect()] == list(range(1, 51))


def test_evenly_spaced_and_bootstrap_take_text(spark):
    rows = [("g", k, int(i % 3 == 0), float(i)) for i, k in enumerate(text_keys(21))]
    df = spark.createDataFrame(rows, "g string, key string, label int, score double")
    assert sorted(r["key"] for r in evenly_spaced(df, "g", "key", 5).collect()) == [text_keys(21)[i] for i in (0, 5, 10, 15, 20)]
    times = bootstrap_counts(df, ["g"], "key", 7, 1)
    assert {r["n"] for r in times.groupBy("replicate").agg(F.sum("times").alias("n")).collect()} == {21}
    assert bootstrap_auc(df, ["g"], "key", "label", "score", 5, 1).count() == 5


def test_pairs_take_text(spark):
    member = spark.createDataFrame([(f"t{i % 4}", k) for i, k in enumerate(text_keys(40))], "term string, key string")
    got = sample_pairs(member, 10, 3).collect()
    term = {k: i % 4 for i, k in enumerate(text_keys(40))}
    assert len(got) == 20 and all((term[r["a"]] == term[r["b"]]) == bool(r["label"]) for r in got)


def test_repeated_cells_are_averaged(spark):
    vocab = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "feature string, pos int")
    df = spark.createDataFrame([("s", "B", 1.0), ("s", "B", 3.0), ("s", "C", 5.0), ("u", "B", None), ("u", "B", 4.0)], "sample_id string, feature string, value double")
    got = {r["sample_id"]: r["values"] for r in pack(df, vocab).collect()}
    assert got == {"s": [0.0, 2.0, 5.0], "u": [0.0, 4.0, 0.0]}
    assert align(df, vocab).count() == 6


def test_weights_leave_missing_labels_out(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,)], "label string")
    got = sorted((r["label"], r["weight"]) for r in balanced_weights(df, "label").collect())
    assert got == [("a", pytest.approx(4 / 6))] * 3 + [("b", 2.0)]
    assert np.isclose(sum(w for _, w in got), 4)


ATLAS = [("r1", "a", 1.0), ("r1", "b", 2.0), ("r1", "c", 4.0), ("r2", "a", 4.0), ("r2", "b", 1.0), ("r2", "c", 1.0)]
QUERY = [("s1", "a", 1.0), ("s1", "b", 2.0), ("s1", "c", 3.0), ("s2", "a", 90.0), ("s2", "b", 5.0), ("s2", "c", 9.0), ("s3", "x", 1.0), ("s3", "y", 2.0)]


def test_every_sample_and_reference_is_answered(spark):
    from exprlake.plans.atlas import INSUFFICIENT, AtlasSettings, atlas_match

    query = spark.createDataFrame(QUERY, "sample_id string, feature string, value double")
    atlas = spark.createDataFrame(ATLAS, "reference_id string, feature string, value double")
    settings = AtlasSettings(minimum_shared=2, sparse_minimum=1)
    for info in ([], [("r2", None, None)]):
        meta = spark.createDataFrame(info, "reference_id string, species string, tissue string")
        got = {r["sample_id"]: r for r in atlas_match(query.filter("sample_id <> 's3'"), atlas, meta, settings).collect()}
        assert {s: (r["call"], r["margin"], r["best_tissue"]) for s, r in got.items()} == {s: ("indeterminate", 1.0, "unknown") for s in ("s1", "s2")}
        assert (got["s1"]["best_reference"], got["s2"]["best_reference"]) == ("r1", "r2")
    together = {r["sample_id"]: r for r in atlas_match(query, atlas, meta, settings, per_sample=True).collect()}
    assert together["s3"]["call"] == INSUFFICIENT and together["s3"]["best_reference"] is None
    for sample in ("s1", "s2"):
        alone = atlas_match(query.filter(F.col("sample_id") == sample), atlas, meta, settings, per_sample=True).collect()
        assert alone == [together[sample]]
