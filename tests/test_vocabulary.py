"""Vocabularies that are too large for a plan literal give the same answers as small ones."""

import pytest
from pyspark.sql import functions as F

from exprlake.operators import align as al
from exprlake.plans import atlas as at

SCHEMA = "sample_id string, feature string, value double"


@pytest.fixture
def cells(spark):
    rows = [(s, f"g{i}", float(i + len(s))) for s, step in (("a", 1), ("bb", 3), ("ccc", 5)) for i in range(0, 23, step)]
    rows += [("a", "g3", 10.0), ("bb", "g0", None), ("none", "unknown", 1.0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def vocab(spark):
    return spark.createDataFrame([(f"g{i}", i) for i in range(20)], "feature string, pos int")


@pytest.mark.parametrize("fill", [0.0, None])
def test_blocks_equal_literals(cells, vocab, monkeypatch, fill):
    def answers():
        dense = {(r["sample_id"], r["feature"]): r["value"] for r in al.align(cells, vocab, fill).collect()}
        profiles = {r["sample_id"]: r["values"] for r in al.pack(cells, vocab, fill).collect()}
        names = al.vocabulary_names(vocab)
        back = {(r["sample_id"], r["feature"]): r["value"] for r in al.unpack(al.pack(cells, vocab, fill), vocab if names is None else names).collect()}
        return dense, profiles, back

    small = answers()
    monkeypatch.setattr(al, "MAX_VOCABULARY", 5)
    monkeypatch.setattr(al, "POSITIONS", 7)
    assert al.vocabulary_names(vocab) is None and answers() == small
    assert small[0] == small[2] and len(small[0]) == 80


def test_300_000_features(spark):
    vocab = spark.range(300_000).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("feature"), F.col("id").cast("int").alias("pos"))
    cells = spark.createDataFrame([("s", "g7", 2.0), ("s", "g299999", 3.0), ("t", "g4096", 4.0)], SCHEMA)
    out = al.align(cells, vocab)
    got = out.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.count_distinct("feature").alias("d")).collect()
    assert {tuple(r) for r in got} == {("s", 300_000, 5.0, 300_000), ("t", 300_000, 4.0, 300_000)}
    assert {tuple(r) for r in out.filter("value <> 0").collect()} == {("s", "g7", 2.0), ("s", "g299999", 3.0), ("t", "g4096", 4.0)}
    assert al.align_measured(cells, vocab).filter("measured").count() == 3


@pytest.mark.parametrize("per_sample", [False, True])
def test_matching_over_a_large_vocabulary(spark, monkeypatch, per_sample):
    ref = spark.createDataFrame([(r, f"g{i}", float((i * k) % 7)) for r, k in (("x", 1), ("y", 3), ("z", 5)) for i in range(30)], "reference_id string, feature string, value double")
    meta = spark.createDataFrame([("x", "human", "liver"), ("y", "human", "brain"), ("z", "mouse", "brain")], "reference_id string, species string, tissue string")
    query = spark.createDataFrame([(s, f"g{i}", float((i * k) % 7)) for s, k in (("p", 1), ("q", 5)) for i in range(2, 34)], SCHEMA)
    settings = at.AtlasSettings(minimum_shared=5, sparse_minimum=5)

    def answer():
        return sorted(map(str, at.atlas_match(query, ref, meta, settings, per_sample).collect()))

    small = answer()
    for module in (al, at):
        monkeypatch.setattr(module, "MAX_VOCABULARY", 4)
    assert answer() == small
    with pytest.raises(at.OverlapError):
        at.atlas_match(query.filter("feature IN ('g2', 'g31', 'g32', 'g33')").withColumn("feature", F.concat("feature", F.lit("?"))), ref, meta, settings)
