"""The queries' contract and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from exprlake.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import awkward_rows, frame


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_neighbours_match_sql(spark, small_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small_dir}/embeddings.parquet'")
    want = con.sql(ORACLES["op8_rotated_one_bit_codes"]).fetchall()
    got = QUERIES["op8_rotated_one_bit_codes"](spark, small_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.fixture(scope="module")
def stages(spark, small_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, small_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_take_effect(spark, small_dir, stages):
    whole, calm, single, cut, mixed, packed = stages
    for docs in stages[:-1]:
        assert docs.columns == whole.columns
    assert calm.count() < whole.count() and calm.subtract(whole).isEmpty()
    assert single.count() < calm.count() and single.subtract(calm).isEmpty()
    assert {r[0] for r in cut.select("doc_id").collect()} == {r[0] for r in single.select("doc_id").collect()}
    assert cut.filter(F.char_length("text") != F.col("n_chars")).isEmpty()
    assert mixed.subtract(cut).isEmpty() and cut.subtract(mixed).isEmpty()
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in mixed.select("doc_id").collect()}


def test_stages_take_awkward_rows(spark, small_dir, tmp_path):
    docs = frame(spark, awkward_rows()).select(*corpus_pipeline.COLUMNS, F.lit(1).alias("extra"))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small_dir)
    assert kept.filter("doc_id = 107").count() == 0 and kept.filter("doc_id IS NULL").count() == 2
    assert corpus_pipeline.drop_near_duplicates(spark, docs.filter("false"), small_dir).count() == 0
    assert corpus_pipeline.cut_repeated_passages(spark, docs, small_dir).count() == docs.count()
    assert corpus_pipeline.pack_windows(spark, docs.filter("false"), small_dir).count() == 0


def test_filter_and_mixture_take_awkward_rows(spark, small_dir):
    docs = frame(spark, awkward_rows()).select(*corpus_pipeline.COLUMNS, F.lit(1).alias("extra"))
    whole, none = docs.select(*corpus_pipeline.COLUMNS), docs.filter("false")
    calm = corpus_pipeline.drop_toxic(spark, docs, small_dir)
    assert calm.columns == corpus_pipeline.COLUMNS and calm.exceptAll(whole).isEmpty()
    # one text has one score, whatever its row
    assert calm.filter("doc_id IN (106, 107)").count() in (0, 3)
    assert corpus_pipeline.drop_toxic(spark, none, small_dir).count() == 0
    mixed = corpus_pipeline.mix_sources(spark, docs, small_dir)
    assert mixed.columns == corpus_pipeline.COLUMNS and whole.exceptAll(mixed).isEmpty() and mixed.subtract(whole).isEmpty()
    assert corpus_pipeline.mix_sources(spark, none, small_dir).count() == 0
