import gzip
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from exprlake.sources import matrix, sinks, tables, text


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def put(folder, name, content):
    path = os.path.join(folder, name)
    data = content.encode("utf-8")
    with open(path, "wb") as f:
        f.write(gzip.compress(data) if name.endswith(".gz") else data)
    return path


def test_delimited_with_mark_and_gzip(spark, folder):
    path = put(folder, "a.csv.gz", "﻿gene,S1,S2\nA,1,NA\nB,,2.5\n")
    df = text.read_delimited(spark, path)
    assert df.columns == ["gene", "S1", "S2"]
    assert [tuple(r) for r in df.orderBy("gene").collect()] == [("A", "1", None), ("B", None, "2.5")]


def test_gmt(spark, folder):
    path = put(folder, "a.gmt", "T1\tnote\tg1,1.0\tg2\tG1\nshort\tnote\nT2\tn\tx\n")
    got = {(r["term"], r["feature"]) for r in text.read_gmt(spark, path).collect()}
    assert got == {("T1", "G1"), ("T1", "G2"), ("T2", "X")}
    assert {r["term"] for r in text.read_gmt(spark, path, 2).collect()} == {"T1"}


def test_gtf_with_symbol_map(spark, folder):
    row = 'chr1\tsrc\t{}\t{}\t{}\t.\t+\t.\tgene_id "x"; gene_name "{}";'
    path = put(folder, "a.gtf.gz", "#head\n" + "\n".join([row.format("exon", 1, 5, "abc"), row.format("gene", 1, 9, "abc"), row.format("exon", 3, 9, "zz")]))
    m = spark.createDataFrame([("ABC", "H1")], "src string, dst string")
    got = [tuple(r) for r in text.read_gtf_exons(spark, path, symbol_map=m).collect()]
    assert got == [("H1", "chr1", 1, 5)]


def test_series_header(spark, folder):
    put(folder, "one.txt", '!x\n!Sample_title\t"t 1"\t"t2"\n!Sample_geo_accession\t"G1"\t"G2"\n')
    put(folder, "two.txt", '!Sample_title\t"only"\n!Sample_geo_accession\t"G1"\t"G2"\n')
    got = [tuple(r) for r in text.read_series_header(spark, folder).orderBy("accession").collect()]
    assert got == [("one.txt", "t 1", "G1"), ("one.txt", "t2", "G2")]


def test_ontology(spark, folder):
    path = put(folder, "a.obo", "format: 1\n\n[Term]\nid: T:1\nname: one: two\nnamespace: p\n\n[Term]\nid: T:2\nname: x\nis_obsolete: true\n\n[Typedef]\nid: q\n")
    assert [tuple(r) for r in text.read_ontology(spark, path).collect()] == [("T:1", "one: two", "p")]


def test_edges_and_homology(spark, folder):
    path = put(folder, "e.tsv", "a\tb\nlonely\nc d\n")
    assert {tuple(r) for r in text.read_edges(spark, path).collect()} == {("A", "B"), ("C", "D")}
    path = put(folder, "h.tsv", "DB Class Key\tCommon Organism Name\tSymbol\n1\thuman\tA\n1\tMouse, laboratory\t\n2\thuman\tnan\n")
    got = [tuple(r) for r in text.read_homology(spark, path, "DB Class Key", "Common Organism Name", "Symbol").collect()]
    assert got == [("1", "human", "A")]


def test_embedding_validation(spark, folder):
    good = spark.createDataFrame([("a", [1.0, 2.0])], "key string, vec array<float>")
    good.write.parquet(f"{folder}/good")
    assert tables.read_embeddings(spark, f"{folder}/good", "key", "vec").count() == 1
    bad = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [float("nan"), 1.0])], "key string, vec array<float>")
    bad.write.parquet(f"{folder}/bad")
    with pytest.raises(ValueError):
        tables.read_embeddings(spark, f"{folder}/bad", "key", "vec")
    assert tables.embedding_report(bad.withColumn("fb", F.lit(True)), fallback="fb").first()["fallback_rows"] == 2


def test_numbered_csv_pair(spark, folder):
    m = put(folder, "m.csv", "row_number,x,y\n2,3,4\n1,1,2\n")
    n = put(folder, "n.csv", "row_number,gene\n1,A\n2,B\n")
    assert {r["gene"]: r["vec"] for r in tables.number_lines(spark, m, n).collect()} == {"A": [1.0, 2.0], "B": [3.0, 4.0]}


def test_optional_and_required(spark, folder):
    assert tables.read_optional(spark, f"{folder}/none", "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_required(spark, f"{folder}/none", "a int")


def test_provenance_with_missing_keys(spark):
    doc = '{"fallback": false, "shape": [3, 4], "provenance": {"checkpoint": "c", "context_samples": "12"}}'
    r = tables.flatten_provenance(spark.createDataFrame([("m", doc), ("n", "{}")], "model string, doc string"), "doc").orderBy("model").collect()
    assert r[0]["shape"] == "3x4" and r[0]["context_samples"] == 12 and r[0]["dynamic"] is False
    assert r[1]["checkpoint"] is None


def test_wide_frames_take_the_packed_path(spark, monkeypatch):
    df = spark.createDataFrame([("s", 1.0, None), ("t", 3.0, 4.0)], "id string, A double, B double")
    narrow = {tuple(r) for r in matrix.melt(df, "id", ["A", "B"]).collect()}
    monkeypatch.setattr(matrix, "MAX_UNPIVOT", 1)
    assert {tuple(r) for r in matrix.melt(df, "id", ["A", "B"]).collect()} == narrow


def test_orientation_unknown(spark):
    df = spark.createDataFrame([("s", 1.0)], "id string, X double")
    v = spark.createDataFrame([("A",)], "feature string")
    assert matrix.detect_orientation(df, "id", v).first()["orientation"] == "unknown"


def test_inventory_reports_changes(spark, folder):
    put(folder, "a.csv", "x")
    put(folder, "b.md", "y")
    stored = [tuple(r) for r in sinks.content_inventory(spark, folder).collect()]
    put(folder, "a.csv", "changed")
    put(folder, "c.py", "new")
    os.remove(os.path.join(folder, "b.md"))
    was = spark.createDataFrame(stored, "path string, category string, bytes bigint, sha256 string")
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in sinks.verify_inventory(was, sinks.content_inventory(spark, folder)).collect()}
    assert got == {"a.csv": "mismatch", "b.md": "missing", "c.py": "unlisted"}
