"""Delimited and record-structured text formats, parsed with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(
    spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True, null: str = "NA"
) -> DataFrame:
    """CSV/TSV, plain or gzip. Without a schema every column stays text; a byte-order mark is dropped."""
    reader = spark.read.option("sep", sep).option("header", header).option("nullValue", null)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def parse_gmt(lines: DataFrame, min_size: int = 1) -> DataFrame:
    """``term <tab> note <tab> FEATURE[,weight] ...`` lines to (term, feature)."""
    parts = lines.select(F.split(F.rtrim("value"), "\t").alias("p")).filter(F.size("p") >= 3)
    long = parts.select(
        F.col("p")[0].alias("term"),
        F.explode(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0)))).alias("item"),
    )
    long = long.select("term", F.upper(F.trim(F.split("item", ",")[0])).alias("feature")).filter(F.col("feature") != "")
    long = long.distinct()
    if min_size <= 1:
        return long
    big = long.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    return long.join(big, "term", "left_semi")


def read_gmt(spark: SparkSession, path: str, min_size: int = 1) -> DataFrame:
    return parse_gmt(spark.read.text(path), min_size)


def read_json_sets(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects ``{term: [feature, ...]}`` to (term, feature); each file is one object."""
    whole = spark.read.text(path, wholetext=True)
    sets = whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("term", "items"))
    long = sets.select("term", F.explode("items").alias("f")).filter(F.col("f").isNotNull() & (F.col("f") != ""))
    return long.select("term", F.upper("f").alias("feature")).distinct()


def parse_gtf_exons(lines: DataFrame) -> DataFrame:
    """Exon rows of a GTF file as (feature, chrom, start, end)."""
    p = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#")).select(p.alias("p"))
    rows = rows.filter((F.size("p") == 9) & (F.col("p")[2] == "exon"))
    out = rows.select(
        F.upper(F.regexp_extract(F.col("p")[8], 'gene_name "([^"]+)"', 1)).alias("feature"),
        F.col("p")[0].alias("chrom"),
        F.col("p")[3].cast("bigint").alias("start"),
        F.col("p")[4].cast("bigint").alias("end"),
    )
    return out.filter(F.col("feature") != "")


def read_gtf_exons(
    spark: SparkSession, path: str, vocabulary: DataFrame | None = None, symbol_map: DataFrame | None = None
) -> DataFrame:
    """Exons, with symbols mapped through (src, dst) and kept to the vocabulary when given."""
    exons = parse_gtf_exons(spark.read.text(path))
    if symbol_map is not None:
        mapped = symbol_map.select(F.upper("src").alias("feature"), "dst")
        exons = exons.join(mapped, "feature").select(F.col("dst").alias("feature"), "chrom", "start", "end")
    return exons if vocabulary is None else exons.join(vocabulary, "feature", "left_semi")


def parse_series_header(lines: DataFrame, series: str = "series") -> DataFrame:
    """Two parallel header lines per series to (series, title, accession); unequal lengths are dropped."""
    def items(mark: str) -> Column:
        fields = F.split("value", "\t")
        cells = F.transform(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))), lambda x: F.btrim(x, F.lit('"')))
        return F.max(F.when(F.col("value").startswith(mark), cells))

    heads = lines.filter(F.col("value").startswith("!Sample_title") | F.col("value").startswith("!Sample_geo_accession"))
    pair = heads.groupBy(series).agg(
        items("!Sample_title").alias("title"), items("!Sample_geo_accession").alias("accession")
    )
    good = pair.filter(F.size("title") == F.size("accession"))
    zipped = good.select(series, F.explode(F.arrays_zip("title", "accession")).alias("z"))
    return zipped.select(series, "z.title", "z.accession")


def read_series_header(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("series"))
    return parse_series_header(lines)


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """Term stanzas as (id, name, namespace), obsolete ones dropped."""
    stanzas = spark.read.text(path, lineSep="\n[")
    terms = stanzas.filter(F.col("value").rlike(r"^\[?Term\]"))

    def key(name: str) -> Column:
        return F.trim(F.regexp_extract("value", rf"(?m)^{name}: (.*)$", 1))

    out = terms.select(
        key("id").alias("id"), key("name").alias("name"), key("namespace").alias("namespace"),
        key("is_obsolete").alias("obsolete"),
    )
    return out.filter((F.col("id") != "") & (F.col("obsolete") != "true")).drop("obsolete")


def read_homology(
    spark: SparkSession, path: str, class_col: str, species_col: str, symbol_col: str
) -> DataFrame:
    """Homology report to (class, species, symbol); blank fields are dropped, species is folded."""
    raw = read_delimited(spark, path, sep="\t")
    out = raw.select(
        F.trim(class_col).alias("class"), F.lower(F.trim(species_col)).alias("species"), F.trim(symbol_col).alias("symbol")
    )
    ok = [F.col(c).isNotNull() & ~F.lower(c).isin("", "nan") for c in ("class", "species", "symbol")]
    return out.filter(ok[0] & ok[1] & ok[2])


def parse_edges(lines: DataFrame) -> DataFrame:
    """Pairs from the first two fields of each line, upper-cased; short lines are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.select(p.alias("p")).filter(F.size("p") >= 2)
    return rows.select(F.upper(F.col("p")[0]).alias("a"), F.upper(F.col("p")[1]).alias("b"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_edges(spark.read.text(path))
