"""Embedding tables, result trees, optional companions and provenance records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from exprlake.functions.vectors import all_finite


def embedding_report(df: DataFrame, key: str = "key", vec: str = "vec", fallback: str | None = None) -> DataFrame:
    """One row of shape and content checks over an embedding table."""
    is_fallback = F.col(fallback).cast("boolean") if fallback else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.approx_count_distinct(key).alias("approx_keys"),
        F.min(F.size(vec)).cast("bigint").alias("min_width"),
        F.max(F.size(vec)).cast("bigint").alias("max_width"),
        F.count_if(~all_finite(vec)).alias("non_finite_rows"),
        F.count_if(is_fallback).alias("fallback_rows"),
    ).withColumn(
        "valid",
        (F.col("rows") > 0) & (F.col("min_width") == F.col("max_width"))
        & (F.col("non_finite_rows") == 0) & (F.col("fallback_rows") == 0),
    )


def read_embeddings(
    spark: SparkSession, path: str, key: str, vec: str, fallback: str | None = None, strict: bool = True
) -> DataFrame:
    """Embedding Parquet as (key, vec); ``strict`` refuses ragged, non-finite or fallback tables."""
    raw = spark.read.parquet(path)
    if strict:
        report = embedding_report(raw, key, vec, fallback).first()
        if not report["valid"]:
            raise ValueError(f"embedding table failed validation: {report.asDict()}")
    return raw.select(F.col(key).alias("key"), F.col(vec).alias("vec"))


def number_lines(spark: SparkSession, matrix: str, names: str, row_col: str = "row_number") -> DataFrame:
    """Pair a numeric CSV with a separate name list on an explicit row-number column in both."""
    m = spark.read.option("header", True).option("inferSchema", True).csv(matrix)
    n = spark.read.option("header", True).csv(names)
    n = n.withColumn(row_col, F.col(row_col).cast(m.schema[row_col].dataType))
    values = [c for c in m.columns if c != row_col]
    packed = m.select(row_col, F.array(*[F.col(c).cast("double") for c in values]).alias("vec"))
    return n.join(packed, row_col).drop(row_col)


def read_result_tree(spark: SparkSession, path: str, pattern: str, names: list[str], fmt: str = "csv") -> DataFrame:
    """Result files below ``path``; the groups of ``pattern`` in the file path become columns."""
    reader = spark.read.option("recursiveFileLookup", True).option("header", True).option("inferSchema", False)
    df = reader.format(fmt).load(path).select("*", F.col("_metadata.file_path").alias("_p"))
    for i, name in enumerate(names, 1):
        df = df.withColumn(name, F.regexp_extract("_p", pattern, i))
    return df.drop("_p")


def read_optional(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Companion table that may be missing: then an empty table of the same type."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_required(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"required table missing: {path}") from exc
        raise


def flatten_provenance(df: DataFrame, json_col: str, model_col: str = "model") -> DataFrame:
    """Audit documents ``{fallback, shape: [..], provenance: {..}}`` to flat rows; missing keys give NULL."""
    schema = "struct<fallback:boolean, shape:array<bigint>, provenance:map<string,string>>"
    doc = df.select(model_col, F.from_json(json_col, schema).alias("d"))

    def pick(key: str):
        return F.try_element_at("d.provenance", F.lit(key))

    return doc.select(
        model_col,
        F.coalesce(pick("dynamic_embedding").cast("boolean"), F.lit(False)).alias("dynamic"),
        F.col("d.fallback").alias("fallback"),
        F.array_join(F.col("d.shape").cast("array<string>"), "x").alias("shape"),
        pick("checkpoint").alias("checkpoint"),
        pick("context_samples").try_cast("bigint").alias("context_samples"),
        pick("context_elapsed_seconds").try_cast("double").alias("context_elapsed_seconds"),
    )
