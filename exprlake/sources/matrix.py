"""Measurement matrices: wide or long Parquet to the long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UNPIVOT = 1000


def feature_names(spark: SparkSession, path: str, id_cols: Sequence[str]) -> list[str]:
    """Feature columns from the Parquet footer only; no data is read."""
    return [c for c in spark.read.parquet(path).schema.names if c not in set(id_cols)]


def melt(df: DataFrame, id_col: str, features: Sequence[str], feature: str = "feature") -> DataFrame:
    """Wide rows to (id, feature, value).

    Very wide frames are packed into one array first, and names come from a join
    on the column position, so that the plan does not grow with the width.
    """
    if len(features) <= MAX_UNPIVOT:
        cols = [F.col(f"`{c}`").cast("double").alias(c) for c in features]
        return df.select(id_col, *cols).unpivot([id_col], list(features), feature, "value")
    spark = df.sparkSession
    packed = df.select(id_col, F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("_v"))
    names = spark.createDataFrame(list(enumerate(features)), f"pos int, {feature} string")
    long = packed.select(id_col, F.posexplode("_v").alias("pos", "value"))
    return long.join(names, "pos").select(id_col, feature, "value")


def read_wide(
    spark: SparkSession, path: str, id_col: str, features: Sequence[str] | None = None
) -> DataFrame:
    """Sample-major Parquet (one column per feature) to measurements.

    Choosing ``features`` prunes the scan: Catalyst does not push a feature filter
    through an unpivot, so the column list is cut here.
    """
    names = feature_names(spark, path, [id_col])
    if features is not None:
        wanted = set(features)
        names = [c for c in names if c in wanted]
    return melt(spark.read.parquet(path), id_col, names).withColumnRenamed(id_col, "sample_id")


def read_feature_major(spark: SparkSession, path: str, feature_col: str) -> DataFrame:
    """Feature-major Parquet (one column per sample) to measurements."""
    samples = feature_names(spark, path, [feature_col])
    long = melt(spark.read.parquet(path), feature_col, samples, "sample_id")
    return long.select("sample_id", F.col(feature_col).alias("feature"), "value")


def detect_orientation(df: DataFrame, key_col: str, vocabulary: DataFrame, feature: str = "feature") -> DataFrame:
    """One row: how many column names and key values are known features, and the orientation."""
    spark = df.sparkSession
    vocab = vocabulary.select(F.upper(feature).alias("_f")).distinct()
    columns = spark.createDataFrame([(c,) for c in df.columns if c != key_col], "c string")
    names = columns.select(F.upper("c").alias("_f"), F.lit("column").alias("side"))
    keys = df.select(F.upper(F.col(key_col).cast("string")).alias("_f"), F.lit("key").alias("side"))
    hits = names.unionByName(keys).distinct().join(vocab, "_f", "left_semi")
    both = hits.agg(
        F.count_if(F.col("side") == "column").alias("column_hits"), F.count_if(F.col("side") == "key").alias("key_hits")
    )
    return both.withColumn(
        "orientation",
        F.when((F.col("column_hits") == 0) & (F.col("key_hits") == 0), "unknown")
        .when(F.col("column_hits") >= F.col("key_hits"), "sample_major")
        .otherwise("feature_major"),
    )


def read_long(
    spark: SparkSession, path: str, sample: str, feature: str, value: str, features: DataFrame | None = None
) -> DataFrame:
    """Coordinate-list counts (one row per sample and feature), optionally kept to ``features``."""
    long = spark.read.parquet(path).select(
        F.col(sample).alias("sample_id"), F.col(feature).alias("feature"), F.col(value).cast("double").alias("value")
    )
    return long if features is None else long.join(features, "feature", "left_semi")


def to_wide(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long measurements to one column per listed feature."""
    return df.groupBy("sample_id").pivot("feature", list(features)).agg(F.first("value"))
