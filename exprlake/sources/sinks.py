"""Writers: partitioned Parquet, fixed-format text, manifests, resume, content hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exprlake.functions.columns import finite


def write_shards(df: DataFrame, path: str, by: Sequence[str], files_per_value: int | None = None, spread: Sequence[str] = ()) -> None:
    """zstd Parquet below one folder per value of ``by``.

    Rows are rebalanced by ``by``: adaptive execution merges small values and
    splits a hot one over several tasks. With ``files_per_value`` every value is
    dealt over that many tasks by a hash of ``spread`` instead.
    """
    if files_per_value:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in (spread or df.columns)]), F.lit(files_per_value))
        df = df.withColumn("_s", salt).repartition(*by, "_s").drop("_s")
    else:
        df = df.hint("rebalance", *by)
    df.write.mode("overwrite").partitionBy(*by).option("compression", "zstd").parquet(path)


def write_delimited(
    df: DataFrame, path: str, decimals: int | None = None, sep: str = ",", null: str = "NA", gzip: bool = False
) -> None:
    """CSV/TSV with a fixed number of decimals (half-even) and a marker for missing values."""
    if decimals is not None:
        cols = {
            f.name: F.when(
                finite(f.name), F.format_string(f"%.{decimals}f", F.bround(F.col(f.name).cast("double"), decimals))
            )
            for f in df.schema.fields
            if f.dataType.typeName() in ("double", "float")
        }
        df = df.withColumns(cols) if cols else df
    w = df.write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", null)
    (w.option("compression", "gzip") if gzip else w).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """JSON lines; the commit protocol makes the output appear at once."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def shard_manifest(df: DataFrame, id_col: str, sort: str | None = None) -> DataFrame:
    """(file, position, id): the ordered ids of every file.

    Stays long: a shard list packed into one row would grow with the shard.
    """
    from pyspark.sql import Window

    src = df.select(F.col("_metadata.file_path").alias("path"), F.col(id_col).alias("id")).distinct()
    w = Window.partitionBy("path").orderBy("id")
    return src.withColumn("position", F.row_number().over(w).cast("bigint"))


def pending_units(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned units that are not yet in the output."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append_pending(planned: DataFrame, path: str, keys: Sequence[str], compute) -> DataFrame:
    """Compute and append only the units missing from ``path``; returns the whole output."""
    spark = planned.sparkSession
    from exprlake.sources.tables import read_optional

    sample = compute(planned)
    done = read_optional(spark, path, sample.schema)
    compute(pending_units(planned, done, keys)).write.mode("append").parquet(path)
    return spark.read.schema(sample.schema).parquet(path)


#: Size up to which a file is read as one cell where only Spark reaches it; a cell can't hold 2 GB.
WHOLE_FILE = 1 << 30
#: The same of files that every process of a machine can open; a task holds several copies of a cell.
LOCAL_FILE = 16 << 20
PIECE = 8 << 20


def content_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, category, bytes, sha256) of every file below ``path``.

    Spark's file source lists no empty files. Files above ``LOCAL_FILE``, in a store that isn't a local folder above
    ``WHOLE_FILE``, go through the hash in pieces inside a task, so no size is too large and memory stays bounded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    category = (
        F.when(ext.isin("csv", "tsv", "parquet", "json", "gz"), "table")
        .when(ext.isin("png", "svg", "pdf"), "figure")
        .when(ext.isin("py", "sh", "ps1"), "code")
        .when(ext.isin("md", "txt"), "text")
        .otherwise("other")
    )
    listed = ["path", category.alias("category"), F.col("length").alias("bytes")]
    first = files.select("path").first()
    most = min(LOCAL_FILE, WHOLE_FILE) if first and first["path"].startswith("file:") else WHOLE_FILE
    whole = files.filter(F.col("length") <= most).select(*listed, F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > most).select(*listed)
    return whole.unionByName(large.mapInPandas(_hash_in_pieces, "path string, category string, bytes bigint, sha256 string"))


def _hash_in_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for f in frames:
        found = []
        for path in f["path"]:
            local = re.match(r"file:/+(.*)", path, re.S)
            system, at = (fs.LocalFileSystem(), f"/{local.group(1)}") if local else fs.FileSystem.from_uri(quote(path, safe=":/@"))
            digest = hashlib.sha256()
            with system.open_input_stream(at, compression=None) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield f.assign(sha256=found)


def verify_inventory(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Paths whose content differs, is missing, or was not listed."""
    a = stored.select("path", F.col("sha256").alias("stored_sha256"))
    b = current.select("path", F.col("sha256").alias("current_sha256"))
    both = a.join(b, "path", "full_outer")
    status = (
        F.when(F.col("current_sha256").isNull(), "missing")
        .when(F.col("stored_sha256").isNull(), "unlisted")
        .when(F.col("stored_sha256") != F.col("current_sha256"), "mismatch")
        .otherwise("ok")
    )
    return both.withColumn("status", status)
