"""Corpus pipeline: drop toxic documents, keep one of each near-duplicate group, cut repeated passages, mix the sources, pack.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but the last return the
columns of ``documents``. Labels are read by the first stage alone, and only those that may be learned from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exprlake.llm import mixing, neardup, packing, passages, toxicity
from exprlake.llm.common import remainder, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: From this probability on a document counts as toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the labels outside fold 2 of 4 are learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, remainder("doc_id", 4) != 2)
    return toxicity.score(docs, model, out="__toxicity").filter(F.col("__toxicity") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group; rows that repeat an id stay once."""
    groups = neardup.near_duplicates(docs.select("doc_id", "text"))
    gone = stored(groups.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "near-duplicates")
    # one shuffle of the texts serves both; rows without an id are nobody's repeat
    keyed = docs.withColumn("__key", F.coalesce("doc_id", -1 - F.monotonically_increasing_id()))
    kept = keyed.join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    first = Window.partitionBy("__key").orderBy(F.xxhash64("text", "source"))
    return kept.withColumn("__row", F.row_number().over(first)).filter(F.col("__row") == 1).select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that a document of a smaller id has."""
    found = stored(passages.repeated_passages(docs.select("doc_id", "text")), "passages")
    cut = passages.remove_passages(docs, found)
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice, in the order of the mixture's blocks."""
    return mixing.realise(docs.select(*COLUMNS))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2,048 ids."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("source_mixture", mix_sources),
    ("packing", pack_windows),
]

#: The first stage fits a model, so SQL can't express the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
