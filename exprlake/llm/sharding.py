"""Proportional stratified interleaving: shards that all carry the mixture of the whole table.

Rows of every stratum are shuffled by a seeded hash and ranked; rank ``r`` of ``n`` sits at the fraction
``(r - 0.5) / n`` of its stratum. Sorting all rows by that fraction interleaves the strata in proportion,
and equal cuts of that order give shards whose row counts differ by one at most and in which no stratum is
off its share by more rows than there are strata.

No window spans a stratum or the table: ranks are counted inside hash buckets and shifted by the totals of
the buckets before, so a stratum that holds a third of all rows is spread over as many tasks as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.common import stored, unsigned_order

ROWS_PER_BUCKET = 100_000
_HASH_BITS = 63


def _bits(rows: int) -> int:
    """Bucket bits: about ``ROWS_PER_BUCKET`` rows each and 64 buckets at least. Results don't depend on it."""
    return max(6, (rows // ROWS_PER_BUCKET).bit_length())


def interleave(docs: DataFrame, n_shards: int, stratum: str = "source", key: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: key, ``size``, ``text_crc32``, ``shard``, ``slot``, ``stratum_rank``, ``fraction``.

    * ``size`` is the UTF-8 length of the text plus 8; a null text counts as empty.
    * A null stratum is a stratum of its own. Strata of equal fraction keep the order of their names.
    * Repeated rows are placed one by one; equal texts are not kept together.
    * Fewer rows than shards leave the last shards empty; an empty table gives no rows.
    * Other columns, whatever their names, are neither read nor returned.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    body = F.coalesce(F.col(text), F.lit(""))
    base = stored(
        docs.select(
            F.col(key).alias("k"),
            F.concat(F.when(F.col(stratum).isNull(), "0").otherwise("1"), F.coalesce(F.col(stratum).cast("string"), F.lit(""))).alias("s"),
            (F.octet_length(body).cast("long") + 8).alias("size"),
            F.crc32(body).alias("text_crc32"),
        ).withColumn("u", unsigned_order(seed, F.col("k"), F.col("text_crc32"))),
        "interleave",
    )
    rows = base.count()
    bits = _bits(rows)
    base = base.withColumn("b", F.shiftright("u", _HASH_BITS - bits))
    before = Window.partitionBy("s").orderBy("b")
    strata = base.groupBy("s", "b").agg(F.count("*").alias("c")).select(
        "s", "b", (F.sum("c").over(before) - F.col("c")).alias("offset"), F.sum("c").over(Window.partitionBy("s")).alias("n"),
    )
    within = Window.partitionBy("s", "b").orderBy("u", "k", "text_crc32", "size")
    ranked = stored(
        base.withColumn("r", F.row_number().over(within))
        .join(strata, ["s", "b"])
        .withColumn("r", F.col("r") + F.col("offset"))
        .withColumn("f", (F.col("r") - 0.5) / F.col("n"))
        .select("k", "s", "size", "text_crc32", "r", "f"),
        "interleave-ranked",
    ).withColumn("fb", F.floor(F.col("f") * (1 << bits)))
    parts = ranked.groupBy("fb").agg(F.count("*").alias("c"))
    parts = parts.select("fb", (F.sum("c").over(Window.orderBy("fb")) - F.col("c")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("fb").orderBy("f", "s", "r")) - 1
    shard = F.expr(f"g * {n_shards} div {max(rows, 1)}")
    return (
        ranked.withColumn("g", place)
        .join(parts, "fb")
        .withColumn("g", F.col("g") + F.col("offset"))
        .withColumn("shard", shard.cast("int"))
        .select(
            F.col("k").alias(key), "size", "text_crc32", "shard",
            F.expr(f"g - (shard * {rows}L + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"),
            F.col("r").alias("stratum_rank"), F.col("f").alias("fraction"),
        )
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``docs`` into one folder per shard, in the order of their slots.

    ``key`` must be unique; rows without a place are left out. Each shard is written by its own task.
    """
    rows = docs.join(placed.select(key, "shard", "slot"), key)
    rows.repartition("shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
