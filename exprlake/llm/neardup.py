"""Near-duplicate documents by tensored MinHash banding.

A document is the set of its distinct five-word shingles. Two collections of ``SIDE`` sub-keys are made, each
of ``ROWS`` minima; every pair of a sub-key of one collection and one of the other is the key of a table, so
``2 * SIDE * ROWS`` minima serve ``SIDE ** 2`` tables, about the square root of what separate tables would need.
Documents that share a key are candidates, and become links only when their full sets are similar enough.
Equal sets are one candidate; groups are the connected components of the links.

Two documents of similarity 0.75 share no table with probability 0.0027; of 0.8, 0.0006.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.llm.common import mixed, stored, word_ids
from exprlake.llm.links import linked

WIDTH = 5
SIDE = 8
ROWS = 2
PER_CENT = 75
_RNG = np.random.default_rng(20_04)
_STEPS = _RNG.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS = _RNG.integers(0, 2**63, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNED = "id bigint, n_shingles bigint, content string, parts array<bigint>"
SETS = "id bigint, items binary"


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; fewer words than ``width`` are one shingle, none are no shingle."""
    h = word_ids(text)
    if not len(h):
        return h
    if len(h) < width:
        return mixed(np.array([sum(int(x) * int(s) for x, s in zip(h, _STEPS, strict=False)) + len(h) & (2**64 - 1)], np.uint64))
    n = len(h) - width + 1
    s = h[:n] * _STEPS[0]
    for i in range(1, width):
        s = s + h[i : i + n] * _STEPS[i]
    return np.unique(mixed(s))


def minima(items: np.ndarray, turns: np.ndarray, step: int = 2048) -> np.ndarray:
    """MinHash values of a set, one per multiplier."""
    out = np.full(len(turns), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), step):
        out = np.minimum(out, (items[i : i + step, None] * turns[None, :]).min(axis=0))
    return out


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, n_shingles, content`` (hash of the set) and ``parts`` (sub-keys of both collections) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, content, parts = [], [], []
            for t in batch.column(1).to_pylist():
                items = shingles(t)
                size.append(len(items))
                content.append(xxhash.xxh3_128_hexdigest(items.tobytes()))
                m = minima(items, _TURNS).reshape(2 * SIDE, ROWS)
                own = m[:, 0]
                for r in range(1, ROWS):
                    own = mixed(own) + m[:, r]
                parts.append(mixed(own).view(np.int64) if len(items) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(content), pa.array(parts, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "content", "parts"],
            )

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).mapInArrow(run, SIGNED)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``id, items`` of rows ``id, t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                items = [shingles(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(items, pa.binary())], names=["id", "items"])

    return docs.select("id", "t").mapInArrow(run, SETS)


def table_keys(parts: DataFrame) -> DataFrame:
    """``key, bucket, id`` for the tables in which a row may meet another.

    A table's key is a pair of sub-keys, so a row meets nobody where one of them is its own alone; those sub-keys are
    dropped before pairs are made.
    """
    single = parts.select("id", F.posexplode("parts").alias("c", "v"))
    shared = single.groupBy("c", "v").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("c", "v")
    held = single.join(shared, ["c", "v"])
    sides = held.groupBy("id").agg(
        F.collect_list(F.when(F.col("c") < SIDE, F.struct("c", "v"))).alias("left"), F.collect_list(F.when(F.col("c") >= SIDE, F.struct("c", "v"))).alias("right")
    )  # SIDE entries each at most
    return sides.withColumn("l", F.explode("left")).withColumn("r", F.explode("right")).select(
        F.xxhash64("l.c", "l.v", "r.c", "r.v").alias("key"), (F.col("l.c") * SIDE + F.col("r.c") - SIDE).alias("bucket"), "id"
    )


def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first table in which rows of ``x`` and rows of ``y`` have one key: their first equal sub-keys of both sides."""
    out = []
    for side in (range(SIDE), range(SIDE, 2 * SIDE)):
        first = np.full((len(x), len(y)), -1, np.int16)
        for c in reversed(side):
            first[x[:, c][:, None] == y[:, c][None, :]] = c
        out.append(first)
    return np.where((out[0] >= 0) & (out[1] >= 0), out[0] * SIDE + out[1] - SIDE, -1)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", per_cent: int = PER_CENT) -> DataFrame:
    """``key, n_shingles, component_id, kept`` per row.

    * ``component_id`` is the smallest key reachable through links (100 * intersection >= ``per_cent`` * union), the own
      one included; ``kept`` says that it is the own one.
    * A null, empty or blank text has no shingles and no links.
    * A row with a null key is in no group: its component is null and it is kept.
    * Keys are expected to be unique; rows that repeat a key with the same text get the same answer.
    * Other columns are not read; no rows give no rows.
    """
    signed = stored(signatures(docs, key, text), "signatures")
    whole = signed.filter(F.col("id").isNotNull())
    first = whole.filter("n_shingles > 0").groupBy("content").agg(F.min("id").alias("rep"))
    of = stored(
        whole.join(first, "content", "left").select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep"), "parts"),
        "representatives",
    )
    parts = of.filter("id = rep AND n_shingles > 0").select("id", "parts")
    keyed = stored(table_keys(parts), "table-keys")
    asked = keyed.select("id").distinct()
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    sets = stored(shingle_sets(texts.join(asked, "id")).dropDuplicates(["id"]), "shingle-sets")
    found = linked(keyed, parts, sets, per_cent, first_shared, per_part=SIDE)
    answer = of.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("id").alias(key), "n_shingles", F.coalesce("component", "rep").alias("component_id")
    ).withColumn("kept", F.col(key) == F.col("component_id"))
    alone = signed.filter(F.col("id").isNull()).select(
        F.col("id").alias(key), "n_shingles", F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept")
    )
    return answer.union(alone)
