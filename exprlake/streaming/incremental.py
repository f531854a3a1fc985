"""Structured Streaming forms of the three incremental patterns.

File sources give exactly-once input with a checkpoint folder. Batches write to a
folder of their own, overwritten on a retry, so a replayed batch changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from exprlake.functions.vectors import vector_width
from exprlake.operators.sums import PARTS, joined, present, vector_sums


class StateMismatch(ValueError):
    """A resumed run does not fit the stored state."""


def stream_shards(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _per_batch(output: str, fn: Callable[[DataFrame], DataFrame]):
    def write(batch: DataFrame, number: int) -> None:
        fn(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return write


def run_available(stream: DataFrame, output: str, checkpoint: str, fn: Callable[[DataFrame], DataFrame], mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived, in micro-batches, then stop."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(_per_batch(output, fn)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def ingest_shards(stream: DataFrame, output: str, checkpoint: str, qc: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Quality-check arriving shards and append the survivors; each shard holds whole samples."""
    run_available(stream, output, checkpoint, qc)
    return stream.sparkSession.read.option("mergeSchema", False).parquet(output).drop("batch")


def running_totals(parts: DataFrame, groups: list[str], value: str = "value") -> DataFrame:
    """Totals and counters over everything ingested so far."""
    return parts.groupBy(*groups).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("seen"))


def check_state(spark: SparkSession, path: str, config: dict) -> None:
    """Store the run's settings beside its state, or refuse to resume with different ones."""
    target = f"{path}/_settings"
    want = json.dumps(config, sort_keys=True)
    jvm, hconf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(target)
    if p.getFileSystem(hconf).exists(p):
        have = spark.read.text(target).first()["value"]
        if have != want:
            raise StateMismatch(f"stored settings {have} do not match {want}")
        return
    spark.createDataFrame([(want,)], "value string").coalesce(1).write.text(target)


def _children(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished ``batch=`` folders below a path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [f.getPath().getName() for f in system.listStatus(root)]
    done = [n for n in names if n.startswith("batch=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in done)


def _updated(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key's state with what the tasks of a micro-batch have added up for it."""
    now = None
    if state.exists:
        count, total, missing = state.get
        now = [count, np.array(total), np.array(missing)]
    for f in frames:
        for count, total, missing in zip(f["count"], f["sum"], f["missing"], strict=True):
            new = [int(count), np.asarray(total, float), np.zeros(len(total), np.int64) if missing is None else np.asarray(missing, np.int64)]
            now = new if now is None else joined(now, new)
    state.update((now[0], now[1].tolist(), now[2].tolist()))
    yield pd.DataFrame({"key": [key[0]], "count": [now[0]], "sum": [now[1]], "missing": [now[2]]})


def running_vector_mean(stream: DataFrame, key: str, vec: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """Resumable element-wise mean per key: (key, pos, mean, count), of the elements that are there.

    The state is one row per key: a count and whole arrays. The tasks of a micro-batch add their vectors up first. Each
    batch writes the means' states as a whole, from those before and what it changed, so the result is read from the newest
    batch alone; a batch that is run again starts from the one before it. Older states than that are removed.
    """
    spark = stream.sparkSession
    check_state(spark, output, config)
    parts = vector_sums(stream.select(F.col(key).alias("key"), F.col(vec).alias("vec")), ["key"], partial=True)
    kept = StructType(PARTS)
    changed = parts.groupBy("key").applyInPandasWithState(_updated, StructType([parts.schema["key"], *PARTS]), kept, "update", GroupStateTimeout.NoTimeout)
    states = f"{output}/states"

    def write(batch: DataFrame, number: int) -> None:
        earlier = [n for n in _children(spark, states) if n < number]
        whole = batch
        if earlier:
            last = spark.read.schema(batch.schema).parquet(f"{states}/batch={earlier[-1]}")
            batch = batch.persist()
            whole = last.join(batch.select("key"), last["key"].eqNullSafe(batch["key"]), "left_anti").unionByName(batch)
        whole.write.mode("overwrite").parquet(f"{states}/batch={number}")
        batch.unpersist()
        for n in earlier[:-1]:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{states}/batch={n}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    query = changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    done = _children(spark, states)
    schema = StructType([parts.schema["key"], *PARTS])
    newest = spark.read.schema(schema).parquet(f"{states}/batch={done[-1]}") if done else spark.createDataFrame([], schema)
    cells = newest.select(F.col("key").alias(key), F.posexplode(F.arrays_zip(F.col("sum").alias("s"), present().alias("n"))).alias("pos", "x"))
    return cells.select(key, "pos", (F.col("x.s") / F.nullif(F.col("x.n"), F.lit(0).cast("bigint"))).alias("mean"), F.col("x.n").alias("count"))


def match_arrivals(stream: DataFrame, output: str, checkpoint: str, match: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Match arriving profiles to a static atlas, batch by batch."""
    run_available(stream, output, checkpoint, match)
    return stream.sparkSession.read.parquet(output).drop("batch")


__all__ = ["StateMismatch", "check_state", "ingest_shards", "match_arrivals", "run_available", "running_totals",
           "running_vector_mean", "stream_shards", "vector_width"]
