"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprlake.session import materialize


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs of anything but space, tab and line ends, with A-Z lower-cased.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is this definition.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class _WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it holds ``LIMIT`` words to bound a worker's memory."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _stage() -> int | None:
    context = TaskContext.get()
    return context.stageId() if context else None


def kept(name: str, make: Callable[[], Any], version: Any = None) -> Any:
    """An object that lives until the Python worker takes up another stage, so that later tasks of a stage find it again.

    A new ``version`` takes the place of the old one.
    """
    store = released(name)
    if name not in store or store[name][0] != version:
        store.pop(name, None)
        store[name] = (version, make(), None)
    version, value, _ = store[name]
    store[name] = (version, value, _stage())
    return value


def released(name: str | None = None) -> dict[str, tuple]:
    """What :func:`kept` holds, without that of other stages but ``name``: workers are reused, and so is their memory."""
    store, stage = sys.__dict__.setdefault("_exprlake_kept", {}), _stage()
    for other in [x for x, held in store.items() if x != name and held[2] != stage]:
        del store[other]
    return store


def word_ids(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, in order."""
    found = words(text)
    hashes = kept("word hashes", _WordHashes)
    return np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output (a finaliser of the MurmurHash kind)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def remainder(key: str, divisor: int) -> Column:
    """crc32 of a key written as text, modulo ``divisor``; the fold of a row. A null key is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % divisor, F.lit(0))


def unsigned_order(seed: int, *cols: Column) -> Column:
    """Uniform non-negative long that orders rows at random; the same for the same values and seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, so that several readers see the same rows."""
    return materialize(df, name)


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """As :func:`stored`; what Spark has shuffled for the writing is dropped as soon as it is done, since nobody reads it again."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return materialize(df, name)
    finally:
        spark.conf.set(key, before)


def removed(*stored_frames: DataFrame) -> None:
    """Remove the files of stored rows that no later step reads."""
    for df in stored_frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def names(ddl: str) -> list[str]:
    """Column names of a plain "name type, name type" schema."""
    return [x.split()[0] for x in ddl.split(", ")]
