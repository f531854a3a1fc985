"""Language identification by nearest centroids of hashed letter n-grams.

A text becomes the counts of its letter 1- to 3-grams, hashed to a fixed number of slots, damped, weighted by
inverse document frequency and scaled to unit length. The training texts of a language are clustered by
cosine into a few centroids; a text gets the language of the centroid of largest cosine, and is marked as
rejected where even that centroid is farther away than the language's own training texts are.

The classifier is fitted on at most ``per_language`` texts of each language, those of smallest hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.common import kept, stored, unsigned_order

SLOTS = 8192
CHUNK = 64
CENTROIDS = "lang string, centroid array<float>, nearest double"
GUESS = "lang_pred string, score double, rejected boolean"
UNKNOWN = "und"


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter n-grams of a whole text; None where it holds no letter. Runs of other characters are one space."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = kept("letters", _letters)[points]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the character after a letter stands for the gap
    c = np.concatenate([[32], np.where(is_letter, points, 32)[keep], [32]]).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B) + np.uint32(1)
    three = (two[:-1] ^ (one[2:] >> np.uint32(11))) * np.uint32(0xC2B2AE35) + np.uint32(2)
    shift = np.uint32(32 - SLOTS.bit_length() + 1)
    return sum(np.bincount(x >> shift, minlength=SLOTS) for x in (one * np.uint32(0x27D4EB2F), two, three))


def vectors(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors with logarithmic term frequency."""
    x = np.log1p(np.asarray(rows, np.float32)) * idf.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of a cosine k-means, begun at points far from those chosen before."""
    chosen = [int(np.random.default_rng(seed).integers(len(x)))]
    best = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        at = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
    return centres


def fit(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 300, clusters: int = 4, seed: int = 3,
) -> Model:
    """Centroids of every language of ``docs``. Rows without language or text teach nothing; no rows give an empty model."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"), unsigned_order(seed, F.col(key), F.length(text)).alias("h")
    )
    best = Window.partitionBy("lang").orderBy("h")
    # ranked without the texts, so that the window sorts narrow rows; equal hashes are let in together
    last = rows.select("lang", "h").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= per_language).groupBy("lang").agg(F.max("h").alias("last"))
    # a row per language, of which the model holds the centroids anyway; the texts stay where they are read
    sample = stored(rows.join(F.broadcast(last), "lang").filter(F.col("h") <= F.col("last")).select("lang", "t"), "langid-sample")

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if (c := counts(t)) is not None:
                    total += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()])], names=["n", "total"])

    seen = sample.select("t").mapInArrow(document_counts, "n bigint, total binary").collect()  # a row per task of the sample
    n = sum(r["n"] for r in seen)
    df = sum((np.frombuffer(r["total"], np.int64) for r in seen), np.zeros(SLOTS, np.int64))
    idf = np.log((1 + n) / (1 + df)) + 1

    def centroids(frame: pd.DataFrame) -> pd.DataFrame:
        found = [c for c in map(counts, frame["t"]) if c is not None]
        if not found:
            return pd.DataFrame({"lang": [], "centroid": [], "nearest": []})
        x = vectors(found, idf)
        centres = cluster(x, clusters, seed)
        floor = float(np.quantile((x @ centres.T).max(axis=1), 0.01))
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centroid": list(centres), "nearest": floor})

    learned = sample.groupBy("lang").applyInPandas(centroids, CENTROIDS).orderBy("lang").collect()  # `clusters` rows a language
    return Model(
        [r["lang"] for r in learned], idf, np.asarray([r["centroid"] for r in learned], np.float32).reshape(len(learned), SLOTS),
        np.asarray([r["nearest"] for r in learned]),
    )


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "guess") -> DataFrame:
    """``docs`` with a struct column ``out`` of ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text under an empty
    model. Any other text gets a learned language, of equal cosines the first by name. All columns are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # SLOTS floats per centroid

    @F.pandas_udf(GUESS)
    def guess(texts: pd.Series) -> pd.DataFrame:
        m = Model(*shared.value)
        langs = [UNKNOWN] * len(texts)
        score, rejected = np.zeros(len(texts)), np.ones(len(texts), bool)
        for i in range(0, len(texts) if m.langs else 0, CHUNK):
            found = [(i + j, c) for j, t in enumerate(texts.iloc[i : i + CHUNK]) if (c := counts(t)) is not None]
            if found:
                near = vectors([c for _, c in found], m.idf) @ m.centroids.T
                best = near.argmax(axis=1)
                for (j, _), b, v in zip(found, best, near.max(axis=1), strict=True):
                    langs[j], score[j], rejected[j] = m.langs[b], min(max(float(v), 0.0), 1.0), bool(v < m.floors[b])
        return pd.DataFrame({"lang_pred": langs, "score": score, "rejected": rejected})

    return docs.withColumn(out, guess(F.col(text)))
