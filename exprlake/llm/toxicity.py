"""Toxicity by two class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has letter n-gram counts of its words; a word is written between a start and an
end mark, and every letter is predicted from up to ``ORDER - 1`` letters before it. The top order of each
class is discounted, and what the discount frees goes to lower orders that both classes share: continuation
counts of the pooled training texts. A rare expression, or a new form of a known one, so differs between the
classes only where one class has really seen it.

A text's evidence is the log-likelihood ratio per word, over the whole text and over its strongest windows; a
logistic line fitted on training texts kept out of the counts turns it into a probability.

The classifier is fitted on at most ``per_class`` labelled texts of each class, those of smallest hash; the
shares of the classes come from all labels.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exprlake.llm.common import kept, released, stored, unsigned_order

ORDER = 6
DISCOUNT = 0.75
START, END = "\x02", "\x03"
EDGES = ".,;:!?\"'()[]*#%$&|"
#: Words of the windows whose strongest mean ratio counts beside that of the whole text.
WINDOWS = (64, 8)
GRAMS = "gram string, n0 bigint, n1 bigint"


class Counts(NamedTuple):
    """Top-order letter n-grams of both classes, aligned arrays; slim enough to be sent to every task."""

    grams: list[str]
    ordinary: np.ndarray
    toxic: np.ndarray


class Model(NamedTuple):
    counts: Counts
    weights: np.ndarray


def tokens(text: str | None) -> list[str]:
    """Lower-cased words without surrounding punctuation; words of nothing else are left out."""
    return [w for x in (text or "").lower().split() if (w := x.strip(EDGES))]


def word_grams(word: str) -> Iterator[str]:
    s = START + word + END
    return (s[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(s)))


class Ratios(dict):
    """Log-likelihood ratio (toxic to ordinary) of a word, remembered within a bound."""

    LIMIT = 300_000

    def __init__(self, counts: Counts):
        super().__init__()
        top = {g: (int(a), int(b)) for g, a, b in zip(*counts, strict=True)}
        self.top = top
        self.context: dict[str, list[int]] = {}  # of the top order: total and number of kinds, by class
        types: dict[int, set[str]] = {}
        for g, n in top.items():
            own = self.context.setdefault(g[:-1], [0, 0, 0, 0])
            for c in (0, 1):
                own[c] += n[c]
                own[2 + c] += n[c] > 0
            types.setdefault(len(g), set()).add(g)
        self.shared: dict[str, int] = {}  # continuation counts
        self.follow: dict[str, list[int]] = {}  # of a shared context: total and number of kinds
        below: set[str] = set()
        for length in range(ORDER, 1, -1):
            here = types.get(length, set()) | below
            below = set()
            for g in here:
                suffix = g[1:]
                self.shared[suffix] = self.shared.get(suffix, 0) + 1
                below.add(suffix)
        for g, n in self.shared.items():
            own = self.follow.setdefault(g[:-1], [0, 0])
            own[0] += n
            own[1] += 1
        self.floor = 1.0 / (1 + self.follow.get("", [0, 1])[1])
        self.letter: dict[str, float] = {}

    def backoff(self, gram: str) -> float:
        """Shared probability of the last letter of ``gram`` after the others."""
        context = self.follow.get(gram[:-1])
        lower = self.backoff(gram[1:]) if len(gram) > 1 else self.floor
        if context is None:
            return lower
        total, kinds = context
        return (max(self.shared.get(gram, 0) - DISCOUNT, 0.0) + DISCOUNT * kinds * lower) / total

    def gram_ratio(self, gram: str) -> float:
        context = self.context.get(gram[:-1])
        if context is None:
            return 0.0
        lower = self.backoff(gram[1:])
        n = self.top.get(gram, (0, 0))
        p = [
            (max(n[c] - DISCOUNT, 0.0) + DISCOUNT * context[2 + c] * lower) / context[c] if context[c] else lower
            for c in (0, 1)
        ]
        return float(np.log(p[1] / p[0]))

    def __missing__(self, word: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        total = 0.0
        for gram in word_grams(word):
            r = self.letter.get(gram)
            if r is None:
                if len(self.letter) >= 2 * self.LIMIT:
                    self.letter.clear()
                r = self.letter[gram] = self.gram_ratio(gram)
            total += r
        self[word] = total
        return total


def evidence(text: str | None, ratios: Ratios) -> tuple[float, ...]:
    """Mean ratio per word of the whole text, and the largest mean of any window of each length; zeros without words."""
    found = tokens(text)
    if not found:
        return (0.0,) * (1 + len(WINDOWS))
    r = np.fromiter(map(ratios.__getitem__, found), np.float64, len(found))
    sums = np.concatenate([[0.0], np.cumsum(r)])
    out = [sums[-1] / len(r)]
    for w in WINDOWS:
        out.append((sums[w:] - sums[:-w]).max() / w if len(r) > w else sums[-1] / w)
    return tuple(out)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (intercept first, then those of the columns) of a weighted logistic regression by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-9] + [ridge] * x.shape[1]) * weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + penalty @ w
        move = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w)), grad)
        w -= move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_class: int = 8000, seed: int = 7,
) -> Model | None:
    """Model from the labelled texts; ``learn`` (over ``key``) says which keys may be learned from.

    A key labelled more than once has its largest label; labels other than 0 and 1 and null keys are ignored. None
    where one of the classes has no text at all.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    if learn is not None:
        known = known.withColumnRenamed("k", key).filter(learn).withColumnRenamed(key, "k")
    known = stored(known.withColumn("h", unsigned_order(seed, F.col("k"))), "labels")
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return None
    best = Window.partitionBy("y").orderBy("h", "k")
    chosen = known.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= per_class).select("k", "y", (F.col("h") % 4 == 0).alias("held"))
    # 2 * per_class narrow rows at most, so the texts needn't be shuffled to meet them
    sample = stored(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k"), "labelled-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            found: dict[str, list[int]] = {}
            for c in (0, 1):
                for word, n in seen[c].items():
                    for gram in word_grams(word):
                        found.setdefault(gram, [0, 0])[c] += n
                seen[c].clear()
            both = list(found.values())
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array([x[0] for x in both], pa.int64()), pa.array([x[1] for x in both], pa.int64())],
                names=["gram", "n0", "n1"],
            )

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(tokens(t))
            if len(seen[0]) + len(seen[1]) > 200_000:
                yield flush()
        yield flush()

    grams = sample.filter(~F.col("held")).select("t", "y").mapInArrow(count, GRAMS).groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # the bounded sample bounds its n-grams; a gram seen once says little of its class and is left out
    table = grams.filter(F.col("n0") + F.col("n1") > 1).orderBy("gram").toPandas()
    counts = Counts(table["gram"].tolist(), table["n0"].to_numpy(np.int64), table["n1"].to_numpy(np.int64))
    shown = sample.filter("held").select(evidence_column(docs.sparkSession, counts, F.col("t")).alias("e"), "y").toPandas()
    if shown["y"].nunique() < 2:
        return None
    used = shown["y"].value_counts()
    weight = shown["y"].map({y: share[y] / used[y] for y in share}).to_numpy(float)
    weights = logistic(np.array(shown["e"].tolist()), shown["y"].to_numpy(float), weight / weight.mean())
    return Model(counts, weights)


def evidence_column(spark: SparkSession, counts: Counts, text: Column) -> Column:
    """Column of the :func:`evidence` of a text."""
    shared = spark.sparkContext.broadcast(tuple(counts))
    version = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        ratios = kept("toxicity", lambda: Ratios(Counts(*shared.value)), version)
        return pd.Series([list(evidence(t, ratios)) for t in texts])

    return run(text)


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a probability ``out`` of being toxic; all columns and rows are kept.

    A null or empty text has the probability of no evidence; without a model every text has 0. Equal texts have equal
    scores. A column named ``out`` is replaced.
    """
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    e = F.col("__evidence")
    line = sum((F.get(e, F.lit(i)) * float(w) for i, w in enumerate(model.weights[1:])), F.lit(float(model.weights[0])))
    with_evidence = docs.withColumn("__evidence", evidence_column(docs.sparkSession, model.counts, F.col(text)))
    return with_evidence.withColumn(out, 1 / (1 + F.exp(-line))).drop("__evidence")
