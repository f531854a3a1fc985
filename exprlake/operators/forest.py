"""Random forests of all folds of a cross-validation, grown together level by level.

The rows are binned once and packed into blocks of bounded size. In one pass per level each task counts its block's
rows by node, feature and bin; the counts of a tree meet in a shuffle, where its best splits are found. Counts are
integers, so the forests don't depend on how the rows are dealt. The driver holds the trees, whose size depth and number
bound, and never the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.operators.tiles import stacked
from exprlake.session import materialize

#: Bins of a feature, cut at its quantiles over all rows.
BINS = 32
#: Bytes of binned features that one block holds.
BLOCK_BYTES = 64 << 20
#: Rows that make a block worth a task of its own, where there are fewer blocks than cores.
BLOCK_ROWS = 20_000
#: The class of rows without a label.
NONE = 255
#: Counts that one shuffled row holds.
CELLS = 1 << 13
#: Bounds of the Poisson(1) draws: how often a row stands in a tree's bootstrap sample.
_DRAWS = [np.uint64(int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2.0**53) << 11) for k in range(12)]


class Shape(NamedTuple):
    """What all trees have in common; tree ``t`` leaves fold ``t // trees`` out."""

    folds: int
    trees: int
    depth: int
    width: int
    classes: int
    tried: int
    smallest: int
    seed: int


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled(draw: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row stands in a tree's bootstrap sample, from its own hash."""
    u = _mixed(draw + np.uint64((2 * (seed * 1_000_003 + tree) + 1) * 0x9E3779B97F4A7C15 % 2**64))
    times = np.zeros(len(draw), np.int8)
    for bound in _DRAWS:
        over = u >= bound
        if not over.any():
            break
        times += over
    return times


def tried_features(shape: Shape, tree: int, level: int, nodes: int) -> np.ndarray:
    """The features tried at each open node of a level, drawn without repetition (Floyd's method)."""
    rng = np.random.default_rng([shape.seed, tree, level])
    out = np.full((nodes, shape.tried), -1, np.int64)
    for s, top in enumerate(range(shape.width - shape.tried, shape.width)):
        drawn = rng.integers(0, top + 1, nodes)
        out[:, s] = np.where((out[:, :s] == drawn[:, None]).any(axis=1), top, drawn)
    return out


def quantile_edges(rows: DataFrame, features: str) -> list[np.ndarray]:
    """Per feature the distinct bounds of its bins; a value at a bound belongs below it."""
    at = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    cells = rows.select(F.posexplode(features).alias("pos", "v")).filter("v IS NOT NULL AND NOT isnan(v)")
    found = {r["pos"]: r["q"] for r in cells.groupBy("pos").agg(F.percentile_approx("v", at, F.lit(10_000)).alias("q")).collect()}
    width = rows.agg(F.max(F.size(features))).first()[0] or 0
    return [np.unique(np.array(found.get(i, []), float)) for i in range(width)]


def blocks(rows: DataFrame, key: str, features: str, label: str, fold: str, edges: list[np.ndarray], count: int) -> DataFrame:
    """``keys, x, y, fold, draw, block``: rows packed into ``count`` blocks; ``x`` holds the bins, ``y`` the class."""
    held = rows.sparkSession.sparkContext.broadcast(edges)
    kind = rows.schema[key].dataType.simpleString()
    draw = F.xxhash64(key, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, xs, rest = [], [], [[], [], []]
        for batch in batches:
            if not batch.num_rows:
                continue
            v = stacked(batch.column(1).to_pandas())
            x = np.empty(v.shape, np.uint8)
            for i, e in enumerate(held.value):
                x[:, i] = np.searchsorted(e, v[:, i])
            keys.append(batch.column(0))
            xs.append(x)
            for c in range(3):
                rest[c].append(batch.column(2 + c).to_numpy(zero_copy_only=False))
        if keys:
            y, f, d = (np.concatenate(c) for c in rest)
            own = pa.concat_arrays(keys)
            columns = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
            columns += [pa.array([b.tobytes()], pa.binary()) for b in (np.concatenate(xs), y.astype(np.uint8), f.astype(np.int32), d.astype(np.int64))]
            columns.append(pa.array([TaskContext.get().partitionId()], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=["keys", "x", "y", "fold", "draw", "block"])

    known = F.coalesce(F.col(label).cast("int"), F.lit(NONE))
    ready = rows.filter(F.col(fold).isNotNull()).select(key, features, known.alias("y"), F.col(fold).cast("int").alias("f"), draw.alias("d"))
    return ready.repartition(count, "d").mapInArrow(run, f"keys array<{kind}>, x binary, y binary, fold binary, draw binary, block int")


def _opened(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    x, y, fold, draw = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in ((1, np.uint8), (2, np.uint8), (3, np.int32), (4, np.uint64)))
    return x, y, fold, draw


def _descend(x: np.ndarray, at: np.ndarray, feature: np.ndarray, bound: np.ndarray, levels: int) -> np.ndarray:
    """Place in its level of the node that each row has come to; rows of a leaf go on to the left."""
    node = np.zeros(len(at), np.intp)
    for level in range(levels):
        first = (1 << level) - 1
        f, b = feature[first : 2 * first + 1].astype(np.intp), bound[first : 2 * first + 1]
        right = x.take(at + f.take(node)) > b.take(node)
        node += node
        node += right
    return node


def _packed(h: np.ndarray) -> bytes:
    """Counts in the fewest bytes; those that are few with their places."""
    kind = np.min_scalar_type(int(h.max(initial=0)))
    at = np.flatnonzero(h)
    if len(at) * (2 + kind.itemsize) < len(h) * kind.itemsize:
        return bytes([1, kind.itemsize]) + at.astype(np.uint16).tobytes() + h[at].astype(kind).tobytes()
    return bytes([0, kind.itemsize]) + h.astype(kind).tobytes()


def _add(total: np.ndarray, packed: bytes) -> None:
    sparse, size = packed[0], packed[1]
    body, kind = memoryview(packed)[2:], np.dtype(f"u{size}")
    if sparse:
        n = len(body) // (2 + size)
        total[np.frombuffer(body[: 2 * n], np.uint16)] += np.frombuffer(body[2 * n :], kind).astype(np.int64)
    else:
        total += np.frombuffer(body, kind).astype(np.int64)


def _dealt(packed: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Blocks with the share ``g`` of the trees a task counts for, and the number of shares: few blocks share the trees out."""
    spark = packed.sparkSession
    shares = spark.sparkContext.defaultParallelism // count
    if shares < 2:
        return packed.withColumn("g", F.lit(0)), 1
    slots = spark.range(0, count * shares, 1, count * shares)
    slots = slots.select((F.col("id") % count).cast("int").alias("block"), F.floor(F.col("id") / count).cast("int").alias("g"))
    return slots.join(packed, "block").select(*packed.columns, "g"), shares


def _counts(packed: DataFrame, shape: Shape, level: int, held, shares: int) -> DataFrame:
    """``tree, part, h``: counts of a block's rows by open node, tried feature, bin and class."""
    per = shape.tried * BINS * shape.classes
    step = max(1, CELLS // per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, bound, is_open = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, fold, draw = _opened(batch, i)
                share = batch.column(6)[i].as_py()
                for f in range(shape.folds):
                    rows = np.flatnonzero((fold != f) & (y != NONE))
                    hashes, start, label = draw[rows], rows * shape.width, y[rows].astype(np.intp)
                    for tree in range(f * shape.trees + share, (f + 1) * shape.trees, shares):
                        here = is_open[tree]
                        nodes = int(here.sum())
                        if not nodes:
                            continue
                        times = sampled(hashes, tree, shape.seed)
                        at, own = np.repeat(start, times), np.repeat(label, times)
                        place = np.where(here, np.cumsum(here) - 1, -1)
                        c = place.take(_descend(x, at, feature[tree], bound[tree], level))
                        if nodes < len(here):
                            kept = np.flatnonzero(c >= 0)
                            at, own, c = at.take(kept), own.take(kept), c.take(kept)
                        tried = tried_features(shape, tree, level, nodes)
                        h = np.zeros((nodes, shape.tried, BINS * shape.classes), np.int64)
                        base = c * (BINS * shape.classes) + own
                        for s in range(shape.tried):
                            codes = x.take(at + tried[:, s].take(c)).astype(np.intp)
                            codes *= shape.classes
                            codes += base
                            h[:, s] = np.bincount(codes, minlength=nodes * BINS * shape.classes).reshape(nodes, -1)
                        flat = h.ravel()
                        parts = range(-(-nodes // step))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([tree] * len(parts), pa.int32()), pa.array(parts, pa.int32()),
                             pa.array([_packed(flat[p * step * per : (p + 1) * step * per]) for p in parts], pa.binary())],
                            names=["tree", "part", "h"],
                        )

    return packed.mapInArrow(run, "tree int, part int, h binary")


def best_splits(h: np.ndarray, weights: np.ndarray, smallest: int) -> tuple[np.ndarray, ...]:
    """Per node of ``h`` (node, tried feature, bin, class): the tried feature (-1: none helps), its bin, the gain, the rows by class, those to the left.

    The gain is the drop of weighted Gini impurity times the node's weight; both sides keep ``smallest`` rows.
    """
    total = h[:, 0].sum(axis=1)
    left = h.cumsum(axis=2)[:, :, :-1]
    right = total[:, None, None, :] - left
    enough = (left.sum(axis=3) >= smallest) & (right.sum(axis=3) >= smallest)

    def purity(n: np.ndarray) -> np.ndarray:
        w = n * weights
        return (w * w).sum(axis=-1) / np.maximum(w.sum(axis=-1), 1e-300)

    gain = np.where(enough, purity(left) + purity(right) - purity(total)[:, None, None], -np.inf).reshape(len(h), -1)
    at = gain.argmax(axis=1)
    most = gain[np.arange(len(h)), at]
    s, b = np.divmod(at, BINS - 1)
    s = np.where(most > 1e-12 * np.maximum((total * weights).sum(axis=1), 1e-300), s, -1)
    return s, b, most, total, left[np.arange(len(h)), s, b]


def _splits(counts: DataFrame, shape: Shape, level: int, open_nodes, weights: np.ndarray) -> DataFrame:
    """``tree, part, s``: the best splits of the open nodes, once the counts of all blocks have met."""
    per = shape.tried * BINS * shape.classes
    step = max(1, CELLS // per)

    def best(tree: int, part: int, total: np.ndarray) -> pa.RecordBatch:
        nodes = int(open_nodes.value[tree])
        first, last = part * step, min(nodes, (part + 1) * step)
        h = total.reshape(last - first, shape.tried, BINS, shape.classes)
        s, b, gain, whole, left = best_splits(h, weights[tree // shape.trees], shape.smallest)
        feature = np.where(s < 0, -1, tried_features(shape, tree, level, nodes)[first:last][np.arange(last - first), s])
        out = [feature.astype(np.int32), b.astype(np.int32), gain.astype(float), whole.astype(np.int64), left.astype(np.int64)]
        packed = b"".join(a.tobytes() for a in out)
        return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["tree", "part", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, np.int64)
        for batch in batches:
            for tree, part, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if now != (tree, part):
                    if now is not None:
                        yield best(*now, total)
                    now, total = (tree, part), np.zeros(min(step, int(open_nodes.value[tree]) - part * step) * per, np.int64)
                _add(total, h.as_py())
        if now is not None:
            yield best(*now, total)

    # as many tasks as there are cores, however few bytes the counts take
    tasks = counts.sparkSession.sparkContext.defaultParallelism
    met = counts.repartition(2 * tasks, "tree", "part").sortWithinPartitions("tree", "part")
    return met.mapInArrow(run, "tree int, part int, s binary")


class Forests(NamedTuple):
    """The trees of all folds in heap order: ``feature`` (-1: leaf), ``bound`` (the last bin to the left), rows per class, gain."""

    shape: Shape
    feature: np.ndarray
    bound: np.ndarray
    rows: np.ndarray
    gain: np.ndarray
    weights: np.ndarray

    def importances(self) -> np.ndarray:
        """Per fold: gains by feature, normalised per tree, then over the forest."""
        s = self.shape
        out = np.zeros((s.folds, s.width))
        for tree in range(s.folds * s.trees):
            split = np.flatnonzero(self.feature[tree] >= 0)
            own = np.bincount(self.feature[tree, split], self.gain[tree, split], s.width)
            out[tree // s.trees] += own / own.sum() if len(split) else 0.0
        whole = out.sum(axis=1, keepdims=True)
        return out / np.where(whole > 0, whole, 1.0)


def grow(packed: DataFrame, count: int, shape: Shape, class_rows: np.ndarray) -> Forests:
    """The forests over ``count`` blocks. ``class_rows``: labelled rows per fold and class.

    Classes weigh n / (classes * class size) over a fold's training rows.
    """
    sc = packed.sparkSession.sparkContext
    training = class_rows.sum(axis=0) - class_rows
    present = (training > 0).sum(axis=1, keepdims=True)
    weights = np.where(training > 0, training.sum(axis=1, keepdims=True) / np.maximum(present * training, 1), 0.0)
    trees = shape.folds * shape.trees
    feature, bound = np.full((trees, 2**shape.depth - 1), -1, np.int32), np.full((trees, 2**shape.depth - 1), 255, np.uint8)
    rows, gain = np.zeros((trees, 2 ** (shape.depth + 1) - 1, shape.classes), np.int64), np.zeros((trees, 2**shape.depth - 1), np.float32)
    step = max(1, CELLS // (shape.tried * BINS * shape.classes))
    dealt, shares = _dealt(packed, count)
    is_open = np.repeat(training.sum(axis=1) > 0, shape.trees)[:, None]
    for level in range(shape.depth):
        first = 2**level - 1
        nodes = is_open.sum(axis=1)
        if not nodes.any():
            break
        # leaves send their rows to the left, where no node is open
        held = sc.broadcast((np.maximum(feature[:, :first], 0), bound[:, :first], is_open))
        sizes = sc.broadcast(nodes)
        found = _splits(_counts(dealt, shape, level, held, shares), shape, level, sizes, weights).collect()
        further = np.zeros((trees, 2 * is_open.shape[1]), bool)
        for tree, part, s in found:
            own = np.flatnonzero(is_open[tree])[part * step : (part + 1) * step]
            n, c = len(own), shape.classes
            f, b = np.frombuffer(s, np.int32, 2 * n).reshape(2, n)
            g = np.frombuffer(s, float, n, 8 * n)
            whole, left = np.frombuffer(s, np.int64, 2 * n * c, 16 * n).reshape(2, n, c)
            rows[tree, first + own] = whole
            own, f, b, g, left, right = (a[f >= 0] for a in (own, f, b, g, left, whole - left))
            feature[tree, first + own], bound[tree, first + own], gain[tree, first + own] = f, b, g
            for side, there in enumerate((left, right)):
                rows[tree, 2 * (first + own) + 1 + side] = there
                # a node of one class, or of too few rows for two sides, is a leaf
                further[tree, 2 * own + side] = ((there > 0).sum(axis=1) > 1) & (there.sum(axis=1) >= 2 * shape.smallest)
        held.destroy()
        sizes.destroy()
        is_open = further
    return Forests(shape, feature, bound, rows, gain, weights)


def _scored(packed: DataFrame, forests: Forests, key: str, kind: str) -> DataFrame:
    """``key, label, fold, probabilities``: each row by the forest that has not seen its fold."""
    shape = forests.shape
    rows = forests.rows.copy()
    for level in range(shape.depth):  # what a leaf holds goes down to the bottom, where its rows end
        at = 2**level - 1 + np.arange(2**level)
        tree, place = np.nonzero(forests.feature[:, at] < 0)
        rows[tree, 2 * at[place] + 1] = rows[tree, at[place]]
    weighed = rows[:, 2**shape.depth - 1 :] * np.repeat(forests.weights, shape.trees, axis=0)[:, None, :]
    leaves = (weighed / np.maximum(weighed.sum(axis=2, keepdims=True), 1e-300)).astype(np.float32)
    held = packed.sparkSession.sparkContext.broadcast((np.maximum(forests.feature, 0), forests.bound, leaves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, bound, leaves = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, fold, _ = _opened(batch, i)
                p = np.zeros((len(y), shape.classes))
                for f in range(shape.folds):
                    of = np.flatnonzero(fold == f)
                    for tree in range(f * shape.trees, (f + 1) * shape.trees) if len(of) else ():
                        p[of] += leaves[tree, _descend(x, of * shape.width, feature[tree], bound[tree], shape.depth)]
                whole = p.sum(axis=1, keepdims=True)
                p = np.where(whole > 0, p / np.where(whole > 0, whole, 1.0), np.nan)
                flat = pa.array(p.ravel(), from_pandas=True)
                columns = [
                    batch.column(0)[i].values, pa.array(y.astype(np.int32), mask=y == NONE), pa.array(fold),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, shape.classes), pa.int32()), flat),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "label", "fold", "probabilities"])

    return packed.mapInArrow(run, f"{key} {kind}, label int, fold int, probabilities array<double>")


def forest_out_of_fold(
    rows: DataFrame, key: str, features: str = "features", label: str = "label", fold: str = "fold", folds: int = 5, trees: int = 300,
    depth: int = 10, smallest: int = 2, seed: int = 0,
) -> tuple[DataFrame, list[list[float]]]:
    """Random-forest probabilities of every row by the forest fitted without its fold, and the importances per fold.

    ``rows``: ``key``, ``features`` (array of doubles), ``label`` (0, 1, ...; null: not learned from) and ``fold``
    (0 to ``folds`` - 1; null: left out). A tree learns from a bootstrap sample whose draws follow from each row's own hash,
    tries the square root of the features at each node, and keeps ``smallest`` rows on both sides of a split. Classes weigh
    the same in every fold's training rows. Without labelled training rows the probabilities are null.
    """
    spark = rows.sparkSession
    edges = quantile_edges(rows, features)
    sizes = rows.filter(F.col(fold).isNotNull()).groupBy(F.col(fold).cast("int").alias("f"), F.col(label).cast("int").alias("y")).count().collect()
    classes = max([2, *(r["y"] + 1 for r in sizes if r["y"] is not None)])
    if classes > NONE:
        raise ValueError(f"at most {NONE} classes")
    class_rows = np.zeros((folds, classes), np.int64)
    for r in sizes:
        if r["y"] is not None:
            class_rows[r["f"], r["y"]] = r["count"]
    n, width = sum(r["count"] for r in sizes), max(1, len(edges))
    shape = Shape(folds, trees, depth, width, classes, math.ceil(math.sqrt(width)), smallest, seed)
    count = max(min(-(-n // BLOCK_ROWS), spark.sparkContext.defaultParallelism), -(-n * width // BLOCK_BYTES), 1)
    packed = materialize(blocks(rows, key, features, label, fold, edges, count), "forest-rows")
    forests = grow(packed, count, shape, class_rows)
    scored = _scored(packed, forests, key, rows.schema[key].dataType.simpleString())
    return scored, forests.importances().tolist()
