"""Cross-products of wide vectors by tiles.

Rows are centred and cut into chunks of a block of rows and a block of columns. A tile of a product is the sum over all
row blocks; it is added up where its chunks meet, so no task and no row ever holds a whole product. Sums of squares come
from the tiles on Spark; the driver assembles a product only where an answer needs its singular vectors, and then the
smaller of the two there are: that of the columns, or that of the rows, which is the same machinery with the chunks turned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprlake.functions.vectors import vector_width
from exprlake.operators.fitting import add_rows
from exprlake.session import materialize

#: Rows and columns of a chunk.
TILE = 512
#: Width up to which a task adds up whole cross-products; those of wider vectors are made by tiles.
NARROW = 1024
CHUNK = "r bigint, c int, data binary"


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


def column_moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    """Row count, and by column the mean and the centred sum of squares, from one pass of whole-array sums."""
    first = df.select(*cols).first()
    if first is None:
        return 0, [np.zeros(0)] * len(cols), [np.zeros(0)] * len(cols)
    shift = np.concatenate([np.asarray(first[c], float) for c in cols])
    cuts = np.cumsum([len(first[c]) for c in cols])[:-1]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(1 + 2 * len(shift))
        for f in frames:
            if len(f):
                x = np.hstack([stacked(f[c]) for c in cols]) - shift
                acc += np.concatenate([[len(f)], x.sum(0), (x**2).sum(0)])
        yield pd.DataFrame({"sums": [acc]})

    acc = add_rows(df.select(*cols).mapInPandas(add, "sums array<double>"))
    n, total, square = acc[0], acc[1 : len(shift) + 1], acc[len(shift) + 1 :]
    return int(n), np.split(shift + total / n, cuts), np.split(square - total**2 / n, cuts)


@dataclass
class Chunks:
    """Centred vectors in chunks ``r, c, data``, and the keys of every row block in order (``r, keys``)."""

    table: DataFrame
    keys: DataFrame
    n: int
    means: list[np.ndarray]
    #: Blocks of columns; those of the first vector come first.
    widths: list[int]
    firsts: list[int]

    def turned(self, side: int) -> tuple[DataFrame, list[int]]:
        """The chunks of one vector with rows and columns changed over, and the sizes of the row blocks."""
        order = self.keys.withColumn("k", (F.row_number().over(Window.orderBy("r")) - 1).cast("int")).select("r", "k", F.size("keys").alias("rows"))
        order = materialize(order, "row-blocks")
        widths, low, high = self.widths, self.firsts[side], self.firsts[side + 1]

        def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                data = [np.ascontiguousarray(np.frombuffer(d).reshape(-1, widths[c]).T).tobytes() for c, d in zip(f["c"], f["data"], strict=True)]
                yield pd.DataFrame({"r": f["c"].astype("int64"), "c": f["k"], "data": data})

        own = self.table.filter((F.col("c") >= low) & (F.col("c") < high)).join(order, "r").select("r", "c", "k", "data")
        return own.mapInPandas(turn, CHUNK), [x["rows"] for x in order.orderBy("k").collect()]


def narrow_products(df: DataFrame, col: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and centred products of the columns of narrow vectors, from one pass without a shuffle of rows."""
    shift = np.asarray(df.select(col).first()[0], float)
    d = len(shift)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(1 + d + d * d)
        for f in frames:
            if len(f):
                x = stacked(f[col]) - shift
                acc += np.concatenate([[len(f)], x.sum(0), (x.T @ x).ravel()])
        yield pd.DataFrame({"sums": [acc]})

    acc = add_rows(df.select(col).mapInPandas(add, "sums array<double>"))
    n, above = acc[0], acc[1 : d + 1] / acc[0]
    return int(n), shift + above, acc[d + 1 :].reshape(d, d) - n * np.outer(above, above)


def principal_axes(df: DataFrame, k: int, narrow: int = NARROW) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of the vectors ``x``: the mean, the k directions of largest variance, their squares' sums and that of all.

    Up to a width of ``narrow`` from one pass, else from the products of the columns or of the rows, whichever are fewer. Each
    direction's sign is fixed so that its largest loading is positive.
    """
    if vector_width(df, "x") <= narrow:
        _, mean, products = narrow_products(df, "x")
    else:
        found = chunks(df if "key" in df.columns else df.withColumn("key", F.monotonically_increasing_id()), ["x"])
        mean = found.means[0]
        products = None if found.n < len(mean) else column_products(found)[0]
    if products is None:
        ((u, s),) = row_bases(found)
        total, values, load = (s**2).sum(), s[:k] ** 2, loadings(found, u[:, :k]) / s[:k]
    else:
        w, v = np.linalg.eigh(products)
        total, values, load = w.sum(), w[::-1][:k], v[:, ::-1][:, :k]
    return mean, load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])]), values, total


def blocks_of(width: int) -> list[int]:
    return [min(TILE, width - i) for i in range(0, width, TILE)]


def chunks(df: DataFrame, cols: Sequence[str]) -> Chunks:
    """``df``: ``key`` and one or two vector columns of fixed widths."""
    n, means, _ = column_moments(df, cols)
    sizes = [blocks_of(len(m)) for m in means]
    widths = [w for s in sizes for w in s]
    kind = df.schema["key"].dataType.simpleString()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for f in frames:
            for i in range(0, len(f), TILE):
                some = f.iloc[i : i + TILE]
                c = 0
                for col, mean, blocks in zip(cols, means, sizes, strict=True):
                    x, at = stacked(some[col]) - mean, 0
                    for w in blocks:
                        keys = [some["key"].tolist() if c == 0 else None]
                        yield pd.DataFrame({"r": [number], "c": [c], "data": [np.ascontiguousarray(x[:, at : at + w]).tobytes()], "keys": keys})
                        c, at = c + 1, at + w
                number += 1

    table = materialize(df.select("key", *cols).mapInPandas(cut, f"{CHUNK}, keys array<{kind}>"), "chunks")
    return Chunks(table.select("r", "c", "data"), table.filter("c = 0").select("r", "keys"), n, means, widths, [0, *np.cumsum([len(s) for s in sizes]).tolist()])


def tiles(table: DataFrame, widths: Sequence[int], split: int | None = None) -> DataFrame:
    """``i, j, tile``: the product of column blocks i and j, summed over the row blocks (``i <= j``).

    With ``split`` only blocks before it meet those from it on.
    """
    blocks = len(widths)
    wanted = blocks * (blocks + 1) // 2 if split is None else split * (blocks - split)
    # few tiles are added up in several places each, so that the cluster has work
    groups = max(1, 2 * table.sparkSession.sparkContext.defaultParallelism // max(wanted, 1))
    partners = F.sequence(F.lit(0), F.lit(blocks - 1))
    if split is not None:
        partners = F.when(F.col("c") < split, F.sequence(F.lit(split), F.lit(blocks - 1))).otherwise(F.sequence(F.lit(0), F.lit(split - 1)))
    dealt = table.withColumn("other", F.explode(partners)).select(
        F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), F.pmod(F.xxhash64("r"), F.lit(groups)).cast("int").alias("g"), "r", "c", "data"
    )

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, acc, held = None, None, {}
        for f in frames:
            out = []
            for i, j, g, r, c, data in f.itertuples(index=False):
                if (i, j, g) != at:
                    if at is not None:
                        out.append((at[0], at[1], acc.tobytes()))
                    at, acc, held = (i, j, g), np.zeros((widths[i], widths[j])), {}
                if held.get("r") != r:
                    held = {"r": r}
                held[c] = np.frombuffer(data).reshape(-1, widths[c])
                if i in held and j in held:
                    acc += held[i].T @ held[j]
                    held = {}
            yield pd.DataFrame(out, columns=["i", "j", "tile"])
        if at is not None:
            yield pd.DataFrame([(at[0], at[1], acc.tobytes())], columns=["i", "j", "tile"])

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, acc = None, None
        for f in frames:
            out = []
            for i, j, tile in f.itertuples(index=False):
                if (i, j) != at:
                    if at is not None:
                        out.append((*at, acc.tobytes()))
                    at, acc = (i, j), np.zeros(widths[i] * widths[j])
                acc = acc + np.frombuffer(tile)
            yield pd.DataFrame(out, columns=["i", "j", "tile"])
        if at is not None:
            yield pd.DataFrame([(*at, acc.tobytes())], columns=["i", "j", "tile"])

    schema = "i int, j int, tile binary"
    parts = dealt.repartition("i", "j", "g").sortWithinPartitions("i", "j", "g", "r", "c").mapInPandas(multiply, schema)
    return parts if groups == 1 else parts.repartition("i", "j").sortWithinPartitions("i", "j").mapInPandas(merge, schema)


def assembled(found: DataFrame, rows: Sequence[int], cols: Sequence[int], first: int = 0, symmetric: bool = False) -> np.ndarray:
    """A whole product on the driver, tile by tile; ``first`` is the number of its first column block."""
    top, left = np.cumsum([0, *rows]), np.cumsum([0, *cols])
    out = np.zeros((top[-1], left[-1]))
    for t in found.toLocalIterator():
        i, j = t["i"], t["j"] - first
        tile = np.frombuffer(t["tile"]).reshape(rows[i], cols[j])
        out[top[i] : top[i + 1], left[j] : left[j + 1]] = tile
        if symmetric and i != j:
            out[left[j] : left[j + 1], top[i] : top[i + 1]] = tile.T
    return out


def products(left: DataFrame, right: DataFrame) -> float:
    """Sum of the element-wise product of two symmetric matrices, from their tiles."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sums = [(1.0 if i == j else 2.0) * float(np.frombuffer(a) @ np.frombuffer(b)) for i, j, a, b in f[["i", "j", "tile", "other"]].itertuples(index=False)]
            yield pd.DataFrame({"s": [sum(sums)]})

    met = left.join(right.withColumnRenamed("tile", "other"), ["i", "j"]).select("i", "j", "tile", "other")
    return met.mapInPandas(add, "s double").agg(F.sum("s")).first()[0] or 0.0


def squares(found: DataFrame, split: int) -> dict[str, float]:
    """Sums of squares of the products of the first vector, of the second and across."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"i": f["i"], "j": f["j"], "s": [float(np.square(np.frombuffer(t)).sum()) for t in f["tile"]]})

    part = F.when(F.col("j") < split, "xx").when(F.col("i") >= split, "yy").otherwise("xy")
    weight = F.when((part == "xy") | (F.col("i") == F.col("j")), 1.0).otherwise(2.0)
    sums = found.mapInPandas(add, "i int, j int, s double").groupBy(part.alias("part")).agg(F.sum(weight * F.col("s")).alias("s"))
    return {r["part"]: r["s"] for r in sums.collect()}


def row_products(found: Chunks) -> list[tuple[DataFrame, list[int]]]:
    """Per vector: the tiles of the product of all rows with one another, and the sizes of the row blocks."""
    out = []
    for side in range(len(found.means)):
        table, rows = found.turned(side)
        out.append((materialize(tiles(table, rows), "row-products"), rows))
    return out


def cka(found: Chunks) -> float:
    """Linear centred kernel alignment, from whichever products are smaller."""
    if found.n < max(len(m) for m in found.means):
        (k, _), (m, _) = row_products(found)
        return products(k, m) / np.sqrt(products(k, k) * products(m, m))
    s = squares(tiles(found.table, found.widths), found.firsts[1])
    return s["xy"] / np.sqrt(s["xx"] * s["yy"])


def left_singular(product: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Left singular vectors and values of vectors whose rows have this product; those below the floor are left out."""
    w, u = np.linalg.eigh(product)
    keep = w > floor * max(w.max(initial=0.0), 0.0)
    return u[:, keep][:, ::-1], np.sqrt(w[keep])[::-1]


def row_bases(found: Chunks, floor: float = 1e-12) -> list[tuple[np.ndarray, np.ndarray]]:
    return [left_singular(assembled(t, rows, rows, symmetric=True), floor) for t, rows in row_products(found)]


def column_products(found: Chunks) -> list[np.ndarray]:
    """The products of the columns on the driver: within each vector, and across the first two."""
    split, last = found.firsts[1], found.firsts[-1]
    w = [found.widths[:split], found.widths[split:last]]
    all_tiles = materialize(tiles(found.table, found.widths), "column-products")
    out = [assembled(all_tiles.filter(F.col("j") < split), w[0], w[0], symmetric=True)]
    if last > split:
        second = all_tiles.filter(F.col("i") >= split).withColumn("i", F.col("i") - split)
        out.append(assembled(second, w[1], w[1], split, symmetric=True))
        out.append(assembled(all_tiles.filter((F.col("i") < split) & (F.col("j") >= split)), w[0], w[1], split))
    return out


def loadings(found: Chunks, scores: np.ndarray) -> np.ndarray:
    """Columns times scores: ``X' S`` for the first vector; the rows of ``S`` are in the order of the row blocks."""
    order = {r["r"]: r["n"] for r in found.keys.select("r", F.size("keys").alias("n")).orderBy("r").collect()}
    starts = dict(zip(order, np.cumsum([0, *order.values()])[:-1].tolist(), strict=True))
    widths, top = found.widths, np.cumsum([0, *found.widths])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((int(top[-1]), scores.shape[1]))
        for f in frames:
            for r, c, data in f.itertuples(index=False):
                x = np.frombuffer(data).reshape(-1, widths[c])
                acc[top[c] : top[c + 1]] += x.T @ scores[starts[r] : starts[r] + len(x)]
        yield pd.DataFrame({"sums": [acc.ravel()]})

    return add_rows(found.table.mapInPandas(add, "sums array<double>")).reshape(-1, scores.shape[1])


def wide(df: DataFrame, cols: Sequence[str], width: int) -> bool:
    return max(vector_width(df, c) for c in cols) > width
