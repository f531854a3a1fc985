"""Nearest neighbours through randomly rotated one-bit codes.

Every vector is centred, rotated by a random orthogonal matrix and reduced to the signs of its coordinates,
packed eight to a byte, beside two correction scalars: its distance from the centre and the inner product of
the rotated unit vector with its code. From these the inner product with a query is estimated without bias,
with an error bound that shrinks with the square root of the width. A block of the index first answers by
estimates; exact distances are then worked out for every vector whose lower bound could still reach the
best ``k``, so the bound alone decides what is left out.

All vectors are indexed, in packed blocks of a bounded number of bytes. Query blocks meet index blocks on a
grid of cells; a block pair emits its best ``k`` per query and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from exprlake.llm.common import names as column_names
from exprlake.llm.common import kept, stored, unsigned_order

INDEX = "dim int, block bigint, ids binary, codes binary, norms binary, fits binary, vecs binary"
QUERY = "dim int, block bigint, ids binary, vecs binary"
FOUND = "query_id bigint, vec_id bigint, score double"
BLOCK_BYTES = 4 << 20
QUERY_ROWS = 512
#: Rows from which the centre is fitted; codes of all rows are measured from it.
CENTRE_ROWS = 8192


def rotation(dim: int, seed: int) -> np.ndarray:
    """Random orthogonal matrix."""

    def make() -> np.ndarray:
        q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
        return q * np.sign(np.diag(r))

    return kept(f"rotation {dim} {seed}", make)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, distances from the centre, and inner products of unit vectors with their codes."""
    away = x - centre
    norms = np.sqrt((away * away).sum(1))
    turned = (away / np.where(norms > 0, norms, 1)[:, None]) @ turn
    fits = np.where(norms > 0, np.abs(turned).sum(1) / np.sqrt(x.shape[1]), 1.0)
    return np.packbits(turned > 0, axis=1), norms, fits


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed in the order of the components."""
    gap = x.astype(np.float64) - q
    return np.sqrt(np.cumsum(gap * gap, axis=1)[:, -1])


def search_block(
    ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, fits: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray,
    centre: np.ndarray, turn: np.ndarray, k: int, error: float,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: ids and distances of the best ``k`` of a block, ties to smaller ids, the query's own id left out."""
    dim = x.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    away = q - centre
    q_norms = np.sqrt((away * away).sum(1))
    turned = (away / np.where(q_norms > 0, q_norms, 1)[:, None]) @ turn
    inner = (signs @ turned.T.astype(np.float32)).astype(np.float64) / np.sqrt(dim) / fits[:, None]
    slack = error * np.sqrt(np.maximum(1 - fits * fits, 0)) / fits / np.sqrt(max(dim - 1, 1)) + 1e-6
    for j in range(len(q)):
        reach = np.minimum(inner[:, j] + slack, 1.0)
        low = norms * norms + q_norms[j] ** 2 - 2 * norms * q_norms[j] * reach
        low = np.where(ids == q_ids[j], np.inf, low)
        first = np.argpartition(low, min(4 * k, len(low)) - 1)[: 4 * k]
        first = first[low[first] < np.inf]
        if not len(first):
            continue
        near = distances(x[first], q[j])
        limit = np.partition(near, k - 1)[k - 1] if len(near) >= k else np.inf
        chosen = np.flatnonzero((low <= limit * limit * (1 + 1e-9)) & (low < np.inf))
        chosen = np.union1d(chosen, first)
        near = distances(x[chosen], q[j])
        best = np.lexsort((ids[chosen], near))[:k]
        yield int(q_ids[j]), ids[chosen][best], near[best]


def _batches(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, matrix) of each width in a batch of (id, vector) rows."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    vecs = batch.column(1)
    widths = vecs.value_lengths().to_numpy(zero_copy_only=False)
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(kind)
    starts = np.concatenate([[0], np.cumsum(widths)])
    for dim in np.unique(widths):
        at = np.flatnonzero(widths == dim)
        yield int(dim), ids[at], flat[starts[at][:, None] + np.arange(dim)]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vec: str = "embedding", error: float = 3.0, seed: int = 5,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows of ``vectors`` to each row of ``queries``.

    * ``score`` is the Euclidean distance in double precision; ties go to the smaller id; rank starts at 1.
    * A row with the query's own id is no candidate. Fewer candidates than ``k``: all of them; none: no rows.
    * Vectors null, empty, zero or holding null or non-finite components take no part, nor do null ids.
    * Vectors of different widths don't meet: each width is searched by itself.
    * Rows that repeat an id are candidates each; of queries that repeat an id the smallest vector is asked.
    * Other columns are not read.

    ``error`` is the width of the bound in standard deviations of the estimate.
    """
    spark = vectors.sparkSession
    kind = np.float32 if isinstance(vectors.schema[vec].dataType.elementType, FloatType) else np.float64
    element = "float" if kind is np.float32 else "double"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vec).cast(f"array<{element}>")
        sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.filter(F.col(key).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(key).cast("bigint").alias("i"), v.alias("v"))

    rows = usable(vectors)
    asked = usable(queries).groupBy("i").agg(F.min("v").alias("v"))
    sample = rows.orderBy(unsigned_order(seed, F.col("i")), "i", "v").limit(CENTRE_ROWS)
    sums = sample.select(F.size("v").alias("dim"), F.posexplode("v")).groupBy("dim", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    centres: dict[int, np.ndarray] = {}
    for r in sums.collect():  # widths and components of the sample
        centres.setdefault(r["dim"], np.zeros(r["dim"]))[r["pos"]] = r["m"]

    def packed(batches: Iterator[pa.RecordBatch], index: bool) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        bytes_held = 0

        def flush(dims: list[int]) -> Iterator[pa.RecordBatch]:
            nonlocal block, bytes_held
            for dim in dims:
                ids, x = (np.concatenate(part) for part in zip(*held.pop(dim), strict=True))
                bytes_held -= x.nbytes
                step = max(1, BLOCK_BYTES // (dim * x.itemsize)) if index else QUERY_ROWS
                for i in range(0, len(ids), step):
                    part, own = x[i : i + step], ids[i : i + step].astype(np.int64)
                    fields = [dim, block, own.tobytes()]
                    if index:
                        found = encode(part.astype(np.float64), centres.get(dim, np.zeros(dim)), rotation(dim, seed))
                        fields += [y.tobytes() for y in found]
                    fields.append(part.tobytes())
                    block += 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f], t) for f, t in zip(fields, [pa.int32(), pa.int64()] + [pa.binary()] * (len(fields) - 2), strict=True)],
                        names=column_names(INDEX if index else QUERY),
                    )

        for batch in batches:
            for dim, ids, x in _batches(batch, kind):
                held.setdefault(dim, []).append((ids, x))
                bytes_held += x.nbytes
            if bytes_held >= 8 * BLOCK_BYTES:
                yield from flush(list(held))
            else:
                yield from flush([d for d, parts in held.items() if sum(x.nbytes for _, x in parts) >= BLOCK_BYTES])
        yield from flush(list(held))

    index = stored(rows.mapInArrow(lambda b: packed(b, True), INDEX), "codes")
    query = stored(asked.mapInArrow(lambda b: packed(b, False), QUERY), "queries")
    n_index, n_query = index.count(), query.count()
    cells = 8 * spark.sparkContext.defaultParallelism
    across = max(1, min(n_index, cells))
    down = max(1, min(n_query, cells // across))
    left = index.withColumn("i", F.pmod(F.xxhash64("block", "dim"), F.lit(across))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).select(
        "dim", "i", "j", "ids", "codes", "norms", "fits", "vecs"
    )
    right = query.withColumn("j", F.pmod(F.xxhash64("block", "dim"), F.lit(down)).cast("int")).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint")))
    ).select("dim", "i", "j", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    pairs = left.join(right, ["dim", "i", "j"]).drop("i", "j")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                dim = row["dim"]
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                found = list(
                    search_block(
                        ids, np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["norms"]), np.frombuffer(row["fits"]),
                        np.frombuffer(row["vecs"], kind).reshape(len(ids), dim), q_ids,
                        np.frombuffer(row["q_vecs"], kind).reshape(len(q_ids), dim).astype(np.float64),
                        centres.get(dim, np.zeros(dim)), rotation(dim, seed), k, error,
                    )
                )
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])),
                            pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found])),
                        ],
                        names=column_names(FOUND),
                    )

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        pairs.mapInArrow(searched, FOUND).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
