"""Sums of packed vectors per key, in a plan of the same size for every width.

A task adds whole arrays up in a bounded table of keys and sends on one row a key; the rows of a key are then merged as
they stream by. An element that is NULL is left out of its own position only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: Numbers that the table of a task holds.
HELD = 4_000_000
PARTS = [
    StructField("count", LongType()), StructField("sum", ArrayType(DoubleType())), StructField("missing", ArrayType(LongType())),
]


def matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray | None]:
    """Rows of a list array as a matrix, padded at the end, and which elements are missing (none: no element is)."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.slice(vectors.offsets[0].as_py(), int(sizes.sum()))
    gone = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else np.zeros(len(flat), bool)
    values = np.where(gone, 0.0, flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float))
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        x, missing = values.reshape(len(sizes), width), gone.reshape(len(sizes), width)
    else:
        inside = np.arange(width) < sizes[:, None]
        x, missing = np.zeros(inside.shape), np.ones(inside.shape, bool)
        x[inside], missing[inside] = values, gone
    return x, missing if missing.any() else None


def longer(a: np.ndarray, width: int, fill: float) -> np.ndarray:
    return a if len(a) >= width else np.concatenate([a, np.full(width - len(a), fill, a.dtype)])


def joined(a: list, b: list) -> list:
    """Two states ``[count, sum, missing]`` as one; a position that a state doesn't reach is missing in all of its rows."""
    width = max(len(a[1]), len(b[1]))
    return [a[0] + b[0], longer(a[1], width, 0.0) + longer(b[1], width, 0.0), longer(a[2], width, a[0]) + longer(b[2], width, b[0])]


def vector_sums(df: DataFrame, keys: Sequence[str], vec: str = "vec", merge: bool = False, partial: bool = False) -> DataFrame:
    """``keys, count, sum, missing``: rows, element-wise sums, and by position the rows without an element there (NULL: none).

    With ``merge`` the rows of ``df`` are such states themselves. A row whose vector is NULL counts, and is missing everywhere.
    ``partial`` states are those of the tasks, not yet merged by key.
    """
    keys = list(keys)
    fields = [df.schema[k] for k in keys]
    schema = StructType([*fields, *PARTS])
    arrow = to_arrow_schema(schema)

    def rows(states: dict[tuple, list]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in states], arrow.field(i).type) for i in range(len(keys))]
        columns += [
            pa.array([s[0] for s in states.values()], pa.int64()), pa.array([s[1] for s in states.values()], pa.list_(pa.float64())),
            pa.array([s[2] if s[2].any() else None for s in states.values()], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def names(batch: pa.RecordBatch) -> list[tuple]:
        return list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * len(batch)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            if not len(batch):
                continue
            number: dict[tuple, int] = {}
            codes = np.array([number.setdefault(k, len(number)) for k in names(batch)])
            vectors = batch.column(vec).fill_null([]) if batch.column(vec).null_count else batch.column(vec)
            x, gone = matrix(vectors)
            order = np.argsort(codes, kind="stable")
            starts = np.searchsorted(codes[order], np.arange(len(number)))
            counts = np.bincount(codes, minlength=len(number))
            total = np.add.reduceat(x[order], starts, axis=0)
            missing = np.zeros(total.shape, np.int64) if gone is None else np.add.reduceat(gone[order].astype(np.int64), starts, axis=0)
            widths = np.maximum.reduceat(np.diff(vectors.offsets.to_numpy())[order], starts)
            for key, i in number.items():
                state = [int(counts[i]), total[i, : widths[i]], missing[i, : widths[i]]]
                held[key] = joined(held[key], state) if key in held else state
            if len(held) * x.shape[1] > HELD:
                yield rows(held)
                held = {}
        yield rows(held)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done: dict[tuple, list] = {}
            sums, missing = (batch.column(c).to_pylist() for c in ("sum", "missing"))
            for key, count, s, m in zip(names(batch), batch.column("count").to_pylist(), sums, missing, strict=True):
                new = [count, np.array(s, float), np.zeros(len(s), np.int64) if m is None else np.array(m, np.int64)]
                if state is not None and key == at:
                    state = joined(state, new)
                    continue
                if state is not None:
                    done[at] = state
                at, state = key, new
            yield rows(done)
        if state is not None:
            yield rows({at: state})

    parts = df.select(*keys, "count", "sum", "missing") if merge else df.select(*keys, vec).mapInArrow(add, schema)
    if partial:
        return parts
    sent = parts.repartition(*keys).sortWithinPartitions(*keys) if keys else parts.coalesce(1)
    return sent.mapInArrow(together, schema)


def present(count: str = "count", missing: str = "missing") -> Column:
    """By position: the rows that have an element there."""
    return F.when(F.col(missing).isNull(), F.array_repeat(count, F.size("sum"))).otherwise(
        F.zip_with(F.array_repeat(count, F.size("sum")), missing, lambda n, m: n - m)
    )


def means() -> Column:
    """Element-wise means of the states of :func:`vector_sums`; NULL where no row has an element."""
    return F.zip_with("sum", present(), lambda s, n: s / F.nullif(n, F.lit(0).cast("bigint")))
