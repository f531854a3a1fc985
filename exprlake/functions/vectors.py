"""Expressions over packed vectors (``ARRAY<FLOAT>`` or ``ARRAY<DOUBLE>``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(vec: Column | str) -> Column:
    return _c(vec).cast("array<double>")


def total(vec: Column | str) -> Column:
    return F.aggregate(as_double(vec), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(vec: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0), lambda acc, x: acc + x * x))


def _each(vec: Column, scalar: Column, fn) -> Column:
    """Combine every element with one scalar of the row; the scalar is worked out once, not per element."""
    return F.zip_with(vec, F.array_repeat(scalar, F.size(vec)), fn)


def unit(vec: Column | str, floor: float = 1e-12) -> Column:
    """L2-normalised vector; the norm never drops below ``floor``."""
    v = as_double(vec)
    return _each(v, F.greatest(norm(v), F.lit(floor)), lambda x, n: x / n)


def centred(vec: Column | str) -> Column:
    v = as_double(vec)
    return _each(v, total(v) / F.size(v), lambda x, m: x - m)


def centred_unit(vec: Column | str, floor: float = 1e-8) -> Column:
    """Centred, then L2-normalised, so that a dot product is a Pearson correlation."""
    return unit(centred(vec), floor)


def all_finite(vec: Column | str) -> Column:
    inf = float("inf")
    return F.forall(_c(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf)))


def vector_width(df: DataFrame, vec: str) -> int:
    """Width of the packed vectors, read from one row."""
    row = df.select(F.size(vec).alias("n")).filter(F.col("n") > 0).first()
    if row is None:
        raise ValueError(f"no vector found in column {vec}")
    return int(row["n"])


def vector_mean(vec: str, width: int) -> Column:
    """Element-wise mean as one aggregate over ``width`` slots; partial sums stay one row per key."""
    return F.array(*[F.avg(F.col(vec)[i].cast("double")) for i in range(width)])


def vector_sum(vec: str, width: int) -> Column:
    return F.array(*[F.sum(F.col(vec)[i].cast("double")) for i in range(width)])
