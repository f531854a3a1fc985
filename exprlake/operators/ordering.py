"""Ranks, prefix sums and exact quantiles without pulling a group into one task.

A window over a whole group runs in a single task, and a group may hold a large
share of all rows. Here a group is first cut into value buckets whose edges
follow from the group's minimum, maximum and row count alone, so they come out
the same whenever the plan is evaluated. A window then only spans one bucket,
and a small table of bucket totals supplies the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.functions.columns import draw_key, draw_unit, finite
from exprlake.session import materialize

ROWS_PER_BUCKET = 500_000
MAX_BUCKETS = 8192


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on the key columns. As in the reference's grouping, NULL keys form no group."""
    return left.join(right, list(keys), how)


def _bucket(numeric: str, rows_per_bucket: int, max_buckets: int) -> Column:
    """Bucket number from the group's ``_lo``, ``_hi`` and ``_rows``.

    The place of a value is the mean of its linear position in the range and of
    three logarithmic ones (from the bottom, from the top, away from zero). Each
    never decreases with the value, so neither does the mean, and a heavy tail on
    any side still spreads over many buckets.
    """
    wanted = F.least(F.lit(max_buckets), F.ceil(F.col("_rows") / F.lit(float(rows_per_bucket)))).cast("int")
    v, span = F.col(numeric).cast("double"), F.col("_hi") - F.col("_lo")
    u = F.least(F.greatest((v - F.col("_lo")) / F.nullif(span, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    zoom = float(1 << 30)

    def log_place(x: Column) -> Column:
        return F.log1p(x * zoom) / F.log1p(F.lit(zoom))

    far = F.greatest(F.abs(F.col("_lo")), F.abs(F.col("_hi")))
    around_zero = (1.0 + F.signum(v) * log_place(F.abs(v) / F.nullif(far, F.lit(0.0)))) / 2.0
    place = (u + log_place(u) + (1.0 - log_place(1.0 - u)) + around_zero) / 4.0
    spread = F.floor(place * wanted)
    return F.when((wanted > 1) & (span > 0) & (span < float("inf")), F.least(spread, wanted - 1)).otherwise(F.lit(0)).cast("int")


def _spread(numeric: str) -> list[Column]:
    return [
        F.min(numeric).cast("double").alias("_lo"), F.max(numeric).cast("double").alias("_hi"),
        F.count(F.lit(1)).alias("_rows"),
    ]


def _attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put a group's statistics on its rows; without groups they are a scalar subquery, not a join."""
    if keys:
        return same_key(df, stats, keys)
    names = stats.columns
    row = stats.select(F.struct(*names).alias("s")).scalar()
    return df.withColumn("_s", row).select("*", *[F.col(f"_s.{n}").alias(n) for n in names]).drop("_s")


def _earlier(df: DataFrame, groups: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per (group, bucket): the sum over all earlier buckets."""
    part = df.groupBy(*groups, "_b").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return part.select(*groups, "_b", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums])


def cumulative(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    weights: dict[str, Column] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    keep_bucket: bool = False,
) -> DataFrame:
    """One row per (group, distinct value) with running sums in ascending order.

    For every weight ``w`` the result holds ``w`` (sum at this value), ``w_before``
    (sum over smaller values) and ``w_total`` (sum over the group). Rows with a
    missing or non-finite value are left out. ``n`` (row count) is always there.
    """
    keys = list(groups)
    weights = {"n": F.lit(1), **(weights or {})}
    base = df.filter(finite(F.col(value).cast("double")))
    flat = base.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()])
    # every use of ``flat`` reads all of its columns, so that Spark shuffles the input once and reuses it
    stats = flat.groupBy(*keys).agg(*_spread(value), *[F.sum(n).alias(f"{n}_total") for n in weights])
    totals = [f"{n}_total" for n in weights]
    cut = _attach(flat, stats, keys).withColumn("_b", _bucket(value, rows_per_bucket, MAX_BUCKETS))
    cut = cut.select(*keys, value, "_b", *weights, *totals)
    earlier = _earlier(cut, keys, {n: F.col(n) for n in weights})
    below = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select("*", *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"{n}_before") for n in weights])
    out = same_key(local, earlier, [*keys, "_b"])
    out = out.withColumns({f"{n}_before": F.col(f"{n}_before") + F.col(f"_off_{n}") for n in weights})
    drop = [f"_off_{n}" for n in weights] + ([] if keep_bucket else ["_b"])
    return out.drop(*drop)


def average_rank(df: DataFrame, groups: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Tie-averaged ascending rank (1 = smallest) on every row with a finite value."""
    table = cumulative(df, groups, value)
    ranks = table.select(
        *groups, value, (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(out),
        F.col("n_total").alias(f"{out}_n"),
    )
    return same_key(df, ranks, [*groups, value])


def position(
    df: DataFrame,
    groups: Sequence[str],
    numeric: str,
    order: Sequence[Column],
    out: str = "position",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """1-based row number inside each group; ``numeric`` must agree with ``order``.

    Also adds ``<out>_n``, the size of the group.
    """
    keys = list(groups)
    stats = df.groupBy(*keys).agg(*_spread(numeric))
    cut = _attach(df, stats, keys).withColumn("_b", _bucket(numeric, rows_per_bucket, MAX_BUCKETS))
    earlier = _earlier(cut, keys, {"_m": F.lit(1)})
    local = cut.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    joined = same_key(local, earlier, [*keys, "_b"])
    result = joined.withColumn(out, (F.col(out) + F.col("_off__m")).cast("bigint"))
    return result.withColumnRenamed("_rows", f"{out}_n").drop("_off__m", "_b", "_lo", "_hi")


def keyed_position(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    out: str = "position",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    keep_bucket: bool = False,
) -> DataFrame:
    """1-based row number inside each group in the order of ``key``, which may be of any ordered type.

    Buckets are ranges of the key over all groups, cut at quantiles that Spark samples, so neither a common start of
    texts nor values packed into a narrow range fill one of them; a group's share of a bucket is no larger than the
    bucket. The buckets are written once, so every later pass sees the same ones. Also adds ``<out>_n``.
    """
    keys = list(groups)
    buckets = max(1, -(-df.count() // rows_per_bucket))
    cut = materialize(df.repartitionByRange(buckets, key).withColumn("_b", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys, "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_off"), F.sum("_m").over(Window.partitionBy(*keys)).alias(f"{out}_n"),
    )
    local = cut.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(key)))
    return same_key(local, sizes, [*keys, "_b"]).withColumn(out, (F.col(out) + F.col("_off")).cast("bigint")).drop("_off", *([] if keep_bucket else ["_b"]))


def draw_position(
    df: DataFrame,
    groups: Sequence[str],
    keys: Sequence[str],
    seed: int | str,
    out: str = "position",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Repeatable random order of the rows of each group, as a 1-based position."""
    drawn = df.withColumn("_h", draw_key(seed, *keys)).withColumn("_u", draw_unit(F.col("_h")))
    order = [F.col("_h"), *[F.col(k) for k in keys]]
    return position(drawn, groups, "_u", order, out, rows_per_bucket).drop("_h", "_u")


def exact_percentile(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    points: dict[str, float],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    interpolate: bool = True,
) -> DataFrame:
    """Percentiles (linear interpolation, or the lower neighbour) per group, one output column per entry of ``points``."""
    table = cumulative(df, groups, value, rows_per_bucket=rows_per_bucket)
    picks = []
    for name, p in points.items():
        spot = F.lit(float(p)) * (F.col("n_total") - 1)
        for side, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            picks.append(F.max(F.when(F.col("n_before") <= at, F.col(value).cast("double"))).alias(f"_{side}_{name}"))
    agg = table.groupBy(*groups).agg(F.max("n_total").alias("_t"), *picks)
    cols = []
    for name, p in points.items():
        spot = F.lit(float(p)) * (F.col("_t") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (spot - F.floor(spot)) * (hi - lo) if interpolate else lo).alias(name))
    return agg.select(*groups, *cols)


def suffix_min(df: DataFrame, groups: Sequence[str], value: str, target: str, out: str) -> DataFrame:
    """Minimum of ``target`` over this and all larger ``value`` s; needs the ``_b`` column."""
    keys = list(groups)
    mins = df.groupBy(*keys, "_b").agg(F.min(target).alias("_m"))
    later = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    mins = mins.select(*keys, "_b", F.min("_m").over(later).alias("_later"))
    here = Window.partitionBy(*keys, "_b").orderBy(F.col(value).desc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = df.withColumn(out, F.min(target).over(here))
    joined = same_key(local, mins, [*keys, "_b"])
    return joined.withColumn(out, F.least(F.col(out), F.col("_later"))).drop("_later")


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; each task keeps only k rows of a group before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_row(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per group in the given order (keep-first de-duplication)."""
    return top_k(df, groups, order, 1, "_first").drop("_first")
