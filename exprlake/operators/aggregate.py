"""Grouped summaries, pivots, vector pooling and interval unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.functions.columns import safe_div
from exprlake.operators.ordering import exact_percentile, same_key, top_k
from exprlake.operators.normalize import log1p_cpm
from exprlake.operators.sums import means, vector_sums


def group_means(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*groups).agg(*[F.avg(m).alias(m) for m in metrics])


def named_aggregates(df: DataFrame, groups: Sequence[str], spec: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*groups).agg(*[c.alias(n) for n, c in spec.items()])


def scope_expansion(df: DataFrame, base: Sequence[str], scope: str, spec: Mapping[str, Column], everything: str = "all") -> DataFrame:
    """Aggregates per scope plus one ``all`` row over every scope, in a single pass of grouping sets."""
    keys = [*base, scope]
    aggs = [c.alias(n) for n, c in spec.items()]
    out = df.groupingSets([keys, list(base)], *keys).agg(*aggs, F.grouping(scope).alias("_g"))
    return out.withColumn(scope, F.when(F.col("_g") == 1, everything).otherwise(F.col(scope))).drop("_g")


def pivot(df: DataFrame, index: Sequence[str], column: str, values: Sequence, metric: str, how: str = "first") -> DataFrame:
    """Long to wide with a fixed column order; ``how`` is first (smallest value wins) or mean."""
    agg = F.avg(metric) if how == "mean" else F.min(metric)
    return df.groupBy(*index).pivot(column, list(values)).agg(agg)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def transpose(df: DataFrame, index: str, columns: Sequence[str], index_values: Sequence) -> DataFrame:
    """Swap rows and columns of a small table."""
    return df.unpivot([index], list(columns), "column", "v").groupBy("column").pivot(index, list(index_values)).agg(F.first("v"))


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)
    return out.limit(limit) if limit else out


def top_crosstab(df: DataFrame, row: str, column: str, n_rows: int, n_columns: int) -> DataFrame:
    """Counts of (row, column) pairs kept to the most frequent rows and columns."""
    pairs = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))

    def most(c: str, n: int) -> DataFrame:
        return pairs.groupBy(c).agg(F.sum("n").alias("_n")).orderBy(F.col("_n").desc(), c).limit(n).select(c)

    return pairs.join(most(row, n_rows), row, "left_semi").join(most(column, n_columns), column, "left_semi")


def column_profile(df: DataFrame, max_distinct: int = 100) -> DataFrame:
    """Per column: rows, missing, and the exact distinct count when it does not exceed ``max_distinct``.

    A sketch decides first, so that exact counting only ever handles few values.
    """
    names = df.columns
    sketch = df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in names]).first()
    gate = {c: sketch[c] <= 2 * max_distinct for c in names}
    text = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    long = text.unpivot([], names, "column", "v")
    counts = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("missing"), F.min("v").alias("example")
    )
    small = [c for c in names if gate[c]]
    distinct = (
        text.select(*small).unpivot([], small, "column", "v").groupBy("column").agg(F.count_distinct("v").alias("d"))
        if small else text.sparkSession.createDataFrame([], "column string, d bigint")
    )
    out = counts.join(distinct, "column", "left")
    return out.withColumn("distinct_values", F.when(F.col("d") <= max_distinct, F.col("d"))).drop("d")


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str = "vec", width: int | None = None) -> DataFrame:
    """Element-wise mean per key in double precision, of vectors of any width."""
    return vector_sums(df, keys, vec).select(*keys, means().alias("vec"), F.col("count").alias("n"))


def vector_state(df: DataFrame, keys: Sequence[str], vec: str = "vec", width: int | None = None) -> DataFrame:
    """Mergeable state of a running mean: element-wise sum, count, and missing elements per key."""
    return vector_sums(df, keys, vec)


def merge_states(states: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    return vector_sums(states, keys, merge=True)


def finish_state(state: DataFrame) -> DataFrame:
    return state.withColumn("vec", means())


def group_centroids(df: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Mean raw counts over the chosen members of each group, normalised afterwards.

    ``members`` holds (group, sample_id); a feature a member lacks counts as zero.
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sums = df.join(members, "sample_id").groupBy(group, "feature").agg(F.sum("value").alias("_s"))
    mean = same_key(sums, sizes, [group]).select(F.col(group).alias("sample_id"), "feature", (F.col("_s") / F.col("_n")).alias("value"))
    return log1p_cpm(mean).withColumnRenamed("sample_id", group)


def union_length(df: DataFrame, groups: Sequence[str], start: str, end: str, bucket_width: int) -> DataFrame:
    """Length covered by inclusive integer intervals per group; touching ones merge.

    Intervals are cut at fixed bucket borders. Buckets do not overlap, so their
    covered lengths add up, and no window spans more than one bucket of one group.
    """
    w = F.lit(bucket_width)
    cut = df.select(*groups, F.col(start).alias("_s"), F.col(end).alias("_e")).filter(F.col("_e") >= F.col("_s"))
    cut = cut.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_s") / w), F.floor(F.col("_e") / w))))
    cut = cut.select(
        *groups, "_k", F.greatest("_s", F.col("_k") * w).alias("_s"), F.least("_e", (F.col("_k") + 1) * w - 1).alias("_e")
    )
    flat = cut.groupBy(*groups, "_k", "_s").agg(F.max("_e").alias("_e"))
    before = Window.partitionBy(*groups, "_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("_e").over(before), F.col("_s") - 1)
    fresh = F.greatest(F.col("_e") - F.greatest(reach, F.col("_s") - 1), F.lit(0))
    return flat.withColumn("_new", fresh).groupBy(*groups).agg(F.sum("_new").cast("bigint").alias("length"))


def mean_and_spread(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return df.groupBy(*groups).agg(*aggs)


def rates(df: DataFrame, groups: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """Share of rows meeting each condition; NULL conditions are skipped."""
    return df.groupBy(*groups).agg(*[F.avg(c.cast("double")).alias(n) for n, c in conditions.items()])


def sample_statistics(df: DataFrame, top_list: int = 8, concentration: int = 10) -> DataFrame:
    """Per sample: detected features, total, share of the ten largest values, and the top features.

    A sample's rows are bounded by the vocabulary, so a window per sample is fine.
    """
    clipped = df.withColumn("value", F.greatest(F.col("value"), F.lit(0.0)))
    w = Window.partitionBy("sample_id").orderBy(F.col("value").desc(), "feature")
    ranked = clipped.withColumn("_r", F.row_number().over(w))
    names = F.sort_array(F.collect_list(F.when(F.col("_r") <= top_list, F.struct("_r", "feature"))))
    out = ranked.groupBy("sample_id").agg(
        F.count_if(F.col("value") > 0).alias("detected"),
        F.sum("value").alias("total"),
        F.sum(F.when(F.col("_r") <= concentration, F.col("value"))).alias("_top"),
        F.array_join(F.transform(names, lambda x: x["feature"]), ",").alias("top_features"),
    )
    share = F.coalesce(safe_div("_top", "total"), F.lit(0.0))
    return out.withColumn("top10_concentration", share).drop("_top")


def feature_totals(df: DataFrame, groups: Sequence[str], feature: str = "feature") -> DataFrame:
    return df.groupBy(*groups, feature).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("seen"))


def cohort_table(meta: DataFrame, measurements: DataFrame, cohort: str, label: str, kind: str) -> DataFrame:
    """Per cohort: samples, positives, negatives, the kinds present, and how many features were measured."""
    people = meta.groupBy(cohort).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(label).cast("bigint").alias("positives"),
        F.sum(1 - F.col(label)).cast("bigint").alias("negatives"),
        F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"),
    )
    wide = measurements.join(meta.select("sample_id", cohort), "sample_id").groupBy(cohort).agg(
        F.count_distinct("feature").alias("features"))
    return people.join(wide, cohort, "left")


def pool_vectors(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Per key and position: mean, max, lower median, and their sum, over a set of vectors."""
    long = df.select(*keys, F.posexplode(vec).alias("pos", "_v")).withColumn("_v", F.col("_v").cast("double"))
    means = long.groupBy(*keys, "pos").agg(F.avg("_v").alias("mean"), F.max("_v").alias("max"))
    med = exact_percentile(long, [*keys, "pos"], "_v", {"median": 0.5}, interpolate=False)
    out = same_key(means, med, [*keys, "pos"])
    return out.withColumn("total", F.col("mean") + F.col("max") + F.col("median"))


def masked_mean(df: DataFrame, groups: Sequence[str], value: str, observed: Column) -> DataFrame:
    """Mean over observed rows only; the count never drops below one."""
    seen = observed.cast("double")
    return df.groupBy(*groups).agg((F.sum(F.col(value) * seen) / F.greatest(F.sum(seen), F.lit(1.0))).alias("mean"))


def metric_averages(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Average of per-term metrics with the number of terms."""
    return df.groupBy(*groups).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("terms"))
