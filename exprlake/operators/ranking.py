"""Ranking, top-k, sorting, paging and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.operators.ordering import average_rank, cumulative, first_row, keyed_position, same_key, top_k


def dense_ids(df: DataFrame, key: str, out: str = "token_id", start: int = 1) -> DataFrame:
    """Consecutive ids in the order of a key, for a vocabulary of any size."""
    return keyed_position(df, [], key, out).withColumn(out, F.col(out) + F.lit(start - 1)).drop(f"{out}_n")


def rank_by(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """SQL rank among the few candidates (models) of a group."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*groups).orderBy(*order)).cast("bigint"))


def average_tie_rank(df: DataFrame, groups: Sequence[str], score: str, out: str = "rank") -> DataFrame:
    """Descending rank with ties averaged, among the few models of a benchmark."""
    w = Window.partitionBy(*groups).orderBy(F.col(score).desc())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*groups, score))
    return df.withColumn(out, F.rank().over(w) + (ties - 1) / F.lit(2.0))


def model_standing(df: DataFrame, benchmark: Sequence[str], model: str, score: str) -> DataFrame:
    """Per model: benchmarks, wins, top-three places and mean rank."""
    ranked = average_tie_rank(df.filter(F.col(score).isNotNull()), benchmark, score)
    return ranked.groupBy(model).agg(
        F.count(F.lit(1)).alias("benchmarks"), F.count_if(F.col("rank") == 1).alias("wins"),
        F.count_if(F.col("rank") <= 3).alias("top3"), F.avg("rank").alias("mean_rank"),
    )


def percentile_rank(df: DataFrame, groups: Sequence[str], score: str, out: str = "pct_rank") -> DataFrame:
    """Average rank divided by the group size."""
    ranked = average_rank(df, groups, score, "_r")
    return ranked.withColumn(out, F.col("_r") / F.col("_r_n")).drop("_r", "_r_n")


def winners(df: DataFrame, groups: Sequence[str], score: str, model: str) -> DataFrame:
    """Best row per group; the smallest model name wins a tie."""
    return first_row(df, groups, [F.col(score).desc_nulls_last(), F.col(model)])


def tied_winners(df: DataFrame, groups: Sequence[str], score: str, model: str, tolerance: float = 1e-12) -> DataFrame:
    """Best score per group and every model within ``tolerance`` of it."""
    best = df.groupBy(*groups).agg(F.max(score).alias("best"))
    tied = same_key(df, best, groups).filter(F.abs(F.col(score) - F.col("best")) <= tolerance)
    return tied.groupBy(*groups).agg(
        F.max("best").alias("best"), F.array_join(F.sort_array(F.collect_set(model)), ", ").alias("winners"))


def winner_counts(df: DataFrame, groups: Sequence[str], score: str, model: str, unit: str) -> DataFrame:
    return winners(df, groups, score, model).groupBy(model).agg(F.count_distinct(unit).alias("wins"))


def select_candidate(df: DataFrame, low_metric: str, high_metric: str, model: str) -> DataFrame:
    """Candidate with the best mean of two ranks, one ascending and one descending; ties by the ranks, then the name.

    A candidate list is short, but the ranks still come from prefix counts.
    """
    low = cumulative(df, [], low_metric).select(low_metric, (F.col("n_before") + 1).alias("low_rank"))
    high = cumulative(df, [], high_metric).select(
        high_metric, (F.col("n_total") - F.col("n_before") - F.col("n") + 1).alias("high_rank"))
    out = df.join(low, low_metric).join(high, high_metric)
    out = out.withColumn("mean_rank", (F.col("low_rank") + F.col("high_rank")) / F.lit(2.0))
    return out.orderBy("mean_rank", "high_rank", "low_rank", model).limit(1)


def most_variable(df: DataFrame, k: int, fit: Column | None = None) -> DataFrame:
    """The k features of largest population variance over the rows matching ``fit``."""
    v = F.col("value") if fit is None else F.when(fit, F.col("value"))
    stats = df.groupBy("feature").agg(F.var_pop(v).alias("variance"))
    return stats.orderBy(F.col("variance").desc_nulls_last(), "feature").limit(k)


def panel_scores(df: DataFrame, samples: DataFrame, excluded: DataFrame) -> DataFrame:
    """variance * sqrt(detection rate) per feature over ``samples``, with an exclusion flag.

    Absent cells count as zeros, so the moments come from sums and the sample count.
    """
    n = samples.agg(F.count(F.lit(1)).alias("_n")).scalar()
    v = F.col("value")
    sums = df.join(samples.select("sample_id"), "sample_id", "left_semi").groupBy("feature").agg(
        F.sum(v).alias("_s"), F.sum(v * v).alias("_ss"), F.count_if(v > 0).alias("_d"))
    out = sums.withColumn("_n", n)
    mean = F.col("_s") / F.col("_n")
    out = out.withColumn("variance", F.greatest(F.col("_ss") / F.col("_n") - mean * mean, F.lit(0.0)))
    out = out.withColumn("detection_rate", F.col("_d") / F.col("_n"))
    out = out.withColumn("score", F.col("variance") * F.sqrt("detection_rate"))
    flag = excluded.select("feature").distinct().withColumn("_x", F.lit(True))
    out = out.join(flag, "feature", "left").withColumn("excluded", F.coalesce("_x", F.lit(False)))
    return out.select("feature", "variance", "detection_rate", "score", "excluded")


def evenly_spaced(df: DataFrame, group: str, key: str, m: int) -> DataFrame:
    """At most ``m`` members per group at evenly spaced places of the key order; adds ``members``.

    Row i is taken when floor(j * (n-1)/(m-1)) = i for some j; that is decided
    from i alone, without listing the j.
    """
    placed = keyed_position(df, [group], key, "_p")
    i = F.col("_p") - 1
    n = F.col("_p_n")
    if m == 1:
        return placed.filter(i == 0).withColumnRenamed("_p_n", "members").drop("_p")
    step = (n - 1) / F.lit(float(m - 1))
    guess = F.floor(i / F.greatest(step, F.lit(1e-300)))
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        j = guess + shift
        hit = hit | ((j >= 0) & (j < m) & (F.floor(j * step) == i))
    return placed.filter((n <= m) | (i == n - 1) | hit).withColumnRenamed("_p_n", "members").drop("_p")


def best_record(df: DataFrame, group: str, preferred: Column, quality: str, key: str) -> DataFrame:
    """Best record per group; if any record is preferred only those compete; missing quality comes last."""
    return first_row(df, [group], [preferred.desc_nulls_last(), F.col(quality).desc_nulls_last(), F.col(key)])


def quota_top_k(
    matches: DataFrame, kind: str, quotas: Mapping[str, int], fallback: int, fallback_kind: str | None = None, class_rank: str | None = None,
) -> DataFrame:
    """Best matches per sample by class quota in the given class order, ranks renumbered.

    Samples without any match of a listed class get their overall best ``fallback``, named ``fallback_kind`` if given.
    ``class_rank`` names a column that already ranks a sample's matches in their class. One shuffle serves all windows.
    """
    order = [F.col("similarity").desc(), F.col("reference_id")]
    places = {k: i for i, k in enumerate(quotas)}
    place = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])[F.col(kind)]
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(kind)]
    listed = F.coalesce(F.col(kind).isin(*quotas), F.lit(False))
    own = Window.partitionBy("sample_id")
    out = matches.withColumn("_any", F.max(listed).over(own))
    out = out.withColumn("_r", F.col(class_rank) if class_rank else F.row_number().over(Window.partitionBy("sample_id", kind).orderBy(*order)))
    out = out.filter(~F.col("_any") | (listed & (F.col("_r") <= quota))).withColumn("_c", F.when(F.col("_any"), place).otherwise(0))
    if fallback_kind is not None:
        out = out.withColumn(kind, F.when(F.col("_any"), F.col(kind)).otherwise(fallback_kind))
    out = out.withColumn("rank", F.row_number().over(own.orderBy("_c", *order)).cast("bigint"))
    return out.filter(F.col("_any") | (F.col("rank") <= fallback)).drop("_any", "_r", "_c")


def first_of_class(matches: DataFrame, kind: str, value: str) -> DataFrame:
    """First match of one class per sample."""
    keep = matches.filter(F.col(kind) == value)
    return keep.groupBy("sample_id").agg(F.min_by(F.struct("reference_id", "similarity"), "rank").alias("_m")).select(
        "sample_id", "_m.reference_id", "_m.similarity")


def vote_call(
    matches: DataFrame, label: str, candidates: int = 50, margin: float = 0.1, temperature: float = 0.08, rank: str | None = None,
    samples: DataFrame | None = None,
) -> DataFrame:
    """Label call per sample from its best candidates.

    The best similarity per label goes through a softmax; the call is the first
    label when it leads by ``margin``, else ``indeterminate``. A sample whose candidates
    have no named label is ``indeterminate`` with margin 1 and no weight. ``rank`` names a column that already ranks a
    sample's matches; ``samples`` are those to answer, by default all of ``matches``.
    """
    from exprlake.operators.normalize import softmax

    if rank:
        near = matches.filter(F.col(rank) <= candidates)
    else:
        near = top_k(matches, ["sample_id"], [F.col("similarity").desc(), F.col("reference_id")], candidates, "_r")
    named = near.filter(~F.lower(F.coalesce(label, F.lit(""))).isin("", "unknown"))
    best = named.groupBy("sample_id", label).agg(F.max("similarity").alias("_s"))
    voted = softmax(best, ["sample_id"], "_s", temperature)
    ranked = top_k(voted, ["sample_id"], [F.col("weight").desc(), F.col(label)], 2, "_r")
    voted_for = ranked.groupBy("sample_id").agg(
        F.max(F.when(F.col("_r") == 1, F.col(label))).alias("_l"),
        F.max(F.when(F.col("_r") == 1, F.col("weight"))).alias("weight"),
        F.max(F.when(F.col("_r") == 2, F.col("weight"))).alias("_w2"),
    )
    samples = matches.select("sample_id").distinct() if samples is None else samples
    out = samples.join(voted_for, "sample_id", "left")
    out = out.withColumn("margin", F.when(F.col("_w2").isNull(), 1.0).otherwise(F.col("weight") - F.col("_w2")))
    call = F.when(F.col("_l").isNotNull() & (F.col("margin") >= margin), F.col("_l")).otherwise("indeterminate")
    return out.withColumn("call", call).drop("_l", "_w2")


def label_scores(matches: DataFrame, label: str, k: int = 5) -> DataFrame:
    """Mean similarity of a sample's matches per label, best ``k`` labels."""
    mean = matches.groupBy("sample_id", label).agg(F.avg("similarity").alias("score"))
    return top_k(mean, ["sample_id"], [F.col("score").desc(), F.col(label)], k)


def top_overlap(df: DataFrame, groups: Sequence[str], a: str, b: str, key: str, ks: Sequence[int]) -> DataFrame:
    """Share of features that are in the top k of both rankings, for several k."""
    k_max = max(ks)
    keys = list(groups)
    ta = top_k(df, keys, [F.col(a).desc(), F.col(key)], k_max, "_ra").select(*keys, key, "_ra")
    tb = top_k(df, keys, [F.col(b).desc(), F.col(key)], k_max, "_rb").select(*keys, key, "_rb")
    both = ta.join(tb, [*keys, key])
    out = both.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks])))
    hit = (F.col("_ra") <= F.col("top_k")) & (F.col("_rb") <= F.col("top_k"))
    out = out.groupBy(*keys, "top_k").agg(F.count_if(hit).alias("overlap"))
    return out.withColumn("fraction", F.col("overlap") / F.col("top_k"))


def recovered_only_by(df: DataFrame, label: str, scope: Column, a: str, b: str, threshold: float = 0.9) -> DataFrame:
    """Positive rows in scope that ranking ``a`` places high and ranking ``b`` does not."""
    return df.filter((F.col(label) == 1) & scope & (F.col(a) >= threshold) & (F.col(b) < threshold))


def category_order(df: DataFrame, column: str, order: Sequence[str], unknown: int = 99) -> DataFrame:
    """Sort key for a custom category order; values outside it come last."""
    table = F.create_map(*[F.lit(x) for kv in ((v, i) for i, v in enumerate(order)) for x in kv])
    return df.withColumn("sort_order", F.coalesce(F.try_element_at(table, F.col(column)), F.lit(unknown)))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered result."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / F.lit(float(size))))


def symmetric_difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with the side."""
    left = a.select(*on).distinct().withColumn("_l", F.lit(True))
    right = b.select(*on).distinct().withColumn("_r", F.lit(True))
    both = left.join(right, list(on), "full_outer").filter(F.col("_l").isNull() | F.col("_r").isNull())
    return both.withColumn("side", F.when(F.col("_r").isNull(), "left").otherwise("right")).drop("_l", "_r")


def replace_slice(table: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop the slices that ``fresh`` carries, then append it."""
    kept = table.join(fresh.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
