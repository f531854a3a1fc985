"""Normalisation of measurements and packed profiles.

Windows here span one sample, whose rows are bounded by the vocabulary. Anything
taken over all samples of a feature or group is an aggregate joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.functions.columns import finite
from exprlake.operators.ordering import cumulative, exact_percentile, same_key

def _sample():
    return Window.partitionBy("sample_id")



def _clip0(col: Column | str) -> Column:
    return F.greatest(F.col(col) if isinstance(col, str) else col, F.lit(0.0))


def log1p_tpm(df: DataFrame, lengths: DataFrame, on: Sequence[str] = ("feature",)) -> DataFrame:
    """Counts to log1p TPM with per-feature (and per-species) lengths in base pairs."""
    rate = _clip0("value") / F.greatest(F.col("length") / 1000.0, F.lit(1e-6))
    joined = df.join(lengths, list(on)).withColumn("_rate", rate)
    total = F.greatest(F.sum("_rate").over(_sample()), F.lit(1e-12))
    return joined.withColumn("value", F.log1p(F.col("_rate") / total * 1e6)).drop("_rate", "length")


def log1p_cpm(df: DataFrame) -> DataFrame:
    """Counts to log1p of counts per million; totals below one count as one."""
    total = F.greatest(F.sum(_clip0("value")).over(_sample()), F.lit(1.0))
    return df.withColumn("value", F.log1p(_clip0("value") * 1e6 / total))


def fpkm_to_log1p_tpm(df: DataFrame) -> DataFrame:
    """FPKM to log1p TPM. Samples with a zero total give NULL; see :func:`zero_total_samples`."""
    total = F.sum(_clip0("value")).over(_sample())
    return df.withColumn("value", F.log1p(_clip0("value") / F.when(total > 0, total) * 1e6))


def zero_total_samples(df: DataFrame) -> DataFrame:
    return df.groupBy("sample_id").agg(F.sum(_clip0("value")).alias("total")).filter(F.col("total") <= 0)


def log1p_clip(col: Column | str) -> Column:
    return F.log1p(_clip0(col))


def expm1_clip(col: Column | str) -> Column:
    return F.greatest(F.expm1(F.col(col) if isinstance(col, str) else col), F.lit(0.0))


def centre_unit_rows(df: DataFrame, floor: float = 1e-8) -> DataFrame:
    """Centre and L2-normalise every sample, so that a dot product is a correlation."""
    centred = df.withColumn("value", F.col("value") - F.avg("value").over(_sample()))
    scale = F.greatest(F.sqrt(F.sum(F.col("value") * F.col("value")).over(_sample())), F.lit(floor))
    return centred.withColumn("value", F.col("value") / scale)


def unit_rows(df: DataFrame, floor: float = 1e-12) -> DataFrame:
    scale = F.greatest(F.sqrt(F.sum(F.col("value") * F.col("value")).over(_sample())), F.lit(floor))
    return df.withColumn("value", F.col("value") / scale)


def zscore(df: DataFrame, by: Sequence[str] = ("feature",), fit: Column | None = None, zero_variance: str = "zero") -> DataFrame:
    """Column z-score, optionally fitted on the rows matching ``fit`` only.

    ``zero_variance`` decides what happens when the standard deviation is below
    1e-6: "zero" gives 0, "one" divides by 1.
    """
    v = F.col("value") if fit is None else F.when(fit, F.col("value"))
    stats = df.filter(finite("value")).groupBy(*by).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    joined = same_key(df, stats, list(by))
    scaled = (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 1e-6, F.col("_s"))
    low = F.lit(0.0) if zero_variance == "zero" else F.col("value") - F.col("_m")
    out = F.when(F.col("_s") > 1e-6, scaled).when(F.col("value").isNotNull(), low)
    return joined.withColumn("value", out).drop("_m", "_s")


def centre_within(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Subtract the group's mean of each feature."""
    keys = [*groups, "feature"]
    means = df.groupBy(*keys).agg(F.avg("value").alias("_m"))
    return same_key(df, means, keys).withColumn("value", F.col("value") - F.col("_m")).drop("_m")


def rank_within_sample(df: DataFrame) -> DataFrame:
    """Position of each feature inside its sample, scaled to [0, 1]; ties keep feature order."""
    w = Window.partitionBy("sample_id").orderBy("value", "feature")
    n = F.count(F.lit(1)).over(_sample())
    return df.withColumn("value", (F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1)).cast("double"))


def spearman_columns(df: DataFrame) -> DataFrame:
    """Per feature: average rank over samples, centred and L2-normalised (dot = Spearman).

    Mean and spread of the ranks follow from the counts of distinct values, so
    the rows are only read to look their value up.
    """
    table = cumulative(df, ["feature"], "value")
    mean = (F.col("n_total") + 1) / F.lit(2.0)
    ranked = table.select("feature", "value", "n", (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0) - mean).alias("_r"))
    spread = ranked.groupBy("feature").agg(F.sqrt(F.sum(F.col("n") * F.col("_r") * F.col("_r"))).alias("_s"))
    scaled = same_key(ranked, spread, ["feature"]).select(
        "feature", "value", F.coalesce(F.col("_r") / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0)).alias("_z"))
    out = same_key(df, scaled, ["feature", "value"]).withColumn("value", F.col("_z"))
    return out.select(*df.columns)


def fill_median(df: DataFrame, default: float | None = None) -> DataFrame:
    """Missing values become the feature's exact median, or ``default`` when there is none."""
    med = exact_percentile(df, ["feature"], "value", {"_med": 0.5})
    joined = same_key(df, med, ["feature"], "left")
    v = F.when(finite("value"), F.col("value"))
    filled = F.coalesce(v, F.col("_med"), *( [F.lit(default)] if default is not None else []))
    return joined.withColumn("value", filled).drop("_med")


def softmax(df: DataFrame, groups: Sequence[str], score: str, temperature: float = 0.08, out: str = "weight") -> DataFrame:
    """Temperature softmax over the few candidate labels of each group."""
    w = Window.partitionBy(*groups)
    shifted = (F.col(score) - F.max(score).over(w)) / F.lit(temperature)
    e = F.exp(F.least(F.greatest(shifted, F.lit(-50.0)), F.lit(50.0)))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.greatest(F.sum("_e").over(w), F.lit(1e-12))).drop("_e")


def resolve_lengths(features: DataFrame, own: DataFrame, annotation: DataFrame, other: DataFrame) -> DataFrame:
    """Feature lengths with a fallback chain: own species, own annotation, and for the other species its own or ours.

    Inputs hold (feature, length). Features without any length are dropped.
    """
    a = own.select("feature", F.col("length").alias("_own"))
    b = annotation.select("feature", F.col("length").alias("_ann"))
    c = other.select("feature", F.col("length").alias("_oth"))
    j = features.join(a, "feature", "left").join(b, "feature", "left").join(c, "feature", "left")

    def positive(name: str) -> Column:
        return F.when(F.col(name) > 0, F.col(name))

    human = F.coalesce(positive("_own"), positive("_ann"))
    return (
        j.withColumn("human_length", human)
        .withColumn("mouse_length", F.coalesce(positive("_oth"), F.col("human_length")))
        .withColumn("human_source", F.when(positive("_own").isNotNull(), "exon_union").otherwise("annotation_fallback"))
        .withColumn("mouse_source", F.when(positive("_oth").isNotNull(), "exon_union").otherwise("human_length_fallback"))
        .filter(F.col("human_length").isNotNull() & F.col("mouse_length").isNotNull())
        .drop("_own", "_ann", "_oth")
    )
