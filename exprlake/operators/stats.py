"""Effect sizes, meta-analysis, tests, multiple testing, bootstrap and recalibration."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from exprlake.functions.columns import draw_key, finite
from exprlake.operators.bootstrap import replicate_auc
from exprlake.operators.ordering import cumulative, exact_percentile, keyed_position, same_key, suffix_min
from exprlake.session import materialize


def _two_sided(z: pd.Series) -> pd.Series:
    return z.abs().map(lambda x: None if x != x else math.erfc(x / math.sqrt(2.0)))


def normal_p(z: Column | str) -> Column:
    """Two-sided p-value of a standard normal statistic (Spark has no erfc)."""
    return F.pandas_udf(_two_sided, DoubleType())(F.col(z) if isinstance(z, str) else z)


def hedges_g(df: DataFrame, groups: Sequence[str], label: str, value: str) -> DataFrame:
    """Hedges' g and its variance per group; a zero pooled variance gives an effect of 0."""
    def arm(k: int, fn) -> Column:
        return fn(F.when(F.col(label) == k, F.col(value)))

    s = df.filter(finite(value)).groupBy(*groups).agg(
        arm(1, F.count).alias("n1"), arm(0, F.count).alias("n0"), arm(1, F.avg).alias("mean1"), arm(0, F.avg).alias("mean0"),
        arm(1, F.var_samp).alias("_v1"), arm(0, F.var_samp).alias("_v0"),
    ).filter((F.col("n1") > 1) & (F.col("n0") > 1))
    n = (F.col("n1") + F.col("n0")).cast("double")
    pooled = ((F.col("n1") - 1) * F.col("_v1") + (F.col("n0") - 1) * F.col("_v0")) / F.greatest(n - 2, F.lit(1.0))
    s = s.withColumn("_pv", pooled)
    base = n / (F.col("n1") * F.col("n0"))
    d = (F.col("mean1") - F.col("mean0")) / F.sqrt(F.when(F.col("_pv") > 0, F.col("_pv")))
    g = F.coalesce((1.0 - 3.0 / F.greatest(4.0 * n - 9.0, F.lit(1.0))) * d, F.lit(0.0))
    s = s.withColumn("hedges_g", g)
    extra = F.when(F.col("_pv") > 0, F.col("hedges_g") * F.col("hedges_g") / F.greatest(2.0 * (n - 2), F.lit(1.0))).otherwise(0.0)
    return s.withColumn("variance", base + extra).drop("_v1", "_v0", "_pv")


def random_effects(df: DataFrame, groups: Sequence[str], effect: str = "hedges_g", variance: str = "variance") -> DataFrame:
    """DerSimonian-Laird meta-analysis per group: estimate, interval, p, tau2, I2, concordant cohorts.

    All sums are taken in grouped passes, so effects are never listed. The effects
    (one row per cohort) are written once, since three passes read them.
    """
    df = materialize(df.select(*groups, effect, variance), "effects")
    w = 1.0 / F.col(variance)
    g = F.col(effect)
    first = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("cohorts"), F.sum(w).alias("_w"), F.sum(w * w).alias("_ww"), F.sum(w * g).alias("_wg"))
    first = first.withColumn("_fixed", F.col("_wg") / F.col("_w"))
    with_mean = same_key(df, first.select(*groups, "cohorts", "_w", "_ww", "_fixed"), groups)
    dev = g - F.col("_fixed")
    q = with_mean.groupBy(*groups, "cohorts", "_w", "_ww").agg(F.sum(w * dev * dev).alias("_q"))
    dof = F.col("cohorts") - 1
    den = F.col("_w") - F.col("_ww") / F.col("_w")
    q = q.withColumn("tau_squared", F.when(den > 0, F.greatest((F.col("_q") - dof) / F.nullif(den, F.lit(0.0)), F.lit(0.0))).otherwise(0.0))
    q = q.withColumn("i_squared", F.when(F.col("_q") > 0, F.greatest((F.col("_q") - dof) / F.nullif(F.col("_q"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0))
    second = same_key(df, q.select(*groups, "cohorts", "tau_squared", "i_squared"), groups)
    wr = 1.0 / (F.col(variance) + F.col("tau_squared"))
    out = second.groupBy(*groups, "cohorts", "tau_squared", "i_squared").agg(
        F.sum(wr).alias("_w"), F.sum(wr * g).alias("_wg"), F.count_if(g > 0).alias("_up"), F.count_if(g < 0).alias("_down"),
        F.count_if(g == 0).alias("_flat"))
    out = out.withColumn("estimate", F.col("_wg") / F.col("_w")).withColumn("se", F.sqrt(1.0 / F.col("_w")))
    agree = F.when(F.col("estimate") > 0, F.col("_up")).when(F.col("estimate") < 0, F.col("_down")).otherwise(F.col("_flat"))
    return (
        out.withColumn("concordant", agree)
        .withColumn("ci_low", F.col("estimate") - 1.96 * F.col("se")).withColumn("ci_high", F.col("estimate") + 1.96 * F.col("se"))
        .withColumn("p_value", normal_p(F.col("estimate") / F.col("se"))).drop("_w", "_wg", "_up", "_down", "_flat")
    )


#: Rows of the smaller arm up to which the distribution of U is worked out exactly.
EXACT_ARM = 8


def exact_u_p(smaller: int, larger: int, u: int) -> float:
    """Two-sided p-value of U without ties: twice the share of arrangements with a U of at most ``u``, the smaller of both U.

    The arrangements with U = k are the partitions of k into at most ``smaller`` parts of at most ``larger``, whose
    generating function is a product of (1 - q^(larger + i)) / (1 - q^i). In whole numbers, so nothing is rounded.
    """
    ways = [1] + [0] * u
    for i in range(1, smaller + 1):
        for k in range(u, larger + i - 1, -1):
            ways[k] -= ways[k - larger - i]
        for k in range(i, u + 1):
            ways[k] += ways[k - i]
    return min(1.0, 2 * sum(ways) / math.comb(smaller + larger, smaller))


def _exact_p(n1: pd.Series, n0: pd.Series, u: pd.Series) -> pd.Series:
    found: dict[tuple[int, int, int], float] = {}
    out = []
    for a, b, x in zip(n1, n0, u, strict=True):
        if min(a, b) > EXACT_ARM:  # both sides of a conditional expression are worked out
            out.append(None)
            continue
        key = int(min(a, b)), int(max(a, b)), round(min(x, a * b - x))
        if key not in found:
            found[key] = exact_u_p(*key)
        out.append(found[key])
    return pd.Series(out, dtype=float)


def mann_whitney(df: DataFrame, groups: Sequence[str], label: str, value: str) -> DataFrame:
    """Two-sided Mann-Whitney U: exact for an arm of at most ``EXACT_ARM`` rows without ties, else the normal approximation
    with tie and continuity correction.
    """
    t = cumulative(df.filter(F.col(label).isNotNull()), groups, value, {"pos": F.col(label)})
    n = F.col("n").cast("double")
    s = t.groupBy(*groups).agg(
        F.max("pos_total").cast("double").alias("n1"), F.max("n_total").cast("double").alias("_n"),
        F.sum(F.col("pos") * (F.col("n_before") + (n + 1) / 2.0)).alias("_r"), F.sum(n * n * n - n).alias("_t"))
    s = s.withColumn("n0", F.col("_n") - F.col("n1")).filter((F.col("n1") > 0) & (F.col("n0") > 0))
    s = s.withColumn("u", F.col("_r") - F.col("n1") * (F.col("n1") + 1) / 2.0)
    pairs = F.col("n1") * F.col("n0")
    sigma = F.sqrt(pairs / 12.0 * ((F.col("_n") + 1) - F.col("_t") / F.greatest(F.col("_n") * (F.col("_n") - 1), F.lit(1.0))))
    z = (F.greatest(F.col("u"), pairs - F.col("u")) - pairs / 2.0 - 0.5) / F.when(sigma > 0, sigma)
    s = s.withColumn("auc", F.col("u") / pairs).withColumn("z", F.greatest(z, F.lit(0.0)))
    small = (F.least("n1", "n0") <= EXACT_ARM) & (F.col("_t") == 0)
    exact = F.pandas_udf(_exact_p, DoubleType())("n1", "n0", "u")
    s = s.withColumn("p_value", F.when(small, exact).otherwise(F.coalesce(normal_p("z"), F.lit(1.0))))
    return s.select(*groups, F.col("n1").cast("bigint").alias("n1"), F.col("n0").cast("bigint").alias("n0"), "u", "auc", "p_value")


def benjamini_hochberg(df: DataFrame, groups: Sequence[str], p: str = "p_value", out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q-values within each group.

    The tests themselves (one row each) are written once, since they are read twice.
    """
    df = materialize(df, "tests")
    keys = list(groups)
    t = cumulative(df, keys, p, keep_bucket=True)
    t = t.withColumn("_c", F.col(p) * F.col("n_total") / (F.col("n_before") + F.col("n")))
    q = suffix_min(t, keys, p, "_c", out).select(*keys, p, F.least(F.col(out), F.lit(1.0)).alias(out))
    return same_key(df, q, [*keys, p], "left")


def two_group_effects(df: DataFrame, groups: Sequence[str], arm: Column, value: str, minimum: int = 20) -> DataFrame:
    """Mean difference between two arms; groups with fewer than ``minimum`` rows in an arm drop out."""
    out = df.groupBy(*groups).agg(
        F.count(F.when(arm, F.col(value))).alias("n1"), F.count(F.when(~arm, F.col(value))).alias("n0"),
        F.avg(F.when(arm, F.col(value))).alias("_m1"), F.avg(F.when(~arm, F.col(value))).alias("_m0"))
    out = out.filter((F.col("n1") >= minimum) & (F.col("n0") >= minimum))
    return out.withColumn("effect", F.col("_m1") - F.col("_m0")).drop("_m1", "_m0")


def effect_ranks(df: DataFrame, groups: Sequence[str], effect: str, out: str) -> DataFrame:
    """Rank of the absolute effect, largest first, ties sharing the smallest rank."""
    rows = df.withColumn("_a", F.abs(F.col(effect)))
    t = cumulative(rows, groups, "_a")
    ranks = t.select(*groups, "_a", (F.col("n_total") - F.col("n_before") - F.col("n") + 1).cast("bigint").alias(out))
    return same_key(rows, ranks, [*groups, "_a"]).drop("_a")


def bootstrap_counts(df: DataFrame, strata: Sequence[str], key: str, replicates: int, seed: int) -> DataFrame:
    """How often each row is drawn in each replicate: (strata, key, replicate, times).

    Draw j of a replicate picks place hash(seed, replicate, j) mod n inside the
    stratum, so the draws depend on no task order and can be repeated anywhere.
    """
    placed = materialize(keyed_position(df.select(*strata, key), strata, key, "_p"), "places")
    draws = placed.select(*strata, F.col("_p").alias("_j"), F.col("_p_n").alias("_n"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    h = draw_key(seed, *[F.col(s) for s in strata], F.col("replicate"), F.col("_j"))
    pick = F.pmod(F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint"), F.col("_n")) + 1
    times = draws.withColumn("_p", pick).groupBy(*strata, "replicate", "_p").agg(F.count(F.lit(1)).alias("times"))
    return same_key(times, placed.select(*strata, key, "_p"), [*strata, "_p"]).drop("_p")


def bootstrap_auc(df: DataFrame, groups: Sequence[str], key: str, label: str, score: str, replicates: int, seed: int, strata: Sequence[str] | None = None) -> DataFrame:
    """AUROC and AUPRC of every replicate; one-class replicates are NULL."""
    strata = groups if strata is None else strata
    df = materialize(df.select(*dict.fromkeys([*groups, *strata, key, label, score])), "scored")
    return replicate_auc(df, groups, key, label, score, replicates, seed, strata)


def percentile_interval(reps: DataFrame, groups: Sequence[str], metrics: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of replicate metrics with the number of valid replicates."""
    reps = materialize(reps, "replicates")
    out = None
    for m in metrics:
        ci = exact_percentile(reps, groups, m, {f"{m}_ci_low": low, f"{m}_ci_high": high})
        out = ci if out is None else same_key(out, ci, groups)
    valid = reps.groupBy(*groups).agg(F.count(metrics[0]).alias("valid"))
    return same_key(out, valid, groups)


def paired_deltas(df: DataFrame, groups: Sequence[str], key: str, method: str, label: str, score: str, a: str, b: str,
                  replicates: int, seed: int, strata: Sequence[str] = ()) -> DataFrame:
    """Per replicate: AUROC and AUPRC of method ``a`` minus ``b`` on the same draws.

    Only entities scored by both methods take part. ``strata`` (label, cohort)
    keeps the resampling inside those classes.
    """
    pair = materialize(df.filter(F.col(method).isin(a, b)), "pairs")
    both = pair.groupBy(*groups, key).agg(F.count_distinct(method).alias("_m")).filter(F.col("_m") == 2).drop("_m")
    pair = pair.join(both, [*groups, key], "left_semi")
    where = [*groups, *[s for s in strata if s not in groups]]
    per = replicate_auc(pair, [*groups, method], key, label, score, replicates, seed, where)

    def side(m: str, c: str) -> Column:
        return F.max(F.when(F.col(method) == m, F.col(c)))

    return per.groupBy(*groups, "replicate").agg(
        (side(a, "auroc") - side(b, "auroc")).alias("auroc"), (side(a, "auprc") - side(b, "auprc")).alias("auprc"))


def macro_deltas(deltas: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean over cohorts of each replicate's deltas."""
    return deltas.groupBy(*groups, "replicate").agg(F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc"))


def logit(p: Column | str, eps: float = 1e-5) -> Column:
    c = F.least(F.greatest(F.col(p) if isinstance(p, str) else p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(c / (1 - c))


def fit_logit_line(df: DataFrame, groups: Sequence[str], label: str, probability: str, slope: bool = True,
                   ridge: float = 1.0, bound: float | None = None, steps: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """Intercept and slope of the logistic regression of a label on the logit of a probability, per group.

    Newton's method: each step is one grouped sum over the distinct logits. The
    tiny parameter table is written between steps, which also cuts lineage.
    ``slope=False`` keeps the slope at one (offset-only recalibration); ``ridge``
    is the penalty on the slope.
    """
    keys = list(groups)
    if not keys:
        df, keys = df.withColumn("_g1", F.lit(1)), ["_g1"]
    x = df.withColumn("_x", logit(probability)).groupBy(*keys, "_x").agg(
        F.sum(F.col(label).cast("double")).alias("_y"), F.count(F.lit(1)).cast("double").alias("_n"))
    x = materialize(x, "logits")
    params = x.select(*keys).distinct().select(*keys, F.lit(0.0).alias("a"), F.lit(0.0 if slope else 1.0).alias("b"))
    for _ in range(steps):
        j = same_key(x, params, keys)
        p = 1.0 / (1.0 + F.exp(-(F.col("a") + F.col("b") * F.col("_x"))))
        r = F.col("_n") * p - F.col("_y")
        w = F.col("_n") * p * (1.0 - p)
        v = F.col("_x")
        s = j.groupBy(*keys, "a", "b").agg(
            F.sum(r).alias("ga"), F.sum(r * v).alias("gb"), F.sum(w).alias("haa"), F.sum(w * v).alias("hab"), F.sum(w * v * v).alias("hbb"))
        if slope:
            s = s.withColumn("gb", F.col("gb") + ridge * F.col("b")).withColumn("hbb", F.col("hbb") + ridge)
            det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
            da = (F.col("hbb") * F.col("ga") - F.col("hab") * F.col("gb")) / F.nullif(det, F.lit(0.0))
            db = (F.col("haa") * F.col("gb") - F.col("hab") * F.col("ga")) / F.nullif(det, F.lit(0.0))
        else:
            da, db = F.col("ga") / F.nullif(F.col("haa"), F.lit(0.0)), F.lit(0.0)
        new_a = F.col("a") - F.greatest(F.least(F.coalesce(da, F.lit(0.0)), F.lit(4.0)), F.lit(-4.0))
        if bound is not None:
            new_a = F.greatest(F.least(new_a, F.lit(bound)), F.lit(-bound))
        new_b = F.col("b") - F.greatest(F.least(F.coalesce(db, F.lit(0.0)), F.lit(4.0)), F.lit(-4.0))
        moved = F.greatest(F.abs(new_a - F.col("a")), F.abs(new_b - F.col("b")))
        step = materialize(s.select(*keys, new_a.alias("na"), new_b.alias("nb"), moved.alias("moved")), "params")
        params = step.select(*keys, F.col("na").alias("a"), F.col("nb").alias("b"))
        if (step.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
    return params.select(*groups, F.col("a").alias("intercept"), F.col("b").alias("slope"))


def recalibrate(out_of_fold: DataFrame, test: DataFrame, groups: Sequence[str], label: str, probability: str) -> DataFrame:
    """Shift test logits by the offset that minimises the log loss of the out-of-fold predictions."""
    off = fit_logit_line(out_of_fold, groups, label, probability, slope=False, bound=6.0).select(*groups, F.col("intercept").alias("offset"))
    j = same_key(test, off, groups)
    return j.withColumn("calibrated", 1.0 / (1.0 + F.exp(-(logit(probability) + F.col("offset")))))
