"""Grouped evaluation metrics.

Rank-based metrics come from the table of distinct scores with prefix sums
(:func:`exprlake.operators.ordering.cumulative`), never from a window over a
whole group. An undefined metric is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprlake.functions.columns import correlation, finite, safe_div
from exprlake.operators.ordering import cumulative, draw_position, same_key, top_k
from exprlake.session import materialize


def ranking_table(df: DataFrame, groups: Sequence[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """Distinct scores per group with (weighted) counts and positives, and their prefix sums."""
    w = F.lit(1) if weight is None else F.col(weight)
    rows = df.filter(F.col(label).isNotNull())
    return cumulative(rows, groups, score, {"cnt": w, "pos": w * F.col(label)})


def auroc_auprc_from(table: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    pos, cnt = F.col("pos"), F.col("cnt")
    rank = F.col("cnt_before") + (cnt + 1) / F.lit(2.0)
    at_least_pos = F.col("pos_total") - F.col("pos_before")
    at_least = F.col("cnt_total") - F.col("cnt_before")
    agg = [
        F.max("cnt_total").alias("n"), F.max("pos_total").alias("positives"),
        F.sum(pos * rank).alias("_rs"), F.sum(safe_div(at_least_pos, at_least) * pos).alias("_ap"),
    ]
    out = table.groupBy(*groups).agg(*agg) if groups else table.agg(*agg)
    p = F.col("positives").cast("double")
    q = F.col("n") - p
    both = (p > 0) & (q > 0)
    return (
        out.withColumn("auroc", F.when(both, (F.col("_rs") - p * (p + 1) / 2.0) / F.nullif(p * q, F.lit(0.0))))
        .withColumn("auprc", F.when(both, F.col("_ap") / F.nullif(p, F.lit(0.0))))
        .withColumns({"n": F.col("n").cast("bigint"), "positives": F.col("positives").cast("bigint")})
        .drop("_rs", "_ap")
    )


def auroc_auprc(df: DataFrame, groups: Sequence[str], label: str = "label", score: str = "score", weight: str | None = None) -> DataFrame:
    """AUROC (ties averaged) and average precision (step form, ties grouped) per group."""
    return auroc_auprc_from(ranking_table(df, groups, label, score, weight), groups, score)


def macro_and_pooled(df: DataFrame, groups: Sequence[str], cohort: str, label: str, score: str) -> DataFrame:
    """Mean of per-cohort AUROC beside the AUROC of all rows."""
    per = auroc_auprc(df, [*groups, cohort], label, score)
    macro = per.groupBy(*groups).agg(F.avg("auroc").alias("macro_auroc"), F.count("auroc").alias("cohorts"))
    pooled = auroc_auprc(df, groups, label, score).select(*groups, F.col("auroc").alias("pooled_auroc"), "n")
    return same_key(pooled, macro, groups)


def curve_points(df: DataFrame, groups: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """ROC points at every distinct threshold, from the strictest down."""
    t = ranking_table(df, groups, label, score)
    tp = F.col("pos_total") - F.col("pos_before")
    cnt = F.col("cnt_total") - F.col("cnt_before")
    return t.select(
        *groups, F.col(score).alias("threshold"),
        safe_div(cnt - tp, F.col("cnt_total") - F.col("pos_total")).alias("fpr"), safe_div(tp, "pos_total").alias("tpr"),
    )


def pearson(df: DataFrame, groups: Sequence[str], x: str, y: str, out: str = "pearson") -> DataFrame:
    """Pearson correlation over finite pairs; zero variance gives NULL."""
    ok = df.filter(finite(x) & finite(y))
    return ok.groupBy(*groups).agg(correlation(x, y).alias(out), F.count(F.lit(1)).alias("n"))


def macro_pearson(df: DataFrame, by: Sequence[str], outer: Sequence[str], x: str, y: str) -> DataFrame:
    """Mean over features (or samples) of the Pearson correlation, undefined ones left out."""
    per = pearson(df, [*outer, *by], x, y)
    return per.groupBy(*outer).agg(F.avg("pearson").alias("macro_pearson"), F.count("pearson").alias("defined"))


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of tie-averaged ranks.

    Three passes read the pairs, so just these columns are written once.
    """
    ok = materialize(df.filter(finite(x) & finite(y)).select(*groups, x, y), "pairs")
    half = F.lit(2.0)
    tx = cumulative(ok, groups, x).select(*groups, x, (F.col("n_before") + (F.col("n") + 1) / half).alias("_rx"))
    ty = cumulative(ok, groups, y).select(*groups, y, (F.col("n_before") + (F.col("n") + 1) / half).alias("_ry"))
    ranked = same_key(same_key(ok, tx, [*groups, x]), ty, [*groups, y])
    return ranked.groupBy(*groups).agg(correlation("_rx", "_ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def errors(df: DataFrame, groups: Sequence[str], truth: str, prediction: str) -> DataFrame:
    """MSE, MAE and RMSE over finite pairs."""
    ok = df.filter(finite(truth) & finite(prediction))
    e = F.col(prediction) - F.col(truth)
    out = ok.groupBy(*groups).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("rmse", F.sqrt("mse"))


def binary_classification(df: DataFrame, groups: Sequence[str], label: str, probability: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, balanced accuracy and F1 at a threshold."""
    hit = F.col(probability) >= threshold
    y = F.col(label) == 1
    out = df.groupBy(*groups).agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        out.withColumn("accuracy", safe_div(tp + tn, tp + fp + fn + tn))
        .withColumn("balanced_accuracy", (safe_div(tp, tp + fn) + safe_div(tn, tn + fp)) / 2.0)
        .withColumn("f1", F.coalesce(safe_div(2 * tp, 2 * tp + fp + fn), F.lit(0.0)))
    )


def multiclass_classification(df: DataFrame, groups: Sequence[str], label: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 from predicted classes."""
    cells = df.groupBy(*groups, F.col(label).alias("_y"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = cells.select(*groups, F.explode(F.array(
        F.struct(F.col("_y").alias("c"), F.col("_n").alias("t"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0).alias("h")),
        F.struct(F.col("_p").alias("c"), F.lit(0).cast("bigint").alias("t"), F.col("_n").alias("p"), F.lit(0).cast("bigint").alias("h")),
    )).alias("z")).select(*groups, "z.*")
    per = sides.groupBy(*groups, "c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    return per.groupBy(*groups).agg(
        safe_div(F.sum("h"), F.sum("t")).alias("accuracy"), F.avg(safe_div("h", "t")).alias("balanced_accuracy"),
        F.avg(F.coalesce(safe_div(2 * F.col("h"), F.col("t") + F.col("p")), F.lit(0.0))).alias("macro_f1"),
    )


def probability_scores(df: DataFrame, groups: Sequence[str], label: str, probability: str, eps: float = 1e-5) -> DataFrame:
    """Brier score and log loss with clipping."""
    y = F.col(label).cast("double")
    p = F.least(F.greatest(F.col(probability), F.lit(eps)), F.lit(1 - eps))
    loss = -(y * F.ln(p) + (1 - y) * F.ln(1 - p))
    return df.groupBy(*groups).agg(
        F.avg((F.col(probability) - y) * (F.col(probability) - y)).alias("brier"), F.avg(loss).alias("log_loss"))


def precision_at(df: DataFrame, groups: Sequence[str], label: str, score: str, key: str, k: int = 10) -> DataFrame:
    """Share of positives among the k best scores.

    The reference takes this figure from an outside benchmark; the definition
    here is ours: score descending, then key, over min(k, rows).
    """
    top = top_k(df, groups, [F.col(score).desc(), F.col(key)], k)
    return top.groupBy(*groups).agg(F.avg(F.col(label).cast("double")).alias("precision_at_k"))


def one_vs_rest_auroc(df: DataFrame, groups: Sequence[str], truth: str, klass: str, score: str) -> DataFrame:
    """Macro AUROC over classes from long rows (entity, class, score) and the true class."""
    rows = df.withColumn("_y", (F.col(truth) == F.col(klass)).cast("int"))
    per = auroc_auprc(rows, [*groups, klass], "_y", score)
    agg = [F.avg("auroc").alias("macro_auroc"), F.count("auroc").alias("classes")]
    return per.groupBy(*groups).agg(*agg) if groups else per.agg(*agg)


def shuffled_labels(df: DataFrame, groups: Sequence[str], key: str, label: str, seed: int) -> DataFrame:
    """Labels permuted within each group: the row at one random place takes the label at another."""
    places = draw_position(df, groups, [key], f"{seed}a", "_p").drop("_p_n")
    labels = draw_position(df.select(*groups, key, F.col(label).alias("shuffled")), groups, [key], f"{seed}b", "_p")
    return same_key(places, labels.select(*groups, "_p", "shuffled"), [*groups, "_p"]).drop("_p")


def sign_concordance(df: DataFrame, groups: Sequence[str], a: str, b: str) -> DataFrame:
    same = F.signum(F.col(a)) == F.signum(F.col(b))
    return df.groupBy(*groups).agg(F.avg(same.cast("double")).alias("direction_concordance"), F.count(F.lit(1)).alias("n"))


def eta_squared(df: DataFrame, label: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Between-group over total sum of squares, summed over all features."""
    cell = df.groupBy(feature, label).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    per = cell.groupBy(feature).agg(
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("g"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("ss").alias("ss"))
    grand = F.col("s") * F.col("s") / F.col("n")
    out = per.agg(F.sum(F.col("g") - grand).alias("between"), F.sum(F.col("ss") - grand).alias("total"))
    return out.withColumn("eta_squared", safe_div("between", "total"))


def expressed_auc(df: DataFrame, by: Sequence[str], truth: str, prediction: str, threshold: float) -> DataFrame:
    """Per feature: AUROC/AUPRC of "expressed" (truth at or above the threshold), and its prevalence."""
    rows = df.filter(finite(truth) & finite(prediction)).withColumn("_y", (F.col(truth) >= threshold).cast("int"))
    out = auroc_auprc(rows, by, "_y", prediction)
    return out.withColumn("prevalence", safe_div("positives", "n"))


def _pair_correlation(a: str, b: str) -> Column:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return correlation(F.when(both, F.col(a)), F.when(both, F.col(b)))


def score_correlations(df: DataFrame, benchmark: Sequence[str], model: str, score: str, models: Sequence[str]) -> DataFrame:
    """Correlation of every two models' scores over the benchmarks both have.

    Models are few, so they become columns and all pairs come from one aggregate.
    """
    tagged = df.withColumn("_m", F.concat(F.lit("model:"), F.col(model)))
    wide = tagged.groupBy(*benchmark).pivot("_m", [f"model:{m}" for m in models]).agg(F.first(score))
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    cols = [_pair_correlation(f"`model:{a}`", f"`model:{b}`").alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    row = wide.agg(*cols)
    items = F.array(*[
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(items).alias("z")).select("z.*")


def imputation_summary(df: DataFrame, groups: Sequence[str], truth: str = "truth", prediction: str = "prediction", threshold: float = 0.6931471805599453) -> DataFrame:
    """All imputation metrics of a (truth, prediction) table, one row per group.

    The table is read by six metrics, so it is written once to the shared folder.
    """
    df = materialize(df.select(*groups, "sample_id", "feature", truth, prediction), "imputed")
    parts = [
        errors(df, groups, truth, prediction),
        pearson(df, groups, truth, prediction, "pcc_global").drop("n"),
        spearman(df, groups, truth, prediction).drop("n").withColumnRenamed("spearman", "spearman_global"),
        macro_pearson(df, ["feature"], groups, truth, prediction).drop("defined").withColumnRenamed("macro_pearson", "pcc_feature_macro"),
        macro_pearson(df, ["sample_id"], groups, truth, prediction).drop("defined").withColumnRenamed("macro_pearson", "pcc_sample_macro"),
        expressed_auc(df, [*groups, "feature"], truth, prediction, threshold).groupBy(*groups).agg(
            F.avg("auroc").alias("auroc_macro"), F.avg("auprc").alias("auprc_macro"), F.count("auroc").alias("auc_eligible")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = same_key(out, p, groups, "left")
    return out
