"""Queries for evaluation metrics."""

import math

from pyspark.sql import functions as F

from exprlake.functions.columns import fixed
from exprlake.operators import metrics as mt
from exprlake.plans.catalog_ranking import EFFECTS
from exprlake.plans.inputs import (
    LOGCPM, MEASUREMENT, PREDICTIONS, SAMPLE_META, SCORES, VECTORS, R, counts, log_cpm, predictions, rounded,
    newton_line, sample_meta, scores, table, vectors,
)
from exprlake.plans.registry import query


def auc_cte(name, source, groups, label="label", score="score", weight="1"):
    """Rank-form AUROC and step-form average precision as plain SQL."""
    g = ", ".join(groups)
    pg = f"PARTITION BY {g}" if groups else ""
    sel = f"{g}, " if groups else ""
    by = f"GROUP BY {g}" if groups else ""
    return f"""{name}_t AS (SELECT {sel}{score} AS s, sum({weight}) AS n, sum({weight} * {label}) AS y FROM {source} WHERE {label} IS NOT NULL AND {score} IS NOT NULL GROUP BY {sel}{score}),
{name}_c AS (SELECT *, sum(n) OVER w - n AS nb, sum(y) OVER w - y AS yb, sum(n) OVER p AS nt, sum(y) OVER p AS yt FROM {name}_t WINDOW w AS ({pg} ORDER BY s), p AS ({pg})),
{name}_a AS (SELECT {sel}max(nt)::DOUBLE AS n, max(yt)::DOUBLE AS p, sum(y * (nb + (n + 1) / 2.0::DOUBLE)) AS rs, sum((yt - yb) / (nt - nb)::DOUBLE * y) AS ap FROM {name}_c {by}),
{name} AS (SELECT {sel}n::BIGINT AS n, p::BIGINT AS positives, CASE WHEN p > 0 AND n > p THEN (rs - p * (p + 1) / 2) / (p * (n - p)) END AS auroc,
  CASE WHEN p > 0 AND n > p THEN ap / p END AS auprc FROM {name}_a)"""


@query("met01_auroc", f"""WITH {PREDICTIONS}, {auc_cte('m', 'predictions', ['method', 'cohort'])} SELECT method, cohort, n, positives, {R('auroc')} AS auroc FROM m""")
def met01(spark, d):
    return rounded(mt.auroc_auprc(predictions(spark, d), ["method", "cohort"]).drop("auprc"), "auroc")


EVENT_PRED = """ev AS (SELECT event_type, value AS score, CAST(user_id < 60 AS INTEGER) AS label FROM events)"""


@query("met01_auroc_large_groups", f"""WITH {EVENT_PRED}, {auc_cte('m', 'ev', ['event_type'])} SELECT event_type, n, positives, {R('auroc')} AS auroc, {R('auprc')} AS auprc FROM m""")
def met01b(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("value").alias("score"), (F.col("user_id") < 60).cast("int").alias("label"))
    return rounded(mt.auroc_auprc(e, ["event_type"]), "auroc", "auprc")


@query("met02_auprc", f"""WITH {PREDICTIONS}, {auc_cte('m', 'predictions', ['method', 'cohort'])} SELECT method, cohort, n, positives, {R('auprc')} AS auprc FROM m""")
def met02(spark, d):
    return rounded(mt.auroc_auprc(predictions(spark, d), ["method", "cohort"]).drop("auroc"), "auprc")


@query("agg04_macro_and_pooled", f"""WITH {PREDICTIONS}, {auc_cte('m', 'predictions', ['method', 'cohort'])}, {auc_cte('q', 'predictions', ['method'])}
SELECT q.method, q.n, {R('q.auroc')} AS pooled_auroc, {R('avg(m.auroc)')} AS macro_auroc, count(m.auroc) AS cohorts FROM q JOIN m ON q.method = m.method GROUP BY 1, 2, q.auroc""")
def agg04(spark, d):
    return rounded(mt.macro_and_pooled(predictions(spark, d), ["method"], "cohort", "label", "score"), "pooled_auroc", "macro_auroc")


IMPUTED = LOGCPM + ", " + SAMPLE_META + """,
imputed AS (SELECT l.sample_id, l.feature, cohort, floor(value * 1e9 + 0.500123) / 1e9 AS truth,
  floor((avg(value) OVER (PARTITION BY cohort, l.feature) + avg(value) OVER (PARTITION BY l.sample_id)) / 2 * 1e9 + 0.500123) / 1e9 AS prediction
  FROM logcpm l JOIN sample_meta s ON l.sample_id = s.sample_id)"""


def imputed(spark, d):
    """Truth and a simple prediction: mean of the cohort's feature mean and the sample's own mean."""
    x = log_cpm(spark, d).join(sample_meta(spark, d).select("sample_id", "cohort"), "sample_id")
    by_feature = x.groupBy("cohort", "feature").agg(F.avg("value").alias("f"))
    by_sample = x.groupBy("sample_id").agg(F.avg("value").alias("s"))
    j = x.join(by_feature, ["cohort", "feature"]).join(by_sample, "sample_id")
    return j.select("sample_id", "feature", "cohort", fixed("value", 9).alias("truth"), fixed((F.col("f") + F.col("s")) / 2, 9).alias("prediction"))


@query("met03_macro_pearson", f"""WITH {IMPUTED}, f AS (SELECT cohort, feature, CASE WHEN var_pop(truth) > 0 AND var_pop(prediction) > 0 THEN corr(truth, prediction) END AS c FROM imputed GROUP BY 1, 2), s AS (SELECT cohort, sample_id, CASE WHEN var_pop(truth) > 0 AND var_pop(prediction) > 0 THEN corr(truth, prediction) END AS c FROM imputed GROUP BY 1, 2)
SELECT cohort, 'feature' AS axis, {R('avg(c)')} AS macro_pearson, count(c) AS defined FROM f GROUP BY 1 UNION ALL SELECT cohort, 'sample', {R('avg(c)')}, count(c) FROM s GROUP BY 1""")
def met03(spark, d):
    x = imputed(spark, d)
    a = mt.macro_pearson(x, ["feature"], ["cohort"], "truth", "prediction").withColumn("axis", F.lit("feature"))
    b = mt.macro_pearson(x, ["sample_id"], ["cohort"], "truth", "prediction").withColumn("axis", F.lit("sample"))
    return rounded(a.unionByName(b), "macro_pearson")


@query("met04_global_pearson", f"""WITH {IMPUTED} SELECT cohort, {R('CASE WHEN var_pop(truth) > 0 AND var_pop(prediction) > 0 THEN corr(truth, prediction) END')} AS pearson, count(*) AS n FROM imputed GROUP BY 1""")
def met04(spark, d):
    return rounded(mt.pearson(imputed(spark, d), ["cohort"], "truth", "prediction"), "pearson")


@query("met05_spearman", f"""WITH {IMPUTED}, r AS (SELECT cohort, rank() OVER (PARTITION BY cohort ORDER BY truth) + (count(*) OVER (PARTITION BY cohort, truth) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY cohort ORDER BY prediction) + (count(*) OVER (PARTITION BY cohort, prediction) - 1) / 2.0::DOUBLE AS b FROM imputed)
SELECT cohort, {R('CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END')} AS spearman, count(*) AS n FROM r GROUP BY 1""")
def met05(spark, d):
    return rounded(mt.spearman(imputed(spark, d), ["cohort"], "truth", "prediction"), "spearman")


@query("met06_errors", f"""WITH {IMPUTED} SELECT feature, {R('avg((prediction - truth) * (prediction - truth))')} AS mse, {R('avg(abs(prediction - truth))')} AS mae,
 {R('sqrt(avg((prediction - truth) * (prediction - truth)))')} AS rmse, count(*) AS n FROM imputed GROUP BY 1""")
def met06(spark, d):
    return rounded(mt.errors(imputed(spark, d), ["feature"], "truth", "prediction"), "mse", "mae", "rmse")


@query("met07_binary_classification", f"""WITH {PREDICTIONS}, c AS (SELECT method, cohort, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp,
 count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn FROM predictions GROUP BY 1, 2)
SELECT *, {R('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {R('(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2')} AS balanced_accuracy, {R('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1 FROM c""")
def met07(spark, d):
    return rounded(mt.binary_classification(predictions(spark, d), ["method", "cohort"], "label", "score"), "accuracy", "balanced_accuracy", "f1")


@query("met07_multiclass_classification", f"""WITH x AS (SELECT o_orderpriority AS y, CASE WHEN o_totalprice > 200000 THEN '1-URGENT' WHEN o_totalprice > 100000 THEN '3-MEDIUM' ELSE '5-LOW' END AS p FROM orders),
k AS (SELECT DISTINCT y AS c FROM x UNION SELECT p FROM x), s AS (SELECT c, (SELECT count(*) FROM x WHERE y = c) AS t, (SELECT count(*) FROM x WHERE p = c) AS p, (SELECT count(*) FROM x WHERE y = c AND p = c) AS h FROM k)
SELECT 'all' AS scope, {R('sum(h) / sum(t)')} AS accuracy, {R('avg(h / nullif(t, 0))')} AS balanced_accuracy, {R('avg(2 * h / (t + p))')} AS macro_f1 FROM s""")
def met07b(spark, d):
    v = F.col("o_totalprice")
    x = table(spark, d, "orders").select(F.lit("all").alias("scope"), F.col("o_orderpriority").alias("y"), F.when(v > 200000, "1-URGENT").when(v > 100000, "3-MEDIUM").otherwise("5-LOW").alias("p"))
    return rounded(mt.multiclass_classification(x, ["scope"], "y", "p"), "accuracy", "balanced_accuracy", "macro_f1")


@query("met08_probability_scores", f"""WITH {PREDICTIONS}, c AS (SELECT *, least(greatest(score, 1e-5), 1 - 1e-5) AS q FROM predictions)
SELECT method, cohort, {R('avg((score - label) * (score - label))')} AS brier, {R('avg(-(label * ln(q) + (1 - label) * ln(1 - q)))')} AS log_loss FROM c GROUP BY 1, 2""")
def met08(spark, d):
    return rounded(mt.probability_scores(predictions(spark, d), ["method", "cohort"], "label", "score"), "brier", "log_loss")


@query("met09_precision_at_10", f"""WITH {PREDICTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY method, source ORDER BY score DESC, doc_id) AS k FROM predictions)
SELECT method, source, {R('avg(label)')} AS precision_at_k FROM r WHERE k <= 10 GROUP BY 1, 2""")
def met09(spark, d):
    return rounded(mt.precision_at(predictions(spark, d), ["method", "source"], "label", "score", "doc_id"), "precision_at_k")


@query("met10_calibration", f"""WITH RECURSIVE {PREDICTIONS}, {newton_line('true', True)} SELECT method, {R('a')} AS intercept, {R('b')} AS slope FROM line WHERE i = 25""")
def met10(spark, d):
    from exprlake.operators.stats import fit_logit_line

    return rounded(fit_logit_line(predictions(spark, d), ["method"], "label", "score"), "intercept", "slope")


@query("met11_curve_points", f"""WITH {PREDICTIONS}, {auc_cte('m', 'predictions', ['method'])} SELECT method, {R('s')} AS threshold, {R('((nt - nb) - (yt - yb)) / (nt - yt)::DOUBLE')} AS fpr, {R('(yt - yb) / yt::DOUBLE')} AS tpr FROM m_c""")
def met11(spark, d):
    return rounded(mt.curve_points(predictions(spark, d), ["method"]), "threshold", "fpr", "tpr")


@query("met12_one_vs_rest_auroc", f"""WITH {VECTORS}, x AS (SELECT i AS klass, CAST(label = i AS INTEGER) AS y, vec[i + 1] AS score FROM vectors, (SELECT unnest(range(0, 10)) AS i)), {auc_cte('m', 'x', ['klass'], 'y')}
SELECT {R('avg(auroc)')} AS macro_auroc, count(auroc) AS classes FROM m""")
def met12(spark, d):
    """Component i of the embedding serves as the score of class i."""
    long = vectors(spark, d).select("label", F.posexplode(F.slice("vec", 1, 10)).alias("klass", "score"))
    return rounded(mt.one_vs_rest_auroc(long, [], "label", "klass", "score"), "macro_auroc")


SHUFFLED = """sh AS (SELECT a.method, a.cohort, a.score, b.label AS shuffled FROM
  (SELECT *, row_number() OVER (PARTITION BY method, cohort ORDER BY md5('5a:' || CAST(doc_id AS VARCHAR)), doc_id) AS p FROM predictions) a JOIN
  (SELECT *, row_number() OVER (PARTITION BY method, cohort ORDER BY md5('5b:' || CAST(doc_id AS VARCHAR)), doc_id) AS p FROM predictions) b
  ON a.method = b.method AND a.cohort = b.cohort AND a.p = b.p)"""


@query("met13_shuffled_auroc", f"""WITH {PREDICTIONS}, {SHUFFLED}, {auc_cte('m', 'sh', ['method', 'cohort'], 'shuffled')} SELECT method, cohort, n, positives, {R('auroc')} AS auroc FROM m""")
def met13(spark, d):
    s = mt.shuffled_labels(predictions(spark, d), ["method", "cohort"], "doc_id", "label", 5)
    return rounded(mt.auroc_auprc(s, ["method", "cohort"], "shuffled").drop("auprc"), "auroc")


@query("met14_sign_concordance", f"""WITH {MEASUREMENT}, {SAMPLE_META}, e AS (SELECT cohort, p_partkey AS feature, avg(value) FILTER (WHERE label = 1) - avg(value) FILTER (WHERE label = 0) AS a,
  avg(value) FILTER (WHERE region = 'ASIA') - avg(value) FILTER (WHERE region <> 'ASIA') AS b FROM counts c JOIN sample_meta s ON c.sample_id = s.sample_id GROUP BY 1, 2)
SELECT cohort, {R('avg(CAST(sign(floor(a * 1e9 + 0.5)) = sign(floor(b * 1e9 + 0.5)) AS INTEGER))')} AS direction_concordance, count(*) AS n FROM e WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def met14(spark, d):
    c = counts(spark, d).join(sample_meta(spark, d).select("sample_id", "cohort", "label", "region"), "sample_id")
    def side(cond):
        return F.avg(F.when(cond, F.col("value")))
    e = c.groupBy("cohort", F.col("p_partkey").alias("feature")).agg(
        F.floor((side(F.col("label") == 1) - side(F.col("label") == 0)) * 1e9 + 0.5).alias("a"),
        F.floor((side(F.col("region") == "ASIA") - side(F.col("region") != "ASIA")) * 1e9 + 0.5).alias("b"))
    return rounded(mt.sign_concordance(e.filter("a IS NOT NULL AND b IS NOT NULL"), ["cohort"], "a", "b"), "direction_concordance")


@query("met17_eta_squared", f"""WITH {VECTORS}, x AS (SELECT label, unnest(vec) AS v, unnest(range(0, 64)) AS pos FROM vectors),
g AS (SELECT pos, label, count(*) AS n, avg(v) AS m FROM x GROUP BY 1, 2), t AS (SELECT pos, avg(v) AS mm, var_pop(v) * count(*) AS ss FROM x GROUP BY 1)
SELECT {R('b')} AS "between", {R('s')} AS total, {R('b / s')} AS eta_squared FROM (SELECT sum(n * (m - mm) * (m - mm)) AS b FROM g JOIN t ON g.pos = t.pos), (SELECT sum(ss) AS s FROM t)""")
def met17(spark, d):
    long = vectors(spark, d).select("label", F.posexplode("vec").alias("feature", "v")).withColumn("value", F.col("v").cast("double"))
    return rounded(mt.eta_squared(long, "label"), "between", "total", "eta_squared")


LIMIT = 10.5


@query("met18_expressed_auc", f"""WITH {IMPUTED}, x AS (SELECT feature, CAST(truth >= {LIMIT} AS INTEGER) AS y, prediction FROM imputed), {auc_cte('m', 'x', ['feature'], 'y', 'prediction')}
SELECT feature, n, positives, {R('auroc')} AS auroc, {R('auprc')} AS auprc, {R('positives / n')} AS prevalence FROM m""")
def met18(spark, d):
    return rounded(mt.expressed_auc(imputed(spark, d), ["feature"], "truth", "prediction", LIMIT), "auroc", "auprc", "prevalence")


@query("met18_imputation_summary", f"""WITH {IMPUTED}, x AS (SELECT cohort, feature, CAST(truth >= {LIMIT} AS INTEGER) AS y, prediction FROM imputed), {auc_cte('m', 'x', ['cohort', 'feature'], 'y', 'prediction')},
f AS (SELECT cohort, feature, CASE WHEN var_pop(truth) > 0 AND var_pop(prediction) > 0 THEN corr(truth, prediction) END AS c FROM imputed GROUP BY 1, 2), s AS (SELECT cohort, sample_id, CASE WHEN var_pop(truth) > 0 AND var_pop(prediction) > 0 THEN corr(truth, prediction) END AS c FROM imputed GROUP BY 1, 2),
r AS (SELECT cohort, rank() OVER (PARTITION BY cohort ORDER BY truth) + (count(*) OVER (PARTITION BY cohort, truth) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY cohort ORDER BY prediction) + (count(*) OVER (PARTITION BY cohort, prediction) - 1) / 2.0::DOUBLE AS b FROM imputed)
SELECT i.cohort, {R('avg((prediction - truth) * (prediction - truth))')} AS mse, {R('avg(abs(prediction - truth))')} AS mae, {R('sqrt(avg((prediction - truth) * (prediction - truth)))')} AS rmse, count(*) AS n,
 {R('CASE WHEN var_pop(truth) > 0 AND var_pop(prediction) > 0 THEN corr(truth, prediction) END')} AS pcc_global, (SELECT {R('CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END')} FROM r WHERE r.cohort = i.cohort) AS spearman_global,
 (SELECT {R('avg(c)')} FROM f WHERE f.cohort = i.cohort) AS pcc_feature_macro, (SELECT {R('avg(c)')} FROM s WHERE s.cohort = i.cohort) AS pcc_sample_macro,
 (SELECT {R('avg(auroc)')} FROM m WHERE m.cohort = i.cohort) AS auroc_macro, (SELECT {R('avg(auprc)')} FROM m WHERE m.cohort = i.cohort) AS auprc_macro, (SELECT count(auroc) FROM m WHERE m.cohort = i.cohort) AS auc_eligible
FROM imputed i GROUP BY 1""")
def met18b(spark, d):
    out = mt.imputation_summary(imputed(spark, d), ["cohort"], threshold=LIMIT)
    return rounded(out, "mse", "mae", "rmse", "pcc_global", "spearman_global", "pcc_feature_macro", "pcc_sample_macro", "auroc_macro", "auprc_macro")


@query("met20_score_correlations", f"""WITH {SCORES} SELECT a.model AS model_a, b.model AS model_b, {R('CASE WHEN var_pop(a.auroc) > 0 AND var_pop(b.auroc) > 0 THEN corr(a.auroc, b.auroc) END')} AS correlation FROM scores a JOIN scores b ON a.scope = b.scope AND a.term = b.term AND a.model < b.model GROUP BY 1, 2""")
def met20(spark, d):
    s = scores(spark, d)
    models = [r[0] for r in s.select("model").distinct().orderBy("model").collect()]
    return rounded(mt.score_correlations(s, ["scope", "term"], "model", "auroc", models), "correlation")
