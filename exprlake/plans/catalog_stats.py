"""Queries for statistics."""

from pyspark.sql import functions as F

from exprlake.operators import stats as st
from exprlake.plans.catalog_metrics import auc_cte
from exprlake.plans.catalog_ranking import EFFECTS, effects
from exprlake.plans.inputs import (
    LOGCPM, LOGIT, MEASUREMENT, PREDICTIONS, SAMPLE_META, R, counts, log_cpm, newton_line, predictions, rounded, sample_meta, table,
)
from exprlake.plans.registry import query

# 1 - erf by its positive series, enough for |z| up to 8
ERFC = ("(CASE WHEN abs({z}) < 1e-12 THEN 1.0::DOUBLE WHEN abs({z}) > 8 THEN 0 ELSE 1 - 2 / sqrt(pi()) * exp(-({z}) * ({z}) / 2) * "
        "list_sum([exp((2 * k + 1) * ln(abs({z}) / sqrt(2::DOUBLE)) + 2 * k * ln(2::DOUBLE) + lgamma(k + 1) - lgamma(2 * k + 2)) FOR k IN range(0, 250)]) END)")


def P(z: str) -> str:
    return ERFC.format(z=z)


HEDGES = LOGCPM + ", " + SAMPLE_META + """,
h0 AS (SELECT feature, cohort, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0, avg(value) FILTER (WHERE label = 1) AS mean1, avg(value) FILTER (WHERE label = 0) AS mean0,
  var_samp(value) FILTER (WHERE label = 1) AS v1, var_samp(value) FILTER (WHERE label = 0) AS v0 FROM logcpm l JOIN sample_meta s ON l.sample_id = s.sample_id GROUP BY 1, 2),
h1 AS (SELECT *, ((n1 - 1) * v1 + (n0 - 1) * v0) / greatest(n1 + n0 - 2, 1) AS pv FROM h0 WHERE n1 > 1 AND n0 > 1),
h2 AS (SELECT *, CASE WHEN pv > 0 THEN (1 - 3 / greatest(4.0::DOUBLE * (n1 + n0) - 9, 1)) * (mean1 - mean0) / sqrt(pv) ELSE 0 END AS hedges_g FROM h1),
hedges AS (SELECT feature, cohort, n1, n0, mean1, mean0, hedges_g, (n1 + n0) / (n1 * n0)::DOUBLE + CASE WHEN pv > 0 THEN hedges_g * hedges_g / greatest(2.0::DOUBLE * (n1 + n0 - 2), 1) ELSE 0 END AS variance FROM h2)"""


def cohort_values(spark, d):
    return log_cpm(spark, d).join(sample_meta(spark, d).select("sample_id", "cohort", "label"), "sample_id")


@query("sta01_hedges_g", f"""WITH {HEDGES} SELECT feature, cohort, n1, n0, {R('mean1')} AS mean1, {R('mean0')} AS mean0, {R('hedges_g')} AS hedges_g, {R('variance')} AS variance FROM hedges""")
def sta01(spark, d):
    return rounded(st.hedges_g(cohort_values(spark, d), ["feature", "cohort"], "label", "value"), "mean1", "mean0", "hedges_g", "variance")


META = HEDGES + f""",
a1 AS (SELECT feature, count(*) AS k, sum(1 / variance) AS w, sum(1 / (variance * variance)) AS ww, sum(hedges_g / variance) / sum(1 / variance) AS fm FROM hedges GROUP BY 1),
a2 AS (SELECT h.feature, k, w, ww, sum((hedges_g - fm) * (hedges_g - fm) / variance) AS q FROM hedges h JOIN a1 ON h.feature = a1.feature GROUP BY 1, 2, 3, 4),
a3 AS (SELECT *, CASE WHEN w - ww / w > 0 THEN greatest((q - (k - 1)) / (w - ww / w), 0) ELSE 0 END AS tau, CASE WHEN q > 0 THEN greatest((q - (k - 1)) / q, 0) ELSE 0 END AS i2 FROM a2),
a4 AS (SELECT h.feature, k, tau, i2, sum(hedges_g / (variance + tau)) / sum(1 / (variance + tau)) AS est, sqrt(1 / sum(1 / (variance + tau))) AS se, count(*) FILTER (WHERE hedges_g > 0) AS up, count(*) FILTER (WHERE hedges_g < 0) AS down
  FROM hedges h JOIN a3 ON h.feature = a3.feature GROUP BY 1, 2, 3, 4),
meta AS (SELECT feature, k AS cohorts, tau AS tau_squared, i2 AS i_squared, est AS estimate, se, CASE WHEN est > 0 THEN up ELSE down END AS concordant, est - 1.96 * se AS ci_low, est + 1.96 * se AS ci_high, {P('est / se')} AS p_value FROM a4)"""
META_COLS = ["tau_squared", "i_squared", "estimate", "se", "ci_low", "ci_high", "p_value"]


@query("sta02_random_effects", f"""WITH {META} SELECT feature, cohorts, concordant, {', '.join(f'{R(c)} AS {c}' for c in META_COLS)} FROM meta""")
def sta02(spark, d):
    h = st.hedges_g(cohort_values(spark, d), ["feature", "cohort"], "label", "value")
    return rounded(st.random_effects(h, ["feature"]), *META_COLS)


MWU = MEASUREMENT + ", " + SAMPLE_META + f""",
v AS (SELECT feature, cohort, label, value FROM measurement m JOIN sample_meta s ON m.sample_id = s.sample_id),
b AS (SELECT feature, cohort, value, count(*)::DOUBLE AS t, sum(label) AS y FROM v GROUP BY 1, 2, 3),
c AS (SELECT *, sum(t) OVER (PARTITION BY feature, cohort ORDER BY value) - t AS tb FROM b),
u0 AS (SELECT feature, cohort, sum(y)::DOUBLE AS n1, sum(t) - sum(y) AS n0, sum(t) AS n, sum(y * (tb + (t + 1) / 2)) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE AS u, sum(t * t * t - t) AS ties FROM c GROUP BY 1, 2),
u1 AS (SELECT *, greatest((greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / nullif(sqrt(n1 * n0 / 12 * ((n + 1) - ties / greatest(n * (n - 1), 1))), 0), 0) AS z FROM u0 WHERE n1 > 0 AND n0 > 0),
few AS (SELECT *, least(n1, n0)::INTEGER AS k, least(u, n1 * n0 - u) AS low FROM u1 WHERE least(n1, n0) <= 8 AND ties = 0),
subsets AS (SELECT 0 AS j, 0 AS k, 0 AS s, 1::DOUBLE AS ways UNION ALL
  SELECT j + 1, kk, ss, sum(ways) FROM (SELECT j, k AS kk, s AS ss, ways FROM subsets UNION ALL SELECT j, k + 1, s + j + 1, ways FROM subsets WHERE k < 8)
  WHERE j < (SELECT coalesce(max(n), 0) FROM few) GROUP BY 1, 2, 3),
exact AS (SELECT feature, cohort, least(1, 2 * sum(ways) FILTER (WHERE s - subsets.k * (subsets.k + 1) / 2 <= low) / sum(ways)) AS p
  FROM few JOIN subsets ON subsets.j = few.n AND subsets.k = few.k GROUP BY 1, 2),
mwu AS (SELECT u1.feature, u1.cohort, n1::BIGINT AS n1, n0::BIGINT AS n0, u, u / (n1 * n0) AS auc, coalesce(exact.p, {P('z')}, 1) AS p_value
  FROM u1 LEFT JOIN exact ON u1.feature = exact.feature AND u1.cohort = exact.cohort)"""


def mwu(spark, d):
    from exprlake.plans.inputs import measurement

    v = measurement(spark, d).join(sample_meta(spark, d).select("sample_id", "cohort", "label"), "sample_id")
    return st.mann_whitney(v, ["feature", "cohort"], "label", "value")


@query("sta03_mann_whitney", f"""WITH RECURSIVE {MWU} SELECT feature, cohort, n1, n0, u, {R('auc')} AS auc, {R('p_value')} AS p_value FROM mwu""")
def sta03(spark, d):
    return rounded(mwu(spark, d), "auc", "p_value")


@query("sta04_benjamini_hochberg", f"""WITH RECURSIVE {MWU}, r AS (SELECT *, p_value * count(*) OVER (PARTITION BY cohort) / row_number() OVER (PARTITION BY cohort ORDER BY p_value) AS c, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value) AS g FROM mwu)
SELECT feature, cohort, {R('p_value')} AS p_value, {R('least(min(c) OVER (PARTITION BY cohort ORDER BY p_value DESC), 1)')} AS q_within, {R('least(min(g) OVER (ORDER BY p_value DESC), 1)')} AS q_global FROM r""")
def sta04(spark, d):
    q = st.benjamini_hochberg(mwu(spark, d), ["cohort"], "p_value", "q_within")
    q = st.benjamini_hochberg(q, [], "p_value", "q_global")
    return rounded(q.select("feature", "cohort", "p_value", "q_within", "q_global"), "p_value", "q_within", "q_global")


#: Replicates of an interval, of paired deltas, and of their average over cohorts.
BOOT, PAIRED, MACRO = 1000, 3000, 2000


def draws(source, strata, replicates, key="doc_id"):
    """Multinomial resampling counts: place hash mod n inside each stratum, for every replicate."""
    g = ", ".join(strata)
    cat = " || ':' || ".join(f"CAST({s} AS VARCHAR)" for s in strata)
    same = " AND ".join(f"a.{s} = b.{s}" for s in strata)
    return f"""pl AS (SELECT {g}, {key}, row_number() OVER (PARTITION BY {g} ORDER BY {key}) AS p, count(*) OVER (PARTITION BY {g}) AS m FROM (SELECT DISTINCT {g}, {key} FROM {source})),
dr AS (SELECT {g}, replicate, ('0x' || substr(md5('11:' || {cat} || ':' || CAST(replicate AS VARCHAR) || ':' || CAST(p AS VARCHAR)), 1, 13))::BIGINT % m + 1 AS p FROM pl, (SELECT unnest(range(1, {replicates + 1})) AS replicate)),
bt AS (SELECT {', '.join('a.' + s for s in strata)}, b.{key}, a.replicate, count(*) AS times FROM dr a JOIN pl b ON {same} AND a.p = b.p GROUP BY ALL)"""


@query("sta05_bootstrap_interval", f"""WITH {PREDICTIONS}, {draws('predictions', ['method'], BOOT)}, x AS (SELECT p.method, label, score, replicate, times FROM predictions p JOIN bt ON p.method = bt.method AND p.doc_id = bt.doc_id),
{auc_cte('m', 'x', ['method', 'replicate'], weight='times')}
SELECT method, {R('quantile_cont(auroc, 0.025)')} AS auroc_ci_low, {R('quantile_cont(auroc, 0.975)')} AS auroc_ci_high, {R('quantile_cont(auprc, 0.025)')} AS auprc_ci_low, {R('quantile_cont(auprc, 0.975)')} AS auprc_ci_high, count(auroc) AS valid FROM m GROUP BY 1""")
def sta05(spark, d):
    reps = st.bootstrap_auc(predictions(spark, d), ["method"], "doc_id", "label", "score", BOOT, 11)
    return rounded(st.percentile_interval(reps, ["method"], ["auroc", "auprc"]), "auroc_ci_low", "auroc_ci_high", "auprc_ci_low", "auprc_ci_high")


def delta_sql(strata, groups):
    g = "".join(f"{c}, " for c in groups)
    on = "".join(f"p.{s} = bt.{s} AND " for s in strata)
    return f"""x AS (SELECT {"".join(f"p.{c}, " for c in groups)}p.method, p.label, score, replicate, times FROM pr p JOIN bt ON {on}p.doc_id = bt.doc_id),
{auc_cte('m', 'x', [*groups, 'method', 'replicate'], weight='times')},
dl AS (SELECT {g}replicate, max(auroc) FILTER (WHERE method = 'length') - max(auroc) FILTER (WHERE method = 'lines') AS auroc, max(auprc) FILTER (WHERE method = 'length') - max(auprc) FILTER (WHERE method = 'lines') AS auprc FROM m GROUP BY {g}replicate)"""


CI = ", ".join(f"{R(f'quantile_cont({m}, {q})')} AS {m}_ci_{n}" for m in ("auroc", "auprc") for n, q in (("low", 0.025), ("high", 0.975)))
PAIR = "pr AS (SELECT *, 1 AS _all FROM predictions WHERE method IN ('length', 'lines'))"


@query("sta06_paired_deltas", f"""WITH {PREDICTIONS}, {PAIR}, {draws('pr', ['_all'], PAIRED)}, {delta_sql(['_all'], [])}
SELECT 'length-lines' AS contrast, {CI}, count(auroc) AS valid FROM dl""")
def sta06(spark, d):
    deltas = st.paired_deltas(predictions(spark, d), [], "doc_id", "method", "label", "score", "length", "lines", PAIRED, 11)
    ci = st.percentile_interval(deltas.withColumn("contrast", F.lit("length-lines")), ["contrast"], ["auroc", "auprc"])
    return rounded(ci, "auroc_ci_low", "auroc_ci_high", "auprc_ci_low", "auprc_ci_high")


@query("sta07_stratified_macro_deltas", f"""WITH {PREDICTIONS}, {PAIR}, {draws('pr', ['cohort', 'label'], MACRO)}, {delta_sql(['cohort', 'label'], ['cohort'])},
mac AS (SELECT replicate, avg(auroc) AS auroc, avg(auprc) AS auprc FROM dl GROUP BY 1)
SELECT 'length-lines' AS contrast, {CI}, count(auroc) AS valid FROM mac""")
def sta07(spark, d):
    deltas = st.paired_deltas(predictions(spark, d), ["cohort"], "doc_id", "method", "label", "score", "length", "lines", MACRO, 11, ["label"])
    macro = st.macro_deltas(deltas.withColumn("contrast", F.lit("length-lines")), ["contrast"])
    return rounded(st.percentile_interval(macro, ["contrast"], ["auroc", "auprc"]), "auroc_ci_low", "auroc_ci_high", "auprc_ci_low", "auprc_ci_high")


@query("sta08_two_group_effects", f"""WITH {MEASUREMENT}, {SAMPLE_META}, e AS (SELECT cohort, feature, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0,
  floor((avg(value) FILTER (WHERE label = 1) - avg(value) FILTER (WHERE label = 0)) * 1e9 + 0.500123) / 1e9 AS effect FROM measurement m JOIN sample_meta s ON m.sample_id = s.sample_id GROUP BY 1, 2)
SELECT cohort, feature, n1, n0, {R('effect')} AS effect, rank() OVER (PARTITION BY cohort ORDER BY abs(effect) DESC) AS abs_rank FROM e WHERE n1 >= 20 AND n0 >= 20""")
def sta08(spark, d):
    from exprlake.functions.columns import fixed
    from exprlake.plans.inputs import measurement

    v = measurement(spark, d).join(sample_meta(spark, d).select("sample_id", "cohort", "label"), "sample_id")
    e = st.two_group_effects(v, ["cohort", "feature"], F.col("label") == 1, "value").withColumn("effect", fixed("effect", 9))
    return rounded(st.effect_ranks(e, ["cohort"], "effect", "abs_rank"), "effect")


@query("sta09_normal_p", f"""SELECT c_custkey AS sample_id, {R(P('(c_acctbal / 2000)'))} AS p_value FROM customer""")
def sta09(spark, d):
    return rounded(table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), st.normal_p(F.col("c_acctbal") / 2000).alias("p_value")), "p_value")


@query("sta10_recalibrate", f"""WITH RECURSIVE {PREDICTIONS}, {newton_line("cohort <> 'en'", False)} SELECT p.method, doc_id, label, {R('score')} AS score, {R('a')} AS "offset", {R(f'1 / (1 + exp(-({LOGIT} + a)))')} AS calibrated
FROM predictions p JOIN line ON p.method = line.method WHERE i = 25 AND cohort = 'en'""")
def sta10(spark, d):
    p = predictions(spark, d)
    test = p.filter("cohort = 'en'")
    out = st.recalibrate(p.filter("cohort <> 'en'"), test, ["method"], "label", "score")
    return rounded(out.select("method", "doc_id", "label", "score", "offset", "calibrated"), "score", "offset", "calibrated")
