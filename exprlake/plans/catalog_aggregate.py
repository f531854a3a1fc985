"""Queries for grouped summaries."""

from pyspark.sql import functions as F

from exprlake.operators import aggregate as ag
from exprlake.operators import align as al
from exprlake.operators.ordering import exact_percentile
from exprlake.operators.ranking import evenly_spaced
from exprlake.plans.inputs import (
    LOGCPM, MEASUREMENT, PREDICTIONS, SAMPLE_META, SCORES, VECTORS, R, counts, log_cpm, measurement, predictions,
    rounded, sample_meta, scores, table, vectors,
)
from exprlake.plans.registry import query


@query("agg01_group_means", f"""WITH {SCORES} SELECT model, scope, {R('avg(auroc)')} AS auroc, {R('avg(auprc)')} AS auprc FROM scores GROUP BY 1, 2""")
def agg01(spark, d):
    return rounded(ag.group_means(scores(spark, d), ["model", "scope"], ["auroc", "auprc"]), "auroc", "auprc").orderBy("scope", F.col("auroc").desc())


@query("agg02_named_aggregates", f"""WITH {SCORES} SELECT model, scope, count(DISTINCT term) AS terms, {R('avg(auroc)')} AS mean_auroc, {R('median(auroc)')} AS median_auroc,
 count(*) AS rows_seen, CAST(sum(n_terms) AS BIGINT) AS total, {R('avg(CAST(auroc > 0.5 AS INTEGER))')} AS rate, {R('avg(auroc) - avg(auprc)')} AS gap FROM scores GROUP BY 1, 2""")
def agg02(spark, d):
    # a (model, scope) group holds one row per term, so an exact median stays small
    spec = {
        "terms": F.count_distinct("term"), "mean_auroc": F.avg("auroc"), "median_auroc": F.median("auroc"), "rows_seen": F.count(F.lit(1)),
        "total": F.sum("n_terms"), "rate": F.avg((F.col("auroc") > 0.5).cast("double")), "gap": F.avg("auroc") - F.avg("auprc"),
    }
    return rounded(ag.named_aggregates(scores(spark, d), ["model", "scope"], spec), "mean_auroc", "median_auroc", "rate", "gap")


@query("agg03_group_size_with_nulls", """SELECT CASE WHEN p_size > 10 THEN p_type END AS project, p_brand AS tissue, count(*) AS samples FROM part GROUP BY 1, 2""")
def agg03(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_size") > 10, F.col("p_type")).alias("project"), F.col("p_brand").alias("tissue"))
    return p.groupBy("project", "tissue").agg(F.count(F.lit(1)).alias("samples"))


@query("agg05_scope_expansion", f"""WITH {SCORES} SELECT model, coalesce(scope, 'all') AS scope, {R('avg(auroc)')} AS auroc, count(*) AS n FROM scores
GROUP BY GROUPING SETS ((model, scope), (model))""")
def agg05(spark, d):
    return rounded(ag.scope_expansion(scores(spark, d), ["model"], "scope", {"auroc": F.avg("auroc"), "n": F.count(F.lit(1))}), "auroc")


@query("agg06_pivot", f"""WITH {SCORES} SELECT term, model, {R("avg(auroc) FILTER (WHERE scope = 'A')")} AS "A", {R("avg(auroc) FILTER (WHERE scope = 'N')")} AS "N",
 {R("avg(auroc) FILTER (WHERE scope = 'R')")} AS "R" FROM scores GROUP BY 1, 2""")
def agg06(spark, d):
    return rounded(ag.pivot(scores(spark, d), ["term", "model"], "scope", ["A", "N", "R"], "auroc", "mean"), "A", "N", "R")


@query("agg07_unpivot_transpose", f"""WITH {SCORES}, l AS (SELECT model, scope, term, 'auroc' AS metric, auroc AS value FROM scores UNION ALL SELECT model, scope, term, 'auprc', auprc FROM scores)
SELECT metric || '/' || term AS "column", {R("max(value) FILTER (WHERE scope = 'A')")} AS "A", {R("max(value) FILTER (WHERE scope = 'R')")} AS "R" FROM l GROUP BY 1""")
def agg07(spark, d):
    long = ag.unpivot(scores(spark, d), ["model", "scope", "term"], ["auroc", "auprc"], "metric", "value")
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    cols = [f"{m}/{t}" for m in ("auroc", "auprc") for t in kinds]
    best = long.groupBy("scope", F.concat_ws("/", "metric", "term").alias("c")).agg(F.max("value").alias("v"))
    wide = best.groupBy("scope").pivot("c", cols).agg(F.first("v"))
    present = table(spark, d, "part").select("p_type").distinct()
    out = ag.transpose(wide.withColumnsRenamed({c: c.replace("/", "_") for c in cols}), "scope", [c.replace("/", "_") for c in cols], ["A", "R"])
    out = out.withColumn("column", F.concat(F.substring_index("column", "_", 1), F.lit("/"), F.substring_index("column", "_", -1)))
    out = out.join(present, F.substring_index("column", "/", -1) == F.col("p_type"), "left_semi")
    return rounded(out, "A", "R")


@query("agg08_top_crosstab", """WITH p AS (SELECT p_name AS r, p_brand AS c, count(*) AS n FROM part GROUP BY 1, 2),
tr AS (SELECT r FROM p GROUP BY 1 ORDER BY sum(n) DESC, r LIMIT 8), tc AS (SELECT c FROM p GROUP BY 1 ORDER BY sum(n) DESC, c LIMIT 6)
SELECT r AS p_name, c AS p_brand, n FROM p WHERE r IN (SELECT r FROM tr) AND c IN (SELECT c FROM tc)""")
def agg08(spark, d):
    return ag.top_crosstab(table(spark, d, "part"), "p_name", "p_brand", 8, 6)


@query("agg08_value_counts", """SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10""")
def agg08b(spark, d):
    return ag.value_counts(table(spark, d, "documents"), "source", 10)


def _profile_sql():
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    one = ("SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS missing, min(CAST({c} AS VARCHAR)) AS example, "
           "CASE WHEN count(DISTINCT {c}) <= 100 THEN count(DISTINCT {c}) END AS distinct_values FROM customer")
    return " UNION ALL ".join(one.format(c=c) for c in cols)


@query("agg09_column_profile", _profile_sql())
def agg09(spark, d):
    return ag.column_profile(table(spark, d, "customer"))


MEANVEC = """x AS (SELECT label, unnest(vec) AS v, unnest(range(0, 64)) AS pos FROM vectors)"""


@query("agg10_mean_vectors", f"""WITH {VECTORS}, {MEANVEC} SELECT label, pos::INTEGER AS pos, {R('avg(v)')} AS value, count(*) AS n FROM x GROUP BY 1, 2""")
def agg10(spark, d):
    m = ag.mean_vectors(vectors(spark, d), ["label"])
    return rounded(m.select("label", "n", F.posexplode("vec").alias("pos", "value")), "value")


@query("agg11_corpus_mean_state", f"""WITH {VECTORS}, {MEANVEC} SELECT pos::INTEGER AS pos, {R('avg(v)')} AS value, count(*) AS "count" FROM x GROUP BY 1""")
def agg11(spark, d):
    """States per label are merged, as an all-reduce of (sum, count) would."""
    parts = ag.vector_state(vectors(spark, d), ["label"]).withColumn("scope", F.lit("corpus"))
    whole = ag.finish_state(ag.merge_states(parts, ["scope"]))
    return rounded(whole.select("count", F.posexplode("vec").alias("pos", "value")), "value")


PICKED = """place AS (SELECT s.sample_id, cohort, row_number() OVER (PARTITION BY cohort ORDER BY s.sample_id) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n
  FROM sample_meta s WHERE s.sample_id IN (SELECT sample_id FROM measurement)),
slot AS (SELECT DISTINCT cohort, CASE WHEN n <= 16 THEN i ELSE CASE WHEN j = 15 THEN n - 1 ELSE floor(j * ((n - 1) / 15.0::DOUBLE)) END END AS i
  FROM place, (SELECT unnest(range(0, 16)) AS j)),
picked AS (SELECT place.sample_id, place.cohort, n AS members FROM place JOIN slot ON place.cohort = slot.cohort AND place.i = slot.i)"""


@query("agg12_group_centroids", f"""WITH {MEASUREMENT}, {SAMPLE_META}, {PICKED},
c AS (SELECT cohort, feature, sum(value) / (SELECT count(*) FROM picked q WHERE q.cohort = p.cohort) AS v FROM measurement m JOIN picked p ON m.sample_id = p.sample_id GROUP BY 1, 2)
SELECT cohort, feature, {R('ln(1 + v * 1e6 / greatest(sum(v) OVER (PARTITION BY cohort), 1.0))')} AS value FROM c""")
def agg12(spark, d):
    m = measurement(spark, d)
    have = sample_meta(spark, d).select("sample_id", "cohort").join(m.select("sample_id").distinct(), "sample_id", "left_semi")
    members = evenly_spaced(have, "cohort", "sample_id", 16).select("cohort", "sample_id")
    return rounded(ag.group_centroids(m, members, "cohort"), "value")


@query("agg13_union_length", """WITH e AS (SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY s, e) AS island FROM m),
i AS (SELECT user_id, event_type, island, max(e) - min(s) + 1 AS len FROM g GROUP BY 1, 2, 3)
SELECT user_id, event_type, CAST(sum(len) AS BIGINT) AS length FROM i GROUP BY 1, 2""")
def agg13(spark, d):
    at = F.floor(F.unix_micros("ts") / F.lit(1e6)) if dict(table(spark, d, "events").dtypes)["ts"] == "timestamp" else F.floor(
        F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    e = table(spark, d, "events").select("user_id", "event_type", at.alias("s"), (at + F.floor(F.col("value") * 60)).alias("e"))
    return ag.union_length(e, ["user_id", "event_type"], "s", "e", 86_400)


@query("agg14_mean_and_spread", f"""WITH {SCORES} SELECT model, {R('avg(auroc)')} AS auroc_mean, {R('stddev_samp(auroc)')} AS auroc_std,
 {R('avg(auprc)')} AS auprc_mean, {R('stddev_samp(auprc)')} AS auprc_std FROM scores GROUP BY 1""")
def agg14(spark, d):
    return rounded(ag.mean_and_spread(scores(spark, d), ["model"], ["auroc", "auprc"]), "auroc_mean", "auroc_std", "auprc_mean", "auprc_std")


@query("agg15_rates", f"""WITH {MEASUREMENT} SELECT feature, {R('avg(CAST(value > 30 AS INTEGER))')} AS detection, {R('avg(CAST(value <= 10 AS INTEGER))')} AS low FROM measurement GROUP BY 1""")
def agg15(spark, d):
    return rounded(ag.rates(measurement(spark, d), ["feature"], {"detection": F.col("value") > 30, "low": F.col("value") <= 10}), "detection", "low")


@query("agg16_exact_percentile", f"""WITH {LOGCPM} SELECT feature, {R('quantile_cont(value, 0.5)')} AS p50, {R('quantile_cont(value, 0.99)')} AS p99, {R('quantile_cont(value, 0.025)')} AS p025
FROM logcpm GROUP BY 1""")
def agg16(spark, d):
    return rounded(exact_percentile(log_cpm(spark, d), ["feature"], "value", {"p50": 0.5, "p99": 0.99, "p025": 0.025}), "p50", "p99", "p025")


@query("agg17_sample_statistics", f"""WITH {MEASUREMENT}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value DESC, feature) AS k FROM measurement)
SELECT sample_id, count(*) FILTER (WHERE value > 0) AS detected, sum(value) AS total, {R('sum(value) FILTER (WHERE k <= 10) / sum(value)')} AS top10_concentration,
 string_agg(feature, ',' ORDER BY k) FILTER (WHERE k <= 8) AS top_features FROM r GROUP BY 1""")
def agg17(spark, d):
    return rounded(ag.sample_statistics(measurement(spark, d)), "top10_concentration")


@query("agg18_feature_totals", f"""WITH {MEASUREMENT}, {SAMPLE_META} SELECT region, p_partkey AS feature, sum(value) AS total, count(*) AS seen FROM counts c JOIN sample_meta s ON c.sample_id = s.sample_id GROUP BY 1, 2""")
def agg18(spark, d):
    c = counts(spark, d).select("sample_id", F.col("p_partkey").alias("feature"), "value")
    return ag.feature_totals(c.join(sample_meta(spark, d).select("sample_id", "region"), "sample_id"), ["region"])


@query("agg19_cohort_table", f"""WITH {MEASUREMENT}, {SAMPLE_META} SELECT cohort, count(DISTINCT s.sample_id) AS samples, count(DISTINCT s.sample_id) FILTER (WHERE label = 1) AS positives,
 count(DISTINCT s.sample_id) FILTER (WHERE label = 0) AS negatives, (SELECT string_agg(DISTINCT region, ',' ORDER BY region) FROM sample_meta z WHERE z.cohort = s.cohort) AS kinds,
 count(DISTINCT p_partkey) AS features FROM sample_meta s LEFT JOIN counts c ON c.sample_id = s.sample_id GROUP BY 1""")
def agg19(spark, d):
    m = counts(spark, d).select("sample_id", F.col("p_partkey").alias("feature"))
    return ag.cohort_table(sample_meta(spark, d), m, "cohort", "label", "region")


@query("agg20_pool_vectors", f"""WITH {VECTORS}, {MEANVEC}, p AS (SELECT label, pos, avg(v) AS a, max(v) AS m, quantile_disc(v, 0.5) AS q FROM x GROUP BY 1, 2)
SELECT label, pos::INTEGER AS pos, {R('a')} AS mean, {R('m')} AS max, {R('q')} AS median, {R('a + m + q')} AS total FROM p""")
def agg20(spark, d):
    return rounded(ag.pool_vectors(vectors(spark, d), ["label"]), "mean", "max", "median", "total")


@query("agg21_masked_mean", f"""WITH {MEASUREMENT}, {SAMPLE_META} SELECT cohort, p_partkey AS feature, {R('coalesce(sum(value) FILTER (WHERE value > 40), 0) / greatest(count(*) FILTER (WHERE value > 40), 1)')} AS mean
FROM counts c JOIN sample_meta s ON c.sample_id = s.sample_id GROUP BY 1, 2""")
def agg21(spark, d):
    c = counts(spark, d).select("sample_id", F.col("p_partkey").alias("feature"), "value").join(sample_meta(spark, d).select("sample_id", "cohort"), "sample_id")
    return rounded(ag.masked_mean(c, ["cohort", "feature"], "value", F.col("value") > 40), "mean")


@query("agg22_metric_averages", f"""WITH {SCORES} SELECT model, scope, {R('avg(auroc)')} AS auroc, {R('avg(auprc)')} AS auprc, count(*) AS terms FROM scores GROUP BY 1, 2""")
def agg22(spark, d):
    return rounded(ag.metric_averages(scores(spark, d), ["model", "scope"], ["auroc", "auprc"]), "auroc", "auprc")
