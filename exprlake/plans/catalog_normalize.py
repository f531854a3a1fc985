"""Queries for normalisation."""

from pyspark.sql import functions as F

from exprlake.functions.vectors import centred, centred_unit, norm, unit
from exprlake.operators import normalize as nz
from exprlake.plans.inputs import (
    LOGCPM, MEASUREMENT, SAMPLE_META, VECTORS, R, counts, log_cpm, measurement, rounded, sample_meta, table, vectors,
)
from exprlake.plans.registry import query


def with_meta(df, spark, d, *cols):
    return df.join(sample_meta(spark, d).select("sample_id", *cols), "sample_id")


@query("nrm01_log1p_tpm", f"""WITH {MEASUREMENT}, {SAMPLE_META},
lens AS (SELECT r_name AS region, p_brand AS feature, avg(p_size) * 100 * (1 + r_regionkey) AS length FROM part, region GROUP BY 1, 2, r_regionkey),
x AS (SELECT m.sample_id, m.feature, s.region, greatest(value, 0) / greatest(length / 1000, 1e-6) AS rate
  FROM measurement m JOIN sample_meta s ON m.sample_id = s.sample_id JOIN lens l ON l.feature = m.feature AND l.region = s.region)
SELECT sample_id, feature, region, {R('ln(1 + rate / greatest(sum(rate) OVER (PARTITION BY sample_id), 1e-12) * 1e6)')} AS value FROM x""")
def nrm01(spark, d):
    by_brand = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg((F.avg("p_size") * 100).alias("l"))
    regions = [("AFRICA", 1), ("AMERICA", 2), ("ASIA", 3), ("EUROPE", 4), ("MIDDLE EAST", 5)]
    # lengths per species: the five regions stand in for species
    spread = F.explode(F.array(*[F.struct(F.lit(r).alias("region"), F.lit(k).alias("k")) for r, k in regions])).alias("z")
    lens = by_brand.select("feature", "l", spread).select("feature", "z.region", (F.col("l") * F.col("z.k")).alias("length"))
    return rounded(nz.log1p_tpm(with_meta(measurement(spark, d), spark, d, "region"), lens, ["feature", "region"]), "value")


@query("nrm02_log1p_cpm", f"""WITH {LOGCPM} SELECT sample_id, feature, {R('value')} AS value FROM logcpm""")
def nrm02(spark, d):
    return rounded(log_cpm(spark, d), "value")


FPKM = "greatest(value - 30, 0)"


@query("nrm03_fpkm_to_log1p_tpm", f"""WITH {MEASUREMENT}, x AS (SELECT sample_id, feature, {FPKM} AS v FROM measurement)
SELECT sample_id, feature, {R('ln(1 + v / nullif(sum(v) OVER (PARTITION BY sample_id), 0) * 1e6)')} AS value,
  sum(v) OVER (PARTITION BY sample_id) <= 0 AS zero_total FROM x""")
def nrm03(spark, d):
    m = measurement(spark, d).withColumn("value", F.greatest(F.col("value") - 30, F.lit(0.0)))
    bad = nz.zero_total_samples(m).select("sample_id", F.lit(True).alias("zero_total"))
    out = nz.fpkm_to_log1p_tpm(m).join(bad, "sample_id", "left")
    return rounded(out.withColumn("zero_total", F.coalesce("zero_total", F.lit(False))), "value")


@query("nrm04_log1p_expm1", f"""WITH {MEASUREMENT} SELECT sample_id, feature, {R('ln(1 + greatest(value - 20, 0))')} AS logged,
  {R('greatest(exp(value / 100 - 1) - 1, 0)')} AS restored FROM measurement""")
def nrm04(spark, d):
    m = measurement(spark, d)
    return rounded(m.select("sample_id", "feature", nz.log1p_clip(F.col("value") - 20).alias("logged"),
                            nz.expm1_clip(F.col("value") / 100 - 1).alias("restored")), "logged", "restored")


CENTRED = LOGCPM + """,
cen AS (SELECT sample_id, feature, value - avg(value) OVER (PARTITION BY sample_id) AS c FROM logcpm),
centred AS (SELECT sample_id, feature, c / greatest(sqrt(sum(c * c) OVER (PARTITION BY sample_id)), 1e-8) AS value FROM cen)"""


@query("nrm05_centre_unit_rows", f"""WITH {CENTRED} SELECT sample_id, feature, {R('value')} AS value FROM centred""")
def nrm05(spark, d):
    return rounded(nz.centre_unit_rows(log_cpm(spark, d)), "value")


@query("nrm05_centre_unit_packed", f"""WITH {VECTORS}, x AS (SELECT key, vec, list_avg(vec) AS m FROM vectors),
y AS (SELECT key, [v - m for v in vec] AS c FROM x)
SELECT key, {R('sqrt(list_dot_product(c, c))')} AS centred_norm, {R('c[1] / greatest(sqrt(list_dot_product(c, c)), 1e-8)')} AS first_value FROM y""")
def nrm05b(spark, d):
    v = vectors(spark, d)
    c = v.select("key", centred("vec").alias("c"), centred_unit("vec").alias("u"))
    return rounded(c.select("key", norm("c").alias("centred_norm"), F.col("u")[0].alias("first_value")), "centred_norm", "first_value")


@query("nrm06_unit_rows", f"""WITH {VECTORS} SELECT key, {R('vec[1] / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)')} AS first_value,
 {R('vec[64] / greatest(sqrt(list_dot_product(vec, vec)), 1e-12)')} AS last_value FROM vectors""")
def nrm06(spark, d):
    u = vectors(spark, d).select("key", unit("vec").alias("u"))
    return rounded(u.select("key", F.col("u")[0].alias("first_value"), F.col("u")[63].alias("last_value")), "first_value", "last_value")


@query("nrm07_zscore", f"""WITH {LOGCPM}, s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM logcpm GROUP BY 1)
SELECT sample_id, l.feature, {R('CASE WHEN sd > 1e-6 THEN (value - m) / sd ELSE 0 END')} AS value FROM logcpm l JOIN s ON l.feature = s.feature""")
def nrm07(spark, d):
    return rounded(nz.zscore(log_cpm(spark, d)), "value")


@query("nrm08_zscore_fitted_on_subset", f"""WITH {LOGCPM}, {SAMPLE_META}, x AS (
  SELECT l.*, cohort, label FROM logcpm l JOIN sample_meta m ON l.sample_id = m.sample_id),
s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM x WHERE label = 1 GROUP BY 1)
SELECT sample_id, x.feature, cohort, label, {R('(value - m) / CASE WHEN sd > 1e-6 THEN sd ELSE 1 END')} AS value FROM x JOIN s ON x.feature = s.feature""")
def nrm08(spark, d):
    x = with_meta(log_cpm(spark, d), spark, d, "cohort", "label")
    return rounded(nz.zscore(x, fit=F.col("label") == 1, zero_variance="one"), "value")


@query("nrm09_centre_within", f"""WITH {LOGCPM}, {SAMPLE_META}, x AS (SELECT l.*, cohort FROM logcpm l JOIN sample_meta m ON l.sample_id = m.sample_id)
SELECT sample_id, feature, cohort, {R('value - avg(value) OVER (PARTITION BY cohort, feature)')} AS value FROM x""")
def nrm09(spark, d):
    return rounded(nz.centre_within(with_meta(log_cpm(spark, d), spark, d, "cohort"), ["cohort"]), "value")


RANKED = MEASUREMENT + """,
ranked AS (SELECT sample_id, feature, (row_number() OVER (PARTITION BY sample_id ORDER BY value, feature) - 1)
  / greatest(count(*) OVER (PARTITION BY sample_id) - 1, 1)::DOUBLE AS value FROM measurement)"""


@query("nrm10_rank_within_sample", f"""WITH {RANKED} SELECT sample_id, feature, {R('value')} AS value FROM ranked""")
def nrm10(spark, d):
    return rounded(nz.rank_within_sample(measurement(spark, d)), "value")


SPEARCOL = MEASUREMENT + """,
rk AS (SELECT sample_id, feature, rank() OVER (PARTITION BY feature ORDER BY value)
  + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS r FROM measurement),
spearcol AS (SELECT sample_id, feature, coalesce((r - avg(r) OVER w) / nullif(sqrt(var_pop(r) OVER w * count(*) OVER w), 0), 0) AS value
  FROM rk WINDOW w AS (PARTITION BY feature))"""


@query("nrm11_spearman_columns", f"""WITH {SPEARCOL} SELECT sample_id, feature, {R('value')} AS value FROM spearcol""")
def nrm11(spark, d):
    return rounded(nz.spearman_columns(measurement(spark, d)), "value")


@query("nrm12_fill_median", f"""WITH {MEASUREMENT}, x AS (SELECT sample_id, feature, CASE WHEN value > 20 THEN value END AS value FROM measurement)
SELECT sample_id, feature, {R('coalesce(value, quantile_cont(value, 0.5) OVER (PARTITION BY feature))')} AS value FROM x""")
def nrm12(spark, d):
    x = measurement(spark, d).withColumn("value", F.when(F.col("value") > 20, F.col("value")).otherwise(F.lit(float("nan"))))
    return rounded(nz.fill_median(x), "value")


@query("nrm13_softmax", f"""WITH {SAMPLE_META}, s AS (SELECT cohort, region, avg(balance) / 10000 AS score FROM sample_meta GROUP BY 1, 2),
e AS (SELECT *, exp(least(greatest((score - max(score) OVER (PARTITION BY cohort)) / 0.08::DOUBLE, -50), 50)) AS e FROM s)
SELECT cohort, region, {R('score')} AS score, {R('e / greatest(sum(e) OVER (PARTITION BY cohort), 1e-12)')} AS weight FROM e""")
def nrm13(spark, d):
    s = sample_meta(spark, d).groupBy("cohort", "region").agg((F.avg("balance") / 10000).alias("score"))
    return rounded(nz.softmax(s, ["cohort"], "score"), "score", "weight")


@query("nrm14_resolve_lengths", """WITH a AS (SELECT p_partkey AS feature, p_size AS length FROM part WHERE p_size > 20),
b AS (SELECT p_partkey AS feature, p_size * 10 AS length FROM part WHERE p_size > 10), c AS (SELECT p_partkey AS feature, p_size + 1 AS length FROM part WHERE p_size < 30)
SELECT p.p_partkey AS feature, coalesce(a.length, b.length) AS human_length, coalesce(c.length, a.length, b.length) AS mouse_length,
  CASE WHEN a.length IS NOT NULL THEN 'exon_union' ELSE 'annotation_fallback' END AS human_source,
  CASE WHEN c.length IS NOT NULL THEN 'exon_union' ELSE 'human_length_fallback' END AS mouse_source
FROM part p LEFT JOIN a ON a.feature = p.p_partkey LEFT JOIN b ON b.feature = p.p_partkey LEFT JOIN c ON c.feature = p.p_partkey
WHERE coalesce(a.length, b.length) IS NOT NULL""")
def nrm14(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("feature"), "p_size")
    own = p.filter("p_size > 20").select("feature", F.col("p_size").alias("length"))
    ann = p.filter("p_size > 10").select("feature", (F.col("p_size") * 10).alias("length"))
    oth = p.filter("p_size < 30").select("feature", (F.col("p_size") + 1).alias("length"))
    return nz.resolve_lengths(p.select("feature"), own, ann, oth)
