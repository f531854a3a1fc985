"""Queries for alignment, masking and completion."""

import numpy as np
from pyspark.sql import functions as F

from exprlake.operators import align as al
from exprlake.plans.inputs import (
    LOGCPM, MEASUREMENT, MEMBERSHIP, SAMPLE_META, R, counts, log_cpm, measurement, membership, rounded, sample_meta, table,
)
from exprlake.plans.registry import query

VOCAB = """vocab AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS pos FROM (
  SELECT DISTINCT p_brand AS feature FROM part WHERE p_size > 3 UNION SELECT 'Brand#X' || CAST(r_regionkey AS VARCHAR) FROM region))"""


def vocab(spark, d):
    """Brands plus five features that were never measured; position by name."""
    from exprlake.operators.ranking import dense_ids

    names = table(spark, d, "part").filter("p_size > 3").select(F.col("p_brand").alias("feature")).unionByName(
        table(spark, d, "region").select(F.concat(F.lit("Brand#X"), F.col("r_regionkey").cast("string")).alias("feature"))).distinct()
    return dense_ids(names, "feature", "pos", start=0)


GRID = "SELECT s.sample_id, v.feature, m.value FROM (SELECT DISTINCT sample_id FROM measurement) s, vocab v LEFT JOIN measurement m ON m.sample_id = s.sample_id AND m.feature = v.feature"


@query("aln01_align", f"""WITH {MEASUREMENT}, {VOCAB}, g AS ({GRID}) SELECT sample_id, feature, coalesce(value, 0) AS value FROM g""")
def aln01(spark, d):
    return al.align(measurement(spark, d), vocab(spark, d))


@query("aln02_align_measured", f"""WITH {MEASUREMENT}, {VOCAB}, g AS ({GRID})
SELECT sample_id, feature, CASE WHEN value > 15 THEN value END AS value, coalesce(value > 15, FALSE) AS measured FROM g""")
def aln02(spark, d):
    m = measurement(spark, d).withColumn("value", F.when(F.col("value") > 15, F.col("value")).otherwise(F.lit(float("nan"))))
    return al.align_measured(m, vocab(spark, d))


@query("aln03_shared_features", """WITH s AS (SELECT DISTINCT p_type AS source, p_size AS feature FROM part),
o AS (SELECT p_size AS feature, min(p_partkey) AS pos FROM part GROUP BY 1)
SELECT s.feature, min(o.pos) AS pos FROM s JOIN o ON s.feature = o.feature GROUP BY 1 HAVING count(DISTINCT source) = 6""")
def aln03(spark, d):
    p = table(spark, d, "part")
    order = p.groupBy(F.col("p_size").alias("feature")).agg(F.min("p_partkey").alias("pos"))
    return al.shared_features(p.select(F.col("p_type").alias("source"), F.col("p_size").alias("feature")), 6, order)


@query("aln04_coverage", f"""WITH {MEMBERSHIP}, v AS (SELECT DISTINCT p_brand AS feature FROM part WHERE p_size > 20)
SELECT term, count(*) AS submitted, count(DISTINCT feature) AS unique_features, count(DISTINCT CASE WHEN feature IN (SELECT feature FROM v) THEN feature END) AS shared,
  (SELECT count(*) FROM v) AS vocabulary, (SELECT count(*) FROM v) - count(DISTINCT CASE WHEN feature IN (SELECT feature FROM v) THEN feature END) AS missing,
  {R('count(DISTINCT CASE WHEN feature IN (SELECT feature FROM v) THEN feature END) / (SELECT count(*) FROM v)::DOUBLE')} AS fraction,
  count(DISTINCT CASE WHEN feature IN (SELECT feature FROM v) THEN feature END) / (SELECT count(*) FROM v)::DOUBLE < 0.5 AS warning
FROM membership GROUP BY term""")
def aln04(spark, d):
    v = table(spark, d, "part").filter("p_size > 20").select(F.col("p_brand").alias("feature")).distinct()
    return rounded(al.coverage(membership(spark, d), v, ["term"]), "fraction")


@query("aln05_mask_features", """SELECT feature, row_number() OVER (ORDER BY md5('7:' || CAST(feature AS VARCHAR))) <= round_even(0.15::DOUBLE * count(*) OVER (), 0) AS masked
FROM (SELECT p_partkey AS feature FROM part)""")
def aln05(spark, d):
    return al.mask_features(table(spark, d, "part").select(F.col("p_partkey").alias("feature")), 7)


@query("aln06_mask_cells", f"""WITH {MEASUREMENT}, {SAMPLE_META}, x AS (SELECT m.sample_id, feature, cohort, value AS truth,
  row_number() OVER (PARTITION BY cohort ORDER BY md5('7:' || CAST(m.sample_id AS VARCHAR) || ':' || feature)) <= round_even(0.15::DOUBLE * count(*) OVER (PARTITION BY cohort), 0) AS masked
  FROM measurement m JOIN sample_meta s ON m.sample_id = s.sample_id)
SELECT sample_id, feature, cohort, truth, masked, CASE WHEN NOT masked THEN truth END AS value FROM x""")
def aln06(spark, d):
    x = measurement(spark, d).join(sample_meta(spark, d).select("sample_id", "cohort"), "sample_id")
    return al.mask_cells(x, ["cohort"], 7)


@query("aln07_mask_per_sample", f"""WITH {MEASUREMENT} SELECT sample_id, feature, value,
 row_number() OVER (PARTITION BY sample_id ORDER BY md5('7:' || CAST(sample_id AS VARCHAR) || ':' || feature)) <= 4 AS masked FROM measurement""")
def aln07(spark, d):
    return al.mask_per_sample(measurement(spark, d), 4, 7)


@query("aln08_complete", f"""WITH {MEASUREMENT}, o AS (SELECT sample_id, feature, CASE WHEN value > 15 THEN value END AS value FROM measurement),
p AS (SELECT feature, avg(value) AS prediction FROM o GROUP BY 1 HAVING feature < 'Brand#5')
SELECT sample_id, o.feature, {R('coalesce(value, CASE WHEN prediction IS NOT NULL THEN greatest(prediction, 0) END)')} AS value, CASE WHEN value IS NOT NULL THEN 1.0::DOUBLE WHEN prediction IS NOT NULL THEN 0.5 ELSE 0 END AS confidence
FROM o LEFT JOIN p ON o.feature = p.feature""")
def aln08(spark, d):
    o = measurement(spark, d).withColumn("value", F.when(F.col("value") > 15, F.col("value")))
    return rounded(al.complete(o, al.predict_feature_mean(o).filter("feature < 'Brand#5'")), "value")


@query("aln09_panel_split", """WITH r AS (SELECT p_partkey AS feature, p_retailprice * p_size AS score FROM part), g AS (SELECT p_partkey AS feature FROM part WHERE p_type = 'PROMO'),
k AS (SELECT feature FROM r WHERE feature NOT IN (SELECT feature FROM g) ORDER BY score DESC, feature LIMIT 50)
SELECT feature, score, feature IN (SELECT feature FROM g) AS excluded, CASE WHEN feature IN (SELECT feature FROM k) THEN 'observed' ELSE 'hidden' END AS role FROM r""")
def aln09(spark, d):
    p = table(spark, d, "part")
    ranking = p.select(F.col("p_partkey").alias("feature"), (F.col("p_retailprice") * F.col("p_size")).alias("score"))
    return al.panel_split(ranking, p.filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("feature")), 50)


@query("aln10_strict_support", f"""WITH {MEASUREMENT}, x AS (SELECT p_type AS model, p_partkey AS f, feature, value FROM counts)
SELECT feature FROM (SELECT feature, model, bool_and(value < 50 OR model <> 'PROMO') AS ok FROM x GROUP BY 1, 2) GROUP BY feature HAVING bool_and(ok) AND count(*) = 6
UNION ALL SELECT 'parts:' || CAST(count(*) AS VARCHAR) FROM (SELECT f FROM (SELECT f, model, bool_and(value < 50) AS ok FROM x GROUP BY 1, 2) GROUP BY f HAVING bool_and(ok) AND count(*) = 1)""")
def aln10(spark, d):
    bad = F.when(F.col("value") < 50, F.col("value")).otherwise(F.lit(float("nan")))
    c = counts(spark, d)
    brands = al.strict_support(c.select("feature", F.col("p_type").alias("model"), F.when(F.col("p_type") == "PROMO", bad).otherwise(F.col("value")).alias("value")), 6)
    parts = al.strict_support(c.select(F.col("p_partkey").alias("feature"), F.col("p_type").alias("model"), bad.alias("value")), 1)
    return brands.unionByName(parts.agg(F.concat(F.lit("parts:"), F.count(F.lit(1)).cast("string")).alias("feature")))


@query("aln11_collapse_features", """SELECT o_custkey AS sample_id, p_brand AS feature, sum(l_quantity) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 5 GROUP BY 1, 2""")
def aln11(spark, d):
    raw = counts(spark, d).select("sample_id", F.col("p_partkey").alias("feature"), "value")
    idmap = table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("dst"))
    return al.collapse_features(raw, idmap)


@query("aln12_collapse_replicates", f"""WITH {MEASUREMENT}, {SAMPLE_META} SELECT substr(name, 1, 16) AS sample_id, feature, {R('avg(value)')} AS value
FROM measurement m JOIN sample_meta s ON m.sample_id = s.sample_id GROUP BY 1, 2""")
def aln12(spark, d):
    x = measurement(spark, d).join(sample_meta(spark, d).select("sample_id", "name"), "sample_id")
    return rounded(al.collapse_replicates(x, F.regexp_extract("name", r"^(Customer#\d{7})", 1)), "value")


@query("aln13_impute", f"""WITH {LOGCPM}, {VOCAB}, g AS (SELECT s.sample_id, v.feature, m.value FROM (SELECT DISTINCT sample_id FROM logcpm) s, vocab v
  LEFT JOIN logcpm m ON m.sample_id = s.sample_id AND m.feature = v.feature)
SELECT sample_id, feature, {R('coalesce(value, avg(value) OVER (PARTITION BY sample_id))')} AS value FROM g""")
def aln13(spark, d):
    """A user's scorer that fills each profile with its own mean."""
    v = vocab(spark, d)
    names = al.vocabulary_names(v)

    def own_mean(frame):
        out = frame.copy()
        out["values"] = [np.where(np.isnan(x), np.nanmean(x), x) for x in (np.array(a, dtype=float) for a in frame["values"])]
        return out

    return rounded(al.unpack(al.impute(al.pack(log_cpm(spark, d), v, None, names), own_mean), v if names is None else names), "value")
