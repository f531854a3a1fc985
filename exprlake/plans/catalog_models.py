"""Queries for splits and model fitting."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from exprlake.operators import align as al
from exprlake.operators import models as mo
from exprlake.operators import splits as sp
from exprlake.operators import vectors as ve
from exprlake.operators.aggregate import mean_and_spread
from exprlake.operators.forest import forest_out_of_fold
from exprlake.operators.joins import pair_vectors
from exprlake.operators.metrics import auroc_auprc, eta_squared, multiclass_classification
from exprlake.plans.inputs import (
    EDGES, MEASUREMENT, PREDICTIONS, SAMPLE_META, SCORES, VECTORS, R, edges, log_cpm, measurement, predictions,
    rounded, sample_meta, scores, table, vector_terms, vectors,
)
from exprlake.plans.registry import query


def h10(expr):
    return f"(('0x' || substr(sha256({expr}), 1, 8))::BIGINT % 10)"


@query("spl01_hash_split", f"""SELECT c_custkey AS sample_id, CASE WHEN {h10("'case-' || CAST(c_nationkey AS VARCHAR)")} < 7 THEN 'discovery' ELSE 'test' END AS split FROM customer""")
def spl01(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.concat(F.lit("case-"), F.col("c_nationkey").cast("string")).alias("case"))
    return sp.hash_split(c, "case").drop("case")


@query("spl02_stratified_kfold", f"""WITH {SAMPLE_META} SELECT sample_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('4:' || CAST(sample_id AS VARCHAR)), sample_id) - 1) % 5 AS INTEGER) AS fold FROM sample_meta""")
def spl02(spark, d):
    return sp.stratified_kfold(sample_meta(spark, d).select("sample_id", "label"), "label", "sample_id", 5, 4)


GROUPK = """gk AS (SELECT group_id, CAST(avg(label) >= 0.5 AS INTEGER) AS st FROM sample_meta GROUP BY 1),
gp AS (SELECT group_id, (row_number() OVER (PARTITION BY st ORDER BY md5('4:' || CAST(group_id AS VARCHAR)), group_id) - 1) % 6 AS t FROM gk),
gf AS (SELECT group_id, CAST(CASE WHEN t < 3 THEN t ELSE 5 - t END AS INTEGER) AS fold FROM gp)"""


@query("spl03_stratified_group_kfold", f"""WITH {SAMPLE_META}, {GROUPK} SELECT sample_id, s.group_id, label, fold FROM sample_meta s JOIN gf ON s.group_id = gf.group_id""")
def spl03(spark, d):
    return sp.stratified_group_kfold(sample_meta(spark, d).select("sample_id", "group_id", "label"), "group_id", "label", 3, 4)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("spl04_leave_one_group_out", f"""WITH {SAMPLE_META}, c AS (SELECT DISTINCT cohort AS c FROM sample_meta),
r AS (SELECT s.sample_id, s.cohort, o.c AS "outer", NULL AS "inner" FROM sample_meta s, c o UNION ALL SELECT s.sample_id, s.cohort, o.c, i.c FROM sample_meta s, c o, c i WHERE i.c <> o.c AND s.cohort <> o.c)
SELECT "outer", "inner", CASE WHEN cohort = "outer" THEN 'test' WHEN cohort = "inner" THEN 'validate' ELSE 'train' END AS role, count(*) AS n, CAST(sum(sample_id) AS BIGINT) AS ids FROM r GROUP BY 1, 2, 3""")
def spl04(spark, d):
    r = sp.leave_one_group_out(sample_meta(spark, d).select("sample_id", "cohort"), "cohort", SEGMENTS)
    return r.groupBy("outer", "inner", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("sample_id").alias("ids"))


@query("spl05_balanced_sample", f"""WITH {SAMPLE_META}, r AS (SELECT sample_id, cohort, row_number() OVER (PARTITION BY cohort ORDER BY md5('4:' || CAST(sample_id AS VARCHAR)), sample_id) AS p FROM sample_meta)
SELECT sample_id, cohort FROM r WHERE p <= (SELECT min(n) FROM (SELECT count(*) AS n FROM r GROUP BY cohort))""")
def spl05(spark, d):
    return sp.balanced_sample(sample_meta(spark, d).select("sample_id", "cohort"), "cohort", "sample_id", 4)


@query("spl06_exact_counts", f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('4:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS p FROM orders)
SELECT o_orderkey, CASE WHEN p <= 900 THEN 'train' ELSE 'validate' END AS split FROM r WHERE p <= 1100""")
def spl06(spark, d):
    return sp.exact_counts(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 4, 900, 200)


@query("spl07_balanced_shards", """WITH s AS (SELECT o_custkey AS shard, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY 1),
k AS (SELECT shard FROM s WHERE a > 0 AND b > 0 AND abs(a - b) <= 1 ORDER BY shard LIMIT 100) SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT shard FROM k)""")
def spl07(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return sp.balanced_shards(o, "o_custkey", "o_orderstatus", ("F", "O"), 1, 100)


@query("spl08_sample_keys", f"""WITH {MEASUREMENT}, k AS (SELECT sample_id FROM (SELECT DISTINCT sample_id FROM measurement) ORDER BY md5('4:' || CAST(sample_id AS VARCHAR)), sample_id LIMIT 64)
SELECT sample_id, feature, value FROM measurement WHERE sample_id IN (SELECT sample_id FROM k)
 AND ('0x' || substr(md5('6:' || CAST(sample_id AS VARCHAR) || ':' || feature), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.4""")
def spl08(spark, d):
    m = measurement(spark, d)
    return sp.sample_cells(m.join(sp.sample_keys(m, "sample_id", 64, 4), "sample_id", "left_semi"), ["sample_id", "feature"], 0.4, 6)


NODES = f"""nodes AS (SELECT key AS node, CASE WHEN {h10('CAST(key AS VARCHAR)')} < 7 THEN 'discovery' ELSE 'test' END AS part, label AS task FROM vectors)"""


def nodes(spark, d):
    return sp.hash_split(vectors(spark, d).select(F.col("key").alias("node"), F.col("label").alias("task")), "node").withColumnRenamed("split", "part")


@query("spl09_endpoint_disjoint", f"""WITH {EDGES}, {VECTORS}, {NODES}, t AS (SELECT e.*, n.task FROM edges e JOIN nodes n ON e.a = n.node)
SELECT t.task, count(*) AS source_edges, CAST(sum(t.label) AS BIGINT) AS source_positives, count(*) FILTER (WHERE x.part = y.part) AS eligible_edges,
 CAST(coalesce(sum(t.label) FILTER (WHERE x.part = y.part), 0) AS BIGINT) AS eligible_positives FROM t JOIN nodes x ON t.a = x.node LEFT JOIN nodes y ON t.b = y.node GROUP BY 1""")
def spl09(spark, d):
    n = nodes(spark, d)
    e = edges(spark, d).join(n.select(F.col("node").alias("a"), "task"), "a")
    return sp.edge_coverage(e, sp.endpoint_disjoint(e, n), ["task"])


@query("spl10_verify_split", f"""WITH {SAMPLE_META}, s AS (SELECT sample_id, CASE WHEN {h10('CAST(sample_id AS VARCHAR)')} < 7 THEN 'discovery' ELSE 'test' END AS split FROM sample_meta WHERE balance > 0)
SELECT 'missing_in_split' AS "check", (SELECT count(*) FROM sample_meta WHERE balance <= 0) AS offending UNION ALL SELECT 'missing_in_metadata', 0 UNION ALL SELECT 'repeated_id', 0
UNION ALL SELECT 'group_crosses_split', (SELECT count(*) FROM (SELECT group_id FROM s JOIN sample_meta USING (sample_id) GROUP BY 1 HAVING count(DISTINCT split) > 1))""")
def spl10(spark, d):
    m = sample_meta(spark, d)
    return sp.verify_split(sp.hash_split(m.filter("balance > 0").select("sample_id"), "sample_id"), m, "sample_id", "group_id")


# models -------------------------------------------------------------------------------------
def packed(spark, d):
    """Customers as packed log-CPM profiles over all brands, with metadata."""
    from exprlake.plans.catalog_align import vocab

    names = [f"Brand#{i}" for i in range(1, 26)]
    v = spark.createDataFrame(list(zip(names, range(25))), "feature string, pos int")
    p = al.pack(log_cpm(spark, d), v, 0.0, names)
    return p.join(sample_meta(spark, d).select("sample_id", "cohort", "label", "group_id"), "sample_id")


@query("ml01_leave_one_cohort_out")
def ml01(spark, d):
    rows = packed(spark, d).select("sample_id", F.col("values").alias("features"), F.array(F.col("label").cast("double")).alias("labels"), F.col("cohort").alias("fold"))
    out = mo.leave_one_cohort_out(rows, "sample_id", top_variance=1000)
    return rounded(out, "probability", "inner_auroc")


@query("ml02_random_forest")
def ml02(spark, d):
    """Out-of-fold probabilities, each row with the importances of the forest that scored it."""
    rows = mo.materialize(sp.stratified_group_kfold(packed(spark, d), "group_id", "label", 5, 4), "folds")
    preds, imps = forest_out_of_fold(rows, "sample_id", "values")
    of_fold = F.array(*[F.array(*[F.lit(v) for v in i]) for i in imps])[F.col("fold")]
    return preds.select("sample_id", "label", "fold", F.col("probabilities")[1].alias("probability"), of_fold.alias("importances"))


@query("ml03_pca_multinomial")
def ml03(spark, d):
    v = vectors(spark, d).withColumn("features", array_to_vector(F.col("vec").cast("array<double>"))).drop("vec")
    rows = mo.materialize(sp.stratified_kfold(v, "label", "key", 3, 4), "folds")
    preds = mo.out_of_fold(rows, mo.scaled_pca_logistic("features", "label", 20, rows=rows.count()), "label", 3, ["key"])
    return preds.select("key", "label", "fold", "prediction", F.array_max("probabilities").alias("confidence"))


@query("ml04_term_probes")
def ml04(spark, d):
    return rounded(mo.term_probes(vectors(spark, d).select("key", "vec"), vector_terms(spark, d)), "auroc", "auprc", "cv_auroc")


@query("ml05_edge_classifier")
def ml05(spark, d):
    kept = sp.endpoint_disjoint(edges(spark, d), nodes(spark, d).drop("task"))
    p = pair_vectors(kept, vectors(spark, d).select("key", "vec"))
    rows = p.select("a", "b", "label", "part", array_to_vector(ve.pair_features(p, "product_absdiff")).alias("features"))
    rows = mo.materialize(rows, "edges")
    train = mo.balanced_weights(rows.filter("part = 'discovery'"), "label")
    from pyspark.ml.functions import vector_to_array

    out = mo.edge_classifier("features", "label").fit(train).transform(rows.filter("part = 'test'"))
    return out.select("a", "b", "label", vector_to_array("probability")[1].alias("score"))


@query("ml06_average_repeats", f"""WITH {PREDICTIONS} SELECT doc_id, label, {R('avg(score)')} AS probability, count(*) AS repeats FROM predictions GROUP BY 1, 2""")
def ml06(spark, d):
    p = predictions(spark, d).withColumnRenamed("score", "probability")
    return rounded(mo.average_repeats(p, ["doc_id", "label"]), "probability")


@query("ml07_importance_spread", f"""WITH {SCORES} SELECT term, model, {R('avg(auroc)')} AS auroc_mean, {R('stddev_samp(auroc)')} AS auroc_std FROM scores GROUP BY 1, 2""")
def ml07(spark, d):
    return rounded(mean_and_spread(scores(spark, d), ["term", "model"], ["auroc"]), "auroc_mean", "auroc_std")


@query("ml08_nuisance_check")
def ml08(spark, d):
    rows = packed(spark, d)
    cohort_id = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("cohort")).cast("int") - 1
    rows = rows.select("sample_id", "cohort", "values", array_to_vector("values").alias("features"), cohort_id.alias("cohort_id"))
    rows = mo.materialize(sp.stratified_kfold(rows, "cohort_id", "sample_id", 3, 4), "folds")
    preds = mo.out_of_fold(rows, mo.scaled_pca_logistic("features", "cohort_id", 20, rows=rows.count()), "cohort_id", 3, ["sample_id"])
    acc = multiclass_classification(preds.withColumn("one", F.lit(1)), ["one"], "cohort_id", "prediction")
    eta = eta_squared(rows.select("cohort", F.posexplode("values").alias("feature", "value")), "cohort")
    sil = ve.silhouette(rows.select(F.col("sample_id").alias("key"), F.col("values").alias("vec"), F.col("cohort").alias("label")))
    return acc.drop("one").withColumns({"eta_squared": eta.select("eta_squared").scalar(), "silhouette": sil.select("silhouette").scalar()})


@query("udf02_top_variance_selector", f"""WITH {VECTORS}, x AS (SELECT unnest(vec) AS v, unnest(range(0, 64)) AS i FROM vectors), s AS (SELECT i FROM x GROUP BY 1 ORDER BY var_pop(v) DESC, i LIMIT 16)
SELECT key, {R('sum(v)')} AS total, count(*)::INTEGER AS width FROM (SELECT key, unnest(vec) AS v, unnest(range(0, 64)) AS i FROM vectors) WHERE i IN (SELECT i FROM s) GROUP BY 1""")
def udf02(spark, d):
    from exprlake.functions.vectors import total

    v = vectors(spark, d)
    out = mo.TopVarianceSelector(inputCol="vec", outputCol="kept", k=16).fit(v).transform(v)
    return rounded(out.select("key", total("kept").alias("total"), F.size("kept").alias("width")), "total")
