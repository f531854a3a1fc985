"""Queries for similarity, neighbours and term sets."""

from pyspark.sql import functions as F

from exprlake.functions.vectors import norm, total
from exprlake.operators import joins as jn
from exprlake.operators import normalize as nz
from exprlake.operators import vectors as ve
from exprlake.operators.ordering import top_k
from exprlake.plans.catalog_metrics import auc_cte
from exprlake.plans.catalog_normalize import RANKED, SPEARCOL
from exprlake.plans.inputs import (
    EDGES, LOGCPM, MEASUREMENT, MEMBERSHIP, SAMPLE_META, TWO_MODELS, VECTOR_TERMS, VECTORS, R, edges, log_cpm,
    measurement, membership, rounded, sample_meta, table, two_models, vector_terms, vectors,
)
from exprlake.plans.registry import query

UNIT = VECTORS + """,
un AS (SELECT key, label, [v / greatest(sqrt(list_dot_product(vec, vec)), 1e-12) FOR v IN vec] AS u FROM vectors)"""


def halves(spark, d):
    m = two_models(spark, d)
    return m.filter("model = 'A'").select("key", "label", "vec"), m.filter("model = 'B'").select("key", "label", "vec")


@query("jn13_query_reference_top_k", f"""WITH {TWO_MODELS}, p AS (SELECT a.key, b.key AS neighbour, list_dot_product(a.vec, b.vec) AS s FROM two_models a, two_models b WHERE a.model = 'A' AND b.model = 'B')
SELECT key, neighbour, {R('s')} AS similarity, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, neighbour) AS k FROM p) WHERE k <= 3""")
def jn13(spark, d):
    a, b = halves(spark, d)
    return rounded(ve.exact_knn(a, b, 3, "dot"), "similarity")


@query("vec01_pairwise_summary", f"""WITH {UNIT}, p AS (SELECT list_dot_product(a.u, b.u) AS s FROM un a JOIN un b ON a.key < b.key)
SELECT (SELECT count(*) FROM un) AS n, {R('avg(s)')} AS mean_similarity, {R('median(s)')} AS median_similarity FROM p""")
def vec01(spark, d):
    v = vectors(spark, d)
    out = ve.pairwise_mean(v).withColumn("median_similarity", ve.pairwise_median(v).scalar())
    return rounded(out, "mean_similarity", "median_similarity")


@query("vec02_exact_knn", f"""WITH {UNIT}, p AS (SELECT a.key, b.key AS neighbour, b.label, list_dot_product(a.u, b.u) AS s FROM un a JOIN un b ON a.key <> b.key)
SELECT key, neighbour, label, {R('s')} AS similarity, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, neighbour) AS k FROM p) WHERE k <= 20""")
def vec02(spark, d):
    v = vectors(spark, d)
    near = ve.exact_knn(v, v, 20, exclude_self=True)
    return rounded(near.join(v.select(F.col("key").alias("neighbour"), "label"), "neighbour"), "similarity")


@query("vec05_centroid_scores", f"""WITH {UNIT}, {VECTOR_TERMS}, un2 AS (SELECT key, u, unnest(range(1, 65)) AS i FROM un),
s0 AS (SELECT t.term, i, sum(u[i]) AS v FROM un2 JOIN vector_terms t ON un2.key = t.key GROUP BY 1, 2), s AS (SELECT term, list(v ORDER BY i) AS s FROM s0 GROUP BY 1),
z AS (SELECT term, un.key, u, s, (term, un.key) IN (SELECT (term, key) FROM vector_terms) AS m FROM un, s),
c AS (SELECT term, key, CAST(m AS INTEGER) AS label, floor(list_dot_product(u, CASE WHEN m THEN list_transform(list_zip(s, u), lambda x: x[1] - x[2]) ELSE s END) /
  greatest(sqrt(list_dot_product(CASE WHEN m THEN list_transform(list_zip(s, u), lambda x: x[1] - x[2]) ELSE s END, CASE WHEN m THEN list_transform(list_zip(s, u), lambda x: x[1] - x[2]) ELSE s END)), 1e-12) * 1e9 + 0.500123) / 1e9 AS score FROM z),
{auc_cte('m', 'c', ['term'])} SELECT term, n, positives, {R('auroc')} AS auroc, {R('auprc')} AS auprc FROM m""")
def vec05(spark, d):
    from exprlake.functions.columns import fixed
    from exprlake.operators.metrics import auroc_auprc

    s = ve.centroid_scores(vectors(spark, d), vector_terms(spark, d)).withColumn("score", fixed("score", 9))
    return rounded(auroc_auprc(s, ["term"]), "auroc", "auprc")


@query("vec06_pair_features", f"""WITH {EDGES}, {VECTORS}, p AS (SELECT a, b, x.vec AS va, y.vec AS vb FROM edges JOIN vectors x ON a = x.key JOIN vectors y ON b = y.key)
SELECT a, b, {R('list_sum(va) + list_sum(vb)')} AS concat_total, {R('list_dot_product(va, vb)')} AS product_total,
 {R('list_sum(list_transform(list_zip(va, vb), lambda x: abs(x[1] - x[2])))')} AS absdiff_total, {R('va[1] + vb[1]')} AS first_sum, 128 AS width FROM p""")
def vec06(spark, d):
    p = jn.pair_vectors(edges(spark, d), vectors(spark, d).select("key", "vec"))
    f = {op: ve.pair_features(p, op) for op in ("concat", "product", "sum", "product_absdiff")}
    out = p.select(
        "a", "b", total(f["concat"]).alias("concat_total"), total(f["product"]).alias("product_total"),
        total(F.slice(f["product_absdiff"], 65, 64)).alias("absdiff_total"), f["sum"][0].alias("first_sum"), F.size(f["product_absdiff"]).alias("width"))
    return rounded(out, "concat_total", "product_total", "absdiff_total", "first_sum")


PAIRCOS = f"""paircos AS (SELECT a, b, e.label, x.label AS label_a, floor(list_dot_product(x.vec, y.vec) / (greatest(sqrt(list_dot_product(x.vec, x.vec)), 1e-12) * greatest(sqrt(list_dot_product(y.vec, y.vec)), 1e-12)) * 1e9 + 0.500123) / 1e9 AS score
 FROM edges e JOIN vectors x ON a = x.key JOIN vectors y ON b = y.key)"""


@query("vec07_pair_separation", f"""WITH {EDGES}, {VECTORS}, {PAIRCOS}, {auc_cte('m', 'paircos', ['label_a'])}
SELECT m.label_a, m.n, m.positives, {R('m.auroc')} AS auroc, {R('m.auprc')} AS auprc, {R('avg(score) FILTER (WHERE label = 1)')} AS mean_positive, {R('avg(score) FILTER (WHERE label = 0)')} AS mean_negative
FROM m JOIN paircos p ON m.label_a = p.label_a GROUP BY m.label_a, m.n, m.positives, m.auroc, m.auprc""")
def vec07(spark, d):
    from exprlake.functions.columns import fixed

    v = vectors(spark, d)
    s = ve.pair_cosines(edges(spark, d), v.select("key", "vec")).withColumn("score", fixed("score", 9))
    s = s.join(v.select(F.col("key").alias("a"), F.col("label").alias("label_a")), "a")
    return rounded(ve.pair_separation(s, ["label_a"]), "auroc", "auprc", "mean_positive", "mean_negative")


def hpick(what, n, i="i"):
    return f"(('0x' || substr(md5('3:{what}:' || CAST({i} AS VARCHAR)), 1, 13))::BIGINT % {n} + 1)"


@query("vec08_sample_pairs", f"""WITH {VECTORS}, {VECTOR_TERMS}, pl AS (SELECT term, key, row_number() OVER (PARTITION BY term ORDER BY key) AS p, count(*) OVER (PARTITION BY term) AS size FROM vector_terms),
tt AS (SELECT term, size, row_number() OVER (ORDER BY term) AS t FROM (SELECT DISTINCT term, size FROM pl WHERE size >= 2)), kk AS (SELECT key, row_number() OVER (ORDER BY key) AS p FROM (SELECT DISTINCT key FROM pl)),
tr AS (SELECT unnest(range(1, 200 * 200 + 1)) AS i), d AS (SELECT i, term, {hpick('x', 'size')} AS pa, {hpick('y', 'size')} AS pb FROM tr JOIN tt ON tt.t = {hpick('t', '(SELECT count(*) FROM tt)')}),
po AS (SELECT d.i, a.key AS x, b.key AS y FROM d JOIN pl a ON a.term = d.term AND a.p = d.pa JOIN pl b ON b.term = d.term AND b.p = d.pb WHERE pa <> pb),
f AS (SELECT i, {hpick('u', '(SELECT count(*) FROM kk)')} AS pa, {hpick('v', '(SELECT count(*) FROM kk)')} AS pb FROM tr),
ne AS (SELECT f.i, a.key AS x, b.key AS y FROM f JOIN kk a ON a.p = pa JOIN kk b ON b.p = pb WHERE pa <> pb AND NOT EXISTS (SELECT 1 FROM vector_terms s JOIN vector_terms t ON s.term = t.term WHERE s.key = a.key AND t.key = b.key)),
p2 AS (SELECT least(x, y) AS a, greatest(x, y) AS b, min(i) AS i FROM po GROUP BY 1, 2 ORDER BY 3 LIMIT 200), n2 AS (SELECT least(x, y) AS a, greatest(x, y) AS b, min(i) AS i FROM ne GROUP BY 1, 2 ORDER BY 3 LIMIT 200),
pp AS (SELECT *, row_number() OVER (ORDER BY i) AS k FROM p2), nn AS (SELECT *, row_number() OVER (ORDER BY i) AS k FROM n2)
SELECT a, b, 1 AS label FROM pp WHERE k <= (SELECT count(*) FROM nn) UNION ALL SELECT a, b, 0 FROM nn WHERE k <= (SELECT count(*) FROM pp)""")
def vec08(spark, d):
    return ve.sample_pairs(vector_terms(spark, d), 200, 3)


GRAM = TWO_MODELS + """,
ab AS (SELECT a.key, a.vec AS x, b.vec AS y FROM two_models a JOIN two_models b ON a.key = b.key AND a.model = 'A' AND b.model = 'B'),
lx AS (SELECT key, unnest(x) AS v, unnest(range(0, 32)) AS i FROM ab), ly AS (SELECT key, unnest(y) AS v, unnest(range(0, 32)) AS i FROM ab),
cx AS (SELECT key, i, v - avg(v) OVER (PARTITION BY i) AS v FROM lx), cy AS (SELECT key, i, v - avg(v) OVER (PARTITION BY i) AS v FROM ly),
gxy AS (SELECT cx.i, cy.i AS j, sum(cx.v * cy.v) AS g FROM cx JOIN cy ON cx.key = cy.key GROUP BY 1, 2), gxx AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS g FROM cx a JOIN cx b ON a.key = b.key GROUP BY 1, 2),
gyy AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS g FROM cy a JOIN cy b ON a.key = b.key GROUP BY 1, 2)"""


@query("vec09_linear_cka", f"""WITH {GRAM} SELECT (SELECT count(*) FROM ab) AS shared, {R('(SELECT sum(g * g) FROM gxy) / sqrt((SELECT sum(g * g) FROM gxx) * (SELECT sum(g * g) FROM gyy))')} AS linear_cka""")
def vec09(spark, d):
    return rounded(ve.linear_cka(*halves(spark, d)), "linear_cka")


@query("vec10_procrustes")
def vec10(spark, d):
    return rounded(ve.procrustes(*halves(spark, d)), "mean_cosine", "median_cosine", "nuclear_norm")


@query("vec11_neighbour_overlap", f"""WITH {TWO_MODELS}, u AS (SELECT model, key, [v / greatest(sqrt(list_dot_product(vec, vec)), 1e-12) FOR v IN vec] AS u FROM two_models),
qs AS (SELECT key FROM (SELECT key, row_number() OVER (ORDER BY md5('9:' || CAST(key AS VARCHAR)), key) AS p FROM vectors) WHERE p <= 256),
p AS (SELECT a.model, a.key, b.key AS nb, row_number() OVER (PARTITION BY a.model, a.key ORDER BY list_dot_product(a.u, b.u) DESC, b.key) AS k FROM u a JOIN u b ON a.model = b.model AND a.key <> b.key WHERE a.key IN (SELECT key FROM qs)),
c AS (SELECT qs.key, count(x.nb) AS c FROM qs LEFT JOIN (SELECT a.key, a.nb FROM p a JOIN p b ON a.key = b.key AND a.nb = b.nb AND a.model = 'A' AND b.model = 'B' AND a.k <= 10 AND b.k <= 10) x ON qs.key = x.key GROUP BY 1)
SELECT {R('avg(c / 10.0::DOUBLE)')} AS overlap, {R('avg(c / (20.0::DOUBLE - c))')} AS jaccard, count(*) AS queries FROM c""")
def vec11(spark, d):
    a, b = halves(spark, d)
    return rounded(ve.neighbour_overlap(a, b, 10, 256, 9), "overlap", "jaccard")


@query("vec12_pca")
def vec12(spark, d):
    coords, ratio = ve.pca(vectors(spark, d), 3)
    share = F.array(*[F.lit(x) for x in ratio])
    out = coords.select("key", *[F.col("vec")[i].alias(f"pc{i + 1}") for i in range(3)], share[0].alias("explained1"))
    return rounded(out, "pc1", "pc2", "pc3", "explained1", digits=4)


@query("vec13_coexpression", f"""WITH {SPEARCOL}, e AS (SELECT DISTINCT least(x.p_brand, y.p_brand) AS a, greatest(x.p_brand, y.p_brand) AS b FROM lineitem JOIN part x ON l_partkey = x.p_partkey JOIN part y ON l_suppkey = y.p_partkey WHERE x.p_brand <> y.p_brand)
SELECT e.a, e.b, {R('sum(x.value * y.value)')} AS correlation, {R('abs(sum(x.value * y.value))')} AS abs_correlation FROM e JOIN spearcol x ON e.a = x.feature JOIN spearcol y ON e.b = y.feature AND x.sample_id = y.sample_id GROUP BY 1, 2""")
def vec13(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    e = li.join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("x")), "l_partkey").join(
        p.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_brand").alias("y")), "l_suppkey").filter("x <> y")
    e = e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return rounded(ve.coexpression(measurement(spark, d), e), "correlation", "abs_correlation")


@query("vec14_set_scores", f"""WITH {RANKED}, {MEMBERSHIP} SELECT term, count(*) AS samples, {R('avg(score)')} AS mean_score, {R('max(score)')} AS best, CAST(max(members) AS BIGINT) AS members FROM (
 SELECT sample_id, term, avg(value) AS score, count(*) AS members FROM ranked r JOIN membership m ON r.feature = m.feature GROUP BY 1, 2) GROUP BY 1""")
def vec14(spark, d):
    s = ve.set_scores(nz.rank_within_sample(measurement(spark, d)), membership(spark, d))
    return rounded(s.groupBy("term").agg(F.count(F.lit(1)).alias("samples"), F.avg("score").alias("mean_score"), F.max("score").alias("best"), F.max("members").alias("members")), "mean_score", "best")


TOPF = """topf AS (SELECT feature, avg(ln(1 + greatest(value, 0))) AS mean_value FROM measurement GROUP BY 1 ORDER BY 2 DESC, feature LIMIT 10)"""


@query("vec15_over_representation", f"""WITH {MEASUREMENT}, {MEMBERSHIP}, {TOPF} SELECT term, overlap, features, set_size, {R('overlap / sqrt(set_size)')} AS score FROM (
 SELECT m.term, count(*) AS overlap, string_agg(m.feature, ',' ORDER BY m.feature) AS features, (SELECT count(*) FROM membership z WHERE z.term = m.term) AS set_size FROM membership m WHERE feature IN (SELECT feature FROM topf) GROUP BY 1)
ORDER BY overlap / sqrt(set_size) DESC, term LIMIT 15""")
def vec15(spark, d):
    top = ve.top_mean_features(measurement(spark, d), k=10)
    return rounded(ve.over_representation(top, membership(spark, d)), "score")


@query("vec15_term_edges", f"""WITH {MEASUREMENT}, {MEMBERSHIP}, {TOPF}, h AS (SELECT * FROM membership WHERE feature IN (SELECT feature FROM topf))
SELECT term, feature, count(*) OVER (PARTITION BY term) AS overlap FROM h QUALIFY count(*) OVER (PARTITION BY term) >= 2""")
def vec15b(spark, d):
    return ve.term_edges(ve.top_mean_features(measurement(spark, d), k=10), membership(spark, d))


@query("vec16_top_features_annotated", f"""WITH {MEASUREMENT}, t AS (SELECT p_partkey AS feature, avg(ln(1 + value)) AS mean_value FROM counts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)
SELECT feature, {R('mean_value')} AS mean_value, p_name AS note, 'annotation' AS kind FROM (SELECT t.*, p_name FROM t JOIN part ON feature = p_partkey WHERE p_size > 20 ORDER BY mean_value DESC, feature LIMIT 25)
UNION ALL SELECT feature, {R('mean_value')}, CAST(dst AS VARCHAR), 'ortholog' FROM (SELECT t.*, l_suppkey AS dst FROM t JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON feature = l_partkey ORDER BY mean_value DESC, feature, l_suppkey LIMIT 50)""")
def vec16(spark, d):
    from exprlake.plans.inputs import counts

    c = counts(spark, d).select("sample_id", F.col("p_partkey").alias("feature"), "value")
    top = ve.top_mean_features(c, k=100)
    notes = table(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("feature"), F.col("p_name").alias("note"))
    orth = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    calls = sample_meta(spark, d).select(F.when(F.col("balance") > 9000, "Mouse").otherwise("human").alias("call"))
    a = ve.annotate_top(top, notes).select("feature", "mean_value", "note", F.lit("annotation").alias("kind"))
    o = ve.orthologs_if_called(top, orth, calls).select("feature", "mean_value", F.col("dst").cast("string").alias("note"), F.lit("ortholog").alias("kind"))
    return rounded(a.unionByName(o), "mean_value")


@query("vec17_hybrid_vectors", f"""WITH {TWO_MODELS}, u AS (SELECT model, key, [v / greatest(sqrt(list_dot_product(vec, vec)), 1e-12) FOR v IN vec] AS u FROM two_models),
h AS (SELECT a.key, list_transform(list_zip(a.u, b.u), lambda x: x[1] + 0.3::DOUBLE * x[2]) AS h FROM u a JOIN u b ON a.key = b.key AND a.model = 'A' AND b.model = 'B')
SELECT key, {R('h[1] / sqrt(list_dot_product(h, h))')} AS first_value, {R('1')} AS length FROM h""")
def vec17(spark, d):
    a, b = halves(spark, d)
    h = ve.hybrid_vectors(a, b, 0.3)
    return rounded(h.select("key", F.col("vec")[0].alias("first_value"), norm("vec").alias("length")), "first_value", "length")


@query("vec18_cosine_alignment", f"""WITH {TWO_MODELS}, u AS (SELECT model, key, label, [v / greatest(sqrt(list_dot_product(vec, vec)), 1e-12) FOR v IN vec] AS u FROM two_models)
SELECT a.label, {R('1 - avg(list_dot_product(a.u, b.u))')} AS loss, count(*) AS covered FROM u a JOIN u b ON a.key = b.key AND a.model = 'A' AND b.model = 'B' GROUP BY 1""")
def vec18(spark, d):
    a, b = halves(spark, d)
    return rounded(ve.cosine_alignment(a, b, ["label"]), "loss")


@query("vec19_model_similarity", f"""WITH {EDGES}, {TWO_MODELS}, c AS (SELECT a, b, x.model, list_dot_product(x.vec, y.vec) / (sqrt(list_dot_product(x.vec, x.vec)) * sqrt(list_dot_product(y.vec, y.vec))) AS s
 FROM edges JOIN two_models x ON a = x.key JOIN two_models y ON b = y.key AND x.model = y.model)
SELECT 'A' AS model_a, 'B' AS model_b, {R('CASE WHEN var_pop(p.s) > 0 AND var_pop(q.s) > 0 THEN corr(p.s, q.s) END')} AS correlation FROM c p JOIN c q ON p.a = q.a AND p.b = q.b AND p.model = 'A' AND q.model = 'B'""")
def vec19(spark, d):
    return rounded(ve.model_similarity(edges(spark, d).select("a", "b"), two_models(spark, d), ["A", "B"]), "correlation")


@query("vec19_mean_cca")
def vec19b(spark, d):
    return rounded(ve.mean_cca(*halves(spark, d)), "mean_cca")


@query("met15_neighbour_agreement", f"""WITH {UNIT}, g AS (SELECT key, u, CASE WHEN label = 3 THEN 'unknown' ELSE CAST(label AS VARCHAR) END AS l FROM un),
p AS (SELECT a.key, a.l AS la, b.l AS lb, list_dot_product(a.u, b.u) AS s, row_number() OVER (PARTITION BY a.key ORDER BY list_dot_product(a.u, b.u) DESC, b.key) AS k FROM g a JOIN g b ON a.key <> b.key)
SELECT (SELECT {R('avg(CAST(la = lb AS INTEGER))')} FROM p WHERE k = 1 AND la <> 'unknown') AS agreement, {R("avg(s) FILTER (WHERE la = lb)")} AS within, {R("avg(s) FILTER (WHERE la <> lb)")} AS "between"
FROM p WHERE la <> 'unknown' AND lb <> 'unknown'""")
def met15(spark, d):
    g = vectors(spark, d).withColumn("label", F.when(F.col("label") == 3, "unknown").otherwise(F.col("label").cast("string")))
    out = ve.group_similarity(g).withColumn("agreement", ve.neighbour_agreement(g).select("agreement").scalar())
    return rounded(out, "agreement", "within", "between")


@query("met16_silhouette", f"""WITH {VECTORS}, p AS (SELECT a.key, a.label AS la, b.label AS lb, sum(sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))) AS t, count(*) AS n FROM vectors a JOIN vectors b ON a.key <> b.key GROUP BY 1, 2, 3),
s AS (SELECT key, max(t / n) FILTER (WHERE la = lb) AS a, min(t / n) FILTER (WHERE la <> lb) AS b FROM p GROUP BY 1)
SELECT {R('avg((b - a) / greatest(a, b))')} AS silhouette, count(*) AS rows FROM s""")
def met16(spark, d):
    return rounded(ve.silhouette(vectors(spark, d)), "silhouette")


@query("met19_trustworthiness", f"""WITH {UNIT}, pr AS (SELECT key, vec[1] AS x, vec[2] AS y FROM vectors),
q AS (SELECT a.key, b.key AS nb, row_number() OVER (PARTITION BY a.key ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.key) AS k FROM pr a JOIN pr b ON a.key <> b.key),
r AS (SELECT a.key, b.key AS nb, rank() OVER (PARTITION BY a.key ORDER BY list_dot_product(a.u, b.u) DESC) AS r FROM un a JOIN un b ON a.key <> b.key), n AS (SELECT count(*)::DOUBLE AS n FROM un)
SELECT {R('1 - 2 / ((SELECT n FROM n) * 5 * (2 * (SELECT n FROM n) - 16)) * sum(greatest(r.r - 5, 0))')} AS trustworthiness, count(*) AS pairs FROM q JOIN r ON q.key = r.key AND q.nb = r.nb WHERE q.k <= 5""")
def met19(spark, d):
    v = vectors(spark, d)
    return rounded(ve.trustworthiness(v, v.select("key", F.slice("vec", 1, 2).alias("vec")), 5), "trustworthiness")
