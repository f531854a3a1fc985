"""Queries for atlas matching, corpus preparation, leaderboards and streaming."""

from pyspark.sql import functions as F

from exprlake.operators import clean
from exprlake.operators import ranking as rk
from exprlake.operators.aggregate import group_centroids
from exprlake.plans import atlas as at
from exprlake.plans.corpus import prepare_corpus, store_corpus
from exprlake.plans.inputs import (
    MEASUREMENT, SAMPLE_META, SCORES, VECTORS, R, counts, measurement, rounded, sample_meta, scores, table, vectors,
)
from exprlake.plans.leaderboard import leaderboard
from exprlake.plans.registry import query
from exprlake.session import materialize, scratch_dir
from exprlake.streaming import incremental as inc

SETTINGS = at.AtlasSettings(minimum_shared=20, sparse_minimum=5)


def references(spark, d, m=None):
    """One centroid per (nation, segment); some count as tumour cohorts, some are unlabelled or unknown."""
    meta = sample_meta(spark, d).withColumn("reference_id", F.concat_ws("/", "nation", "cohort"))
    m = measurement(spark, d) if m is None else m
    have = meta.join(m.select("sample_id").distinct(), "sample_id", "left_semi")
    ref = group_centroids(m, have.select("reference_id", "sample_id"), "reference_id")
    g = F.col("group_id")
    tissue = F.when(g < 5, F.concat(F.lit("TCGA-"), F.col("cohort"))).when(g < 8, F.concat(F.lit("unlabelled "), F.col("nation"))).otherwise(F.col("cohort"))
    info = meta.filter(g != 10).select("reference_id", F.col("region").alias("species"), tissue.alias("tissue")).distinct()
    return ref, info


def near(spark, d, per_class=None):
    ref, info = references(spark, d)
    return at.similarities(measurement(spark, d), ref, info, SETTINGS, per_class=per_class)


# the scale of a request as a whole (its largest value is above the threshold), and of each sample by itself
WHOLE = """qlog AS (SELECT sample_id AS id, feature, ln(1 + value * 1e6 / greatest(sum(value) OVER (PARTITION BY sample_id), 1.0)) AS v FROM measurement),"""
EACH = """known AS (SELECT sample_id, count(*) AS k, count(*) FILTER (WHERE feature IN (SELECT feature FROM rraw)) AS s FROM measurement GROUP BY 1),
shared AS (SELECT * FROM measurement WHERE feature IN (SELECT feature FROM rraw) AND sample_id IN (SELECT sample_id FROM known WHERE s >= least(20, greatest(5, ceil(0.4 * k))))),
qlog AS (SELECT sample_id AS id, feature, CASE WHEN max(value) OVER (PARTITION BY sample_id) > 30 THEN ln(1 + value * 1e6 / greatest(sum(value) OVER (PARTITION BY sample_id), 1.0)) ELSE value END AS v FROM shared),"""

NEAR_OF = MEASUREMENT + ", " + SAMPLE_META + """,
feats AS (SELECT DISTINCT feature FROM measurement),
mem AS (SELECT sample_id, nation || '/' || cohort AS reference_id FROM sample_meta WHERE sample_id IN (SELECT sample_id FROM measurement)),
info AS (SELECT DISTINCT nation || '/' || cohort AS reference_id, region AS species, CASE WHEN group_id < 5 THEN 'TCGA-' || cohort WHEN group_id < 8 THEN 'unlabelled ' || nation ELSE cohort END AS tissue FROM sample_meta WHERE group_id <> 10),
rsize AS (SELECT reference_id, count(*) AS k FROM mem GROUP BY 1),
rraw AS (SELECT mem.reference_id AS id, feature, sum(value) / max(k) AS v FROM measurement JOIN mem ON measurement.sample_id = mem.sample_id JOIN rsize ON rsize.reference_id = mem.reference_id GROUP BY 1, 2),
rlog AS (SELECT id, feature, ln(1 + v * 1e6 / greatest(sum(v) OVER (PARTITION BY id), 1.0)) AS v FROM rraw),
{query}
rg AS (SELECT i.id, f.feature, coalesce(v, 0) AS v FROM (SELECT DISTINCT id FROM rlog) i CROSS JOIN feats f LEFT JOIN rlog ON rlog.id = i.id AND rlog.feature = f.feature),
qg AS (SELECT i.id, f.feature, coalesce(v, 0) AS v FROM (SELECT DISTINCT id FROM qlog) i CROSS JOIN feats f LEFT JOIN qlog ON qlog.id = i.id AND qlog.feature = f.feature),
rc AS (SELECT id, feature, v - avg(v) OVER (PARTITION BY id) AS v FROM rg), qc AS (SELECT id, feature, v - avg(v) OVER (PARTITION BY id) AS v FROM qg),
rv AS (SELECT id, list(v ORDER BY feature) AS vec FROM rc GROUP BY 1), qv AS (SELECT id, list(v ORDER BY feature) AS vec FROM qc GROUP BY 1),
ru AS (SELECT id, [x / greatest(sqrt(list_dot_product(vec, vec)), 1e-8) FOR x IN vec] AS u FROM rv), qu AS (SELECT id, [x / greatest(sqrt(list_dot_product(vec, vec)), 1e-8) FOR x IN vec] AS u FROM qv),
near AS (SELECT qu.id AS sample_id, ru.id AS reference_id, coalesce(species, 'unknown') AS species, coalesce(tissue, 'unknown') AS tissue, CASE WHEN tissue IS NULL THEN 'unknown' WHEN tissue LIKE 'TCGA-%' THEN 'tumor_cohort' WHEN tissue LIKE 'unlabelled%' THEN 'unlabelled' ELSE 'healthy_tissue' END AS reference_type,
  list_dot_product(qu.u, ru.u) AS similarity FROM qu CROSS JOIN ru LEFT JOIN info ON ru.id = info.reference_id),
classed AS (SELECT *, row_number() OVER (PARTITION BY sample_id, reference_type ORDER BY similarity DESC, reference_id) AS k FROM near),
found AS (SELECT sample_id, reference_id, species, tissue, reference_type, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY sample_id ORDER BY CASE reference_type WHEN 'healthy_tissue' THEN 0 ELSE 1 END, similarity DESC, reference_id) AS rank
  FROM classed WHERE (reference_type = 'healthy_tissue' AND k <= 8) OR (reference_type = 'tumor_cohort' AND k <= 3)),
best AS (SELECT sample_id, species, max(similarity) AS s FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY similarity DESC, reference_id) AS j FROM near) WHERE j <= 50 AND species <> 'unknown' GROUP BY 1, 2),
soft AS (SELECT sample_id, species, exp(greatest((s - max(s) OVER w) / 0.08::DOUBLE, -50)) AS e FROM best WINDOW w AS (PARTITION BY sample_id)),
wt AS (SELECT sample_id, species, e / sum(e) OVER (PARTITION BY sample_id) AS weight FROM soft),
wr AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY weight DESC, species) AS j FROM wt),
votes AS (SELECT sample_id, max(species) FILTER (WHERE j = 1) AS top, max(weight) FILTER (WHERE j = 1) AS weight, coalesce(max(weight) FILTER (WHERE j = 1) - max(weight) FILTER (WHERE j = 2), 1) AS margin FROM (SELECT DISTINCT sample_id FROM near) LEFT JOIN wr USING (sample_id) GROUP BY 1)"""
NEAR = NEAR_OF.replace("{query}", WHOLE)


@query("vec03_reference_matches", f"""WITH {NEAR} SELECT sample_id, reference_id, tissue, reference_type, {R('similarity', 5)} AS similarity FROM classed WHERE k <= 5""")
def vec03(spark, d):
    from exprlake.operators.ordering import top_k

    n = top_k(near(spark, d, 5), ["sample_id", "reference_type"], [F.col("similarity").desc(), F.col("reference_id")], 5)
    return rounded(n.select("sample_id", "reference_id", "tissue", "reference_type", "similarity"), "similarity", digits=5)


@query("vec04_nearest_unlabelled", f"""WITH {NEAR} SELECT sample_id, reference_id, species, k::INTEGER AS rank, {R('similarity', 5)} AS similarity FROM classed WHERE reference_type = 'unlabelled' AND k <= 3""")
def vec04(spark, d):
    return rounded(at.nearest_unlabelled(near(spark, d), SETTINGS).select("sample_id", "reference_id", "species", "rank", "similarity"), "similarity", digits=5)


@query("win11_quota_top_k", f"""WITH {NEAR} SELECT sample_id, rank, reference_id, reference_type, {R('similarity', 5)} AS similarity FROM found""")
def win11(spark, d):
    return rounded(at.matches(near(spark, d, SETTINGS.top_k), SETTINGS).select("sample_id", "rank", "reference_id", "reference_type", "similarity"), "similarity", digits=5)


@query("win13_first_of_class", f"""WITH {NEAR} SELECT sample_id, arg_min(reference_id, rank) AS reference_id, {R('arg_min(similarity, rank)', 5)} AS similarity FROM found WHERE reference_type = 'tumor_cohort' GROUP BY 1""")
def win13(spark, d):
    return rounded(rk.first_of_class(at.matches(near(spark, d, SETTINGS.top_k), SETTINGS), "reference_type", "tumor_cohort"), "similarity", digits=5)


@query("win14_vote_call", f"""WITH {NEAR} SELECT sample_id, {R('weight', 5)} AS weight, {R('margin', 5)} AS margin, CASE WHEN top IS NOT NULL AND margin >= 0.1 THEN top ELSE 'indeterminate' END AS call FROM votes""")
def win14(spark, d):
    return rounded(rk.vote_call(near(spark, d), "species"), "weight", "margin", digits=5)


@query("win15_label_scores", f"""WITH {NEAR}, m AS (SELECT sample_id, tissue, avg(similarity) AS score FROM found WHERE reference_type = 'healthy_tissue' GROUP BY 1, 2)
SELECT sample_id, tissue, {R('score', 5)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, tissue) AS k FROM m) WHERE k <= 5""")
def win15(spark, d):
    return rounded(at.tissue_evidence(at.matches(near(spark, d, SETTINGS.top_k), SETTINGS)).drop("rank"), "score", digits=5)


BEST = """b AS (SELECT sample_id, arg_min(reference_id, rank) AS best_reference, arg_min(tissue, rank) AS best_tissue, arg_min(similarity, rank) AS s FROM found WHERE reference_type = 'healthy_tissue' GROUP BY 1),
t AS (SELECT sample_id, arg_min(reference_id, rank) AS nearest_tumor, arg_min(similarity, rank) AS s FROM found WHERE reference_type = 'tumor_cohort' GROUP BY 1)"""
CALL = "WHEN top IS NOT NULL AND margin >= 0.1 THEN top ELSE 'indeterminate' END AS call"
ANSWER = f"{R('margin', 5)} AS margin, best_reference, best_tissue, {R('b.s', 5)} AS best_similarity, nearest_tumor, {R('t.s', 5)} AS tumor_similarity"
MATCH = f"""WITH {NEAR}, {BEST} SELECT v.sample_id, CASE {CALL}, {ANSWER}
FROM votes v LEFT JOIN b ON v.sample_id = b.sample_id LEFT JOIN t ON v.sample_id = t.sample_id"""
ARRIVALS = f"""WITH {NEAR_OF.replace("{query}", EACH)}, {BEST} SELECT e.sample_id, CASE WHEN v.sample_id IS NULL THEN '{at.INSUFFICIENT}' {CALL}, {ANSWER}
FROM (SELECT DISTINCT sample_id FROM measurement) e LEFT JOIN votes v ON v.sample_id = e.sample_id LEFT JOIN b ON e.sample_id = b.sample_id LEFT JOIN t ON e.sample_id = t.sample_id"""


@query("entry1_atlas_match", MATCH)
def entry1(spark, d):
    ref, info = references(spark, d)
    out = at.atlas_match(measurement(spark, d), ref, info, SETTINGS)
    return rounded(out, "margin", "best_similarity", "tumor_similarity", digits=5)


CORPUS = MEASUREMENT + ", " + SAMPLE_META + """,
raw AS (SELECT sample_id, p_partkey AS feature, value FROM counts), idmap AS (SELECT p_partkey AS src, p_brand AS dst FROM part WHERE p_size > 5),
col AS (SELECT sample_id, dst AS feature, sum(value) AS value FROM raw JOIN idmap ON feature = src GROUP BY 1, 2),
good AS (SELECT c.sample_id FROM (SELECT sample_id FROM col GROUP BY 1 HAVING count(*) FILTER (WHERE value > 0) >= 10) c JOIN sample_meta s ON c.sample_id = s.sample_id WHERE (balance + 1000) / 11000 < 0.5),
kept AS (SELECT c.sample_id, region AS species, feature, value FROM col c JOIN sample_meta s ON c.sample_id = s.sample_id WHERE c.sample_id IN (SELECT sample_id FROM good)),
common AS (SELECT feature FROM (SELECT feature, species, sum(value) AS s FROM kept GROUP BY 1, 2) GROUP BY 1 HAVING min(s) > 0 AND count(*) = (SELECT count(DISTINCT species) FROM kept)),
corpus AS (SELECT * FROM kept WHERE feature IN (SELECT feature FROM common))"""


def corpus_inputs(spark, d):
    raw = counts(spark, d).select("sample_id", F.col("p_partkey").alias("feature"), "value")
    meta = sample_meta(spark, d).select("sample_id", F.col("region").alias("species"), ((F.col("balance") + 1000) / 11000.0).alias("probability"))
    idmap = table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("dst"))
    return raw, meta, idmap


@query("entry2_prepare_corpus", f"""WITH {CORPUS} SELECT sample_id, species, feature, value FROM corpus""")
def entry2(spark, d):
    path = scratch_dir(spark, "corpus")
    store_corpus(prepare_corpus(*corpus_inputs(spark, d), 10), path)
    return spark.read.parquet(path).select("sample_id", "species", "feature", "value")


@query("entry3_leaderboard", f"""WITH {SCORES}, g AS (SELECT model, coalesce(scope, 'all') AS scope, avg(auroc) AS m, count(DISTINCT term) AS terms FROM scores GROUP BY GROUPING SETS ((model, scope), (model))),
r AS (SELECT *, rank() OVER (PARTITION BY scope, term ORDER BY auroc DESC) + (count(*) OVER (PARTITION BY scope, term, auroc) - 1) / 2.0::DOUBLE AS k FROM scores),
s AS (SELECT model, count(*) FILTER (WHERE k = 1) AS wins, avg(k) AS mean_rank FROM r GROUP BY 1)
SELECT g.model, g.scope, {R('m')} AS mean_metric, terms, rank() OVER (PARTITION BY g.scope ORDER BY m DESC) AS rank, wins, {R('mean_rank')} AS mean_rank FROM g JOIN s ON g.model = s.model""")
def entry3(spark, d):
    return rounded(leaderboard(scores(spark, d)), "mean_metric", "mean_rank")


# streaming ----------------------------------------------------------------------------------
def shards(spark, d):
    """Measurements as a folder of shards that hold whole samples."""
    path = scratch_dir(spark, "arriving")
    measurement(spark, d).repartition(6, "sample_id").write.parquet(path)
    return path


@query("str01_ingest_shards", f"""WITH {MEASUREMENT}, g AS (SELECT sample_id FROM measurement GROUP BY 1 HAVING count(*) FILTER (WHERE value > 0) >= 15)
SELECT feature, sum(value) AS total, count(*) AS seen FROM measurement WHERE sample_id IN (SELECT sample_id FROM g) GROUP BY 1""")
def str01(spark, d):
    path = shards(spark, d)

    def qc(batch):
        good = batch.groupBy("sample_id").agg(F.count_if(F.col("value") > 0).alias("n")).filter("n >= 15")
        return batch.join(good.select("sample_id"), "sample_id", "left_semi")

    stream = inc.stream_shards(spark, path, spark.read.parquet(path).schema, 2)
    kept = inc.ingest_shards(stream, scratch_dir(spark, "ingested"), scratch_dir(spark, "ckpt"), qc)
    return inc.running_totals(kept, ["feature"])


@query("str02_running_vector_mean", f"""WITH {VECTORS}, x AS (SELECT label, unnest(vec) AS v, unnest(range(0, 64)) AS pos FROM vectors)
SELECT label, pos::INTEGER AS pos, {R('avg(v)')} AS mean, count(*) AS "count" FROM x GROUP BY 1, 2""")
def str02(spark, d):
    """Two runs over the same checkpoint: the second resumes with the shards that arrived later."""
    path = scratch_dir(spark, "vectors")
    v = vectors(spark, d)
    v.filter("label < 5").repartition(3).write.parquet(path)
    out, ck = scratch_dir(spark, "state"), scratch_dir(spark, "ckpt")
    config = {"model": "embedding", "width": 64}
    inc.running_vector_mean(inc.stream_shards(spark, path, v.schema, 2), "label", "vec", out, ck, config)
    v.filter("label >= 5").repartition(3).write.mode("append").parquet(path)
    done = inc.running_vector_mean(inc.stream_shards(spark, path, v.schema, 2), "label", "vec", out, ck, config)
    return rounded(done, "mean")


@query("str03_match_arrivals", ARRIVALS)
def str03(spark, d):
    """Every arriving sample is judged by itself, so the answer doesn't depend on the files that arrive together."""
    path = shards(spark, d)
    arriving = spark.read.parquet(path)
    ref, info = references(spark, d, arriving)
    ref, info = materialize(ref, "atlas"), materialize(info, "atlas-info")
    stream = inc.stream_shards(spark, path, arriving.schema, 3)
    out = inc.match_arrivals(stream, scratch_dir(spark, "matched"), scratch_dir(spark, "ckpt"), lambda b: at.atlas_match(b, ref, info, SETTINGS, per_sample=True))
    return rounded(out, "margin", "best_similarity", "tumor_similarity", digits=5)
