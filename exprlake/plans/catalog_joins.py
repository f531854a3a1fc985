"""Queries for joins and identifier mapping."""

from pyspark.sql import functions as F

from exprlake.functions.columns import strip_copy_suffix
from exprlake.operators import joins as jn
from exprlake.operators.ranking import rank_by
from exprlake.plans.inputs import (
    EDGES, MEASUREMENT, MEMBERSHIP, PREDICTIONS, SAMPLE_META, SCORES, VECTORS, R, counts, edges, measurement,
    membership, predictions, rounded, sample_meta, scores, table, vectors,
)
from exprlake.plans.registry import query


@query("jn01_one_to_one_join", f"""WITH {PREDICTIONS} SELECT a.doc_id, a.label, {R('a.score')} AS score_a, {R('b.score')} AS score_b
FROM predictions a JOIN predictions b ON a.doc_id = b.doc_id AND a.method = 'length' AND b.method = 'spacing'""")
def jn01(spark, d):
    p = predictions(spark, d)
    a = p.filter("method = 'length'").select("doc_id", "label", F.col("score").alias("score_a"))
    b = p.filter("method = 'spacing'").select("doc_id", F.col("score").alias("score_b"))
    return rounded(jn.checked_join(a, b, ["doc_id"]), "score_a", "score_b")


@query("jn02_dimension_join", """SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def jn02(spark, d):
    dim = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return jn.dimension_join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), dim, ["o_custkey"], ["c_mktsegment"])


@query("jn03_lookup_default", """SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def jn03(spark, d):
    return jn.lookup(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"], {"quality": -1, "toxic": 0})


HOMOLOGY = """homology AS (SELECT p_name || '/' || p_brand AS class, CASE WHEN p_size > 25 THEN 'human' ELSE 'mouse' END AS species,
  'G' || CAST(p_partkey AS VARCHAR) AS symbol FROM part)"""


def homology(spark, d):
    return table(spark, d, "part").select(
        F.concat_ws("/", "p_name", "p_brand").alias("class"), F.when(F.col("p_size") > 25, "human").otherwise("mouse").alias("species"),
        F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("symbol"))


@query("jn04_one_to_one_orthologs", f"""WITH {HOMOLOGY} SELECT class, max(symbol) FILTER (WHERE species = 'human') AS src, max(symbol) FILTER (WHERE species = 'mouse') AS dst
FROM homology GROUP BY 1 HAVING count(DISTINCT symbol) FILTER (WHERE species = 'human') = 1 AND count(DISTINCT symbol) FILTER (WHERE species = 'mouse') = 1""")
def jn04(spark, d):
    return jn.one_to_one_orthologs(homology(spark, d), "human", "mouse")


@query("jn05_many_to_many_orthologs", f"""WITH {HOMOLOGY} SELECT DISTINCT a.class, a.symbol AS src, b.symbol AS dst FROM homology a JOIN homology b
ON a.class = b.class AND a.species = 'mouse' AND b.species = 'human'""")
def jn05(spark, d):
    return jn.many_to_many_orthologs(homology(spark, d), "mouse", "human")


@query("jn06_map_and_average", f"""WITH {VECTORS}, m AS (SELECT p_partkey AS src, p_name AS dst FROM part UNION SELECT p_partkey, p_type FROM part),
x AS (SELECT dst AS key, unnest(vec) AS v, unnest(range(0, 64)) AS pos, vectors.key AS src FROM vectors JOIN m ON vectors.key = m.src),
y AS (SELECT key, pos, avg(v) AS v, count(*) AS sources FROM x GROUP BY 1, 2)
SELECT key, pos::INTEGER AS pos, {R('v')} AS value, sources FROM y""")
def jn06(spark, d):
    p = table(spark, d, "part")
    m = p.select(F.col("p_partkey").alias("src"), F.col("p_name").alias("dst")).union(p.select("p_partkey", "p_type")).distinct()
    out = jn.map_and_average(vectors(spark, d).select("key", "vec"), m)
    return rounded(out.select("key", "sources", F.posexplode("vec").alias("pos", "value")), "value")


@query("jn07_keep_universe", """SELECT p_type AS term, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) GROUP BY 1""")
def jn07(spark, d):
    u = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return jn.keep_universe(table(spark, d, "part"), u, ["p_partkey"]).groupBy(F.col("p_type").alias("term")).agg(F.count(F.lit(1)).alias("n"))


@query("jn08_missing_report", """SELECT p_partkey AS feature FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)""")
def jn08(spark, d):
    have = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("feature"))
    return jn.missing_report(table(spark, d, "part").select(F.col("p_partkey").alias("feature")), have, ["feature"])


@query("jn09_overlap_audit", f"""WITH {SAMPLE_META}, c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
SELECT nation AS cohort, count(DISTINCT sample_id) AS entities, count(DISTINCT k) AS overlapping, {R('count(DISTINCT k) / count(DISTINCT sample_id)')} AS fraction,
  count(DISTINCT k) = 0 AS clean FROM sample_meta LEFT JOIN c ON sample_id = k GROUP BY 1""")
def jn09(spark, d):
    corpus = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("sample_id"))
    return rounded(jn.overlap_audit(sample_meta(spark, d).select(F.col("nation").alias("cohort"), "sample_id"), corpus, "cohort", "sample_id"), "fraction")


@query("jn09_text_overlap_audit", """WITH c AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE lang <> 'en' UNION SELECT md5(text) FROM benchmark),
e AS (SELECT DISTINCT role AS cohort, md5(text) AS k FROM conversations UNION SELECT DISTINCT source, md5(text) FROM documents)
SELECT cohort, count(*) AS entities, count(*) FILTER (WHERE k IN (SELECT k FROM c)) AS overlapping,
""" + R("count(*) FILTER (WHERE k IN (SELECT k FROM c)) / count(*)") + """ AS fraction, count(*) FILTER (WHERE k IN (SELECT k FROM c)) = 0 AS clean FROM e GROUP BY 1""")
def jn09b(spark, d):
    docs = table(spark, d, "documents")
    corpus = docs.filter("lang <> 'en'").select(F.md5("text").alias("k")).unionByName(table(spark, d, "benchmark").select(F.md5("text").alias("k")))
    ent = table(spark, d, "conversations").select(F.col("role").alias("cohort"), F.md5("text").alias("k")).unionByName(
        docs.select(F.col("source").alias("cohort"), F.md5("text").alias("k")))
    return rounded(jn.overlap_audit(ent, corpus, "cohort", "k"), "fraction")


@query("jn10_pair_vectors", f"""WITH {EDGES}, {VECTORS} SELECT e.a, e.b, e.label, {R('list_dot_product(x.vec, y.vec)')} AS dot
FROM edges e JOIN vectors x ON e.a = x.key JOIN vectors y ON e.b = y.key""")
def jn10(spark, d):
    from exprlake.functions.vectors import dot

    p = jn.pair_vectors(edges(spark, d), vectors(spark, d).select("key", "vec"))
    return rounded(p.select("a", "b", "label", dot("vec_a", "vec_b").alias("dot")), "dot")


@query("jn11_compare_to_baseline", f"""WITH {SCORES} SELECT x.model, x.term, {R('x.auroc')} AS base, {R('y.auroc')} AS other, {R('y.auroc - x.auroc')} AS delta
FROM scores x JOIN scores y ON x.model = y.model AND x.term = y.term AND x.scope = 'A' AND y.scope = 'R'""")
def jn11(spark, d):
    return rounded(jn.compare_to_baseline(scores(spark, d), ["model", "term"], "scope", "auroc", "A", "R"), "base", "other", "delta")


@query("jn12_pivot_join", f"""WITH {SCORES}, p AS (SELECT term, model, max(auroc) FILTER (WHERE scope = 'A') AS auroc_a, max(auroc) FILTER (WHERE scope = 'N') AS auroc_n,
 max(auprc) FILTER (WHERE scope = 'A') AS auprc_a, max(auprc) FILTER (WHERE scope = 'N') AS auprc_n FROM scores GROUP BY 1, 2)
SELECT term, model, {R('auroc_a')} AS auroc_a, {R('auroc_n')} AS auroc_n, {R('auprc_a')} AS auprc_a, {R('auprc_n')} AS auprc_n FROM p""")
def jn12(spark, d):
    from exprlake.operators.aggregate import pivot

    s = scores(spark, d)
    a = pivot(s, ["term", "model"], "scope", ["A", "N"], "auroc").withColumnsRenamed({"A": "auroc_a", "N": "auroc_n"})
    b = pivot(s, ["term", "model"], "scope", ["A", "N"], "auprc").withColumnsRenamed({"A": "auprc_a", "N": "auprc_n"})
    return rounded(a.join(b, ["term", "model"]), "auroc_a", "auroc_n", "auprc_a", "auprc_n")


@query("jn14_normalised_join", r"""WITH a AS (SELECT c_custkey AS sample_id, regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g') AS k FROM customer),
b AS (SELECT 'customer_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS k, s_suppkey FROM supplier)
SELECT sample_id, s_suppkey, b.k IS NOT NULL AS matched FROM a LEFT JOIN b ON a.k = b.k""")
def jn14(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.concat(F.upper("c_name"), F.lit("-7")).alias("name"))
    b = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Customer "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("supplier"))
    hit, failed = jn.normalised_join(a, b, strip_copy_suffix("name"), strip_copy_suffix("supplier"))
    return hit.select("sample_id", "s_suppkey", F.lit(True).alias("matched")).unionByName(
        failed.select("sample_id", F.lit(None).cast("bigint").alias("s_suppkey"), F.lit(False).alias("matched")))


@query("jn15_top_feature_overlap", f"""WITH {MEASUREMENT}, {MEMBERSHIP}, t AS (SELECT * FROM (SELECT sample_id, feature, row_number() OVER (PARTITION BY sample_id ORDER BY value DESC, feature) AS r FROM measurement) WHERE r <= 5)
SELECT sample_id, term, count(*) AS overlap, string_agg(t.feature, ',' ORDER BY t.feature) AS features FROM t JOIN membership m ON t.feature = m.feature GROUP BY 1, 2""")
def jn15(spark, d):
    return jn.top_feature_overlap(measurement(spark, d), membership(spark, d), 5)
