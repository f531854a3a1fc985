"""Queries for projections, filters and validation."""

from pyspark.sql import functions as F

from exprlake.functions.columns import strip_copy_suffix
from exprlake.operators import clean
from exprlake.plans.inputs import (
    EDGES, MEASUREMENT, MEMBERSHIP, PREDICTIONS, SAMPLE_META, SCORES, VECTORS, R, counts, edges, measurement,
    membership, predictions, rounded, sample_meta, scores, table, vectors,
)
from exprlake.plans.registry import query


@query("prj01_clean_features", """SELECT upper(trim(n)) AS feature, count(*) AS n FROM (
  SELECT CASE WHEN p_size > 45 THEN ' nan ' WHEN p_size > 40 THEN '  ' ELSE ' ' || lower(p_brand) || ' ' END AS n FROM part)
WHERE upper(trim(n)) NOT IN ('', 'NAN') GROUP BY 1""")
def prj01(spark, d):
    raw = F.when(F.col("p_size") > 45, " nan ").when(F.col("p_size") > 40, "  ").otherwise(F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ")))
    return clean.clean_features(table(spark, d, "part").select(raw.alias("feature"))).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("prj04_map_values", """SELECT o_orderkey AS sample_id, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS label,
  o_orderpriority = '1-URGENT' AS urgent FROM orders""")
def prj04(spark, d):
    return table(spark, d, "orders").withColumnsRenamed({"o_orderkey": "sample_id"}).select(
        "sample_id", clean.map_values("o_orderstatus", {"O": 0, "F": 1}).alias("label"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("prj05_sample_qc", f"""WITH {MEASUREMENT}, {SAMPLE_META}
SELECT m.sample_id, m.detected, {R('p.probability')} AS probability FROM
 (SELECT sample_id, count(*) FILTER (WHERE value > 0) AS detected FROM measurement GROUP BY 1) m
 JOIN (SELECT sample_id, (balance + 1000) / 11000 AS probability FROM sample_meta) p ON m.sample_id = p.sample_id
WHERE detected >= 15 AND p.probability < 0.5""")
def prj05(spark, d):
    p = sample_meta(spark, d).select("sample_id", ((F.col("balance") + 1000) / 11000.0).alias("probability"))
    return rounded(clean.sample_qc(measurement(spark, d), p, 15), "probability")


@query("prj06_nonzero_in_every_group", f"""WITH {MEASUREMENT}, {SAMPLE_META}, t AS (
  SELECT c.p_partkey AS feature, s.region, sum(c.value - 10) AS s FROM counts c JOIN sample_meta s ON c.sample_id = s.sample_id GROUP BY 1, 2)
SELECT feature, min(s) AS lowest, count(*) AS groups FROM t GROUP BY 1 HAVING min(s) > 0 AND count(*) = 5""")
def prj06(spark, d):
    long = counts(spark, d).select("sample_id", F.col("p_partkey").alias("feature"), (F.col("value") - 10).alias("value"))
    return clean.nonzero_in_every_group(long.join(sample_meta(spark, d).select("sample_id", "region"), "sample_id"), "region", 5)


@query("prj07_folded_filter", f"""WITH {SAMPLE_META} SELECT sample_id, cohort, region FROM sample_meta
WHERE lower(trim(cohort)) = 'building' AND region IN ('ASIA', 'EUROPE')""")
def prj07(spark, d):
    m = sample_meta(spark, d).select("sample_id", "cohort", "region")
    return clean.folded_filter(m, {"cohort": "Building"}, {"region": ["ASIA", "EUROPE"]})


@query("prj08_drop_non_finite", f"""WITH {VECTORS} SELECT key, label FROM vectors WHERE label NOT IN (3, 7)""")
def prj08(spark, d):
    bad = F.when(F.col("label") == 3, F.lit(float("nan"))).when(F.col("label") == 7, F.lit(float("inf"))).otherwise(F.lit(0.0)).cast("float")
    v = vectors(spark, d).withColumn("vec", F.concat(F.slice("vec", 1, 63), F.array(bad)))
    return clean.drop_non_finite(v).select("key", "label")


@query("prj09_min_support", f"""WITH {MEASUREMENT}, c AS (SELECT sample_id, p_partkey AS feature, CASE WHEN value > 10 THEN value END AS value FROM counts)
SELECT feature, count(*) AS rows_kept FROM c WHERE feature IN (SELECT feature FROM c GROUP BY 1 HAVING count(value) >= 30) GROUP BY 1""")
def prj09(spark, d):
    c = counts(spark, d).select("sample_id", F.col("p_partkey").alias("feature"), F.when(F.col("value") > 10, F.col("value")).otherwise(F.lit(float("nan"))).alias("value"))
    return clean.min_support(c, 30).groupBy("feature").agg(F.count(F.lit(1)).alias("rows_kept"))


@query("prj10_overlap_gate", """WITH p AS (SELECT DISTINCT p_type || '/' || p_brand AS panel, p_partkey AS feature, p_size FROM part)
SELECT panel, count(*) AS features, count(*) FILTER (WHERE p_size > 20) AS shared,
  least(100, greatest(5, CAST(ceil(count(*) * 0.4::DOUBLE) AS BIGINT))) AS minimum,
  count(*) FILTER (WHERE p_size > 20) >= least(100, greatest(5, CAST(ceil(count(*) * 0.4::DOUBLE) AS BIGINT))) AS passed
FROM p GROUP BY 1""")
def prj10(spark, d):
    p = table(spark, d, "part")
    panel = p.select(F.concat_ws("/", "p_type", "p_brand").alias("panel"), F.col("p_partkey").alias("feature"))
    vocab = p.filter("p_size > 20").select(F.col("p_partkey").alias("feature"))
    return clean.overlap_gate(panel, vocab, ["panel"], 100, 5)


@query("prj11_search", f"""WITH {SAMPLE_META} SELECT sample_id, name, cohort FROM sample_meta
WHERE contains(lower(name || ' ' || cohort || ' ' || region), '7 build')""")
def prj11(spark, d):
    return clean.search(sample_meta(spark, d), ["name", "cohort", "region"], "7 BUILD").select("sample_id", "name", "cohort")


TISSUE = """CASE WHEN balance > 7000 THEN 'tcga-' || lower(cohort) WHEN balance < 0 THEN 'Unlabelled ' || region
  WHEN balance < 500 THEN 'UNKNOWN' WHEN balance < 700 THEN NULL ELSE cohort END"""


def tissue_col():
    b = F.col("balance")
    return (
        F.when(b > 7000, F.concat(F.lit("tcga-"), F.lower("cohort"))).when(b < 0, F.concat(F.lit("Unlabelled "), F.col("region")))
        .when(b < 500, "UNKNOWN").when(b < 700, F.lit(None)).otherwise(F.col("cohort"))
    )


@query("prj12_reference_class", f"""WITH {SAMPLE_META}, t AS (SELECT sample_id, {TISSUE} AS tissue FROM sample_meta)
SELECT sample_id, tissue, CASE WHEN upper(coalesce(tissue, 'unknown')) LIKE 'TCGA-%' THEN 'tumor_cohort'
  WHEN lower(coalesce(tissue, 'unknown')) LIKE '%unlabelled%' THEN 'unlabelled'
  WHEN lower(coalesce(tissue, 'unknown')) = 'unknown' THEN 'unknown' ELSE 'healthy_tissue' END AS reference_type FROM t""")
def prj12(spark, d):
    return sample_meta(spark, d).select("sample_id", tissue_col().alias("tissue")).withColumn("reference_type", clean.reference_class("tissue"))


@query("prj13_matrix_violations", f"""WITH {MEASUREMENT}, x AS (
  SELECT sample_id, upper(trim(p_type)) AS f, value - 2 AS value FROM counts)
SELECT * FROM (
  SELECT 'duplicate_feature' AS rule, (SELECT count(*) FROM (SELECT 1 FROM x GROUP BY sample_id, f HAVING count(*) > 1)) AS entries
  UNION ALL SELECT 'negative_value', (SELECT count(*) FROM x WHERE value < 0)
  UNION ALL SELECT 'too_many_samples', (SELECT greatest(count(DISTINCT sample_id) - 512, 0) FROM x)
  UNION ALL SELECT 'missing_cells', (SELECT count(DISTINCT f) * count(DISTINCT sample_id) FROM x) - (SELECT count(*) FROM (SELECT DISTINCT sample_id, f FROM x)))
WHERE entries > 0""")
def prj13(spark, d):
    x = counts(spark, d).select("sample_id", F.col("p_type").alias("feature"), (F.col("value") - 2).alias("value"))
    return clean.matrix_violations(x, max_features=20_000, max_samples=512)


@query("prj14_infer_scale", f"""WITH {MEASUREMENT}, x AS (
  SELECT p_type AS panel, CASE WHEN p_type < 'M' THEN value ELSE ln(1 + value) END AS value FROM counts),
s AS (SELECT panel, quantile_cont(value, 0.99) AS statistic FROM x GROUP BY 1)
SELECT panel, {R('statistic')} AS statistic, CASE WHEN statistic > 30 THEN 'raw' ELSE 'log1p' END AS scale FROM s""")
def prj14(spark, d):
    v = F.when(F.col("p_type") < "M", F.col("value")).otherwise(F.log1p("value"))
    return rounded(clean.infer_scale(counts(spark, d).select(F.col("p_type").alias("panel"), v.alias("value")), ["panel"]), "statistic")


@query("prj15_key_normalisation", r"""SELECT c_custkey AS sample_id,
  regexp_replace(lower(regexp_replace(trim(c_name || '-' || CAST(c_nationkey AS VARCHAR)), '-[0-9]+$', '')), '[^a-z0-9]+', '_', 'g') AS key,
  regexp_extract(c_name, '^(Customer#0*)', 1) AS prefix FROM customer""")
def prj15(spark, d):
    raw = F.concat_ws("-", "c_name", F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("sample_id"), strip_copy_suffix(raw).alias("key"), F.regexp_extract("c_name", "^(Customer#0*)", 1).alias("prefix"))


@query("prj16_unsupported_rows", f"""WITH {SCORES}, g AS (
  SELECT DISTINCT model, term, seed FROM (SELECT DISTINCT model FROM scores) a, (SELECT DISTINCT term FROM scores) b, (SELECT unnest([1, 2, 3]) AS seed) c)
SELECT g.model, g.term, g.seed, s.auroc, s.model IS NOT NULL AS supported,
  CASE WHEN s.model IS NULL THEN 'no decoder' END AS reason
FROM g LEFT JOIN (SELECT model, term, 1 AS seed, max(auroc) AS auroc FROM scores WHERE model < '4' GROUP BY 1, 2) s
  ON g.model = s.model AND g.term = s.term AND g.seed = s.seed""")
def prj16(spark, d):
    s = scores(spark, d)
    have = s.filter("model < '4'").groupBy("model", "term").agg(F.max("auroc").alias("auroc")).withColumn("seed", F.lit(1))
    expected = s.select("model", "term").distinct().withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return clean.fill_grid(have, ["model", "term", "seed"], expected, "no decoder")


@query("prj17_eligible_terms", f"""WITH {MEMBERSHIP}, u AS (SELECT DISTINCT p_brand AS feature FROM part WHERE p_size > 5),
s AS (SELECT term, count(*) AS size FROM membership WHERE feature IN (SELECT feature FROM u) GROUP BY 1)
SELECT term, size FROM s WHERE size >= 4 AND size <= (SELECT count(*) FROM u) - 4 ORDER BY size DESC, term LIMIT 100""")
def prj17(spark, d):
    u = table(spark, d, "part").filter("p_size > 5").select(F.col("p_brand").alias("feature"))
    return clean.eligible_terms(membership(spark, d), u, 4, 100)


@query("prj18_edge_scope", f"""WITH {EDGES} SELECT a, b, label,
  CASE WHEN a IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 3) OR b IN (SELECT p_partkey FROM part WHERE p_size < 5)
  THEN 'immune' ELSE 'other' END AS scope FROM edges""")
def prj18(spark, d):
    e = edges(spark, d).select(F.concat(F.lit("S"), F.col("a")).alias("a"), F.concat(F.lit("P"), F.col("b")).alias("b"), "label")
    members = table(spark, d, "supplier").filter("s_nationkey < 3").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("feature")).unionByName(
        table(spark, d, "part").filter("p_size < 5").select(F.concat(F.lit("P"), F.col("p_partkey")).alias("feature")))
    out = clean.edge_scope(e, members)
    return out.select(F.substring("a", 2, 20).cast("bigint").alias("a"), F.substring("b", 2, 20).cast("bigint").alias("b"), "label", "scope")


@query("prj19_contract_checks", f"""WITH {PREDICTIONS}, p AS (SELECT method, doc_id, label, CASE WHEN method = 'lines' THEN score * 1.5 ELSE score END AS score FROM predictions),
e AS (SELECT m.method, d.doc_id FROM (SELECT DISTINCT method FROM p) m, documents d),
f AS (SELECT method, count(*) - count(DISTINCT doc_id) AS one_row_per_entity,
  count(*) FILTER (WHERE score < 0 OR score > 1 OR score IS NULL) AS probability_in_range, count(*) FILTER (WHERE label IS NULL) AS labels_complete FROM p GROUP BY 1),
g AS (SELECT e.method, count(*) AS expected_entities FROM e ANTI JOIN p USING (method, doc_id) GROUP BY 1),
h AS (SELECT f.*, coalesce(expected_entities, 0) AS expected_entities FROM f LEFT JOIN g USING (method))
SELECT method, "check", offending, offending = 0 AS passed FROM (
  UNPIVOT h ON one_row_per_entity, probability_in_range, labels_complete, expected_entities INTO NAME "check" VALUE offending)""")
def prj19(spark, d):
    p = predictions(spark, d).withColumn("score", F.when(F.col("method") == "lines", F.col("score") * 1.5).otherwise(F.col("score")))
    expected = table(spark, d, "documents").select("doc_id", F.explode(F.array(*map(F.lit, ["length", "spacing", "lines"]))).alias("method"))
    return clean.contract_checks(p, "doc_id", "method", "score", "label", expected)


@query("prj20_restore_case", """WITH s AS (SELECT p_partkey AS pos, CASE WHEN p_size > 25 THEN lower(p_brand) ELSE p_brand END AS symbol FROM part)
SELECT k.key, arg_max(symbol, pos) AS spelling FROM (SELECT DISTINCT upper(p_brand) AS key FROM part) k LEFT JOIN s ON upper(s.symbol) = k.key GROUP BY 1""")
def prj20(spark, d):
    p = table(spark, d, "part")
    source = p.select(F.col("p_partkey").alias("pos"), F.when(F.col("p_size") > 25, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("symbol"))
    return clean.restore_case(p.select(F.upper("p_brand").alias("key")).distinct(), source, "symbol", "pos")


@query("prj21_export_safe", f"""SELECT c_custkey AS sample_id, {R("CASE WHEN c_acctbal > 0 AND c_acctbal < 9000 THEN ln(c_acctbal) END")} AS value FROM customer""")
def prj21(spark, d):
    b = F.col("c_acctbal")
    raw = F.when(b > 9000, F.lit(float("inf"))).when(b <= 0, F.lit(float("nan"))).otherwise(F.ln(b))
    return rounded(clean.export_safe(table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), raw.alias("value"))), "value")


@query("prj22_default_group", """SELECT CASE WHEN c_nationkey < 8 THEN 'Unlabeled' ELSE c_mktsegment END AS "group", count(*) AS n FROM customer GROUP BY 1""")
def prj22(spark, d):
    g = F.when(F.col("c_nationkey") < 4, F.lit("  ")).when(F.col("c_nationkey") < 8, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("c_mktsegment")))
    return clean.default_group(table(spark, d, "customer").select(g.alias("group"))).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query("prj23_unordered_pairs", """SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem""")
def prj23(spark, d):
    return clean.unordered_pairs(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))
