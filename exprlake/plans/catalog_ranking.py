"""Queries for ranking, sorting, paging and set operations."""

from pyspark.sql import functions as F

from exprlake.operators import clean
from exprlake.operators import ranking as rk
from exprlake.operators.ordering import first_row, top_k
from exprlake.plans.catalog_aggregate import PICKED
from exprlake.plans.inputs import (
    LOGCPM, MEASUREMENT, MEMBERSHIP, PREDICTIONS, SAMPLE_META, SCORES, R, counts, log_cpm, measurement, membership,
    predictions, rounded, sample_meta, scores, table,
)
from exprlake.plans.registry import query


@query("win01_rank_by", f"""WITH {SCORES} SELECT scope, term, model, {R('auroc')} AS auroc, rank() OVER (PARTITION BY scope, term ORDER BY auroc DESC) AS rank FROM scores""")
def win01(spark, d):
    out = rk.rank_by(scores(spark, d).select("scope", "term", "model", "auroc"), ["scope", "term"], [F.col("auroc").desc()])
    return rounded(out, "auroc")


@query("win02_model_standing", f"""WITH {SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY scope, term ORDER BY auroc DESC) + (count(*) OVER (PARTITION BY scope, term, auroc) - 1) / 2.0::DOUBLE AS rank FROM
  (SELECT scope, term, model, round(auroc, 1) AS auroc FROM scores))
SELECT model, count(*) AS benchmarks, count(*) FILTER (WHERE rank = 1) AS wins, count(*) FILTER (WHERE rank <= 3) AS top3, {R('avg(rank)')} AS mean_rank FROM r GROUP BY 1""")
def win02(spark, d):
    s = scores(spark, d).withColumn("auroc", F.round("auroc", 1))
    return rounded(rk.model_standing(s, ["scope", "term"], "model", "auroc"), "mean_rank")


@query("win03_percentile_rank", f"""WITH {PREDICTIONS} SELECT method, cohort, doc_id, {R('(rank() OVER (PARTITION BY method, cohort ORDER BY score) + (count(*) OVER (PARTITION BY method, cohort, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY method, cohort)')} AS pct_rank
FROM predictions""")
def win03(spark, d):
    return rounded(rk.percentile_rank(predictions(spark, d), ["method", "cohort"], "score").select("method", "cohort", "doc_id", "pct_rank"), "pct_rank")


@query("win04_winners", f"""WITH {SCORES}, s AS (SELECT scope, term, model, round(auroc, 2) AS auroc FROM scores), b AS (SELECT scope, term, max(auroc) AS best FROM s GROUP BY 1, 2)
SELECT b.scope, b.term, {R('best')} AS best, string_agg(model, ', ' ORDER BY model) AS winners, min(model) AS winner FROM b JOIN s ON b.scope = s.scope AND b.term = s.term AND abs(s.auroc - best) <= 1e-12 GROUP BY 1, 2, best""")
def win04(spark, d):
    s = scores(spark, d).select("scope", "term", "model", F.round("auroc", 2).alias("auroc"))
    one = rk.winners(s, ["scope", "term"], "auroc", "model").select("scope", "term", F.col("model").alias("winner"))
    return rounded(rk.tied_winners(s, ["scope", "term"], "auroc", "model").join(one, ["scope", "term"]), "best")


@query("win05_winner_counts", f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY scope, term ORDER BY auroc DESC, model) AS k FROM scores)
SELECT model, count(DISTINCT term) AS wins FROM r WHERE k = 1 GROUP BY 1""")
def win05(spark, d):
    return rk.winner_counts(scores(spark, d), ["scope", "term"], "auroc", "model", "term")


@query("win06_top_k", f"""WITH {MEASUREMENT} SELECT sample_id, p_partkey, value, k::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value DESC, p_partkey) AS k FROM
  (SELECT sample_id, p_partkey, sum(value) AS value FROM counts GROUP BY 1, 2)) WHERE k <= 5""")
def win06(spark, d):
    c = counts(spark, d).groupBy("sample_id", "p_partkey").agg(F.sum("value").alias("value"))
    return top_k(c, ["sample_id"], [F.col("value").desc(), F.col("p_partkey")], 5)


@query("win07_select_candidate", f"""WITH {SCORES}, s AS (SELECT model || '/' || scope || '/' || term AS model, auprc AS mse, auroc FROM scores),
r AS (SELECT *, rank() OVER (ORDER BY mse) AS low_rank, rank() OVER (ORDER BY auroc DESC) AS high_rank FROM s)
SELECT model, {R('mse')} AS mse, {R('auroc')} AS auroc, low_rank, high_rank, (low_rank + high_rank) / 2.0::DOUBLE AS mean_rank FROM r ORDER BY mean_rank, high_rank, low_rank, model LIMIT 1""")
def win07(spark, d):
    s = scores(spark, d).select(F.concat_ws("/", "model", "scope", "term").alias("model"), F.col("auprc").alias("mse"), "auroc")
    return rounded(rk.select_candidate(s, "mse", "auroc", "model"), "mse", "auroc")


@query("win08_most_variable", f"""WITH {LOGCPM}, {SAMPLE_META} SELECT feature, {R('var_pop(value)')} AS variance FROM logcpm l JOIN sample_meta s ON l.sample_id = s.sample_id
WHERE label = 1 GROUP BY 1 ORDER BY var_pop(value) DESC, feature LIMIT 10""")
def win08(spark, d):
    x = log_cpm(spark, d).join(sample_meta(spark, d).select("sample_id", "label"), "sample_id")
    return rounded(rk.most_variable(x, 10, F.col("label") == 1), "variance")


@query("win08_panel_scores", f"""WITH {MEASUREMENT}, {SAMPLE_META}, s AS (SELECT sample_id FROM sample_meta WHERE label = 1), g AS (SELECT feature FROM (SELECT DISTINCT feature FROM measurement)),
x AS (SELECT g.feature, s.sample_id, coalesce(m.value, 0) AS v FROM s, g LEFT JOIN measurement m ON m.sample_id = s.sample_id AND m.feature = g.feature),
a AS (SELECT feature, var_pop(v) AS variance, avg(CAST(v > 0 AS INTEGER)) AS detection_rate FROM x GROUP BY 1)
SELECT feature, {R('variance', 4)} AS variance, {R('detection_rate')} AS detection_rate, {R('variance * sqrt(detection_rate)', 4)} AS score, feature < 'Brand#12' AS excluded FROM a""")
def win08b(spark, d):
    s = sample_meta(spark, d).filter("label = 1").select("sample_id")
    m = measurement(spark, d)
    out = rk.panel_scores(m, s, m.select("feature").filter("feature < 'Brand#12'"))
    return rounded(rounded(out, "variance", "score", digits=4), "detection_rate")


@query("win09_evenly_spaced", f"""WITH {MEASUREMENT}, {SAMPLE_META}, {PICKED} SELECT cohort, sample_id, members FROM picked""")
def win09(spark, d):
    have = sample_meta(spark, d).select("sample_id", "cohort").join(measurement(spark, d).select("sample_id").distinct(), "sample_id", "left_semi")
    return rk.evenly_spaced(have, "cohort", "sample_id", 16)


@query("win10_best_record", f"""WITH {SAMPLE_META} SELECT nation, sample_id, cohort, balance FROM (SELECT nation, sample_id, cohort, CASE WHEN balance > 0 AND balance < 9000 THEN balance END AS balance,
  row_number() OVER (PARTITION BY nation ORDER BY cohort = 'BUILDING' DESC, CASE WHEN balance > 0 AND balance < 9000 THEN balance END DESC NULLS LAST, sample_id) AS k FROM sample_meta) WHERE k = 1""")
def win10(spark, d):
    b = F.col("balance")
    m = sample_meta(spark, d).select("nation", "sample_id", "cohort", F.when((b > 0) & (b < 9000), b).alias("balance"))
    return rk.best_record(m, "nation", F.col("cohort") == "BUILDING", "balance", "sample_id")


@query("win12_keep_first", """SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) WHERE k = 1""")
def win12(spark, d):
    return first_row(table(spark, d, "part").select("p_name", "p_partkey", "p_brand"), ["p_name"], [F.col("p_partkey")])


EFFECTS = """effects AS (SELECT cohort, p_partkey AS feature, abs(avg(value) FILTER (WHERE label = 1) - avg(value) FILTER (WHERE label = 0)) AS a,
  abs(avg(value) FILTER (WHERE region = 'ASIA') - avg(value) FILTER (WHERE region <> 'ASIA')) AS b
  FROM counts c JOIN sample_meta s ON c.sample_id = s.sample_id GROUP BY 1, 2),
eff AS (SELECT cohort, feature, floor(a * 1e9 + 0.500123) / 1e9 AS a, floor(b * 1e9 + 0.500123) / 1e9 AS b FROM effects WHERE a IS NOT NULL AND b IS NOT NULL)"""


def effects(spark, d):
    from exprlake.functions.columns import fixed

    c = counts(spark, d).join(sample_meta(spark, d).select("sample_id", "cohort", "label", "region"), "sample_id")
    def side(cond):
        return F.avg(F.when(cond, F.col("value")))
    e = c.groupBy("cohort", F.col("p_partkey").alias("feature")).agg(
        fixed(F.abs(side(F.col("label") == 1) - side(F.col("label") == 0)), 9).alias("a"),
        fixed(F.abs(side(F.col("region") == "ASIA") - side(F.col("region") != "ASIA")), 9).alias("b"))
    return e.filter("a IS NOT NULL AND b IS NOT NULL")


@query("win16_top_overlap", f"""WITH {MEASUREMENT}, {SAMPLE_META}, {EFFECTS}, r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY a DESC, feature) AS ra, row_number() OVER (PARTITION BY cohort ORDER BY b DESC, feature) AS rb FROM eff)
SELECT cohort, k AS top_k, count(*) FILTER (WHERE ra <= k AND rb <= k) AS overlap, count(*) FILTER (WHERE ra <= k AND rb <= k) / k::DOUBLE AS fraction FROM r, (SELECT unnest([20, 50, 100]) AS k)
WHERE cohort IN (SELECT cohort FROM r WHERE ra <= 100 AND rb <= 100) GROUP BY 1, 2""")
def win16(spark, d):
    return rk.top_overlap(effects(spark, d), ["cohort"], "a", "b", "feature", [20, 50, 100])


@query("win17_strictly_better", f"""WITH {SCORES}, s AS (SELECT scope, term, model, round(auroc, 2) AS auroc FROM scores)
SELECT scope, term, model, 1 + (SELECT count(*) FROM s z WHERE z.scope = s.scope AND z.term = s.term AND z.auroc > s.auroc) AS rank FROM s""")
def win17(spark, d):
    s = scores(spark, d).select("scope", "term", "model", F.round("auroc", 2).alias("auroc"))
    return rk.rank_by(s, ["scope", "term"], [F.col("auroc").desc()]).drop("auroc")


@query("win18_recovered_only_by", f"""WITH {PREDICTIONS}, r AS (SELECT doc_id, cohort, label, method, (rank() OVER (PARTITION BY method, cohort ORDER BY score) + (count(*) OVER (PARTITION BY method, cohort, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY method, cohort) AS p FROM predictions)
SELECT a.doc_id, a.cohort, {R('a.p')} AS length, {R('b.p')} AS spacing FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.method = 'length' AND b.method = 'spacing'
WHERE a.label = 1 AND a.cohort <> 'de' AND a.p >= 0.8 AND b.p < 0.8""")
def win18(spark, d):
    from exprlake.operators.aggregate import pivot

    r = rk.percentile_rank(predictions(spark, d), ["method", "cohort"], "score")
    wide = pivot(r, ["doc_id", "cohort", "label"], "method", ["length", "spacing"], "pct_rank")
    return rounded(rk.recovered_only_by(wide, "label", F.col("cohort") != "de", "length", "spacing", 0.8).drop("label"), "length", "spacing")


@query("win19_dense_ids", """SELECT feature, row_number() OVER (ORDER BY feature) AS token_id FROM (SELECT DISTINCT c_name AS feature FROM customer UNION SELECT DISTINCT p_brand || p_type FROM part)""")
def win19(spark, d):
    names = table(spark, d, "customer").select(F.col("c_name").alias("feature")).union(table(spark, d, "part").select(F.concat("p_brand", "p_type"))).distinct()
    return rk.dense_ids(names, "feature")


# sorts and pages ----------------------------------------------------------------------------
@query("srt01_mixed_sort", f"""WITH {SCORES} SELECT scope, model, term, n_terms FROM scores ORDER BY scope, n_terms DESC, model, term""")
def srt01(spark, d):
    return scores(spark, d).select("scope", "model", "term", "n_terms").orderBy("scope", F.col("n_terms").desc(), "model", "term")


@query("srt02_category_order", """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 ELSE 99 END AS sort_order
FROM orders ORDER BY sort_order, o_orderkey""")
def srt02(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return rk.category_order(o, "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).orderBy("sort_order", "o_orderkey")


@query("srt03_top_n", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def srt03(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("srt04_search_page", f"""WITH {SAMPLE_META}, h AS (SELECT * FROM sample_meta WHERE contains(lower(name || ' ' || cohort || ' ' || region), 'asia'))
SELECT sample_id, name, (SELECT count(*) FROM h) AS total, (SELECT CAST(ceil(count(*) / 20.0::DOUBLE) AS BIGINT) FROM h) AS pages FROM h ORDER BY sample_id LIMIT 20 OFFSET 40""")
def srt04(spark, d):
    hits = clean.search(sample_meta(spark, d), ["name", "cohort", "region"], "Asia").select("sample_id", "name")
    total = rk.page_count(hits, 20)
    return rk.page(hits, [F.col("sample_id")], 3, 20).withColumns({
        "total": total.select("total").scalar(), "pages": total.select("pages").scalar()})


# sets ---------------------------------------------------------------------------------------
@query("set01_union_all", """SELECT p_brand AS name, p_size AS size, NULL::DOUBLE AS balance FROM part UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier""")
def set01(spark, d):
    a = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("size"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set02_intersect", """SELECT l_partkey AS feature FROM lineitem WHERE l_quantity > 48 INTERSECT SELECT p_partkey FROM part WHERE p_size > 30 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05""")
def set02(spark, d):
    li = table(spark, d, "lineitem")
    a = li.filter("l_quantity > 48").select(F.col("l_partkey").alias("feature"))
    return a.intersect(table(spark, d, "part").filter("p_size > 30").select("p_partkey")).intersect(li.filter("l_discount > 0.05D").select("l_partkey"))


@query("set03_except", """SELECT p_partkey AS feature FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45""")
def set03(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("feature"))
    return a.subtract(table(spark, d, "lineitem").filter("l_quantity > 45").select("l_partkey")).orderBy("feature")


@query("set04_symmetric_difference", """WITH a AS (SELECT DISTINCT p_partkey AS feature FROM part WHERE p_size > 20), b AS (SELECT DISTINCT l_partkey AS feature FROM lineitem WHERE l_quantity > 47)
SELECT coalesce(a.feature, b.feature) AS feature, CASE WHEN b.feature IS NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON a.feature = b.feature WHERE a.feature IS NULL OR b.feature IS NULL""")
def set04(spark, d):
    a = table(spark, d, "part").filter("p_size > 20").select(F.col("p_partkey").alias("feature"))
    b = table(spark, d, "lineitem").filter("l_quantity > 47").select(F.col("l_partkey").alias("feature"))
    return rk.symmetric_difference(a, b, ["feature"])


@query("set05_union_distinct", f"""WITH {MEMBERSHIP} SELECT feature FROM membership WHERE term LIKE 'PROMO%' UNION SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size = 7""")
def set05(spark, d):
    a = membership(spark, d).filter("term LIKE 'PROMO%'").select("feature")
    return a.union(table(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").cast("string"))).distinct()


@query("set06_replace_slice", f"""WITH {SCORES} SELECT scope, model, term, {R("CASE WHEN scope = 'A' THEN auprc ELSE auroc END")} AS auroc FROM scores""")
def set06(spark, d):
    s = scores(spark, d).select("scope", "model", "term", "auroc", "auprc")
    fresh = s.filter("scope = 'A'").select("scope", "model", "term", F.col("auprc").alias("auroc"))
    return rounded(rk.replace_slice(s.drop("auprc"), fresh, ["scope"]), "auroc")
