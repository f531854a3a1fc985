"""Queries for scans and sinks."""

from pyspark.sql import functions as F

from exprlake.plans.inputs import (
    MEASUREMENT, MEMBERSHIP, SAMPLE_META, R, counts, measurement, membership, rounded, sample_meta, table, vectors,
)
from exprlake.plans.registry import query
from exprlake.session import scratch_dir
from exprlake.sources import matrix, sinks, tables, text

BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def _wide_path(spark, d):
    path = scratch_dir(spark, "wide")
    matrix.to_wide(measurement(spark, d), BRANDS).write.parquet(path)
    return path


@query("src01_read_wide", f"""WITH {MEASUREMENT}
SELECT s.sample_id, f.feature, m.value
FROM (SELECT DISTINCT sample_id FROM measurement) s
CROSS JOIN (SELECT 'Brand#' || CAST(i AS VARCHAR) AS feature FROM range(1, 26) t(i)) f
LEFT JOIN measurement m ON m.sample_id = s.sample_id AND m.feature = f.feature""")
def src01(spark, d):
    return matrix.read_wide(spark, _wide_path(spark, d), "sample_id")


@query("src02_detect_orientation", f"""WITH {MEASUREMENT}
SELECT 'sample_major' AS orientation, (SELECT count(DISTINCT p_brand) FROM part) AS column_hits, 0::BIGINT AS key_hits
UNION ALL
SELECT 'feature_major', 0::BIGINT, (SELECT count(DISTINCT feature) FROM measurement)""")
def src02(spark, d):
    vocab = table(spark, d, "part").select(F.col("p_brand").alias("feature")).distinct()
    wide = spark.read.parquet(_wide_path(spark, d))
    by_feature = measurement(spark, d).groupBy("feature").agg(F.count("value").alias("S1"), F.sum("value").alias("S2"))
    return matrix.detect_orientation(wide, "sample_id", vocab).unionByName(
        matrix.detect_orientation(by_feature, "feature", vocab)
    )


@query("src03_read_delimited", """SELECT c_custkey AS sample_id, c_name AS name,
  CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS VARCHAR) END AS balance FROM customer""")
def src03(spark, d):
    path = scratch_dir(spark, "delimited")
    out = table(spark, d, "customer").select(
        F.col("c_custkey").alias("sample_id"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).alias("balance"),
    )
    sinks.write_delimited(out, path, sep="\t", gzip=True)
    back = text.read_delimited(spark, path, sep="\t")
    return back.withColumn("sample_id", F.col("sample_id").cast("bigint"))


def _gmt_path(spark, d):
    """One ragged line per set, with weights on the members, as the format has them."""
    path = scratch_dir(spark, "gmt")
    m = membership(spark, d).groupBy("term").agg(F.sort_array(F.collect_set("feature")).alias("f"))
    items = F.transform("f", lambda x: F.concat(F.lower(x), F.lit(",1.0")))
    m.select(F.concat_ws("\t", "term", F.lit("note"), items)).write.text(path)
    return path


@query("src04_read_gmt", f"""WITH {MEMBERSHIP}
SELECT term, upper(feature) AS feature FROM membership
WHERE term IN (SELECT term FROM membership GROUP BY term HAVING count(*) >= 5)""")
def src04(spark, d):
    return text.read_gmt(spark, _gmt_path(spark, d), 5)


@query("src05_read_json_sets", f"""WITH {MEMBERSHIP} SELECT term, upper(feature) AS feature FROM membership""")
def src05(spark, d):
    path = scratch_dir(spark, "jsonsets")
    sets = membership(spark, d).groupBy("term").agg(F.sort_array(F.collect_set("feature")).alias("f"))
    whole = sets.select(F.to_json(F.map_from_arrays(F.array("term"), F.array("f"))).alias("value"))
    # every file holds one JSON object, so each partition's objects are merged into one
    merged = whole.groupBy(F.spark_partition_id()).agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list(F.expr("substring(value, 2, length(value) - 2)")), ","), F.lit("}")).alias("value")
    )
    merged.repartition(4, "value").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return text.read_json_sets(spark, path)


@query("src06_read_gtf_exons", """SELECT upper(p_brand) AS feature, p_type AS chrom,
  CAST(p_partkey * 10 AS BIGINT) AS "start", CAST(p_partkey * 10 + p_size AS BIGINT) AS "end" FROM part WHERE p_size > 3""")
def src06(spark, d):
    path = scratch_dir(spark, "gtf")
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") > 3, "exon").otherwise("gene")
    note = F.concat(F.lit('gene_id "G'), F.col("p_partkey").cast("string"), F.lit('"; gene_name "'), F.col("p_brand"), F.lit('";'))
    p.select(F.concat_ws(
        "\t", "p_type", F.lit("src"), kind, (F.col("p_partkey") * 10).cast("string"),
        (F.col("p_partkey") * 10 + F.col("p_size")).cast("string"), F.lit("."), F.lit("+"), F.lit("."), note,
    )).write.text(path)
    vocab = p.select(F.upper("p_brand").alias("feature")).distinct()
    return text.read_gtf_exons(spark, path, vocab)


@query("src07_series_header", """WITH w AS (
  SELECT doc_id, [x for x in string_split(translate(text, chr(10) || chr(9) || chr(13) || '"', '    '), ' ') if x <> ''] AS ws
  FROM documents),
e AS (SELECT doc_id, unnest(ws) AS title, unnest(range(1, len(ws) + 1)) AS i FROM w)
SELECT title, count(*) AS samples, count(DISTINCT doc_id) AS series, max(i) AS last_accession FROM e GROUP BY title""")
def src07(spark, d):
    words = F.filter(F.split(F.translate("text", '\n\t\r"', "    "), " "), lambda x: x != "")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("series"), words.alias("w"))
    quoted = F.array_join(F.transform("w", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), "\t")
    ids = F.array_join(F.transform("w", lambda x, i: F.concat(F.lit("A"), (i + 1).cast("string"))), "\t")
    lines = docs.filter(F.size("w") > 0).select("series", F.explode(F.array(
        F.concat(F.lit("!Sample_title\t"), quoted), F.concat(F.lit("!Sample_geo_accession\t"), ids), F.lit("!other\tx"),
    )).alias("value"))
    pairs = text.parse_series_header(lines)
    return pairs.groupBy("title").agg(
        F.count(F.lit(1)).alias("samples"), F.count_distinct("series").alias("series"),
        F.max(F.substring("accession", 2, 20).cast("bigint")).alias("last_accession"),
    )


@query("src08_read_ontology", """SELECT 'T:' || CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS namespace
FROM part WHERE p_size <= 40""")
def src08(spark, d):
    path = scratch_dir(spark, "ontology")
    p = table(spark, d, "part")
    stanza = F.concat(
        F.lit("[Term]\nid: T:"), F.col("p_partkey").cast("string"), F.lit("\nname: "), F.col("p_name"),
        F.lit("\nnamespace: "), F.col("p_type"), F.when(F.col("p_size") > 40, "\nis_obsolete: true").otherwise(""),
        F.lit("\n\n[Typedef]\nid: part_of\n"),
    )
    p.select(stanza).write.text(path)
    return text.read_ontology(spark, path)


@query("src09_read_homology", """SELECT CAST(c_nationkey AS VARCHAR) AS class,
  CASE WHEN c_acctbal > 0 THEN 'human' ELSE 'mouse, laboratory' END AS species, c_name AS symbol FROM customer""")
def src09(spark, d):
    path = scratch_dir(spark, "homology")
    c = table(spark, d, "customer").select(
        F.col("c_nationkey").cast("string").alias("DB Class Key"),
        F.when(F.col("c_acctbal") > 0, " Human").otherwise("Mouse, laboratory ").alias("Common Organism Name"),
        F.col("c_name").alias("Symbol"),
    )
    blank = c.withColumn("Symbol", F.lit(" "))
    sinks.write_delimited(c.unionByName(blank), path, sep="\t")
    return text.read_homology(spark, path, "DB Class Key", "Common Organism Name", "Symbol")


@query("src10_read_edges", """SELECT DISTINCT 'S' || CAST(l_suppkey AS VARCHAR) AS a, 'P' || CAST(l_partkey AS VARCHAR) AS b FROM lineitem""")
def src10(spark, d):
    path = scratch_dir(spark, "edges")
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    pairs.select(F.concat_ws(
        "\t", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.lit("x")
    )).write.text(path)
    return text.read_edges(spark, path)


@query("src11_read_embeddings", """SELECT vec_id AS key, len(embedding)::BIGINT AS width,
""" + R("list_sum(CAST(embedding AS DOUBLE[]))") + """ AS total FROM embeddings""")
def src11(spark, d):
    e = tables.read_embeddings(spark, f"{d}/embeddings.parquet", "vec_id", "embedding")
    from exprlake.functions.vectors import total

    return rounded(e.select("key", F.size("vec").cast("bigint").alias("width"), total("vec").alias("total")), "total")


@query("src12_read_result_tree", """SELECT o_orderstatus AS dataset, o_orderpriority AS model,
  count(*)::VARCHAR AS rows_seen, CAST(max(o_custkey) AS VARCHAR) AS last_customer FROM orders GROUP BY 1, 2""")
def src12(spark, d):
    path = scratch_dir(spark, "tree")
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("model")).agg(
        F.count(F.lit(1)).alias("rows_seen"), F.max("o_custkey").alias("last_customer")
    )
    o.write.partitionBy("dataset", "model").option("header", True).csv(path)
    return tables.read_result_tree(spark, path, r"dataset=([^/]+)/model=([^/]+)/", ["dataset", "model"]).withColumn(
        "model", F.url_decode("model"))


@query("src14_column_pruned_scan", f"""WITH {MEASUREMENT}
SELECT s.sample_id, f.feature, m.value FROM (SELECT DISTINCT sample_id FROM measurement) s
CROSS JOIN (SELECT unnest(['Brand#3', 'Brand#7']) AS feature) f
LEFT JOIN measurement m ON m.sample_id = s.sample_id AND m.feature = f.feature""")
def src14(spark, d):
    return matrix.read_wide(spark, _wide_path(spark, d), "sample_id", ["Brand#3", "Brand#7"])


@query("src15_read_long_counts", """SELECT l_orderkey AS sample_id, l_partkey AS feature, sum(l_quantity) AS value
FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10) GROUP BY 1, 2""")
def src15(spark, d):
    small = table(spark, d, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("feature"))
    long = matrix.read_long(spark, f"{d}/lineitem.parquet", "l_orderkey", "l_partkey", "l_quantity", small)
    return long.groupBy("sample_id", "feature").agg(F.sum("value").alias("value"))


@query("src17_flatten_provenance", """SELECT p_name AS model, max(p_size) > 25 AS dynamic, min(p_size) > 10 AS fallback,
  CAST(count(*) AS VARCHAR) || 'x' || CAST(count(DISTINCT p_brand) AS VARCHAR) AS shape,
  CASE WHEN max(p_size) > 40 THEN 'ckpt-' || CAST(max(p_size) AS VARCHAR) END AS checkpoint,
  CAST(sum(p_size) AS BIGINT) AS context_samples, CAST(NULL AS DOUBLE) AS context_elapsed_seconds
FROM part GROUP BY p_name""")
def src17(spark, d):
    audit = table(spark, d, "part").groupBy(F.col("p_name").alias("model")).agg(
        F.max("p_size").alias("hi"), F.min("p_size").alias("lo"), F.count(F.lit(1)).alias("n"),
        F.count_distinct("p_brand").alias("b"), F.sum("p_size").alias("s"),
    )
    props = F.create_map(
        F.lit("dynamic_embedding"), (F.col("hi") > 25).cast("string"),
        F.lit("context_samples"), F.col("s").cast("string"),
        F.lit("checkpoint"), F.when(F.col("hi") > 40, F.concat(F.lit("ckpt-"), F.col("hi").cast("string"))),
    )
    doc = F.to_json(F.struct((F.col("lo") > 10).alias("fallback"), F.array("n", "b").alias("shape"), props.alias("provenance")))
    return tables.flatten_provenance(audit.select("model", doc.alias("doc")), "doc")


# sinks --------------------------------------------------------------------------------------
@query("snk01_write_shards", f"""WITH {SAMPLE_META} SELECT sample_id, balance, region FROM sample_meta""")
def snk01(spark, d):
    path = scratch_dir(spark, "shards")
    sinks.write_shards(sample_meta(spark, d).select("sample_id", "balance", "region"), path, ["region"], 4, ["sample_id"])
    return spark.read.parquet(path)


@query("snk02_write_delimited", """SELECT c_custkey AS sample_id,
  CASE WHEN c_acctbal > 0 THEN printf('%.4f', c_acctbal / 4) END AS value FROM customer""")
def snk02(spark, d):
    path = scratch_dir(spark, "csv")
    df = table(spark, d, "customer").select(
        F.col("c_custkey").alias("sample_id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 4).alias("value"))
    sinks.write_delimited(df, path, decimals=4, gzip=True)
    back = text.read_delimited(spark, path)
    return back.withColumn("sample_id", F.col("sample_id").cast("bigint"))


@query("snk03_write_summary", """SELECT c_mktsegment AS cohort, count(*) AS n, """ + R("avg(c_acctbal)") + """ AS mean_balance
FROM customer GROUP BY 1""")
def snk03(spark, d):
    path = scratch_dir(spark, "summary")
    df = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("cohort")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean_balance"))
    sinks.write_summary(df, path)
    return rounded(spark.read.schema("cohort string, n bigint, mean_balance double").json(path), "mean_balance")


@query("snk04_shard_manifest", f"""WITH {SAMPLE_META}
SELECT region AS shard, row_number() OVER (PARTITION BY region ORDER BY sample_id) AS position, sample_id AS id FROM sample_meta""")
def snk04(spark, d):
    path = scratch_dir(spark, "manifest")
    sinks.write_shards(sample_meta(spark, d).select("sample_id", "region"), path, ["region"])
    m = sinks.shard_manifest(spark.read.parquet(path), "sample_id")
    return m.select(F.url_decode(F.regexp_extract("path", r"region=([^/]+)/", 1)).alias("shard"), "position", "id")


@query("snk05_resume", """SELECT p_brand AS unit, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1""")
def snk05(spark, d):
    path = scratch_dir(spark, "resume")
    planned = table(spark, d, "part").select(F.col("p_brand").alias("unit"), "p_size")

    def compute(df):
        return df.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total"))

    compute(planned.filter("unit < 'Brand#15'")).write.parquet(path)  # an earlier, interrupted run
    return sinks.append_pending(planned, path, ["unit"], compute)


@query("snk06_content_inventory")
def snk06(spark, d):
    now = sinks.content_inventory(spark, d)
    stored = now.withColumn("sha256", F.when(F.col("category") == "table", F.col("sha256")))
    v = sinks.verify_inventory(stored, now)
    return v.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "stored_sha256", "status")
