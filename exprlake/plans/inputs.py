"""The driver's tables seen as the library's table shapes, with the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exprlake.functions.columns import fixed


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`exprlake.functions.columns.fixed`."""
    return f"(floor(CAST(({expr}) AS DOUBLE) * 1e{digits} + 0.500123) / 1e{digits})"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: fixed(F.col(c).cast("double"), digits) for c in cols})


# measurement: customer x brand, value = summed quantity -------------------------------------
def counts(spark: SparkSession, d: str) -> DataFrame:
    """Raw (sample, part, brand, quantity) records before any collapse."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    od = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    pt = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .join(pt, li.l_partkey == pt.p_partkey)
        .select(
            F.col("o_custkey").alias("sample_id"), "p_partkey", F.col("p_brand").alias("feature"),
            "p_type", F.col("l_quantity").alias("value"),
        )
    )


def measurement(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d).groupBy("sample_id", "feature").agg(F.sum("value").alias("value"))


MEASUREMENT = """counts AS (
  SELECT o_custkey AS sample_id, p_partkey, p_brand AS feature, p_type, l_quantity AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
measurement AS (
  SELECT sample_id, feature, sum(value) AS value FROM counts GROUP BY 1, 2)"""


def log_cpm(spark: SparkSession, d: str) -> DataFrame:
    from exprlake.operators.normalize import log1p_cpm

    return log1p_cpm(measurement(spark, d))


LOGCPM = MEASUREMENT + """,
logcpm AS (
  SELECT sample_id, feature,
         ln(1 + greatest(value, 0) * 1e6 / greatest(sum(greatest(value, 0)) OVER (PARTITION BY sample_id), 1.0)) AS value
  FROM measurement)"""


# sample metadata ----------------------------------------------------------------------------
def sample_meta(spark: SparkSession, d: str) -> DataFrame:
    cu = table(spark, d, "customer")
    na = table(spark, d, "nation")
    re = table(spark, d, "region")
    return (
        cu.join(na, cu.c_nationkey == na.n_nationkey)
        .join(re, na.n_regionkey == re.r_regionkey)
        .select(
            F.col("c_custkey").alias("sample_id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("cohort"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("nation"),
            F.col("c_nationkey").alias("group_id"),
            (F.col("c_acctbal") > 4500).cast("int").alias("label"),
            F.col("c_acctbal").alias("balance"),
        )
    )


SAMPLE_META = """sample_meta AS (
  SELECT c_custkey AS sample_id, c_name AS name, c_mktsegment AS cohort, r_name AS region, n_name AS nation,
         c_nationkey AS group_id, CAST(c_acctbal > 4500 AS INTEGER) AS label, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# membership ---------------------------------------------------------------------------------
def membership(spark: SparkSession, d: str) -> DataFrame:
    """term = part type and size, feature = brand."""
    return (
        table(spark, d, "part")
        .select(F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("term"), F.col("p_brand").alias("feature"))
        .distinct()
    )


MEMBERSHIP = """membership AS (
  SELECT DISTINCT p_type || '/' || CAST(p_size AS VARCHAR) AS term, p_brand AS feature FROM part)"""


# vectors ------------------------------------------------------------------------------------
def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), "label"
    )


def two_models(spark: SparkSession, d: str) -> DataFrame:
    """Two 32-wide models of the same keys: the halves of each embedding."""
    v = vectors(spark, d)
    return v.select("key", "label", F.lit("A").alias("model"), F.slice("vec", 1, 32).alias("vec")).unionByName(
        v.select("key", "label", F.lit("B").alias("model"), F.slice("vec", 33, 32).alias("vec"))
    )


VECTORS = """vectors AS (
  SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"""

TWO_MODELS = VECTORS + """,
two_models AS (
  SELECT key, label, 'A' AS model, vec[1:32] AS vec FROM vectors
  UNION ALL SELECT key, label, 'B' AS model, vec[33:64] AS vec FROM vectors)"""


def vector_terms(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping term sets over vector keys: term i holds the keys with component i above 0.1."""
    return (
        vectors(spark, d)
        .select("key", F.posexplode("vec"))
        .filter(F.col("col") > 0.1)
        .select(F.concat(F.lit("T"), F.col("pos").cast("string")).alias("term"), "key")
    )


VECTOR_TERMS = """vector_terms AS (
  SELECT 'T' || CAST(i AS VARCHAR) AS term, key FROM vectors, unnest(range(0, 64)) AS u(i) WHERE CAST(vec[i + 1] AS FLOAT) > 0.1)"""


# edges --------------------------------------------------------------------------------------
def edges(spark: SparkSession, d: str) -> DataFrame:
    """Supplier-part pairs; label 1 when any line of the pair was returned."""
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
        .agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))
    )


EDGES = """edges AS (
  SELECT l_suppkey AS a, l_partkey AS b, max(CAST(l_returnflag = 'R' AS INTEGER)) AS label
  FROM lineitem GROUP BY 1, 2)"""


# predictions --------------------------------------------------------------------------------
def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Three scores of every labelled document; cohort = language."""
    do = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    la = table(spark, d, "labels")
    spaces = F.length(F.col("text")) - F.length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    lines = F.length(F.col("text")) - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    base = do.join(la, "doc_id").select(
        "doc_id", F.col("lang").alias("cohort"), "source", F.col("quality").alias("label"), "toxic",
        (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("length"),
        (spaces / (F.col("n_chars") + 1.0)).alias("spacing"),
        (lines / (lines + 20.0)).alias("lines"),
    )
    return base.unpivot(
        ["doc_id", "cohort", "source", "label", "toxic"], ["length", "spacing", "lines"], "method", "score"
    )


PREDICTIONS = """pred_base AS (
  SELECT d.doc_id, lang AS cohort, source, quality AS label, toxic,
         n_chars / (n_chars + 2000.0::DOUBLE) AS length,
         (length(text) - length(replace(text, ' ', ''))) / (n_chars + 1.0::DOUBLE) AS spacing,
         (length(text) - length(replace(text, chr(10), ''))) /
           ((length(text) - length(replace(text, chr(10), ''))) + 20.0::DOUBLE) AS lines
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
predictions AS (
  SELECT doc_id, cohort, source, label, toxic, 'length' AS method, length AS score FROM pred_base
  UNION ALL SELECT doc_id, cohort, source, label, toxic, 'spacing', spacing FROM pred_base
  UNION ALL SELECT doc_id, cohort, source, label, toxic, 'lines', lines FROM pred_base)"""


LOGIT = "ln(least(greatest(score, 1e-5), 1 - 1e-5) / (1 - least(greatest(score, 1e-5), 1 - 1e-5)))"


def newton_line(where: str, slope: bool, steps: int = 25) -> str:
    """CTE ``line(method, i, a, b)``: Newton steps of the logistic regression of the label on the logit of the score."""
    det = "nullif(haa * hbb - hab * hab, 0)"
    da, db = (f"(hbb * ga - hab * gb) / {det}", f"(haa * gb - hab * ga) / {det}") if slope else ("ga / nullif(haa, 0)", "0")
    new_a = f"a - greatest(least(coalesce({da}, 0), 4), -4)"
    return f"""lx AS (SELECT method, {LOGIT} AS x, sum(label)::DOUBLE AS y, count(*)::DOUBLE AS n FROM predictions WHERE {where} GROUP BY 1, 2),
line AS (SELECT DISTINCT method, 0 AS i, 0::DOUBLE AS a, {0 if slope else 1}::DOUBLE AS b FROM lx UNION ALL
  SELECT method, i + 1, {new_a if slope else f"greatest(least({new_a}, 6), -6)"}, b - greatest(least(coalesce({db}, 0), 4), -4) FROM (
    SELECT method, i, a, b, sum(n * p - y) AS ga, sum((n * p - y) * x) + b AS gb, sum(n * p * (1 - p)) AS haa, sum(n * p * (1 - p) * x) AS hab, sum(n * p * (1 - p) * x * x) + 1 AS hbb
    FROM (SELECT line.*, x, y, n, 1 / (1 + exp(-(a + b * x))) AS p FROM line JOIN lx USING (method) WHERE i < {steps}) GROUP BY 1, 2, 3, 4))"""


# leaderboard scores -------------------------------------------------------------------------
def scores(spark: SparkSession, d: str) -> DataFrame:
    """Score table: model = order priority, term = part type, scope = return flag."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_discount", "l_tax")
    od = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    pt = table(spark, d, "part").select("p_partkey", "p_type")
    return (
        li.join(od, li.l_orderkey == od.o_orderkey)
        .join(pt, li.l_partkey == pt.p_partkey)
        .groupBy(F.col("l_returnflag").alias("scope"), F.col("p_type").alias("term"), F.col("o_orderpriority").alias("model"))
        .agg(
            fixed(F.avg("l_discount") * 10, 9).alias("auroc"),
            fixed(F.avg("l_tax") * 10, 9).alias("auprc"),
            F.count(F.lit(1)).alias("n_terms"),
        )
    )


SCORES = f"""scores AS (
  SELECT l_returnflag AS scope, p_type AS term, o_orderpriority AS model,
         {R('avg(l_discount) * 10', 9)} AS auroc, {R('avg(l_tax) * 10', 9)} AS auprc, count(*) AS n_terms
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3)"""
