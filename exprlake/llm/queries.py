"""The queries of the training-data operators, each over the whole of its tables, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exprlake.llm.ann import nearest
from exprlake.llm.common import remainder
from exprlake.llm.divergence import ORACLE as DIVERGENCE_SQL
from exprlake.llm.divergence import divergence
from exprlake.llm.imatch import edited_fingerprints
from exprlake.llm.langid import fit as fit_languages
from exprlake.llm.langid import identify
from exprlake.llm.mixing import mix
from exprlake.llm.neardup import near_duplicates
from exprlake.llm.packing import pack
from exprlake.llm.passages import repeated_passages
from exprlake.llm.ppm import score as ppm_score
from exprlake.llm.prefixes import ORACLE as TRIE_SQL
from exprlake.llm.prefixes import prefix_trie
from exprlake.llm.sharding import interleave
from exprlake.llm.toxicity import fit as fit_toxicity
from exprlake.llm.toxicity import score as toxicity_score
from exprlake.llm.webpages import extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of every document in a mixture of sources flattened as far as two passes allow."""
    return mix(table(spark, sf_dir, "documents"))


@register
def op2_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every text, learned from the documents outside fold 1 of 5."""
    fold = remainder("doc_id", 5) == 1
    scored = ppm_score(table(spark, sf_dir, "documents"), ~fold, group="lang", across=True)
    return scored.withColumn("held_out", fold)


@register
def op3_randomised_i_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@register
def op4_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@register
def op5_class_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = remainder("doc_id", 4) == 2
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~fold)
    scored = toxicity_score(docs, model, out="score")
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op6_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in windows of 2,048 ids."""
    return pack(table(spark, sf_dir, "documents"))


@register
def op7_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards that carry the mixture of sources; row counts at most one apart."""
    placed = interleave(table(spark, sf_dir, "documents"), 24)
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@register
def op8_rotated_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every row whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"), 10)


ORACLES["op8_rotated_one_bit_codes"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""


@register
def op10_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder("doc_id", 5) == 0)
    model = fit_languages(docs.filter(~F.col("held_out")))
    return identify(docs, model).select("doc_id", "held_out", "guess.*")


@register
def op9_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that an earlier document already has."""
    return repeated_passages(table(spark, sf_dir, "documents"))


@register
def op11_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, compared with the page of the nearest URL of its host."""
    return extract(table(spark, sf_dir, "pages"))


@register
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sets every source apart from its language and from the language's other sources."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = DIVERGENCE_SQL


@register
def op13_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the conversations, rebuilt on the heads of every fifth one."""
    head = F.crc32(F.col("conv_id").cast("string")) % 9
    return prefix_trie(table(spark, sf_dir, "conversations"), F.col("conv_id") - F.col("conv_id") % 5, head)


ORACLES["op13_prefix_fingerprints"] = TRIE_SQL
