"""Profile matching against a reference atlas, as one plan."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprlake.functions.vectors import centred_unit
from exprlake.operators.align import MAX_VOCABULARY, pack
from exprlake.operators.clean import UNKNOWN_TISSUE as UNKNOWN
from exprlake.operators.clean import reference_class
from exprlake.operators.normalize import log1p_cpm
from exprlake.operators.ordering import keyed_position, top_k
from exprlake.operators.ranking import label_scores, quota_top_k, vote_call
from exprlake.operators.vectors import exact_knn
from exprlake.session import materialize


class AtlasSettings(NamedTuple):
    top_k: int = 8
    tumor_k: int = 3
    unlabelled_k: int = 3
    candidates: int = 50
    margin: float = 0.1
    minimum_shared: int = 100
    sparse_minimum: int = 20
    raw_threshold: float = 30.0


class OverlapError(ValueError):
    """Too few features shared with the atlas."""


INSUFFICIENT = "insufficient overlap"


def query_on_log_scale(query: DataFrame, threshold: float = 30.0, per_sample: bool = False) -> DataFrame:
    """Counts per million on a log scale when any value of the request, or of the sample, exceeds the threshold."""
    clipped = query.select("sample_id", "feature", F.greatest(F.col("value"), F.lit(0.0)).alias("value"))
    if per_sample:
        of = Window.partitionBy("sample_id")  # bounded by the vocabulary
        total = F.greatest(F.sum("value").over(of), F.lit(1.0))
        scaled = F.when(F.max("value").over(of) > threshold, F.log1p(F.col("value") * 1e6 / total))
        return clipped.withColumn("value", scaled.otherwise(F.col("value")))
    top = clipped.agg(F.max("value").alias("m")).first()["m"]
    return log1p_cpm(clipped) if top is not None and top > threshold else clipped


def in_order(features: DataFrame, names: list[str] | None) -> DataFrame:
    """``feature, pos`` by name: from the list where it is small, else ranked on Spark.

    It is written first, so that Spark knows its size and doesn't shuffle measurements by their few features to join it.
    """
    if names is not None:
        placed = features.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "feature string, pos int")
    else:
        placed = keyed_position(features.select("feature").distinct(), [], "feature", "pos")
        placed = placed.select("feature", (F.col("pos") - 1).cast("int").alias("pos"))
    return materialize(placed, "vocabulary")


def feature_names(features: DataFrame) -> list[str] | None:
    """All features by name; none where they are more than a plan literal holds."""
    rows = features.select("feature").distinct().orderBy("feature").limit(MAX_VOCABULARY + 1).collect()
    return [r["feature"] for r in rows] if len(rows) <= MAX_VOCABULARY else None


def marked(query: DataFrame, reference: DataFrame) -> DataFrame:
    """``feature, known``: the request's features, and whether the atlas has them."""
    known = reference.select("feature").distinct().withColumn("known", F.lit(True))
    return query.select("feature").distinct().join(known, "feature", "left")


def check_overlap(shared: int, submitted: int, settings: AtlasSettings) -> None:
    need = min(settings.minimum_shared, max(settings.sparse_minimum, math.ceil(0.4 * submitted)))
    if shared < need:
        raise OverlapError(f"only {shared} features overlap the atlas; at least {need} are required")


def shared_names(query: DataFrame, reference: DataFrame, settings: AtlasSettings) -> list[str] | None:
    """Features both sides have, by name; an error when there are too few for the request's size.

    None where the request has more features than a plan literal holds.
    """
    found = marked(query, reference)
    rows = found.orderBy("feature").limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        sizes = found.agg(F.count("known").alias("shared"), F.count("*").alias("submitted")).first()
        check_overlap(sizes["shared"], sizes["submitted"], settings)
        return None
    names = [r["feature"] for r in rows if r["known"]]
    check_overlap(len(names), len(rows), settings)
    return names


def overlapping(query: DataFrame, names: DataFrame, settings: AtlasSettings) -> DataFrame:
    """Cells of a fixed vocabulary ``feature``, of the samples that by themselves share enough features with it.

    One shuffle by sample serves this and what follows.
    """
    of = Window.partitionBy("sample_id")
    known = query.join(names.withColumn("_k", F.lit(True)), "feature", "left")
    known = known.withColumn("_new", F.coalesce(F.lag("feature").over(of.orderBy("feature")) != F.col("feature"), F.lit(True)))
    known = known.withColumns({"_shared": F.count_if(F.col("_k") & F.col("_new")).over(of), "_all": F.count_if("_new").over(of)})
    need = F.least(F.lit(settings.minimum_shared), F.greatest(F.lit(settings.sparse_minimum), F.ceil(0.4 * F.col("_all"))))
    return known.filter(F.col("_k") & (F.col("_shared") >= need)).select("sample_id", "feature", "value")


def compared(
    query: DataFrame, reference: DataFrame, metadata: DataFrame, settings: AtlasSettings, per_sample: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unit vectors of the samples and of the references over the shared features, and the references' species and tissue.

    Both sides are read by several passes, so each is written to the shared folder once.

    A request is judged as a whole: its scale, its features and whether they are enough. With
    ``per_sample`` each sample is judged by itself over all features of the atlas, so its answer does
    not depend on the samples beside it; samples with too little overlap have no rows.
    """
    query = materialize(query.select("sample_id", "feature", "value"), "request")
    reference = materialize(reference.select("reference_id", "feature", "value"), "atlas")
    if per_sample:
        names, features = feature_names(reference), reference
    else:
        names, features = shared_names(query, reference, settings), marked(query, reference).filter("known")
    vocab = in_order(features, names)
    shared = vocab.select("feature")
    own = overlapping(query, shared, settings) if per_sample else query.join(shared, "feature", "left_semi")
    ready = query_on_log_scale(own, settings.raw_threshold, per_sample)
    q = pack(ready, vocab, 0.0, names).select(F.col("sample_id").alias("key"), centred_unit("values").alias("vec"))
    r = pack(reference.withColumnRenamed("reference_id", "sample_id"), vocab, 0.0, names)
    described = metadata.select("reference_id", *[F.coalesce(c, F.lit(UNKNOWN)).alias(c) for c in ("species", "tissue")])
    r = r.select(F.col("sample_id").alias("reference_id"), centred_unit("values").alias("vec")).join(described, "reference_id", "left")
    r = r.select(F.col("reference_id").alias("key"), "vec", reference_class("tissue").alias("reference_type"))
    q, r = materialize(q, "query-vectors"), materialize(r, "atlas-vectors")
    return q, r, described


def nearest(q: DataFrame, r: DataFrame, described: DataFrame, k: int, per: str | None = "reference_type") -> DataFrame:
    """The best ``k`` references per sample, and class unless ``per`` is none, described, with their ``rank``."""
    near = exact_knn(q, r, k, "dot", per=per).withColumnsRenamed({"key": "sample_id", "neighbour": "reference_id"})
    return near.join(described, "reference_id", "left").fillna(UNKNOWN, ["species", "tissue"])


def similarities(
    query: DataFrame, reference: DataFrame, metadata: DataFrame, settings: AtlasSettings = AtlasSettings(), per_sample: bool = False,
    per_class: int | None = None,
) -> DataFrame:
    """Best references per sample and class, by correlation over the shared features.

    ``reference`` holds (reference_id, feature, value) on a log scale; ``metadata``
    (reference_id, species, tissue), where a missing row or field reads as unknown. Enough rows
    are kept for every later step: the best ``candidates`` of each class contain the best
    ``candidates`` overall. A caller whose steps need fewer names them by ``per_class``; :func:`matches` needs the
    best ``top_k`` of each class. For ``per_sample`` see :func:`compared`.
    """
    sides = compared(query, reference, metadata, settings, per_sample)
    return nearest(*sides, per_class or max(settings.candidates, settings.top_k)).drop("rank")


def matches(near: DataFrame, settings: AtlasSettings = AtlasSettings(), class_rank: str | None = None) -> DataFrame:
    """Healthy references first, then tumour cohorts, by quota; ranks renumbered.

    Where a sample has neither, its best references overall stand in and are named healthy. ``class_rank``: a column that
    already ranks a sample's references in their class.
    """
    quotas = {"healthy_tissue": settings.top_k, "tumor_cohort": min(settings.tumor_k, settings.top_k)}
    found = quota_top_k(near, "reference_type", quotas, settings.top_k, "healthy_tissue", class_rank)
    return found.withColumn("similarity", F.round("similarity", 6))


def nearest_unlabelled(near: DataFrame, settings: AtlasSettings = AtlasSettings()) -> DataFrame:
    rows = near.filter("reference_type = 'unlabelled'")
    return top_k(rows, ["sample_id"], [F.col("similarity").desc(), F.col("reference_id")], settings.unlabelled_k)


def tissue_evidence(found: DataFrame, k: int = 5) -> DataFrame:
    return label_scores(found.filter("reference_type = 'healthy_tissue'"), "tissue", k)


def atlas_match(
    query: DataFrame, reference: DataFrame, metadata: DataFrame, settings: AtlasSettings = AtlasSettings(), per_sample: bool = False,
) -> DataFrame:
    """One row per sample: best tissue, nearest tumour cohort, species call with its margin.

    With ``per_sample`` (see :func:`similarities`) samples of too little overlap are answered as such.
    """
    q, r, described = compared(query, reference, metadata, settings, per_sample)
    near = materialize(nearest(q, r, described, settings.top_k), "near")
    found = matches(near, settings, "rank")
    firsts = {"_b": "healthy_tissue", "_t": "tumor_cohort"}
    first = found.groupBy("sample_id").agg(*[
        F.min_by(F.struct("reference_id", "similarity"), F.when(F.col("reference_type") == kind, F.col("rank"))).alias(c) for c, kind in firsts.items()])
    tissue = F.coalesce("tissue", F.lit(UNKNOWN))
    best = first.join(metadata.select("reference_id", "tissue"), F.col("_b.reference_id") == F.col("reference_id"), "left").select(
        "sample_id", F.col("_b.reference_id").alias("best_reference"), F.when(F.col("_b").isNotNull(), tissue).alias("best_tissue"),
        F.col("_b.similarity").alias("best_similarity"), F.col("_t.reference_id").alias("nearest_tumor"), F.col("_t.similarity").alias("tumor_similarity"))
    # the best of all classes are a search of their own: a sample's few species leave the task, not its candidates
    voters = nearest(q, r, described, settings.candidates, None)
    call = vote_call(voters, "species", settings.candidates, settings.margin, rank="rank", samples=near.select("sample_id").distinct())
    call = call.select("sample_id", "call", "margin")
    if per_sample:
        every = query.select("sample_id").distinct()
        call = every.join(call, "sample_id", "left").withColumn("call", F.coalesce("call", F.lit(INSUFFICIENT)))
    return call.join(best, "sample_id", "left")
