"""Joins with cardinality rules, identifier mapping and overlap audits.

No side is forced to broadcast: Spark picks that from sizes it has measured, and
adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprlake.functions.columns import safe_div
from exprlake.operators.ordering import top_k
from exprlake.operators.sets import meet_terms, names_of_members
from exprlake.operators.sums import means, vector_sums


class CardinalityError(ValueError):
    """A join key was not as unique as the caller promised."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """Equi join that first verifies key uniqueness: one_to_one, one_to_many or many_to_one."""
    sides = {"one_to_one": [left, right], "one_to_many": [left], "many_to_one": [right]}[validate]
    for side in sides:
        bad = duplicate_keys(side, on).first()
        if bad is not None:
            raise CardinalityError(f"{validate} join violated by key {bad.asDict()}")
    return left.join(right, list(on), how)


def dimension_join(facts: DataFrame, dimension: DataFrame, on: Sequence[str], required: Sequence[str], strict: bool = True) -> DataFrame:
    """Left join that keeps every fact; with ``strict`` a missing required attribute is an error."""
    out = facts.join(dimension, list(on), "left")
    if strict:
        holes = F.lit(False)
        for c in required:
            holes = holes | F.col(c).isNull()
        if out.filter(holes).first() is not None:
            raise ValueError(f"dimension rows missing for required columns {list(required)}")
    return out


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], defaults: dict) -> DataFrame:
    """Left join whose missing attributes take defaults."""
    out = df.join(table, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def one_to_one_orthologs(homology: DataFrame, left: str, right: str) -> DataFrame:
    """(src, dst) pairs of classes holding exactly one symbol of each species."""
    def only(species: str, fn) -> Column:
        return fn(F.when(F.col("species") == species, F.col("symbol")))

    per = homology.groupBy("class").agg(
        only(left, F.min).alias("src"), only(left, F.max).alias("_l"),
        only(right, F.min).alias("dst"), only(right, F.max).alias("_r"),
    )
    same = (F.col("src") == F.col("_l")) & (F.col("dst") == F.col("_r"))
    return per.filter(same).select("class", "src", "dst")


def many_to_many_orthologs(homology: DataFrame, left: str, right: str) -> DataFrame:
    """All (src, dst) symbol pairs of the two species within a homology class."""
    a = homology.filter(F.col("species") == left).select("class", F.col("symbol").alias("src")).distinct()
    b = homology.filter(F.col("species") == right).select("class", F.col("symbol").alias("dst")).distinct()
    return a.join(b, "class")


def map_and_average(vectors: DataFrame, idmap: DataFrame, width: int | None = None) -> DataFrame:
    """Vectors renamed through (src, dst); several sources of one target are averaged."""
    mapped = vectors.join(idmap, F.col("key") == F.col("src")).select(F.col("dst").alias("key"), "vec")
    return vector_sums(mapped, ["key"]).select("key", means().alias("vec"), F.col("count").alias("sources"))


def keep_universe(df: DataFrame, universe: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(universe, list(on), "left_semi")


def missing_report(wanted: DataFrame, have: DataFrame, on: Sequence[str]) -> DataFrame:
    return wanted.join(have, list(on), "left_anti").distinct()


def overlap_audit(entities: DataFrame, corpus: DataFrame, cohort: str, key: str) -> DataFrame:
    """Per cohort: distinct entities, those present in the corpus, the share, and whether it is clean."""
    hits = corpus.select(key).distinct().withColumn("_hit", F.lit(True))
    j = entities.select(cohort, key).distinct().join(hits, key, "left")
    out = j.groupBy(cohort).agg(F.count(F.lit(1)).alias("entities"), F.count("_hit").alias("overlapping"))
    return out.withColumn("fraction", safe_div("overlapping", "entities")).withColumn("clean", F.col("overlapping") == 0)


def pair_vectors(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of both ends of every edge; edges with an uncovered end drop out, before any vector travels with them."""
    keys = vectors.select("key")
    for end in ("b", "a"):
        edges = edges.join(keys.withColumnRenamed("key", end), end, "left_semi")
    a = vectors.select(F.col("key").alias("a"), F.col("vec").alias("vec_a"))
    b = vectors.select(F.col("key").alias("b"), F.col("vec").alias("vec_b"))
    return edges.join(a, "a").join(b, "b")


def compare_to_baseline(scores: DataFrame, keys: Sequence[str], variant: str, metric: str, base: str, other: str) -> DataFrame:
    """Side-by-side values of two variants and their difference."""
    def side(name: str) -> Column:
        return F.max(F.when(F.col(variant) == name, F.col(metric)))

    out = scores.filter(F.col(variant).isin(base, other)).groupBy(*keys).agg(side(base).alias("base"), side(other).alias("other"))
    return out.filter(F.col("base").isNotNull() & F.col("other").isNotNull()).withColumn("delta", F.col("other") - F.col("base"))


def normalised_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> tuple[DataFrame, DataFrame]:
    """Join on normalised keys, and the left rows that found no partner."""
    a = left.withColumn("_k", left_key)
    b = right.withColumn("_k", right_key)
    return a.join(b, "_k").drop("_k"), a.join(b.select("_k"), "_k", "left_anti").drop("_k")


def top_feature_overlap(df: DataFrame, membership: DataFrame, k: int) -> DataFrame:
    """Per sample and term: how many, and which, of the sample's k largest features are members."""
    top = top_k(df, ["sample_id"], [F.col("value").desc(), F.col("feature")], k)
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((df, "sample_id"), (membership, "term"))]
    return meet_terms(top, membership, names_of_members, f"sample_id {kinds[0]}, term {kinds[1]}, overlap bigint, features string")
