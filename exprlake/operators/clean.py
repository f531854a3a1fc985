"""Projections, filters, predicates and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exprlake.functions.columns import clean_name, finite
from exprlake.functions.vectors import all_finite
from exprlake.operators.ordering import exact_percentile, same_key


# fixed values: marks in the tissue text of a reference
TUMOR_PREFIX = "TCGA-"
UNLABELLED_MARK = "unlabelled"
UNKNOWN_TISSUE = "unknown"


def clean_features(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Trim and upper-case feature names, dropping blanks and the text NAN."""
    return df.withColumn(feature, clean_name(feature)).filter(F.col(feature).isNotNull())


def first_available(df: DataFrame, preferences: Sequence[str], fallback: str = "error") -> str:
    """First listed column present in ``df``; else the first or last column, or an error."""
    for name in preferences:
        if name in df.columns:
            return name
    if fallback == "first":
        return df.columns[0]
    if fallback == "last":
        return df.columns[-1]
    raise KeyError(f"none of {list(preferences)} in {df.columns}")


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def map_values(col: Column | str, mapping: Mapping) -> Column:
    """Value lookup; values outside the mapping become NULL."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(table, F.col(col) if isinstance(col, str) else col)


def sample_qc(df: DataFrame, probabilities: DataFrame, min_detected: int, max_probability: float = 0.5) -> DataFrame:
    """Samples with enough detected features and a low single-cell probability."""
    detected = df.groupBy("sample_id").agg(F.count_if(F.col("value") > 0).alias("detected"))
    kept = detected.filter(F.col("detected") >= min_detected)
    return kept.join(probabilities.filter(F.col("probability") < max_probability), "sample_id")


def nonzero_in_every_group(df: DataFrame, group: str, n_groups: int | None = None) -> DataFrame:
    """Features whose total is above zero in each group."""
    totals = df.groupBy("feature", group).agg(F.sum("value").alias("s"))
    want = n_groups if n_groups is not None else totals.select(group).distinct().count()
    return (
        totals.groupBy("feature")
        .agg(F.min("s").alias("lowest"), F.count(F.lit(1)).alias("groups"))
        .filter((F.col("lowest") > 0) & (F.col("groups") == want))
    )


def folded_filter(df: DataFrame, equals: Mapping[str, str], within: Mapping[str, Sequence[str]]) -> DataFrame:
    """Case-folded equality plus membership in lists of allowed values."""
    for col, text in equals.items():
        df = df.filter(F.lower(F.trim(col)) == text.lower())
    for col, allowed in within.items():
        df = df.filter(F.col(col).isin(list(allowed)))
    return df


def drop_non_finite(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.filter(all_finite(vec))


def min_support(df: DataFrame, minimum: int = 30) -> DataFrame:
    """Measurements of features with at least ``minimum`` finite values."""
    ok = (
        df.groupBy("feature").agg(F.count_if(finite("value")).alias("n"))
        .filter(F.col("n") >= minimum).select("feature")
    )
    return df.join(ok, "feature", "left_semi")


def overlap_gate(
    panel: DataFrame, vocabulary: DataFrame, groups: Sequence[str], full: int = 100, sparse: int = 20, fraction: float = 0.4
) -> DataFrame:
    """Per group: feature count, shared count, adaptive minimum, and whether it passes."""
    marked = panel.select(*groups, "feature").distinct().join(
        vocabulary.select("feature", F.lit(True).alias("_hit")).distinct(), "feature", "left"
    )
    out = marked.groupBy(*groups).agg(F.count(F.lit(1)).alias("features"), F.count("_hit").alias("shared"))
    need = F.least(F.lit(full), F.greatest(F.lit(sparse), F.ceil(F.col("features") * F.lit(fraction)).cast("int")))
    return out.withColumn("minimum", need.cast("bigint")).withColumn("passed", F.col("shared") >= F.col("minimum"))


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows whose listed columns contain ``text``, ignoring case."""
    joined = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return df.filter(joined.contains(text.lower()))


def reference_class(tissue: Column | str) -> Column:
    """tumor_cohort, unlabelled, unknown or healthy_tissue, from the text of the tissue."""
    t = F.coalesce(F.col(tissue) if isinstance(tissue, str) else tissue, F.lit(UNKNOWN_TISSUE))
    return (
        F.when(F.upper(t).startswith(TUMOR_PREFIX), "tumor_cohort")
        .when(F.lower(t).contains(UNLABELLED_MARK), "unlabelled")
        .when(F.lower(t) == UNKNOWN_TISSUE, "unknown")
        .otherwise("healthy_tissue")
    )


def matrix_violations(
    df: DataFrame, max_features: int | None = None, max_samples: int | None = None, feature: str = "feature"
) -> DataFrame:
    """One row per broken rule with the number of offending entries; empty when the matrix is valid."""
    per_feature = df.groupBy(F.upper(F.trim(feature)).alias("f"), "sample_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if(F.isnan("value") | (F.abs("value") == float("inf"))).alias("bad"),
        F.count_if((F.col("value") < 0) & ~F.isnan("value")).alias("negative"),
    )
    facts = per_feature.agg(
        F.count_if(F.col("copies") > 1).alias("duplicate_feature"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("non_finite"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative_value"),
        F.count_if(F.coalesce(F.col("f"), F.lit("")) == "").alias("blank_feature"),
        F.count_distinct("f").alias("_features"),
        F.count_distinct("sample_id").alias("_samples"),
        F.count(F.lit(1)).alias("_cells"),
    )
    over = {
        "too_many_features": F.greatest(F.col("_features") - F.lit(max_features or 2**62), F.lit(0)),
        "too_many_samples": F.greatest(F.col("_samples") - F.lit(max_samples or 2**62), F.lit(0)),
        "missing_cells": F.col("_features") * F.col("_samples") - F.col("_cells"),
    }
    names = ["duplicate_feature", "non_finite", "negative_value", "blank_feature", *over]
    facts = facts.withColumns(over).select(*[F.col(n).cast("bigint").alias(n) for n in names])
    return facts.unpivot([], names, "rule", "entries").filter(F.col("entries") > 0)


def infer_scale(df: DataFrame, groups: Sequence[str], threshold: float = 30.0, rule: str = "p99") -> DataFrame:
    """Per group, whether the values look raw or log1p-scaled, from the p99 or the maximum."""
    if rule == "max":
        stat = df.filter(finite("value")).groupBy(*groups).agg(F.max("value").alias("statistic"))
    else:
        stat = exact_percentile(df, groups, "value", {"statistic": 0.99})
    return stat.withColumn("scale", F.when(F.col("statistic") > threshold, "raw").otherwise("log1p"))


def to_log_scale(df: DataFrame, groups: Sequence[str], requested: str = "auto", rule: str = "p99") -> DataFrame:
    """log1p of groups that look raw; a requested scale overrides the inference."""
    raw = F.log1p(F.greatest(F.col("value"), F.lit(0.0)))
    if requested != "auto":
        return df.withColumn("value", raw) if requested == "raw" else df
    scale = infer_scale(df, groups, rule=rule).drop("statistic")
    out = same_key(df, scale, groups)
    return out.withColumn("value", F.when(F.col("scale") == "raw", raw).otherwise(F.col("value"))).drop("scale")


def unsupported_rows(spark: SparkSession, dims: Mapping[str, Sequence], metrics: Sequence[str], reason: str) -> DataFrame:
    """Explicit rows for combinations that cannot be scored: NULL metrics and a reason."""
    df = spark.range(1).select()
    for name, values in dims.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    nulls = [F.lit(None).cast("double").alias(m) for m in metrics]
    return df.select("*", *nulls, F.lit(False).alias("supported"), F.lit(reason).alias("reason"))


def fill_grid(df: DataFrame, keys: Sequence[str], expected: DataFrame, reason: str) -> DataFrame:
    """Every expected combination; those without a result carry NULL metrics and the reason."""
    marked = df.withColumn("supported", F.lit(True))
    out = expected.select(*keys).distinct().join(marked, list(keys), "left")
    out = out.withColumn("supported", F.coalesce("supported", F.lit(False)))
    return out.withColumn("reason", F.when(~F.col("supported"), reason))


def eligible_terms(membership: DataFrame, universe: DataFrame, low: int, limit: int | None = None) -> DataFrame:
    """Terms with lo <= |members in universe| <= G - lo, largest first, then by name."""
    g = universe.select("feature").distinct()
    total = g.agg(F.count(F.lit(1)).alias("_g")).scalar()
    sizes = (
        membership.select("term", "feature").distinct().join(g, "feature", "left_semi")
        .groupBy("term").agg(F.count(F.lit(1)).alias("size"))
    )
    kept = sizes.filter((F.col("size") >= low) & (F.col("size") <= total - low))
    kept = kept.select("term", "size").orderBy(F.col("size").desc(), "term")
    return kept.limit(limit) if limit else kept


def edge_scope(edges: DataFrame, members: DataFrame, inside: str = "immune", outside: str = "other") -> DataFrame:
    """Scope of each edge: ``inside`` when either end belongs to the set."""
    m = members.select("feature").distinct()
    hit_a = m.select(F.col("feature").alias("a"), F.lit(True).alias("_a"))
    hit_b = m.select(F.col("feature").alias("b"), F.lit(True).alias("_b"))
    out = edges.join(hit_a, "a", "left").join(hit_b, "b", "left")
    hit = F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False))
    return out.withColumn("scope", F.when(hit, inside).otherwise(outside)).drop("_a", "_b")


def contract_checks(predictions: DataFrame, entity: str, method: str, probability: str, label: str, expected: DataFrame) -> DataFrame:
    """(check, passed, detail) rows over a prediction table."""
    per = predictions.groupBy(method).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(entity).alias("entities"),
        F.count_if(~finite(probability) | (F.col(probability) < 0) | (F.col(probability) > 1)).alias("bad_probability"),
        F.count_if(F.col(label).isNull()).alias("missing_label"),
    )
    missing = (
        expected.select(method, entity).distinct()
        .join(predictions.select(method, entity).distinct(), [method, entity], "left_anti")
        .groupBy(method).agg(F.count(F.lit(1)).alias("missing"))
    )
    per = per.join(missing, method, "left")
    rows = {
        "one_row_per_entity": F.col("rows") - F.col("entities"),
        "probability_in_range": F.col("bad_probability"),
        "labels_complete": F.col("missing_label"),
        "expected_entities": F.coalesce(F.col("missing"), F.lit(0)),
    }
    long = per.select(method, *[c.alias(n) for n, c in rows.items()]).unpivot([method], list(rows), "check", "offending")
    return long.withColumn("passed", F.col("offending") == 0)


def restore_case(keys: DataFrame, source: DataFrame, symbol: str, order: str) -> DataFrame:
    """Source spelling for each upper-cased key; the last spelling in file order wins."""
    last = source.groupBy(F.upper(symbol).alias("key")).agg(F.max_by(symbol, order).alias("spelling"))
    return keys.join(last, "key", "left")


def export_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating column."""
    cols = {
        f.name: F.when(finite(f.name), F.col(f.name))
        for f in df.schema.fields if f.dataType.typeName() in ("double", "float")
    }
    return df.withColumns(cols) if cols else df


def default_group(df: DataFrame, group: str = "group", default: str = "Unlabeled") -> DataFrame:
    """Blank or absent group labels get the default."""
    if group not in df.columns:
        return df.withColumn(group, F.lit(default))
    text = F.trim(F.col(group))
    return df.withColumn(group, F.coalesce(F.when(text != "", text), F.lit(default)))


def unordered_pairs(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct pairs with the smaller end first."""
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
