"""Vocabulary alignment, masking and completion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprlake.functions.columns import draw_key, finite
from exprlake.operators.ordering import draw_position

#: Features up to which a vocabulary is a literal of the plan; a larger one is joined.
MAX_VOCABULARY = 200_000
#: Positions of a larger vocabulary that one row holds.
POSITIONS = 4096
_SEP = "\u0001"


def vocabulary_names(vocabulary: DataFrame) -> list[str] | None:
    """Feature names in order of ``pos``; none for a vocabulary too large for a plan literal."""
    rows = vocabulary.select("feature", "pos").orderBy("pos").limit(MAX_VOCABULARY + 1).collect()
    return [str(r["feature"]) for r in rows] if len(rows) <= MAX_VOCABULARY else None


def pack(df: DataFrame, vocabulary: DataFrame, fill: float | None = 0.0, names: list[str] | None = None) -> DataFrame:
    """Measurements to ``profile(sample_id, values)`` in vocabulary order; absent features get ``fill``.

    Only the measured cells are shuffled. The gaps between two measured
    positions are filled inside the row, in one pass over the sorted cells.
    A feature that a sample measures more than once counts with its mean.
    The profiles of a vocabulary too large for a plan literal are put together from blocks of positions.
    """
    names = names if names is not None else vocabulary_names(vocabulary)
    if names is None:
        blocks = F.array_sort(F.collect_list(F.struct("block", "values")))
        whole = pack_blocks(df, vocabulary, fill).groupBy("sample_id").agg(blocks.alias("blocks"))
        return whole.select("sample_id", F.flatten(F.transform("blocks", lambda b: b["values"])).alias("values"))
    known = df.join(vocabulary.select("feature", F.col("pos").cast("int").alias("pos")), "feature", "left")
    return _filled(_listed(known, ["sample_id"]), F.lit(len(names)), fill).select("sample_id", "values")


def pack_blocks(df: DataFrame, vocabulary: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """As :func:`pack`, in rows ``sample_id, block, values`` of at most ``POSITIONS`` positions, whatever the vocabulary's size."""
    width = vocabulary.count()
    if width == 0:
        return df.select("sample_id").distinct().select("sample_id", F.lit(0).alias("block"), F.array().cast("array<double>").alias("values"))
    places = vocabulary.select(
        "feature", F.floor(F.col("pos") / POSITIONS).cast("int").alias("block"), F.pmod("pos", F.lit(POSITIONS)).cast("int").alias("pos")
    )
    cells = _listed(df.join(places, "feature"), ["sample_id", "block"])
    # a sample has every block, measured or not
    every = F.explode(F.sequence(F.lit(0), F.lit((width - 1) // POSITIONS)))
    grid = df.select("sample_id").distinct().withColumn("block", every).join(cells, ["sample_id", "block"], "left")
    none = F.array().cast(cells.schema["c"].dataType)
    size = F.least(F.lit(POSITIONS), F.lit(width) - F.col("block") * POSITIONS).cast("int")
    return _filled(grid.withColumn("c", F.coalesce("c", none)), size, fill).select("sample_id", "block", "values")


def _listed(known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The measured cells of a row, ``c``, sorted by position."""
    cell = F.when(F.col("pos").isNotNull(), F.struct("pos", F.col("value").cast("double").alias("v")))
    return known.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("c"))


def _filled(listed: DataFrame, width: Column, fill: float | None) -> DataFrame:
    """Dense ``values`` of ``width`` positions from the cells ``c``."""
    gap = F.lit(fill).cast("double")
    # sorted by position, so a repeated position follows itself; cells of one position are met in the row
    at = F.array_distinct(F.transform("c", lambda x: x["pos"]))
    repeated = F.transform(at, lambda p: F.struct(p.alias("pos"), _mean_at(F.col("c"), p).alias("v")))
    cells = listed.withColumn("c", F.when(F.size(at) < F.size("c"), repeated).otherwise(F.col("c")))
    before = F.concat(F.array(F.lit(-1)), F.transform("c", lambda x: x["pos"]))
    filled = F.flatten(F.zip_with(
        "c", F.slice(before, 1, F.size("c")),
        lambda x, p: F.concat(F.array_repeat(gap, x["pos"] - p - 1), F.array(F.coalesce(x["v"], gap))),
    ))
    values = F.concat(filled, F.array_repeat(gap, width - 1 - F.element_at(before, -1)))
    return cells.withColumn("values", values)


def _mean_at(cells: Column, pos: Column) -> Column:
    """Mean of the measured values of one position; NULL where none is."""
    own = F.filter(F.transform(F.filter(cells, lambda x: x["pos"] == pos), lambda x: x["v"]), lambda v: v.isNotNull())
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, v: a + v) / F.size(own))


def unpack(profile: DataFrame, names: Sequence[str] | DataFrame) -> DataFrame:
    """Packed profiles back to measurements; ``names`` in order, or a vocabulary too large to be a literal."""
    if isinstance(names, DataFrame):
        count = F.ceil(F.size("values") / POSITIONS).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice("values", b * POSITIONS + 1, POSITIONS))
        return unpack_blocks(profile.filter(F.size("values") > 0).select("sample_id", F.posexplode(parts).alias("block", "values")), names)
    lookup = F.split(F.lit(_SEP.join(names)), _SEP)
    long = profile.select("sample_id", F.posexplode("values").alias("_p", "value"))
    return long.select("sample_id", lookup[F.col("_p")].alias("feature"), "value")


def unpack_blocks(blocks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows ``sample_id, block, values`` to measurements; the names of a block are one row."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "feature")))
    names = vocabulary.groupBy(F.floor(F.col("pos") / POSITIONS).cast("int").alias("block")).agg(F.transform(listed, lambda x: x["feature"]).alias("names"))
    cells = blocks.join(names, "block").select("sample_id", F.explode(F.arrays_zip(F.col("names").alias("feature"), F.col("values").alias("value"))).alias("x"))
    return cells.select("sample_id", "x.feature", "x.value")


def align(df: DataFrame, vocabulary: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Dense measurements over the vocabulary, absent features set to ``fill``.

    A vocabulary too large for a plan literal is completed by blocks of positions.
    """
    names = vocabulary_names(vocabulary)
    if names is None:
        return unpack_blocks(pack_blocks(df, vocabulary, fill), vocabulary)
    return unpack(pack(df, vocabulary, fill, names), names)


def align_long(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Sparse alignment for any vocabulary size: keep known features with their position."""
    return df.join(vocabulary.select("feature", "pos"), "feature")


def align_measured(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Dense measurements with NULL for absent or non-finite cells and a ``measured`` flag."""
    clean = df.withColumn("value", F.when(finite("value"), F.col("value")))
    return align(clean, vocabulary, None).withColumn("measured", F.col("value").isNotNull())


def shared_features(sources: DataFrame, k: int, order: DataFrame | None = None) -> DataFrame:
    """Features present in all ``k`` sources, with the position given by the first source."""
    both = (
        sources.select("source", "feature").distinct().groupBy("feature")
        .agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") == k).select("feature")
    )
    return both if order is None else both.join(order, "feature")


def coverage(panel: DataFrame, vocabulary: DataFrame, groups: Sequence[str], warn_below: float = 0.5) -> DataFrame:
    """Per group: submitted, unique, shared and missing features, the fraction covered and a warning flag."""
    hits = panel.join(vocabulary.select("feature", F.lit(1).alias("_hit")).distinct(), "feature", "left")
    out = hits.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("submitted"),
        F.count_distinct("feature").alias("unique_features"),
        F.count_distinct(F.when(F.col("_hit") == 1, F.col("feature"))).alias("shared"),
    )
    out = out.withColumn("vocabulary", vocabulary.agg(F.count_distinct("feature")).scalar())
    fraction = F.col("shared") / F.greatest(F.col("vocabulary"), F.lit(1)).cast("double")
    return (
        out.withColumn("missing", F.col("vocabulary") - F.col("shared"))
        .withColumn("fraction", fraction).withColumn("warning", F.col("fraction") < warn_below)
    )


def mask_features(vocabulary: DataFrame, seed: int, fraction: float = 0.15) -> DataFrame:
    """Vocabulary with a ``masked`` flag on a repeatable share of the features."""
    drawn = draw_position(vocabulary, [], ["feature"], seed, "_pos")
    k = F.bround(F.col("_pos_n") * F.lit(fraction))
    return drawn.withColumn("masked", F.col("_pos") <= k).drop("_pos", "_pos_n")


def mask_cells(df: DataFrame, groups: Sequence[str], seed: int, fraction: float = 0.15) -> DataFrame:
    """Cell-wise mask inside each panel: ``value`` becomes NULL, ``truth`` keeps the original."""
    drawn = draw_position(df, groups, ["sample_id", "feature"], seed, "_pos")
    masked = F.col("_pos") <= F.greatest(F.bround(F.col("_pos_n") * F.lit(fraction)), F.lit(1.0))
    return (
        drawn.withColumn("truth", F.col("value")).withColumn("masked", masked)
        .withColumn("value", F.when(~F.col("masked"), F.col("value"))).drop("_pos", "_pos_n")
    )


def mask_per_sample(df: DataFrame, k: int, seed: int) -> DataFrame:
    """Exactly ``k`` masked features in every sample (all, if it has fewer)."""
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id").orderBy(draw_key(seed, "sample_id", "feature"), "feature")
    return df.withColumn("masked", F.row_number().over(w) <= k)


def complete(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """Keep observed values, fill missing ones by prediction; code 1 observed, 0.5 predicted, 0 absent."""
    p = predicted.select("sample_id", "feature", F.greatest(F.col("prediction"), F.lit(0.0)).alias("_p"))
    j = observed.join(p, ["sample_id", "feature"], "left")
    seen = finite("value")
    code = F.when(seen, 1.0).when(finite("_p"), 0.5).otherwise(0.0)
    value = F.when(seen, F.col("value")).otherwise(F.col("_p"))
    return j.withColumn("confidence", code).withColumn("value", value).drop("_p")


def panel_split(ranking: DataFrame, protected: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Observed panel = best ``k`` unprotected features; everything else is hidden."""
    guard = protected.select("feature").distinct().withColumn("_g", F.lit(True))
    marked = ranking.join(guard, "feature", "left").withColumn("excluded", F.coalesce("_g", F.lit(False))).drop("_g")
    best = marked.filter(~F.col("excluded")).orderBy(F.col(score).desc(), "feature").limit(k)
    picked = best.select("feature", F.lit(True).alias("_p"))
    out = marked.join(picked, "feature", "left")
    return out.withColumn("role", F.when(F.col("_p"), "observed").otherwise("hidden")).drop("_p")


def strict_support(predictions: DataFrame, k_models: int) -> DataFrame:
    """Features that are finite everywhere in all ``k_models`` models."""
    per = predictions.groupBy("feature", "model").agg(F.min(finite("value").cast("int")).alias("ok"))
    return (
        per.groupBy("feature").agg(F.min("ok").alias("ok"), F.count(F.lit(1)).alias("models"))
        .filter((F.col("ok") == 1) & (F.col("models") == k_models)).select("feature")
    )


def collapse_features(df: DataFrame, idmap: DataFrame | None = None) -> DataFrame:
    """Sum of all source features that map to one target, before any logarithm."""
    if idmap is not None:
        df = df.join(idmap, F.col("feature") == F.col("src")).withColumn("feature", F.col("dst")).drop("src", "dst")
    return df.groupBy("sample_id", "feature").agg(F.sum("value").alias("value"))


def collapse_replicates(df: DataFrame, key: Column) -> DataFrame:
    """Mean of technical replicates that share an extracted key."""
    return df.withColumn("sample_id", key).groupBy("sample_id", "feature").agg(F.avg("value").alias("value"))


def impute(profiles: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], batch: int = 32, can_impute: bool = True) -> DataFrame:
    """Run a user's scorer over packed profiles in batches of at most ``batch`` rows.

    ``predict`` takes and returns a frame with ``sample_id`` and ``values``. A
    method that only embeds must be declared with ``can_impute=False`` and is refused.
    """
    if not can_impute:
        raise ValueError("this method only provides embeddings and cannot impute")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                yield predict(frame.iloc[start:start + batch])[["sample_id", "values"]]

    kind = profiles.schema["sample_id"].dataType.simpleString()
    return profiles.select("sample_id", "values").mapInPandas(run, f"sample_id {kind}, values array<double>")


def predict_feature_mean(df: DataFrame) -> DataFrame:
    """Baseline predictor: the feature's mean over samples where it was observed."""
    means = df.filter(finite("value")).groupBy("feature").agg(F.avg("value").alias("prediction"))
    return df.join(means, "feature").select("sample_id", "feature", "prediction")


def predict_nearest_mean(cells: DataFrame, neighbours: DataFrame, reference: DataFrame) -> DataFrame:
    """Baseline predictor: mean over a sample's nearest references (sample_id, reference_id)."""
    ref = reference.select("reference_id", "feature", F.col("value").alias("_v"))
    near = cells.select("sample_id", "feature").join(neighbours.select("sample_id", "reference_id"), "sample_id")
    return near.join(ref, ["reference_id", "feature"]).groupBy("sample_id", "feature").agg(F.avg("_v").alias("prediction"))


