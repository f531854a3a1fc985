"""Leakage-safe splits and repeatable sampling.

Every random choice is an order by a hash of seed and key, so it does not depend
on partitions or task order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprlake.functions.columns import draw_key
from exprlake.operators.ordering import draw_position, same_key


def hash_bucket(key: Column | str, buckets: int = 10) -> Column:
    """First 32 bits of the SHA-256 of the key, modulo ``buckets``."""
    k = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.pmod(F.conv(F.substring(F.sha2(k, 256), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def hash_split(df: DataFrame, group: str, train_tenths: int = 7, names: tuple[str, str] = ("discovery", "test")) -> DataFrame:
    """Split decided by the group id alone: all rows of a group land on one side."""
    return df.withColumn("split", F.when(hash_bucket(group) < train_tenths, names[0]).otherwise(names[1]))


def stratified_kfold(df: DataFrame, label: str, key: str, k: int, seed: int) -> DataFrame:
    """Fold number per row; every label is dealt out evenly."""
    placed = draw_position(df, [label], [key], seed, "_p")
    return placed.withColumn("fold", F.pmod(F.col("_p") - 1, F.lit(k)).cast("int")).drop("_p", "_p_n")


def stratified_group_kfold(df: DataFrame, group: str, label: str, k: int, seed: int) -> DataFrame:
    """Fold number per row so that no group crosses folds and the majority labels are balanced.

    Groups are dealt out back and forth (0..k-1, k-1..0) in hash order inside the
    stratum of their majority label.
    """
    sizes = df.groupBy(group).agg(F.avg(F.col(label).cast("double")).alias("_m"))
    sizes = sizes.withColumn("_stratum", (F.col("_m") >= 0.5).cast("int")).drop("_m")
    placed = draw_position(sizes, ["_stratum"], [group], seed, "_p")
    turn = F.pmod(F.col("_p") - 1, F.lit(2 * k))
    folds = placed.select(group, F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("fold"))
    return same_key(df, folds, [group])


def leave_one_group_out(df: DataFrame, cohort: str, cohorts: Sequence[str], nested: bool = True) -> DataFrame:
    """(outer, inner, role) of every row; inner is NULL for the outer fit.

    Cohorts are few. Rows of the outer cohort are ``test``; within an inner round
    rows of the inner cohort are ``validate``; everything else trains.
    """
    names = F.array(*[F.lit(c) for c in cohorts])
    out = df.withColumn("outer", F.explode(names))
    outer_test = F.col(cohort) == F.col("outer")
    if not nested:
        return out.withColumn("inner", F.lit(None).cast("string")).withColumn("role", F.when(outer_test, "test").otherwise("train"))
    inner = F.concat(F.array(F.lit(None).cast("string")), F.filter(names, lambda c: c != F.col("outer")))
    out = out.withColumn("inner", F.explode(inner)).filter(F.col("inner").isNull() | ~outer_test)
    role = F.when(outer_test, "test").when(F.col(cohort) == F.col("inner"), "validate").otherwise("train")
    return out.withColumn("role", role)


def balanced_sample(df: DataFrame, klass: str, key: str, seed: int, total: int | None = None) -> DataFrame:
    """Equally many rows per class: total // classes, or the size of the smallest class."""
    sizes = df.groupBy(klass).agg(F.count(F.lit(1)).alias("n"))
    stats = sizes.agg(F.min("n").alias("m"), F.count(F.lit(1)).alias("c")).first()
    per = stats["m"] if total is None else total // max(stats["c"], 1)
    return draw_position(df, [klass], [key], seed, "_p").filter(F.col("_p") <= per).drop("_p", "_p_n")


def exact_counts(df: DataFrame, key: str, seed: int, train: int | None = None, validate: int | None = None) -> DataFrame:
    """Exact train and validation sizes from one shuffled pool; rows left over are dropped."""
    placed = draw_position(df, [], [key], seed, "_p")
    n = F.col("_p_n")
    if train is not None:
        t = F.least(F.lit(train), n)
    elif validate is not None:
        t = F.greatest(n - F.least(F.lit(validate), n), F.lit(0))
    else:
        t = F.floor(n * F.lit(0.8))
    left = F.greatest(n - t, F.lit(0))
    v = left if validate is None else F.least(F.lit(validate), left)
    role = F.when(F.col("_p") <= t, "train").when(F.col("_p") <= t + v, "validate")
    return placed.withColumn("split", role).filter(F.col("split").isNotNull()).drop("_p", "_p_n")


def balanced_shards(df: DataFrame, shard: str, klass: str, values: tuple[str, str], tolerance: int, limit: int | None = None) -> DataFrame:
    """Rows of shards that hold both classes in nearly equal numbers; at most ``limit`` shards in shard order."""
    per = df.groupBy(shard).agg(*[F.count_if(F.col(klass) == v).alias(f"c{i}") for i, v in enumerate(values)])
    good = per.filter((F.col("c0") > 0) & (F.col("c1") > 0) & (F.abs(F.col("c0") - F.col("c1")) <= tolerance)).select(shard)
    if limit is not None:
        good = good.orderBy(shard).limit(limit)
    return df.join(good, shard, "left_semi")


def sample_keys(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k keys without replacement, in hash order."""
    return df.select(key).distinct().orderBy(draw_key(seed, key), key).limit(k)


def sample_cells(df: DataFrame, keys: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """Each cell kept with the given probability, decided by its own hash."""
    u = F.conv(F.substring(draw_key(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return df.filter(u < fraction)


def endpoint_disjoint(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends lie in the same part of a node split (node, part); mixed edges drop out."""
    a = nodes.select(F.col("node").alias("a"), F.col("part").alias("_pa"))
    b = nodes.select(F.col("node").alias("b"), F.col("part").alias("_pb"))
    j = edges.join(a, "a").join(b, "b").filter(F.col("_pa") == F.col("_pb"))
    return j.withColumn("part", F.col("_pa")).drop("_pa", "_pb")


def edge_coverage(edges: DataFrame, kept: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Source and eligible edges and positives per group."""
    src = edges.groupBy(*groups).agg(F.count(F.lit(1)).alias("source_edges"), F.sum("label").cast("bigint").alias("source_positives"))
    ok = kept.groupBy(*groups).agg(F.count(F.lit(1)).alias("eligible_edges"), F.sum("label").cast("bigint").alias("eligible_positives"))
    return src.join(ok, list(groups), "left").withColumns({
        "eligible_edges": F.coalesce("eligible_edges", F.lit(0)), "eligible_positives": F.coalesce("eligible_positives", F.lit(0))})


def verify_split(split: DataFrame, metadata: DataFrame, key: str, group: str) -> DataFrame:
    """(check, offending) rows: ids missing on either side, repeated ids, groups on both sides."""
    a, b = split.select(key).distinct(), metadata.select(key).distinct()
    checks = {
        "missing_in_split": b.join(a, key, "left_anti"),
        "missing_in_metadata": a.join(b, key, "left_anti"),
        "repeated_id": split.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
        "group_crosses_split": split.join(metadata.select(key, group), key).groupBy(group).agg(F.count_distinct("split").alias("n")).filter("n > 1"),
    }
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count(F.lit(1)).alias("offending")).withColumn("check", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
