"""Similarity links over hash buckets, verified on full sets, and their connected components.

Nothing here pairs all members of a bucket. Every member is first verified against the bucket's smallest
member, which resolves nearly all buckets. Where members of a bucket are still in different components after
that, only pairs across those components are looked at, each in the first bucket that holds both, in blocks of
bounded size, so no link that the buckets can show is lost and no group is gathered in one task. Where a table's key is
a pair of sub-keys, the tables of one first sub-key are looked at together, so a large group isn't dealt once a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.common import stored

LINKS = "a bigint, b bigint"
#: Members that are verified in turn against one copy of a pivot's set.
RUN = 512
#: Members of a block of an unresolved bucket: by their hashes alone, and with their sets.
PARTS_BLOCK = 2048
SETS_BLOCK = 512
#: Rows of blocks that are worked on together.
BATCH = 2000


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes of ``edges (a, b)``: the smallest node that is reachable.

    Alternates the large-star and the small-star step until neither changes an edge; each round is written to the
    shared folder. A node of many edges is aggregated by key first and joined back, so it isn't held in one task. Loops,
    repeated edges and nulls are left out; no edges give no rows.
    """
    now = stored(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = stored(small, "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def similar_enough(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    """Whether two sorted sets without repeats share ``per_cent`` of their union at least."""
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * per_cent:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= per_cent * (len(a) + len(b) - shared)


def verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets (``id, items``: sorted 64-bit integers) reach the Jaccard similarity.

    Each ``b`` is sent to where one copy of its ``a`` is; an ``a`` of many partners is dealt out in runs.
    """
    pairs = stored(pairs, "pairs")
    runs = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / RUN), F.lit(1)).cast("int").alias("runs"))
    member = (
        pairs.join(runs, "a")
        .withColumn("run", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int"))
        .join(sets.withColumnRenamed("id", "b"), "b")
        .select("a", "run", "b", "items")
    )
    pivot = runs.join(sets.withColumnRenamed("id", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(None).cast("bigint").alias("b"), "items"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.empty(0, np.uint64)
        for batch in batches:
            found: tuple[list, list] = ([], [])
            rows = (batch.column(n) for n in ("a", "b", "items"))
            for a, b, items in zip(*(x.to_pylist() for x in rows), strict=True):
                own = np.frombuffer(items, np.uint64)
                if b is None:
                    at, held = a, own
                elif at == a and similar_enough(held, own, per_cent):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    sent = pivot.union(member).repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())
    return sent.mapInArrow(check, LINKS)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of incidence blocks."""
    sides = []
    for sets in (left, right):
        of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        sides.append((of, np.concatenate(sets) if sets else np.empty(0, np.uint64)))
    both = np.intersect1d(sides[0][1], sides[1][1])
    out = np.zeros((len(left), len(right)), np.float32)
    placed = []
    for of, items in sides:
        at = np.searchsorted(both, items)
        hit = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == items) if len(both) else np.zeros(len(items), bool)
        placed.append((of[hit], at[hit]))
    for i in range(0, len(both), columns):
        blocks = []
        for (of, at), n in zip(placed, (len(left), len(right)), strict=True):
            here = (at >= i) & (at < i + columns)
            block = np.zeros((n, min(columns, len(both) - i)), np.float32)
            block[of[here], at[here] - i] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Numbers of the links that join what those before them have not."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for n, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(n)
    return out


def dealt(rows: DataFrame, size: int) -> DataFrame:
    """Rows ``key, bucket, id, component`` once for every two blocks of a bucket that are to be compared: ``own, i, j, batch``.

    A component of more than ``size`` members has blocks of its own, which are never compared with one another; the
    others share blocks, each component in one. Two blocks are a batch; buckets of one block share batches of about ``BATCH`` rows.
    """
    counts = rows.groupBy("key", "bucket", "component").agg(F.count("*").alias("n"))
    counts = counts.withColumn("alone", F.when(F.col("n") > size, F.col("component")))
    units = counts.groupBy("key", "bucket", "alone").agg(F.sum("n").alias("n")).withColumn("blocks", F.ceil(F.col("n") / size).cast("int"))
    bucket = Window.partitionBy("key", "bucket")
    before = F.sum("blocks").over(bucket.orderBy(F.col("alone").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    units = stored(
        units.withColumns({"skipped": F.coalesce(before, F.lit(0)).cast("int"), "all": F.sum("blocks").over(bucket).cast("int")}), "block-units"
    )
    batches = -(-(units.filter(F.col("all") == 1).agg(F.sum("n")).first()[0] or 0) // BATCH) or 1
    # few components are larger than a block
    big = units.filter("alone IS NOT NULL").select("key", "bucket", F.col("alone").alias("component"), "alone", "blocks", "skipped", "all")
    shared = units.filter("alone IS NULL").select("key", "bucket", *(F.col(c).alias(f"{c}_") for c in ("blocks", "skipped", "all")))
    placed = rows.join(big, ["key", "bucket", "component"], "left").join(shared, ["key", "bucket"], "left")
    placed = placed.withColumns({c: F.when(F.col("alone").isNull(), F.col(f"{c}_")).otherwise(F.col(c)) for c in ("blocks", "skipped", "all")})
    number = F.when(F.col("alone").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("id"))
    others = F.filter(
        F.sequence(F.lit(0), F.col("all") - 1),
        lambda x: F.col("alone").isNull() | (x < F.col("skipped")) | (x >= F.col("skipped") + F.col("blocks")),
    )
    cell = F.xxhash64("key", "bucket", "i", "j")
    return (
        placed.withColumn("own", F.col("skipped") + F.pmod(number, F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(others))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .withColumn("batch", F.when(F.col("all") == 1, F.pmod(cell, F.lit(batches))).otherwise(cell))
        .drop("alone", "blocks", "skipped", "all", "other", "blocks_", "skipped_", "all_")
    )


def linked(
    keyed: DataFrame, parts: DataFrame, sets: DataFrame, per_cent: int, first_shared: Callable[[np.ndarray, np.ndarray], np.ndarray],
    per_part: int = 1,
) -> DataFrame:
    """``node, component`` over the links between ids that share a bucket.

    ``keyed``: ``key, bucket, id``, where ``bucket`` numbers the tables; ``parts``: ``id, parts`` (array of long), from
    which ``first_shared`` tells for rows and columns of ids the first table in which each two share a bucket (-1: none);
    ``sets``: ``id, items`` for every id that shares a bucket. Tables ``per_part * p`` to ``per_part * (p + 1) - 1`` are
    those whose keys contain ``parts[p]``.
    """
    buckets = stored(
        keyed.groupBy("key", "bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.count("*").alias("n")).filter("pivot < last"), "buckets"
    )
    members = stored(keyed.join(buckets, ["key", "bucket"]).select("key", "bucket", "id", "pivot", "n"), "members")
    stars = members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    joined = stored(components(verified(stars, sets, per_cent)), "components")

    # buckets of three and more whose members are still in different components
    label = joined.withColumnRenamed("node", "id")
    placed = members.filter("n > 2").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    ends = placed.groupBy("key", "bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key", "bucket")
    # two ids meet in an open table of part p only if they have that part in common
    part = F.floor(F.col("bucket") / per_part).cast("int")
    opened = placed.join(ends, ["key", "bucket"]).select("id", "component", part.alias("bucket")).distinct().join(parts, "id")
    opened = stored(opened.select(F.get("parts", F.col("bucket")).alias("key"), "bucket", "id", "component", "parts"), "open")
    if opened.isEmpty():
        return joined

    def cells(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each two blocks in a batch: row numbers of both sides, and the pairs to look at.

        Those are the pairs that this part's tables are the first to hold and that components keep apart.
        """
        x = np.array(frame["parts"].tolist(), np.int64)
        key, bucket, i, j, component, own = (frame[c].to_numpy() for c in ("key", "bucket", "i", "j", "component", "own"))
        order = np.lexsort((j, i, bucket, key))
        new = np.zeros(len(order), bool)
        for c in (key, bucket, i, j):
            new[1:] |= c[order][1:] != c[order][:-1]
        for rows in np.split(order, np.flatnonzero(new)):
            n = rows[0]
            left, right = (rows, rows) if i[n] == j[n] else (rows[own[rows] == i[n]], rows[own[rows] == j[n]])
            apart = component[left][:, None] != component[right][None, :]
            if apart.any():
                wanted = apart & (first_shared(x[left], x[right]) // per_part == bucket[n])
                if wanted.any():
                    yield left, right, wanted

    def asking(frame: pd.DataFrame) -> pd.DataFrame:
        found = [np.union1d(left[wanted.any(axis=1)], right[wanted.any(axis=0)]) for left, right, wanted in cells(frame)]
        return frame.iloc[np.concatenate(found)][["key", "bucket", "id"]] if found else frame.iloc[:0][["key", "bucket", "id"]]

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        items = [np.frombuffer(x, np.uint64) for x in frame["items"]]
        ids = frame["id"].to_numpy()
        size = np.array([len(x) for x in items])
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for left, right, wanted in cells(frame):
            shared = shared_counts([items[n] for n in left], [items[n] for n in right])
            near = wanted & (shared > 0) & (100 * shared >= per_cent * (size[left][:, None] + size[right][None, :] - shared))
            a, b = np.nonzero(near)
            found.append((ids[left[a]], ids[right[b]]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        kept_ = forest(a, b)
        return pd.DataFrame({"a": a[kept_], "b": b[kept_]})

    asked = dealt(opened, PARTS_BLOCK).groupBy("batch").applyInPandas(asking, "key bigint, bucket int, id bigint").distinct()
    rest = stored(asked.join(opened, ["key", "bucket", "id"]), "asking")
    more = dealt(rest, SETS_BLOCK).join(sets, "id").groupBy("batch").applyInPandas(links, LINKS)
    return components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
