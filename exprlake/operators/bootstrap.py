"""AUROC and average precision of many bootstrap replicates from one ranking.

A row carries how often each replicate draws it, as one array. The rows are ranked once; a descending scan over the
distinct scores then adds up whole arrays, so a replicate costs an addition and not a ranking. A task makes the draws of some
replicates and sends them on by blocks of places, two bytes a draw, to where each block's rows are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.functions.columns import finite
from exprlake.operators.ordering import _attach, _bucket, _spread, keyed_position, same_key
from exprlake.session import materialize

#: Places of a stratum whose counts travel together.
PLACES = 1024
#: Replicates and draws of each that a unit of work makes.
REPLICATES, DRAWS = 25, 1 << 18
ROWS_PER_BUCKET = 50_000
DRAWN = "sid bigint, block bigint, first int, sizes binary, places binary"
RANKED = "gid bigint, bucket int, score double, label double, counts binary"
SUMS = "gid bigint, bucket int, cnt binary, pos binary"


def numbered(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """The distinct combinations of some columns with a number, written once so that it stays the same."""
    distinct = df.select(*columns).distinct() if columns else df.sparkSession.range(1).select()
    return materialize(distinct.withColumn(name, F.monotonically_increasing_id()), "numbers")


def draw_counts(sizes: DataFrame, replicates: int) -> DataFrame:
    """What each replicate draws: places inside blocks of ``PLACES``, one row a block and unit of draws.

    ``sizes``: ``sid, prefix, n``. Draw j of replicate r picks place md5(prefix:r:j) mod n (its first 13 hex digits), so the
    draws depend on no task and can be repeated anywhere. A row holds how many draws each replicate of the unit from
    ``first`` on has in the block, and their places there, so what is sent grows with the draws and not with the blocks.
    """
    units = sizes.withColumn("first", F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(REPLICATES))))
    units = units.withColumn("start", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"), F.lit(DRAWS).cast("bigint"))))
    units = materialize(units, "draws")
    tasks = min(max(units.count(), 1), 4 * units.sparkSession.sparkContext.defaultParallelism)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        md5 = hashlib.md5
        for f in frames:
            for u in f.itertuples(index=False):
                numbers = [b"%d" % j for j in range(u.start, min(u.start + DRAWS, u.n + 1))]
                own = min(REPLICATES, replicates + 1 - u.first)
                codes = np.empty((own, len(numbers)), np.int64)
                for i in range(own):
                    head = f"{u.prefix}:{u.first + i}:".encode()
                    digests = b"".join([md5(head + j).digest() for j in numbers])
                    # 52 bits are 13 hex digits
                    drawn = (np.frombuffer(digests, ">u8")[::2] >> 12).astype(np.int64) % u.n
                    codes[i] = (drawn // PLACES * own + i) * PLACES + drawn % PLACES
                codes = np.sort(codes, axis=None)
                cells, places = codes // PLACES, (codes % PLACES).astype(np.uint16)
                blocks, starts = np.unique(cells // own, return_index=True)
                cuts = [*starts.tolist(), len(codes)]
                sizes = [np.bincount(cells[a:b] - k * own, minlength=own).astype(np.uint32).tobytes() for k, a, b in zip(blocks.tolist(), cuts[:-1], cuts[1:], strict=True)]
                drawn = [places[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pd.DataFrame({"sid": u.sid, "block": blocks, "first": u.first, "sizes": sizes, "places": drawn})

    return units.repartition(tasks, "sid", "first", "start").mapInPandas(draw, DRAWN)


def ranked_draws(df: DataFrame, groups: DataFrame, names: Sequence[str], strata: Sequence[str], key: str, label: str, score: str, replicates: int, seed: int) -> DataFrame:
    """Every scored row with its counts over all replicates: ``gid, bucket, score, label, counts``."""
    stratum = numbered(df, strata, "sid")
    places = keyed_position(df.select(*strata, key).distinct(), strata, key, "_p")
    places = materialize(same_key(places, stratum, strata).select("sid", *strata, key, F.col("_p").alias("place"), F.col("_p_n").alias("n")), "places")
    prefix = F.concat_ws(":", F.lit(str(seed)), *[F.col(s).cast("string") for s in strata])
    counts = draw_counts(places.filter("place = 1").select("sid", prefix.alias("prefix"), "n"), replicates)

    rows = df.filter(F.col(label).isNotNull() & finite(F.col(score).cast("double"))).withColumns({"_y": F.col(label).cast("double"), "_s": F.col(score).cast("double")})
    rows = same_key(rows, groups, names).select("gid", *strata, key, "_y", "_s") if names else rows.withColumn("gid", F.lit(0).cast("bigint"))
    rows = _attach(rows, rows.groupBy("gid").agg(*_spread("_s")), ["gid"]).withColumn("_b", _bucket("_s", ROWS_PER_BUCKET, 1 << 20))
    rows = same_key(rows, places.drop("n"), [*strata, key])
    rows = rows.select("sid", F.floor((F.col("place") - 1) / PLACES).alias("block"), ((F.col("place") - 1) % PLACES).cast("int").alias("at"), "gid", "_b", "_s", "_y")

    def meet(rows: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        codes = [np.empty(0, np.int64)]
        for first, sizes, places in zip(drawn["first"], drawn["sizes"], drawn["places"], strict=True):
            sizes = np.frombuffer(sizes, np.uint32)
            codes.append(np.frombuffer(places, np.uint16).astype(np.int64) * replicates + np.repeat(np.arange(len(sizes)) + first - 1, sizes))
        table = np.bincount(np.concatenate(codes), minlength=PLACES * replicates).reshape(PLACES, replicates)
        small = table.astype(np.uint8 if table.max(initial=0) < 256 else np.uint32)
        return pd.DataFrame({
            "gid": rows["gid"], "bucket": rows["_b"], "score": rows["_s"], "label": rows["_y"], "counts": [small[i].tobytes() for i in rows["at"]],
        })

    return rows.groupBy("sid", "block").cogroup(counts.groupBy("sid", "block")).applyInPandas(meet, RANKED)


def counts_of(packed: bytes, replicates: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint8 if len(packed) == replicates else np.uint32).astype(float)


def above(rows: DataFrame, replicates: int) -> DataFrame:
    """Per group and bucket: counts and positives of all higher buckets (``gid, bucket, cnt, pos``)."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for f in frames:
            for gid, bucket, y, c in zip(f["gid"], f["bucket"], f["label"], f["counts"], strict=True):
                n = counts_of(c, replicates)
                acc = held.setdefault((gid, bucket), np.zeros((2, replicates)))
                acc[0] += n
                acc[1] += n * y
                if len(held) * replicates > 4_000_000:
                    yield packed(held)
                    held = {}
        yield packed(held)

    def packed(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(g, b, x[0].tobytes(), x[1].tobytes()) for (g, b), x in held.items()], columns=["gid", "bucket", "cnt", "pos"])

    def shift(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Buckets of a group from the highest on."""
        at, sums, own = None, None, None
        for f in frames:
            out = []
            for gid, bucket, cnt, pos in zip(f["gid"], f["bucket"], f["cnt"], f["pos"], strict=True):
                part = np.stack([np.frombuffer(cnt), np.frombuffer(pos)])
                if at is None or at[0] != gid:
                    sums, own = np.zeros_like(part), np.zeros_like(part)
                if at != (gid, bucket):
                    sums, own = sums + own, np.zeros_like(part)
                    at = (gid, bucket)
                    out.append((gid, bucket, sums[0].tobytes(), sums[1].tobytes()))
                own = own + part
            yield pd.DataFrame(out, columns=["gid", "bucket", "cnt", "pos"])

    parts = rows.mapInPandas(add, SUMS).repartition("gid").sortWithinPartitions("gid", F.col("bucket").desc())
    return parts.mapInPandas(shift, SUMS)


def replicate_auc(df: DataFrame, groups: Sequence[str], key: str, label: str, score: str, replicates: int, seed: int, strata: Sequence[str]) -> DataFrame:
    """``groups, replicate, auroc, auprc`` of every replicate; both are NULL where a replicate draws one class only."""
    groups, strata = list(groups), list(strata)
    if not strata:
        df, strata = df.withColumn("_all", F.lit(1)), ["_all"]
    known = numbered(df, groups, "gid") if groups else None
    rows = materialize(ranked_draws(df, known, groups, strata, key, label, score, replicates, seed), "ranked-draws")
    heads = above(rows, replicates).withColumns({"score": F.lit(float("inf")), "label": F.lit(0.0), "counts": F.lit(None).cast("binary")})
    both = rows.withColumns({"cnt": F.lit(None).cast("binary"), "pos": F.lit(None).cast("binary")}).unionByName(heads)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Buckets from the highest score down, each after the sums of those above it."""
        at = None
        cnt = pos = own_cnt = own_pos = u = ap = start = None
        value = None

        def close() -> None:
            """Take in the rows of one score."""
            nonlocal cnt, pos, own_cnt, own_pos, u, ap
            u = u + (own_cnt - own_pos) * (pos + own_pos / 2.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                ap = ap + np.where(own_pos > 0, own_pos * (pos + own_pos) / (cnt + own_cnt), 0.0)
            cnt, pos = cnt + own_cnt, pos + own_pos
            own_cnt, own_pos = np.zeros(replicates), np.zeros(replicates)

        def sums() -> tuple:
            close()
            return at, (cnt - start[0]).tolist(), (pos - start[1]).tolist(), u.tolist(), ap.tolist()

        for f in frames:
            out = []
            for gid, bucket, s, y, c, head_cnt, head_pos in zip(*(f[x] for x in ("gid", "bucket", "score", "label", "counts", "cnt", "pos")), strict=True):
                if c is None:
                    if at is not None:
                        out.append(sums())
                    at, value = gid, None
                    cnt, pos = np.frombuffer(head_cnt), np.frombuffer(head_pos)
                    start = cnt, pos
                    own_cnt, own_pos, u, ap = (np.zeros(replicates) for _ in range(4))
                    continue
                if s != value:
                    close()
                    value = s
                n = counts_of(c, replicates)
                own_cnt += n
                own_pos += n * y
            yield pd.DataFrame(out, columns=["gid", "n", "p", "u", "ap"])
        if at is not None:
            yield pd.DataFrame([sums()], columns=["gid", "n", "p", "u", "ap"])

    sent = both.repartition("gid", "bucket").sortWithinPartitions("gid", "bucket", F.col("score").desc(), F.col("counts").isNotNull())
    parts = sent.mapInPandas(scan, "gid bigint, n array<double>, p array<double>, u array<double>, ap array<double>")
    long = parts.select("gid", F.posexplode(F.arrays_zip("n", "p", "u", "ap")).alias("at", "x"))
    out = long.groupBy("gid", (F.col("at") + 1).alias("replicate")).agg(*[F.sum(f"x.{c}").alias(c) for c in ("n", "p", "u", "ap")])
    both_classes = (F.col("p") > 0) & (F.col("p") < F.col("n"))
    out = out.withColumn("auroc", F.when(both_classes, F.col("u") / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0.0))))
    out = out.withColumn("auprc", F.when(both_classes, F.col("ap") / F.nullif(F.col("p"), F.lit(0.0)))).select("gid", "replicate", "auroc", "auprc")
    return out.join(known, "gid").select(*groups, "replicate", "auroc", "auprc") if groups else out.drop("gid")
