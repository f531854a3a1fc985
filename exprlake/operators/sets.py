"""Samples against term sets, by blocks.

A sample meets every term that shares a feature with it, so (sample, term, feature) rows are many times the input. Here the
cells of a block of samples and the members of a block of terms meet in one task, which multiplies them a bounded piece at
a time; a (sample, term) pair is finished there, and only finished pairs leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.session import materialize

#: Cells of samples and members of terms in a block, on average.
CELLS = 1 << 18
#: Numbers in a piece of a matrix.
PIECE = 1 << 21

#: From a piece's cells (sample, feature, value), its number of samples, the features and which terms hold them: places and columns of pairs.
Finish = Callable[[tuple[np.ndarray, ...], int, pa.Array, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]]


def _blocks(df: DataFrame, key: str, side: str, columns: Sequence[str], wanted: int) -> tuple[DataFrame, int]:
    rows = df.count()
    n = max(1, math.ceil(rows / CELLS), min(math.ceil(rows / 1024), wanted))
    b = F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(f"{side}b")
    lists = df.select(b, F.struct(*columns).alias("i")).groupBy(f"{side}b").agg(F.collect_list("i").alias("i"))
    return lists.select(f"{side}b", *[F.col(f"i.{c}").alias(f"{side}{c}") for c in columns]), n


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of values, nulls among them, and the values of the codes."""
    found = values.dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def _pieces(n: int, size: int) -> list[slice]:
    return [slice(i, min(i + size, n)) for i in range(0, n, size)]


def meet_terms(cells: DataFrame, membership: DataFrame, finish: Finish, schema: str) -> DataFrame:
    """``sample_id, term`` and what ``finish`` makes of every sample and term with a common feature.

    ``cells``: ``sample_id, feature, value``, written once for the passes over them.
    """
    from exprlake.operators.vectors import block_pairs

    cells = cells.select("sample_id", "feature", F.col("value").cast("double").alias("value")).filter("feature IS NOT NULL")
    cells = materialize(cells, "cells")
    member = materialize(membership.select("term", "feature").distinct().filter("feature IS NOT NULL"), "members")
    # a sample's cells stay together: blocks are dealt by its key
    q, nq = _blocks(cells, "sample_id", "q", ["sample_id", "feature", "value"], 4 * cells.sparkSession.sparkContext.defaultParallelism)
    r, nr = _blocks(member, "term", "r", ["term", "feature"], 1)
    names = [x.split()[0] for x in schema.split(", ")]

    def one(sample: pa.Array, feature: pa.Array, value: pa.Array, term: pa.Array, of: pa.Array) -> Iterator[pa.RecordBatch]:
        member_at, features = _coded(of)
        term_at, terms = _coded(term)
        at = pc.index_in(feature, value_set=features)
        known = pc.is_valid(at)
        at, value = at.filter(known).to_numpy(), value.filter(known).to_numpy(zero_copy_only=False)
        sample_at, samples = _coded(sample.filter(known))
        turn = np.argsort(sample_at, kind="stable")
        sample_at, at, value = sample_at[turn], at[turn], value[turn]
        order = np.argsort(term_at, kind="stable")
        term_at, member_at = term_at[order], member_at[order]
        step = max(1, PIECE // max(len(features), 1024))
        for some in _pieces(len(samples), step):
            a, b = np.searchsorted(sample_at, [some.start, some.stop])
            own, f, v = sample_at[a:b] - some.start, at[a:b], value[a:b]
            for many in _pieces(len(terms), step):
                c, d = np.searchsorted(term_at, [many.start, many.stop])
                held = np.zeros((len(features), many.stop - many.start))
                held[member_at[c:d], term_at[c:d] - many.start] = 1.0
                for i, j, columns in finish((own, f, v), some.stop - some.start, features, held):
                    yield pa.RecordBatch.from_arrays([samples.take(pa.array(i + some.start)), terms.take(pa.array(j + many.start)), *columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                yield from one(*[batch.column(k)[n].values for k in range(batch.num_columns)])

    return block_pairs(q, r, nq, nr).select("qsample_id", "qfeature", "qvalue", "rterm", "rfeature").mapInArrow(run, schema)


def mean_of_members(cells: tuple[np.ndarray, ...], samples: int, features: pa.Array, held: np.ndarray) -> Iterator[tuple]:
    """Mean value and number of the members, missing values left out of the mean."""
    own, f, v = cells
    flat, size = own * len(features) + f, samples * len(features)

    def table(weights: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weights, size).reshape(samples, -1) @ held

    finite, there = np.isfinite(v), ~np.isnan(v)
    members = table(np.ones(len(v)))
    total, valued = table(np.where(finite, v, 0.0)), members if there.all() else table(there.astype(float))
    if not finite[there].all():  # infinities are added to the terms that hold them only
        for sign in (np.inf, -np.inf):
            total = np.where(table((v == sign).astype(float)) > 0, total + sign, total)
    i, j = np.nonzero(members > 0)
    n = valued[i, j]
    mean = np.divide(total[i, j], n, out=np.zeros(len(i)), where=n > 0)
    yield i, j, [pa.array(mean, mask=n == 0), pa.array(members[i, j].round().astype(np.int64))]


def names_of_members(cells: tuple[np.ndarray, ...], samples: int, features: pa.Array, held: np.ndarray) -> Iterator[tuple]:
    """How many members, and their names in order."""
    own, f, _ = cells
    names = features.to_pylist()
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    turn = np.lexsort((rank[f], own))
    own, f = own[turn], f[turn]
    cuts = np.searchsorted(own, np.arange(samples + 1)).tolist()
    i, j, overlap, said = [], [], [], []
    for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a == b:
            continue
        mine = [names[x] for x in f[a:b]]
        hit = held[f[a:b]] > 0
        # terms that hold the same of the sample's features share one text
        kinds, first, of = np.unique(np.packbits(hit, axis=0).T, axis=0, return_index=True, return_inverse=True)
        texts = np.array([",".join(n for n, x in zip(mine, hit[:, t], strict=True) if x) for t in first], dtype=object)
        n = hit.sum(axis=0)
        with_any = np.flatnonzero(n)
        i.append(np.full(len(with_any), s))
        j.append(with_any)
        overlap.append(n[with_any])
        said.append(texts[of.ravel()[with_any]])
    if i:
        yield np.concatenate(i), np.concatenate(j), [pa.array(np.concatenate(overlap).astype(np.int64)), pa.array(np.concatenate(said), pa.string())]
