"""Where a source's words differ from its language's: count-cell ranking.

All terms that a source has ``n`` times and its language ``m`` times have the same smoothed shares, so they form one
cell: the difference is worked out once a cell, cells of equal difference are merged, the running sum of their sizes
tells which are within the wanted ranks, and only those are expanded into terms, in UTF-8 order.

Nulls in ``text``, ``lang`` and ``source`` are ''. A text without terms still makes its source occur. Repeated rows are
documents of their own. An empty table gives no rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.common import names, stored

#: Letters of ASCII, lower-cased before, and all beyond ASCII, in UTF-8.
TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000
SMOOTH = 5
COUNTED = "lang string, source string, term string, n bigint, docs bigint"
#: Entries of counts that a task holds before it sends them on.
HELD = 300_000
#: Sources of one side of a tile of the pair sums.
TILE = 128
#: Terms that a tile looks at together.
TERMS = 256


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents with the term, counted in the tasks before they are dealt."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, within) in groups.items():
                terms = list(times)
                for i in range(0, len(terms), 50_000):
                    some = terms[i : i + 50_000]
                    columns = [
                        pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                        pa.array([t.decode("utf-8", "replace") for t in some], pa.string()),
                        pa.array([times[t] for t in some], pa.int64()), pa.array([within[t] for t in some], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names(COUNTED))
            groups.clear()

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True)
            for lang, source, text in rows:
                times, within = groups.setdefault((lang, source), (Counter(), Counter()))
                found = Counter(TERM.findall(text.encode("utf-8", "surrogatepass").lower()))
                times.update(found)
                within.update(found.keys())
            if sum(len(times) for times, _ in groups.values()) > HELD:
                yield from flush()
        yield from flush()

    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = read.mapInArrow(count, COUNTED)
    # dealt by term once: the sums per source and those per language both read this partitioning
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column | str, total: Column | str, size: Column | str) -> Column:
    """``1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * size))`` in exact decimals; null where ``size`` is 0."""
    count, total, size = (F.col(x) if isinstance(x, str) else x for x in (count, total, size))
    above = F.lit(SCALE).cast("decimal(11,0)") * (count + SMOOTH).cast("decimal(19,0)")
    below = (total + SMOOTH * size).cast("decimal(19,0)")
    # the remainder is taken off first, so that the quotient of the decimals is whole
    whole = (above - above % F.nullif(below, F.lit(0).cast("decimal(19,0)"))) / below
    return F.when(size > 0, 1 + whole.cast("decimal(38,0)").cast("bigint"))


def pair_tiles(terms: DataFrame) -> DataFrame:
    """``lang, a, b, extra`` (source numbers, ``a < b``) over the terms that both sources have.

    ``terms``: ``lang, term, number`` (of the source), ``p`` (its share of the term), ``p0`` (its share of a term that it
    lacks), ``blocks`` (tiles a side). ``extra`` sums ``|p - q| - |p - q0| - |p0 - q| + |p0 - q0|``, which is what the sums
    over each source's own cells are off by. A task holds a tile of sums and ``TERMS`` terms, never the pairs of a term.
    """
    own = F.floor(F.col("number") / TILE).cast("int")
    tiled = (
        terms.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("lang", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "term", "number", "p", "p0")
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, rest = None, {}, []

        def close() -> Iterator[pa.RecordBatch]:
            if at is not None and total:
                a, b, x = zip(*((a, b, int(x)) for (a, b), x in sorted(total.items())), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at[0]] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(x, pa.int64())],
                    names=["lang", "a", "b", "extra"],
                )
            total.clear()

        def add(rows: list[tuple]) -> None:
            """Terms in a row of one tile: ``(term, number, p, p0)``, sorted by term."""
            for start, end in chunks(rows):
                some = rows[start:end]
                numbers, column = np.unique([r[1] for r in some], return_inverse=True)
                line = np.cumsum([n > 0 and some[n][0] != some[n - 1][0] for n in range(len(some))])
                p = np.zeros((line[-1] + 1, len(numbers)), np.int64)
                has = np.zeros(p.shape, bool)
                p[line, column], has[line, column] = [r[2] for r in some], True
                p0 = np.zeros(len(numbers), np.int64)
                p0[column] = [r[3] for r in some]
                side = numbers // TILE
                for a in range(len(numbers)):
                    if at[1] != at[2] and side[a] != at[1]:
                        continue
                    others = np.flatnonzero(side == at[2]) if at[1] != at[2] else np.arange(a + 1, len(numbers))
                    if not len(others):
                        continue
                    q, q0, mine = p[:, others], p0[others], p[:, [a]]
                    x = np.abs(mine - q) - np.abs(mine - q0) - np.abs(p0[a] - q) + np.abs(p0[a] - q0)
                    for b, value in zip(others, (x * (has[:, [a]] & has[:, others])).sum(axis=0), strict=True):
                        key = (int(numbers[a]), int(numbers[b]))
                        total[key] = total.get(key, 0) + int(value)

        def chunks(rows: list[tuple]) -> Iterator[tuple[int, int]]:
            starts = [n for n in range(len(rows)) if n == 0 or rows[n][0] != rows[n - 1][0]] + [len(rows)]
            for n in range(0, len(starts) - 1, TERMS):
                yield starts[n], starts[min(n + TERMS, len(starts) - 1)]

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("lang", "i", "j", "term", "number", "p", "p0")), strict=True)
            for lang, i, j, *row in rows:
                if (lang, i, j) != at:
                    add(rest)
                    rest = []
                    yield from close()
                    at = (lang, i, j)
                elif rest and len(rest) >= TERMS * 16 and rest[-1][0] != row[0]:
                    add(rest)
                    rest = []
                rest.append(tuple(row))
        add(rest)
        yield from close()

    sent = tiled.repartition("lang", "i", "j", "term").sortWithinPartitions("lang", "i", "j", "term")
    parts = sent.mapInArrow(sums, "lang string, a int, b int, extra bigint")
    return parts.groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every source of every language.

    Part ``term``: the ``top`` terms that the source uses more than its language does; part ``pair``: every other source of
    the language, by the distance of their shares. Only terms of ``least`` documents of the language count.
    """
    counted = term_counts(docs)
    of_term = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"in_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term)})
    first = F.row_number().over(of_term.orderBy("source")) == 1
    kept = counted.withColumn("first", first).filter(F.col("in_docs") >= least)
    kept = stored(kept.select("lang", "source", "term", "n", "lang_n", "first"), "term-counts")

    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("bigint")).alias("v"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = occurring.join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["lang_total", "v", "total", "present"])
    groups = groups.withColumns({
        "number": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1,
        "blocks": F.ceil(F.count("*").over(Window.partitionBy("lang")) / TILE).cast("int"),
        "p0": share(F.lit(0), "total", "v"),
    })
    groups = stored(groups, "groups")

    shared = ["lang", "source"]
    cells = kept.groupBy(*shared, "n", "lang_n").agg(F.count("*").alias("terms")).join(groups, shared)
    cells = stored(
        cells.withColumns({"p": share("n", "total", "v"), "q": share("lang_n", "lang_total", "v")})
        .select(*shared, "number", "n", "lang_n", "terms", "p", "q"), "cells",
    )
    return _terms(kept, cells, top).unionByName(_pairs(kept, cells, groups))


def _terms(kept: DataFrame, cells: DataFrame, top: int) -> DataFrame:
    shared = ["lang", "source"]
    above = cells.filter("p > q").withColumn("value", F.col("p") - F.col("q"))
    merged = above.groupBy(*shared, "value").agg(F.sum("terms").alias("terms"))
    # a value has a term at least, so no more than ``top`` values of a group can be within the ranks
    best = Window.partitionBy(*shared).orderBy(F.col("value").desc())
    merged = merged.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)
    before = F.coalesce(F.sum("terms").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = merged.withColumn("before", before).filter(F.col("before") < top).select(*shared, "value", "before")
    chosen = above.join(chosen, [*shared, "value"]).select(*shared, "n", "lang_n", "value", "before")
    # a value may have very many terms; each task passes on no more of them than there are ranks
    order = Window.partitionBy(*shared, "value").orderBy("term")
    ranked = kept.join(chosen, [*shared, "n", "lang_n"]).withColumn("within", F.row_number().over(order)).filter(F.col("within") <= top)
    rank = (F.col("before") + F.col("within")).cast("int")
    return ranked.select(*shared, F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank.alias("rank")).filter(F.col("rank") <= top)


def _pairs(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    here = groups.select("lang", "source", "number", "present", "v", "p0")
    there = groups.select("lang", *(F.col(c).alias(f"{c}_") for c in ("source", "number", "present", "p0")))
    # what each source's own terms would sum to if the other had none of them, by the cells of equal counts
    merged = cells.groupBy("lang", "number", "p").agg(F.sum("terms").alias("terms"))
    alone = merged.join(there.select("lang", "number_", "p0_"), "lang").filter("number <> number_")
    alone = alone.groupBy("lang", "number", "number_").agg(F.sum(F.col("terms") * F.abs(F.col("p") - F.col("p0_"))).alias("own"))
    shares = cells.select("lang", "source", "n", "p").distinct()
    numbered = kept.join(shares, ["lang", "source", "n"]).join(groups.select("lang", "source", "number", "blocks", "p0"), ["lang", "source"])
    tiles = pair_tiles(numbered.select("lang", "term", "number", "p", "p0", "blocks"))

    pairs = here.join(there, "lang").filter("number <> number_")
    pairs = pairs.join(alone, ["lang", "number", "number_"], "left")
    back = alone.select("lang", F.col("number_").alias("number"), F.col("number").alias("number_"), F.col("own").alias("own_"))
    pairs = pairs.join(back, ["lang", "number", "number_"], "left")
    pairs = pairs.withColumns({"a": F.least("number", "number_"), "b": F.greatest("number", "number_")}).join(tiles, ["lang", "a", "b"], "left")
    lacking = (F.col("v") - F.col("present") - F.col("present_")) * F.abs(F.col("p0") - F.col("p0_"))
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("own", "own_", "extra")), F.coalesce(lacking, F.lit(0)))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("source_").alias("item"), total.cast("bigint").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return pairs.withColumn("rank", F.row_number().over(order).cast("int"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
o AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS nl FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS ln, l.v::HUGEINT AS v, l.nl,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS ng
  FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (ng + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (ln + 5)) // (nl + 5 * v) AS q FROM f),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
             GROUP BY ALL) s ON s.lang = a.lang AND s.s1 = a.source AND s.s2 = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""
