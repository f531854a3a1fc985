"""Scoring texts by prediction by partial matching over bytes.

A trie of byte contexts (``ORDER - 1`` symbols at most, the text's start and the words' ends being symbols) is
filled from the training texts. Contexts run on over the ends of words, or begin anew with each word (``across``). A symbol is predicted from the longest known context; where it was never seen
there, an escape of the estimate ``kinds / (2 * total)`` (method D: every kind gives half a count to it) leads to
the next shorter one, in which all symbols that the longer ones could have predicted are excluded; below the
empty context symbols are uniform. Before each word the text may end, with the share that ends have among training
tokens. A text's code length is the sum of its words' and its end's.

Words of different languages share few contexts, so a trie is kept for each of the largest groups of the training
rows (a column, such as the language) and one for the rest of them, and a text's probability is the mixture of
theirs: the group is never read when a text is scored.

No trie is ever held whole. Every symbol that follows a context in training also follows the shorter ones, so a symbol
is coded from the contexts on one path. Nodes are dealt by the two nearest symbols of their context and sorted
so that a context comes before those that continue it to the left: a task holds one path, and the contexts of at most
one symbol, of which there are 258. Each distinct symbol with its longest context is coded once, each distinct
word is the sum of its symbols' codes, each text that of its words'. Where contexts run on, a word's own sum begins
after its first ``ORDER - 1`` symbols; those are summed with the ``ORDER - 1`` symbols before the word, as a junction.

Words that make up a ``FREQUENT``-th of all tokens, of which there are ``FREQUENT`` at most, are looked up inside the
tasks, as are such junctions; all other words and junctions of a text meet their count and their codes in a shuffle by word, where no key is large. The
coded symbols of words meet their codes in the same two ways.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exprlake.llm.common import kept, removed, stored_alone, words
from exprlake.llm.common import names as column_names

ORDER = 6
START, END, SYMBOLS = 256, 257, 257
BITS = 9
FREQUENT = 300_000
#: Distinct words and junctions that a task counts at a time, and those whose nodes it counts at a time.
HELD, COUNTED = 400_000, 100_000
_TOP = np.uint64(BITS * ORDER)
_MASKS = [np.uint64((1 << (BITS * (k + 1))) - 1) for k in range(ORDER)]
ROWS = "row bigint, doc bigint, hash bigint, tf bigint, wf bigint, n_tokens bigint, n_known bigint, base double"
_SYMBOL = (1 << BITS) - 1


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def top_grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every coded symbol of the words: the packed symbol with its longest context, and the word's number."""
    lens = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(lens + 2) - (lens + 2)
    symbols = np.full(int((lens + 2).sum()), SYMBOLS + 99, np.uint64)
    symbols[starts], symbols[starts + lens + 1] = START, END
    symbols[symbols == SYMBOLS + 99] = np.frombuffer(b"".join(found), np.uint8)
    of = np.repeat(np.arange(len(found)), lens + 2)
    place = np.arange(len(symbols)) - starts[of]
    coded = place > 0
    return packed(symbols, place)[coded], of[coded]


def packed(symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each symbol with up to ``ORDER - 1`` symbols before it that belong to the same row; ``place`` numbers a row's symbols."""
    grams = symbols.copy()
    for k in range(1, ORDER):
        grams[k:] |= np.where(place[k:] >= k, symbols[:-k] << np.uint64(BITS * k), np.uint64(0))
    return grams | (np.minimum(place, ORDER - 1).astype(np.uint64) << _TOP)


def junctions(found: list[bytes]) -> list[bytes]:
    """Of every word of a text the first ``ORDER - 1`` symbols behind as many before them; ends are spaces, what lies before the text is line ends."""
    out, before = [], b"\n" * (ORDER - 1)
    for w in found:
        out.append(before + (w[: ORDER - 1] if len(w) >= ORDER - 1 else w + b" "))
        before = (before + w + b" ")[1 - ORDER :]
    return out


def is_junction(column: str) -> Column:
    """No word holds a space or line end, and what precedes a word ends with one."""
    return F.substring(column, ORDER - 1, 1).isin(F.lit(b" "), F.lit(b"\n"))


def later_grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`top_grams` for words and :func:`junctions`: the symbols that have ``ORDER - 1`` others before them."""
    rows = [x if x[ORDER - 2 : ORDER - 1] in (b" ", b"\n") else x + b" " for x in found]
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    symbols = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint64)
    symbols[symbols == ord(" ")], symbols[symbols == ord("\n")] = END, START
    of = np.repeat(np.arange(len(rows)), lens)
    place = np.arange(len(symbols)) - (np.cumsum(lens) - lens)[of]
    coded = place >= ORDER - 1
    return packed(symbols, place)[coded], of[coded]


def node_counts(found: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trie nodes (order, context and symbol in one integer) of all orders and their weighted counts."""
    grams, of = top_grams(found)
    nodes, at = np.unique(grams, return_inverse=True)
    n = np.bincount(at, counts[of].astype(np.float64), len(nodes))
    order = nodes >> _TOP
    out, sums = [], []
    for k in range(ORDER):
        deep = order >= k
        low, at = np.unique((nodes[deep] & _MASKS[k]) | (np.uint64(k) << _TOP), return_inverse=True)
        out.append(low)
        sums.append(np.bincount(at, n[deep], len(low)))
    return np.concatenate(out), np.concatenate(sums).astype(np.int64)


def places(grams: np.ndarray) -> np.ndarray:
    """Packed symbols (:func:`top_grams`) as integers whose order puts a context before those that continue it to the left."""
    order, out = grams >> _TOP, np.zeros(len(grams), np.uint64)
    for k in range(1, ORDER):
        nearest = (grams >> np.uint64(BITS * k)) & np.uint64(_SYMBOL)
        out |= np.where(order >= k, (nearest + np.uint64(1)) << np.uint64(BITS * (ORDER - k)), np.uint64(0))
    return (out | (grams & np.uint64(_SYMBOL))).astype(np.int64)


def packed_grams(at: np.ndarray) -> np.ndarray:
    """The packed symbols of :func:`places`."""
    at = at.astype(np.uint64)
    out, order = at & np.uint64(_SYMBOL), np.zeros(len(at), np.uint64)
    for k in range(1, ORDER):
        nearest = (at >> np.uint64(BITS * (ORDER - k))) & np.uint64(_SYMBOL)
        out |= np.where(nearest > 0, nearest - np.uint64(1), np.uint64(0)) << np.uint64(BITS * k)
        order += nearest > 0
    return out | (order << _TOP)


class Trie:
    """Contexts (order and packed symbols in one integer), each with the symbols seen after it and their counts.

    A context is put in after the next shorter one; all its symbols follow that one, too.
    """

    def __init__(self) -> None:
        self.at: dict[int, tuple[dict[int, int], int, int]] = {}  # symbols, their sum, their sum in the shorter context

    @classmethod
    def of_nodes(cls, nodes: np.ndarray, counts: np.ndarray) -> Trie:
        """From :func:`node_counts`."""
        found: dict[int, dict[int, int]] = {}
        for node, n in zip(nodes.tolist(), counts.tolist(), strict=True):
            if n:
                found.setdefault(context_of(node), {})[node & _SYMBOL] = n
        trie = cls()
        for context in sorted(found):
            trie.put(context, found[context])
        return trie

    def put(self, context: int, seen: dict[int, int]) -> None:
        order = context >> int(_TOP)
        inside = 0
        if order:
            shorter = self.at[((order - 1) << int(_TOP)) | (context & ((1 << (BITS * (order - 1))) - 1))][0]
            inside = sum(map(shorter.__getitem__, seen))
        self.at[context] = (seen, sum(seen.values()), inside)

    def code(self, gram: int) -> float:
        """log10 probability of the symbol of a packed gram after its context."""
        top = int(_TOP)
        order, symbol = gram >> top, gram & _SYMBOL
        rest = (gram & ((1 << top) - 1)) >> BITS
        excluded = inside = 0  # kinds of the longer context, and their counts in this one
        log = 0.0
        for k in range(order, -1, -1):
            found = self.at.get((k << top) | (rest & ((1 << (BITS * k)) - 1)))
            if found is None:
                continue
            seen, total, below = found
            kinds = len(seen) - excluded
            if kinds:
                n = seen.get(symbol)
                if n is not None:
                    return log + math.log10((n - 0.5) / (total - inside))
                log += math.log10(0.5 * kinds / (total - inside))
            excluded, inside = len(seen), below
        return log - math.log10(SYMBOLS - excluded)


def context_of(node: int) -> int:
    top = int(_TOP)
    return ((node & ((1 << top) - 1)) >> BITS) | (node >> top << top)


def vocabulary(rows: DataFrame, groups: list[str], across: bool = False) -> DataFrame:
    """``hash, word, c0, c1, ...`` of the words of rows ``t, g, learn``: counts of all training rows and of each group of ``g``.

    ``across``: of their :func:`junctions`, too.
    """
    columns = [f"c{i}" for i in range(len(groups) + 1)]
    number = {g: i + 1 for i, g in enumerate(groups)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter() for _ in columns]  # the first for rows of no group
        asked: set[bytes] = set()  # words of rows that are only scored

        def flush() -> pa.RecordBatch:
            found = list(asked.union(*seen))
            counts = np.array([[c.get(w, 0) for w in found] for c in seen], np.int64).reshape(len(columns), len(found))
            counts[0] = counts.sum(axis=0)
            for c in [asked, *seen]:
                c.clear()
            arrays = [pa.array(list(map(word_hash, found)), pa.int64()), pa.array(found, pa.binary()), *map(pa.array, counts)]
            return pa.RecordBatch.from_arrays(arrays, names=["hash", "word", *columns])

        for batch in batches:
            for t, g, learn in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = words(t)
                for x in (found, junctions(found)) if across else (found,):
                    (seen[number.get(g, 0)] if learn else asked).update(x)
                if len(asked) + sum(map(len, seen)) > HELD:
                    yield flush()
        yield flush()

    ddl = "hash bigint, word binary, " + ", ".join(f"{c} bigint" for c in columns)
    # a word is told by its hash here and below; of words of one hash the smallest is kept
    return rows.select("t", "g", "learn").mapInArrow(run, ddl).groupBy("hash").agg(F.min("word").alias("word"), *[F.sum(c).alias(c) for c in columns])


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(x.num_rows for x in held) >= rows):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []


def count_nodes(vocab: DataFrame, columns: list[str], grams_of: Callable = top_grams) -> DataFrame:
    """``place, asked`` and the counts ``columns``: all trie nodes, and how many symbols of ``vocab`` have them as their longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, COUNTED):
            if not batch.num_rows:
                continue
            grams, of = grams_of(batch.column(0).to_pylist())
            nodes, at = np.unique(grams, return_inverse=True)
            asked = np.bincount(at, minlength=len(nodes))
            counts = np.stack([np.bincount(at, batch.column(1 + k).to_numpy()[of], len(nodes)) for k in range(len(columns))])
            order, learned = nodes >> _TOP, counts.any(axis=0)
            for k in range(ORDER):
                own = order == k
                deep = own | (learned & (order > k))
                low, at = np.unique((nodes[deep] & _MASKS[k]) | (np.uint64(k) << _TOP), return_inverse=True)
                sums = [np.bincount(at, np.where(own, asked, 0)[deep], len(low)), *(np.bincount(at, c[deep], len(low)) for c in counts)]
                yield pa.RecordBatch.from_arrays([pa.array(places(low)), *(pa.array(x.astype(np.int64)) for x in sums)], names=["place", "asked", *columns])

    ddl = ", ".join(f"{c} bigint" for c in ["place", "asked", *columns])
    sums = [F.sum(c).alias(c) for c in ["asked", *columns]]
    return vocab.select("word", *columns).mapInArrow(run, ddl).groupBy("place").agg(*sums)


def code_nodes(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``place, asked, l0, l1, ...``: log10 probability of every asked node of :func:`count_nodes`, by the trie of each column."""
    second = F.shiftright("place", BITS * (ORDER - 2))  # the context's two nearest symbols
    short = second.bitwiseAND(F.lit(_SYMBOL)) == 0
    names = ["place", "asked", *(f"l{k}" for k in range(len(columns)))]
    near = nodes.filter(short).select("place", *columns).toArrow()  # contexts of one symbol at most: 258 of 257 nodes
    table = nodes.sparkSession.sparkContext.broadcast([near[c].to_numpy() for c in ["place", *columns]])
    del near
    top = int(_TOP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, *counts = table.value
        tries = [Trie.of_nodes(packed_grams(first), c) for c in counts]
        path = [-1] * ORDER  # the context of each order on the way

        def contexts(at: list[int], grams: list[int], asked: list[int], counts: list[list[int]], ends: list[int]) -> Iterator[tuple]:
            begin = 0
            for end in ends:
                context = context_of(grams[begin])
                order = context >> top
                if order > 1:
                    for trie in tries:
                        for k in range(order, ORDER):
                            trie.at.pop(path[k], None)
                    path[order] = context
                    for trie, n in zip(tries, counts, strict=True):
                        seen = {g & _SYMBOL: x for g, x in zip(grams[begin:end], n[begin:end], strict=True) if x}
                        if seen:
                            trie.put(context, seen)
                for i in range(begin, end):
                    if asked[i]:
                        yield (at[i], asked[i], *(trie.code(grams[i]) for trie in tries))
                begin = end

        schema = pa.schema([(c, pa.int64()) for c in ["place", "asked", *columns]])
        held = None
        for batch in itertools.chain(batches, [None]):
            whole = pa.Table.from_batches([x for x in (held, batch) if x is not None], schema).combine_chunks()
            if not whole.num_rows:
                continue
            at = whole["place"].to_numpy()
            ends = np.flatnonzero(np.diff(at >> BITS)) + 1
            ends = ends.tolist() + ([len(at)] if batch is None else [])
            last = ends[-1] if ends else 0  # the last context may go on in the next batch
            held = whole.slice(last).to_batches()[0] if last < len(at) else None
            grams = packed_grams(at[:last]).tolist()
            part = [whole[c].to_numpy()[:last].tolist() for c in ["place", "asked", *columns]]
            rows = list(contexts(part[0], grams, part[1], part[2:], ends))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names)

    ddl = "place bigint, asked bigint, " + ", ".join(f"{c} double" for c in names[2:])
    return nodes.repartition(second).sortWithinPartitions("place").select("place", "asked", *columns).mapInArrow(run, ddl)


def code_words(vocab: DataFrame, codes: DataFrame, tries: int, grams_of: Callable = top_grams) -> DataFrame:
    """``hash, c0, l0, l1, ...``: log10 probability of each word of ``vocab`` with its end, by each trie."""
    logs = [f"l{k}" for k in range(tries)]
    asked = codes.agg(F.sum("asked")).first()[0] or 0
    often = codes.filter(F.col("asked") * FREQUENT >= asked).sort("place").toArrow()
    table = vocab.sparkSession.sparkContext.broadcast((often["place"].to_numpy(), [often[x].to_numpy() for x in logs]))
    del often
    names = ["hash", "c0", "place", *logs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes = table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found, hashes, c0 = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            grams, of = grams_of(found)
            at = places(grams)
            spot = np.minimum(np.searchsorted(known, at), max(len(known) - 1, 0))
            hit = known[spot] == at if len(known) else np.zeros(len(at), bool)
            sums = [np.bincount(of[hit], c[spot[hit]], len(found)) for c in codes]
            # a row per symbol not found; a word without one asks for nothing
            none = np.flatnonzero(np.bincount(of[~hit], minlength=len(found)) == 0)
            row = np.concatenate([of[~hit], none])
            place = np.concatenate([at[~hit], ~(hashes[none] & np.int64((1 << 63) - 1))])
            first = np.zeros(len(row), bool)
            first[np.unique(row, return_index=True)[1]] = True
            arrays = [hashes[row], np.where(first, c0[row], 0), place, *(np.where(first, x[row], 0.0) for x in sums)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=names)

    ddl = "hash bigint, c0 bigint, place bigint, " + ", ".join(f"{c} double" for c in logs)
    sent = vocab.select("word", "hash", "c0").mapInArrow(run, ddl)
    met = sent.join(codes.select("place", *[F.col(c).alias(f"own_{c}") for c in logs]), "place", "left")
    sums = [F.sum(F.col(c) + F.coalesce(f"own_{c}", F.lit(0.0))).alias(c) for c in logs]
    return met.groupBy("hash").agg(F.sum("c0").alias("c0"), *sums)


def score(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", group: str | None = None, max_groups: int = 7,
    across: bool = False,
) -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` per row; ``learn`` says which rows are learned from.

    * Tokens are the words and one end. ``base_score`` is the unigram score with 0.5 added to every count, ``score`` the
      model's; both are log10 probabilities of the whole text.
    * A null text is empty: its end is its only token. Without training rows the trie is empty and symbols are uniform.
    * ``group`` is read of training rows only; those of a null or smaller group, or without ``group`` all, share one trie.
    * ``across``: contexts run on over the ends of words to the text's start, so the order of words counts; else each word
      begins anew.
    * Repeated rows are scored once each; a null key is kept. Other columns are not read.
    """
    spark = docs.sparkSession
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("t"), g.alias("g"), F.coalesce(learn, F.lit(False)).alias("learn"))
    taught = rows.filter("learn")
    ends = taught.count()
    sizes = taught.filter(F.col("g").isNotNull()).groupBy("g").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "g").limit(max_groups).collect()
    groups = [r["g"] for r in sizes]
    rest = ends - sum(r["n"] for r in sizes)
    columns = [f"c{i + 1}" for i in range(len(groups))] + (["rest"] if rest or not groups else [])
    weights = [r["n"] / ends for r in sizes] + ([rest / ends if ends else 1.0] if rest or not groups else [])

    others = sum((F.col(f"c{i + 1}") for i in range(len(groups))), F.lit(0))
    grams_of = later_grams if across else top_grams
    vocab = stored_alone(vocabulary(rows, groups, across).withColumn("rest", F.col("c0") - others), "vocabulary")
    sums = vocab.filter(~is_junction("word")).agg(F.sum("c0").alias("n"), F.count_if(F.col("c0") > 0).alias("v")).first()
    total, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    floor = total + 0.5 * (distinct + 1)
    share = min(max(ends / total, 1e-12), 1 - 1e-12) if total else 0.5
    go, stop = math.log10(1 - share), math.log10(share)
    logs = [f"l{k}" for k in range(len(columns))]
    nodes = stored_alone(count_nodes(vocab, columns, grams_of), "nodes")
    codes = stored_alone(code_nodes(nodes, columns), "codes")
    removed(nodes)
    coded = stored_alone(code_words(vocab, codes, len(columns), grams_of), "coded-words")
    removed(codes)
    often = vocab.filter((F.col("c0") > 0) & (F.col("c0") * FREQUENT >= total)).select("hash", "word").join(coded, "hash").toArrow()
    frequent = spark.sparkContext.broadcast((often["word"].to_pylist(), often["c0"].to_pylist(), np.stack([often[x].to_numpy() for x in logs], axis=1)))
    del often
    removed(vocab)
    version = uuid.uuid4().hex

    def base(c: int) -> float:
        return math.log10((c + 0.5) / floor)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts, codes = frequent.value
        table = kept("frequent words", lambda: {w: (i, base(c)) for i, (w, c) in enumerate(zip(found, counts, strict=True))}, version)
        row = TaskContext.get().partitionId() << 40
        kinds = [pa.int64()] * 7 + [pa.float64()]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                own = batch.slice(i, 500)
                columns: list[list] = [[] for _ in kinds]
                rows_, docs_, hashes, tf, wf, n_tokens, n_known, bases = columns
                heads, spots, times, of = [], [], [], []  # a document's first row, and the known words of documents
                for n, (doc, t) in enumerate(zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True)):
                    row += 1
                    known, length, b, rare = int(ends > 0), 0, base(ends), 0
                    heads.append(len(rows_))
                    whole = words(t)
                    for w, c in Counter(whole).items():
                        length += c
                        x = table.get(w)
                        if x is None:
                            hashes.append(word_hash(w))
                            tf.append(c)
                            wf.append(c)
                            rare += 1
                        else:
                            known += c
                            b += c * x[1]
                            spots.append(x[0])
                            times.append(c)
                            of.append(n)
                    for w, c in Counter(junctions(whole)).items() if across else ():
                        x = table.get(w)
                        if x is None:
                            hashes.append(word_hash(w))
                            tf.append(c)
                            wf.append(0)
                            rare += 1
                        else:
                            spots.append(x[0])
                            times.append(c)
                            of.append(n)
                    if not rare:  # a row that asks for no word carries the document
                        hashes.append(row)
                        tf.append(0)
                        wf.append(0)
                        rare = 1
                    rows_ += [row] * rare
                    for column, value in ((docs_, doc), (n_tokens, length + 1), (n_known, known), (bases, b)):
                        column.append(value)
                        column += [None] * (rare - 1)
                sums = np.zeros((len(logs), len(rows_)))
                for k in range(len(logs)):
                    sums[k, heads] = np.bincount(np.array(of, np.int64), np.array(times, float) * codes[np.array(spots, np.int64), k], len(heads))
                arrays = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, *map(pa.array, sums)], names=[*column_names(ROWS), *(f"s_{x}" for x in logs)])

    ddl = ROWS + "".join(f", s_{x} double" for x in logs)
    met = rows.select("doc", "t").mapInArrow(meet, ddl).join(coded, "hash", "left")
    c = F.coalesce("c0", F.lit(0))
    per_word = met.select(
        "row", "doc", "n_tokens",
        (F.coalesce("n_known", F.lit(0)) + F.when(c > 0, F.col("wf")).otherwise(0)).alias("n_known"),
        (F.coalesce("base", F.lit(0.0)) + F.col("wf") * F.log10((c + 0.5) / F.lit(floor))).alias("base"),
        *[(F.col(f"s_{x}") + F.col("tf") * F.coalesce(x, F.lit(0.0))).alias(x) for x in logs],
    )
    texts = per_word.groupBy("row").agg(
        F.max("doc").alias(key), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"),
        F.array(*[F.sum(x) + F.lit(math.log10(w)) for x, w in zip(logs, weights, strict=True)]).alias("by_trie"),
    )
    top = F.array_max("by_trie")
    mixed = top + F.log10(F.aggregate(F.transform("by_trie", lambda x: F.pow(F.lit(10.0), x - top)), F.lit(0.0), lambda a, x: a + x))
    of_text = mixed + (F.col("n_tokens") - 1) * F.lit(go) + F.lit(stop)
    return texts.select(key, "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", of_text.alias("score"))
