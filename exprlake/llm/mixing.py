"""Temperature mixing of sources.

A source that holds the share ``p`` of all tokens gets the weight ``p ** a / sum(p ** a)``. The exponent is the
largest one between 0 and 1 that meets the target, found by bisection: a least entropy of the weights, or a
most number of times that any source may be repeated relative to the source repeated least.

The weights become token budgets, and the budgets block permutations: a source is walked through in seeded
random order, pass after pass with a new order each, until its budget is spent; its place in that walk, as a
share of the budget, says which block of the mixture a document falls into, so every block holds every source
in proportion; inside a block documents are in seeded random order.

Running totals are taken inside buckets of the random order and shifted by the totals before, so a source of
any size is spread over many tasks; texts are only counted, never moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.common import stored, stored_alone, unsigned_order

WORDS = "[^\\x20\\x09-\\x0D]+"
STEPS = 30
_HASH_BITS = 63


def token_count(text: Column) -> Column:
    """Words of a text and one end mark; 1 for a null or empty text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("bigint") + 1


def exponent(totals: DataFrame, entropy: float | None = None, repetition: float | None = None) -> float:
    """The exponent in [0, 1] that meets the targets, to ``STEPS`` halvings and six places; 1 without targets.

    ``totals`` has a positive ``p`` (share of tokens) per source. ``repetition`` bounds the ratio between the passes over
    any two sources; alone it gives the least exponent within the bound. ``entropy`` is a share of the largest possible
    one (0 to 1) and gives the largest exponent that reaches it, or the least one within ``repetition`` where none does.
    """
    low_bound = 0.0
    if repetition is not None:
        ends = totals.agg(F.max("p").alias("most"), F.min("p").alias("least")).first()
        spread = math.log(ends["most"] / ends["least"]) if ends["most"] else 0.0
        low, high = 0.0, 1.0  # repetition of a source goes as p ** (a - 1), so a = 1 always meets the limit
        for _ in range(STEPS):
            mid = (low + high) / 2
            if (1 - mid) * spread <= math.log(repetition):
                high = mid
            else:
                low = mid
        low_bound = high if spread > math.log(repetition) else 0.0
    if entropy is None:
        return math.ceil(low_bound * 1e6) / 1e6 if repetition is not None else 1.0
    n = totals.count()
    low, high = low_bound, 1.0
    # several halvings a job: all exponents that the next ones could ask for are evaluated together
    for _ in range(0, STEPS, 6):
        tried = [low + (high - low) * i / 64 for i in range(65)]
        grid = totals.select("p", F.explode(F.lit(tried)).alias("a")).withColumn("q", F.pow("p", "a"))
        sums = grid.groupBy("a").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.ln("p")).alias("s")).collect()  # 65 rows
        reached = {r["a"]: math.log(r["z"]) - r["a"] * r["s"] / r["z"] >= entropy * math.log(max(n, 1)) - 1e-12 for r in sums}
        lo, hi = 0, 64
        if reached.get(tried[hi]):
            lo = hi
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if reached.get(tried[mid]) else (lo, mid)
        low, high = tried[lo], tried[hi]
        if lo == hi:
            break
    return math.floor(low * 1e6) / 1e6


def weights(
    docs: DataFrame, source: str = "source", tokens: str = "tokens", entropy: float | None = None, repetition: float | None = None,
    budget: int | None = None,
) -> DataFrame:
    """``source, n_docs, n_tokens, share, weight, budget, passes`` per source of ``docs`` (columns ``source``, ``tokens``).

    Without ``budget`` the mixture is the smallest one in which every source is used in full at least once. A source
    without tokens gets nothing. A null source is a source of its own.
    """
    sums = stored(docs.groupBy(source).agg(F.count("*").alias("n_docs"), F.sum(tokens).cast("bigint").alias("n_tokens")), "sources")
    total = sums.agg(F.sum("n_tokens")).first()[0] or 0
    totals = sums.filter("n_tokens > 0").withColumn("share", F.col("n_tokens") / F.lit(float(max(total, 1))))
    a = exponent(totals.select(F.col("share").alias("p")), entropy, repetition)
    powered = totals.withColumn("q", F.pow("share", F.lit(a)))
    z = powered.agg(F.sum("q")).first()[0] or 1.0
    weighted = powered.withColumn("weight", F.col("q") / F.lit(z)).withColumn("exponent", F.lit(a))
    if budget is None:
        least = weighted.agg(F.max(F.col("n_tokens") / F.col("weight"))).first()[0] or 0.0
        # rounded up, and no source below one whole pass
        tokens_of = F.greatest(F.ceil(F.col("weight") * F.lit(float(least)) - 1e-6).cast("bigint"), F.col("n_tokens"))
    else:
        tokens_of = F.floor(F.col("weight") * F.lit(float(budget)) + 0.5).cast("bigint")
    return weighted.withColumn("budget", tokens_of).withColumn("passes", F.col("budget") / F.col("n_tokens")).drop("q")


def mix(
    docs: DataFrame, entropy: float | None = 0.95, repetition: float | None = 2.0, budget: int | None = None, block_tokens: int = 1 << 20,
    key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 13, extra: tuple[Column, ...] = (),
) -> DataFrame:
    """The mixture: one row per use of a document.

    ``key, source, copy`` (pass, from 0), ``tokens, block, pos`` (place in the block, from 0), ``weight`` and
    ``passes`` of the source, and the ``extra`` columns.

    A document is used in a pass if its tokens begin before the budget ends, so a source overshoots by less than one
    document. Repeated rows are used once each, a null key is kept, a null text has one token. Equal hashes go by key.
    No rows give no rows.
    """
    base = stored(
        docs.select(
            F.col(key).alias("k"), F.col(source).alias("source"), token_count(F.col(text)).alias("tokens"), *extra
        ).withColumn("s", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce(F.col("source").cast("string"), F.lit("")))),
        "mix",
    )
    names = [c for c in base.columns if c not in ("k", "source", "tokens", "s")]
    plan = stored(weights(base, "s", "tokens", entropy, repetition, budget), "weights")
    rows = base.count()
    bits = max(6, (rows // 100_000).bit_length())
    whole = plan.agg(F.sum("budget")).first()[0] or 0
    n_blocks = max(1, -(-whole // block_tokens))
    # passes that are complete need no running total to be chosen, but all need one to be placed
    used = base.join(plan.select("s", "weight", "passes", "budget", "n_tokens"), "s").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes").cast("int") - 1, F.lit(0))))
    ).withColumn("u", unsigned_order(seed, F.col("copy"), F.col("k"), F.col("tokens"))).withColumn("b", F.shiftright("u", _HASH_BITS - bits))
    before = Window.partitionBy("s", "copy").orderBy("b")
    offsets = used.groupBy("s", "copy", "b").agg(F.sum("tokens").alias("t")).select("s", "copy", "b", (F.sum("t").over(before) - F.col("t")).alias("offset"))
    within = Window.partitionBy("s", "copy", "b").orderBy("u", "k", "tokens", *names).rowsBetween(Window.unboundedPreceding, -1)
    begun = (
        used.withColumn("begin", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .join(offsets, ["s", "copy", "b"])
        .withColumn("begin", F.col("begin") + F.col("offset") + F.col("copy") * F.col("n_tokens"))
        .filter(F.col("begin") < F.col("budget"))
        .withColumn("block", F.floor(F.col("begin") / F.col("budget") * n_blocks))
        .withColumn("v", unsigned_order(seed + 1, F.col("copy"), F.col("k"), F.col("tokens")))
    )
    inside = Window.partitionBy("block").orderBy("v", "s", "begin")
    return begun.withColumn("pos", F.row_number().over(inside).cast("bigint") - 1).select(
        F.col("k").alias(key), F.col("source").alias(source), "copy", "tokens", "block", "pos", "weight", "passes", *names
    )


def realise(docs: DataFrame, key: str = "doc_id", **options: object) -> DataFrame:
    """The rows of ``docs`` as often as the mixture uses them, in its order; the columns are those of ``docs``.

    Equal rows are told apart by nothing, so they are met as one row with all their uses.
    """
    def keyed(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    mark = F.xxhash64(*[F.col(c) for c in docs.columns]).alias("__mark")
    plan = mix(docs, key=key, extra=(mark,), **options).select(keyed(F.col(key)).alias("__key"), "__mark", F.col("block").alias("__block"), F.col("pos").alias("__pos"))
    # Keys without nulls (the mark tells a null key from an empty one), so that one dealing of the texts serves the rows'
    # repeats and their uses; what the plan itself has shuffled is dropped before.
    rows = docs.withColumns({"__mark": mark, "__key": keyed(F.col(key))}).repartition("__key", "__mark").dropDuplicates(["__key", "__mark"])
    met = rows.join(stored_alone(plan, "uses"), ["__key", "__mark"])
    return met.repartitionByRange("__block").sortWithinPartitions("__block", "__pos").select(*docs.columns)
