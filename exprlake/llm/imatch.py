"""I-Match fingerprints over randomised lexicon subsets, with DataFrame functions only.

The lexicon holds the terms whose share of documents lies in a band: common enough to be seen again, rare
enough to tell documents apart. It is kept as bits of term hashes; since a document has a bounded mean number of
distinct terms, ``least_share`` bounds the lexicon at every corpus size.

A fingerprint has ``LEVELS`` groups of ``SUBSETS`` hashes. Every hash belongs to a random subset of the lexicon and is
that of the text's sorted distinct terms in the subset; a term is in one subset of a group at most. Subsets of
the first group share the whole lexicon between them, those of every next one a quarter as much, so texts of any length
have subsets in which they hold only a few terms. Two fingerprints are as alike as the share of equal hashes among
subsets that either text has terms in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.common import stored

LEVELS = 5
SUBSETS = 16
LEXICON_BITS = 22
LEAST_SHARE = 3e-4
MOST_SHARE = 0.05
EDGES = 255


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text."""
    split = F.split(F.lower(text), "[\\x20\\x09-\\x0D]+")
    return F.array_distinct(F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w)))


def bit_of(term: Column) -> Column:
    return F.shiftrightunsigned(term, 64 - LEXICON_BITS).cast("int")


def lexicon(distinct: DataFrame, rows: int, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> Column:
    """Array of longs with a bit for the hash of every term in the band, as a subquery. ``distinct`` has ``terms`` per text."""
    low, high = max(2.0, least_share * rows), max(2.0, most_share * rows)
    inside = distinct.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n").between(low, high))
    at = bit_of(F.col("term"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)))
    longs = inside.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(one).alias("bits"))
    every = distinct.sparkSession.range(1 << (LEXICON_BITS - 6)).select(F.col("id").cast("int").alias("at"))
    filled = stored(every.join(longs, "at", "left").select("at", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")), "lexicon")
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("bits")).scalar()


def in_subset(level: int, k: int | None = None) -> Callable[[Column], Column]:
    """Whether a term is in subset ``k`` of a level, or in any; every level reads bits of its own."""
    bits = [(SUBSETS * 4**x).bit_length() - 1 for x in range(level + 1)]

    def test(term: Column) -> Column:
        own = F.shiftrightunsigned(term, sum(bits[:-1])).bitwiseAND(F.lit((1 << bits[-1]) - 1))
        return own < SUBSETS if k is None else own == k

    return test


def with_fingerprint(df: DataFrame, text: str, bits: Column, out: str) -> DataFrame:
    """``df`` with ``out``: ``LEVELS * SUBSETS`` integers, 0 for a subset of which the text holds no term.

    A text that holds no term of the lexicon is told by all its terms; one without terms has zeros only.
    """

    def known(t: Column) -> Column:
        at = bit_of(t)
        return F.call_function("getbit", F.get("__bits", F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))) == 1

    df = df.withColumn("__terms", terms(F.coalesce(F.col(text), F.lit(""))))
    # a subquery can't stand inside a lambda; as a column that is read once it is merged into it, and is never a field of a row
    df = df.withColumn("__bits", bits).withColumn("__inside", F.filter("__terms", known)).drop("__bits")
    df = df.withColumn("__chosen", F.array_sort(F.when(F.size("__inside") > 0, F.col("__inside")).otherwise(F.col("__terms"))))
    columns = []
    for level in range(LEVELS):
        df = df.withColumn(f"__in{level}", F.filter("__chosen", in_subset(level)))
        columns += [F.filter(f"__in{level}", in_subset(level, k)) for k in range(SUBSETS)]
    parts = F.array(*columns)
    df = df.withColumn(out, F.transform(parts, lambda x: F.when(F.size(x) > 0, F.hash(x)).otherwise(F.lit(0))))
    return df.drop("__terms", "__inside", "__chosen", *[f"__in{level}" for level in range(LEVELS)])


def as_text(marks: Column) -> Column:
    """A fingerprint as hexadecimal digits."""
    return F.concat_ws("", F.transform(marks, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among subsets of which either text has a term; 1 where neither has any, being equal."""
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda x: x))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda x: x))
    return F.when(either > 0, both / either).otherwise(F.lit(1.0))


def successors(ids: DataFrame) -> DataFrame:
    """``id, next`` for the distinct ``id``s of a table in ascending order, the first following the last.

    Ids are dealt into buckets between quantiles, so that no task sorts them all; a few rows join the buckets.
    """
    ids = stored(ids.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max("n").alias("n")), "ids")
    quantiles = [(i + 1) / (EDGES + 1) for i in range(EDGES)]
    edges = ids.agg(F.percentile_approx("id", F.array(*map(F.lit, quantiles)), F.lit(10_000)).alias("e")).first()["e"] or []
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e <= F.col("id"))) if edges else F.lit(0)
    dealt = ids.withColumn("b", bucket)
    heads = dealt.groupBy("b").agg(F.min("id").alias("head"))  # EDGES + 1 rows at most
    order = Window.orderBy("b")
    after = heads.select("b", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    following = F.lead("id").over(Window.partitionBy("b").orderBy("id"))
    return dealt.withColumn("next", following).join(after, "b").select("id", "n", F.coalesce("next", "after").alias("next"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms.

    ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row. The edited text
    has its last ``floor(n_chars / 2)`` characters replaced by the first as many of the next document's, in ascending
    order of keys, the first following the last; a single document follows itself.

    * A null text is empty. Equal texts have equal fingerprints.
    * Rows that repeat a key are rows of the same place: each is followed by the next key, of whose texts the smallest
      is taken. Rows with a null key have no place and are left out; no rows give no rows.
    * Other columns are not read.
    """
    body = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    follow = stored(successors(body.select("id", F.char_length("t").alias("n"))), "successors")
    bits = lexicon(body.select(terms(F.col("t")).alias("terms")), body.count())
    marked = with_fingerprint(body, "t", bits, "marks")
    # a text goes to its predecessor's place only as far as it is needed there
    heads = marked.join(follow.select(F.col("id").alias("before"), F.col("next").alias("id"), "n"), "id").select(
        "before", F.struct(F.left("t", F.floor(F.col("n") / 2).cast("int")).alias("head"), F.col("marks").alias("next_marks")).alias("x")
    )
    heads = heads.groupBy(F.col("before").alias("id")).agg(F.min("x").alias("x"))
    n = F.char_length("t")
    half = F.floor(n / 2).cast("int")
    met = marked.join(heads, "id").withColumn("edited", F.concat(F.left("t", n - half), F.left("x.head", half)))
    done = with_fingerprint(met, "edited", bits, "edited_marks")
    return done.select(
        F.col("id").alias(key), n.cast("bigint").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("marks")).alias("fingerprint"), as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("x.next_marks")).alias("near_next"),
    )
