"""The prefix trie of conversations that are rebuilt from a head of one and the rest of another.

A sequence of turns has a fingerprint in a monoid: the sum of its turns' hashes, each times the base to the power of its
place, modulo a prime, in four lanes. Running sums of every conversation give the fingerprint of any stretch of it as a
difference, and a stretch is moved by a power of the base. So the prefixes of a rebuilt conversation follow from the sums
of its base's head and of its own rest; its text is never put together. Equal fingerprints are verified: the members of a
node must have the same last turn and the same parent, and turns of equal hashes must have equal texts. Otherwise all is
hashed anew with another seed.

Rows without a ``conv_id`` belong to no conversation and are left out. Turns are in the order of ``turn``, null first;
turns of one number are in the order of their hashes, the same in every run. Null roles and texts are empty, repeated rows
are turns of their own, an empty table has no nodes. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.common import stored
from exprlake.operators.ordering import keyed_position

#: The field of the fingerprints; products of two members fit 64 bits.
PRIME = (1 << 31) - 1
LANES = 4
#: Turns or nodes of a conversation that are worked on in one place.
STRETCH = 4096
#: Ids of a conversation range that are written out together; a power of two.
RANGE_BITS = 12
#: Parents of more children than this are joined by broadcast; at most ``PARENTS`` of them.
CHILDREN, PARENTS = 10_000, 100_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
SUMS = [f"s{n}" for n in range(LANES)]


def bases(seed: int) -> list[int]:
    """One number of the field for each lane."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{n}".encode()).digest()[:8], "big") % (PRIME - 2) + 2 for n in range(LANES)]


def power(base: int, exponent: np.ndarray) -> np.ndarray:
    """``base ** exponent`` in the field; negative exponents are powers of the inverse."""
    out = np.ones(len(exponent), np.int64)
    for b, some in ((base, exponent >= 0), (pow(base, PRIME - 2, PRIME), exponent < 0)):
        left, factor = np.where(some, np.abs(exponent), 0), b
        while left.any():
            out = np.where(left & 1, out * factor % PRIME, out)
            left, factor = left >> 1, factor * factor % PRIME
    return out


def lanes(h1: pd.Series, h2: pd.Series) -> list[np.ndarray]:
    """A turn's two hashes as four numbers of the field."""
    return [((h.to_numpy(np.int64) >> shift) & PRIME) % PRIME for h in (h1, h2) for shift in (0, 31)]


def weighted(place: Column, seed: int) -> Column:
    """The lanes of a turn at a place, as a struct."""
    base = bases(seed)

    @F.pandas_udf(", ".join(f"{s} bigint" for s in SUMS))
    def weigh(place: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        at = place.to_numpy(np.int64)
        return pd.DataFrame({s: t * power(b, at) % PRIME for s, t, b in zip(SUMS, lanes(h1, h2), base, strict=True)})

    return weigh(place, "h1", "h2")


def fingerprints(seed: int) -> Column:
    """``ka, kb`` of a rebuilt prefix and ``pa, pb`` of the one before, from sums that are moved to their place.

    Reads ``depth``, ``shift`` (of the own rest), the sums ``s`` to the turn, ``o`` to the end of the own turns left out and ``e``
    of the head.
    """
    base = bases(seed)

    @F.pandas_udf("ka bigint, kb bigint, pa bigint, pb bigint")
    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        shift, depth = frame["shift"].to_numpy(np.int64), frame["depth"].to_numpy(np.int64)
        own = lanes(frame["h1"], frame["h2"])
        here, before = [], []
        for n, b in enumerate(base):
            s, o, e = (frame[f"{c}{n}"].to_numpy(np.int64) for c in "soe")
            whole = (e + (s - o) % PRIME * power(b, shift)) % PRIME
            here.append(whole)
            before.append((whole - own[n] * power(b, depth)) % PRIME)
        return pd.DataFrame({"ka": here[0] << 31 | here[1], "kb": here[2] << 31 | here[3], "pa": before[0] << 31 | before[1], "pb": before[2] << 31 | before[3]})

    return combine(F.struct("depth", "shift", "h1", "h2", *SUMS, *(f"{c}{n}" for c in "oe" for n in range(LANES))))


def stretches(rows: DataFrame, last: str) -> DataFrame:
    """Every row once for each stretch of its conversation up to place ``last``: a key that a long conversation is dealt by."""
    return rows.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.floor(F.col(last) / STRETCH).cast("int"))))


def stretch(place: str) -> Column:
    return F.floor(F.col(place) / STRETCH).cast("int")


def running_sums(turns: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, place, h1, h2, bytes`` with the running sums of their lanes, and ``conv_id, turns``."""
    placed = keyed_position(
        turns.withColumn("key", F.struct("conv_id", "turn", "h1", "h2")), ["conv_id"], "key", out="place", keep_bucket=True
    ).select("conv_id", "_b", "place", F.col("place_n").alias("turns"), "h1", "h2", "bytes")
    placed = placed.withColumn("w", weighted(F.col("place"), seed)).select("*", *(f"w.{s}" for s in SUMS)).drop("w")
    placed = stored(placed, "turns")
    # a bucket of a conversation is bounded; the sums of those before it are added to its own
    parts = placed.groupBy("conv_id", "_b").agg(*(F.sum(s).alias(s) for s in SUMS))
    before = Window.partitionBy("conv_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "_b", *(F.coalesce(F.sum(F.col(s) % PRIME).over(before), F.lit(0)).alias(f"before_{s}") for s in SUMS))
    inside = Window.partitionBy("conv_id", "_b").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("conv_id", "_b", "place", "h1", "h2", "bytes", *(F.sum(s).over(inside).alias(s) for s in SUMS))
    summed = local.join(parts, ["conv_id", "_b"])
    summed = summed.select("conv_id", "place", "h1", "h2", "bytes", *(((F.col(s) + F.col(f"before_{s}")) % PRIME).alias(s) for s in SUMS))
    return stored(summed, "running-sums"), stored(placed.filter("place = 1").select("conv_id", "turns"), "conversations")


def members(turns: DataFrame, base: Column, head: Column, seed: int) -> tuple[DataFrame, DataFrame]:
    """Every prefix of every rebuilt conversation, and ``conv_id, length``.

    A prefix has ``conv_id, depth``, its own and its parent's fingerprint, and its last turn: where it is stored
    (``at, place``), its hashes and its bytes.
    """
    summed, convs = running_sums(turns, seed)
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    plan = convs.withColumns({"base": base, "head": head.cast("bigint")}).join(sizes, "base", "left")
    plan = plan.withColumn("taken", F.least(F.col("head"), F.coalesce("base_turns", F.lit(0))))
    plan = plan.withColumns({"left_out": F.least("head", "turns"), "length": F.col("taken") + F.greatest(F.col("turns") - F.col("head"), F.lit(0))})
    plan = stored(plan.select("conv_id", "turns", "base", "head", "taken", "left_out", "length"), "plan")

    # sums at the ends of heads; only the first turns of a conversation can be one
    most = plan.agg(F.max("head")).first()[0] or 0
    early = summed.filter(F.col("place") <= most)
    ends = early.select(F.col("conv_id").alias("of"), F.col("place").alias("until"), *SUMS)

    def at_end(rows: DataFrame, of: str, until: str, letter: str) -> DataFrame:
        right = ends.select(F.col("of").alias(of), F.col("until").alias(until), *(F.col(s).alias(f"{letter}{n}") for n, s in enumerate(SUMS)))
        return rows.join(right, [of, until], "left").na.fill(0, [f"{letter}{n}" for n in range(LANES)])

    none = [F.lit(0).cast("bigint").alias(f"{c}{n}") for c in "oe" for n in range(LANES)]
    head_rows = plan.filter("taken > 0").select(F.col("conv_id").alias("owner"), F.col("base").alias("conv_id"), "taken")
    head_rows = head_rows.join(early, "conv_id").filter("place <= taken").select(
        F.col("owner").alias("conv_id"), F.col("place").alias("depth"), F.lit(0).cast("bigint").alias("shift"),
        F.col("conv_id").alias("at"), "place", "h1", "h2", "bytes", *SUMS, *none,
    )
    rest = at_end(at_end(plan.filter("turns > head"), "base", "taken", "e"), "conv_id", "left_out", "o")
    rest = stretches(rest, "turns").join(summed.withColumn("stretch", stretch("place")), ["conv_id", "stretch"]).filter("place > head")
    rest_rows = rest.select(
        "conv_id", (F.col("taken") + F.col("place") - F.col("head")).alias("depth"), (F.col("taken") - F.col("head")).alias("shift"),
        F.col("conv_id").alias("at"), "place", "h1", "h2", "bytes", *SUMS, *(f"{c}{n}" for c in "oe" for n in range(LANES)),
    )
    found = head_rows.union(rest_rows).withColumn("k", fingerprints(seed))
    found = found.select("conv_id", "depth", "k.ka", "k.kb", "k.pa", "k.pb", "at", "place", "h1", "h2", "bytes")
    empty = F.lit(None).cast("bigint")
    root = plan.select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), *(F.lit(0).cast("bigint").alias(c) for c in ("ka", "kb")),
        *(empty.alias(c) for c in ("pa", "pb", "at", "place", "h1", "h2")), F.lit(0).cast("bigint").alias("bytes"),
    )
    return stored(root.union(found), "members"), plan.select("conv_id", "length")


def hashed(conversations: DataFrame, seed: int) -> DataFrame:
    """``conv_id, turn, h1, h2, bytes`` of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.xxhash64(F.lit(seed), role, text).alias("h1"), F.xxhash64(role, F.lit(~seed), text).alias("h2"), F.octet_length(text).cast("bigint").alias("bytes"),
    )


def turns_differ(conversations: DataFrame, seed: int) -> bool:
    """Whether turns of equal hashes have different texts anywhere."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    read = conversations.select(
        F.xxhash64(F.lit(seed), role, text).alias("h1"), F.xxhash64(role, F.lit(~seed), text).alias("h2"),
        F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("turn"),
    )
    same = read.groupBy("h1", "h2").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    return not same.filter("a <> b").isEmpty()


def ends(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """``depth, ka, kb, ends_sha256`` of the nodes at which conversations end.

    The ids are written out by ranges in parallel; the hash itself takes the ranges of a node in turn, one at a time in memory.
    """
    last = found.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"])
    ids = F.array_sort(F.collect_list("conv_id"))
    ranges = last.groupBy("depth", "ka", "kb", F.shiftright("conv_id", RANGE_BITS).alias("range")).agg(
        F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for depth, ka, kb, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "ka", "kb", "ids")), strict=True):
                if (depth, ka, kb) != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (depth, ka, kb), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield table(done)
        if at is not None:
            yield table([(*at, state.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["depth", "ka", "kb", "ends_sha256"])

    sent = ranges.repartition("depth", "ka", "kb").sortWithinPartitions("depth", "ka", "kb", "range")
    return sent.mapInArrow(digest, "depth bigint, ka bigint, kb bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None) -> DataFrame:
    """One row per node: ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Every conversation of ``conversations`` (``conv_id, turn, role, text``) is rebuilt from the first ``head`` turns of conversation
    ``base`` and its own turns after its first ``head``; both are expressions over ``conv_id``, by default its own and 0.
    """
    base, head = F.col("conv_id") if base is None else base, F.lit(0) if head is None else head
    seed = 0
    while True:
        if not turns_differ(conversations, seed):
            found, lengths = members(stored(hashed(conversations, seed), "hashed"), base, head, seed)
            same = ["h1", "h2", "pa", "pb"]
            nodes = found.groupBy("depth", "ka", "kb").agg(
                F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
                *(F.min(c).alias(c) for c in same), *(F.max(c).alias(f"{c}_") for c in same),
            )
            nodes = stored(nodes, "nodes")
            if nodes.filter(" OR ".join(f"NOT {c} <=> {c}_" for c in same)).isEmpty():
                break
        seed += 1
    key = ["depth", "ka", "kb"]
    nodes = nodes.select(*key, "pa", "pb", "conv_id", "n_convs", "bytes")
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
    nodes = nodes.join(below.agg(F.count("*").alias("n_children")), key, "left").na.fill(0, ["n_children"])
    nodes = stored(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")), "trie")

    # A node belongs to its smallest member. What lies below a node belongs to its members: all of theirs, but of the
    # smallest what is at its depth or deeper.
    owners = nodes.groupBy("conv_id").agg(F.sum("saved").alias("all_saved"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    owners = stored(owners.filter("all_saved <> 0 OR leaf <> 0").join(lengths, "conv_id"), "owners")
    placed = found.select("conv_id", *key).withColumn("stretch", stretch("depth"))
    sums = placed.join(stretches(owners, "length"), ["conv_id", "stretch"]).groupBy(*key)
    sums = sums.agg(F.sum("all_saved").alias("all_saved"), F.sum("leaf").alias("n_leaves"))

    chain = nodes.withColumn("stretch", stretch("depth"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("depth")
    parts = chain.groupBy("conv_id", "stretch").agg(F.sum("saved").alias("part"), F.min("depth").alias("low"))
    whole = Window.partitionBy("conv_id").orderBy("stretch")
    parts = parts.select(
        "conv_id", "stretch", F.coalesce(F.sum("part").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"),
        F.min("low").over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("top"),
    )
    above = F.coalesce(F.sum("saved").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chain = chain.withColumn("above", above).join(parts, ["conv_id", "stretch"])
    chain = chain.withColumn("owned_above", F.col("above") + F.col("parts_before")).select(*nodes.columns, "owned_above", "top")

    result = chain.join(sums, key, "left").join(_parents(nodes, chain), key, "left").join(ends(found, lengths), key, "left")
    return result.select(
        "conv_id", "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).cast("bigint").alias("n_leaves"),
        (F.coalesce("all_saved", F.lit(0)) - F.col("owned_above")).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def _parents(nodes: DataFrame, chain: DataFrame) -> DataFrame:
    """``depth, ka, kb, parent`` of the nodes whose parent belongs to another conversation."""
    many = max(CHILDREN, nodes.count() // PARENTS)
    high = chain.filter("depth > 0 AND depth = top").select("depth", "ka", "kb", "pa", "pb")
    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent"), "n_children"
    )
    # fewer than PARENTS nodes can have this many children
    busy = F.broadcast(parents.filter(F.col("n_children") > many).withColumnRenamed("parent", "of_busy").drop("n_children"))
    looked = stored(high.join(busy, ["depth", "pa", "pb"], "left"), "parents")
    rest = looked.filter("of_busy IS NULL").drop("of_busy").join(parents.filter(F.col("n_children") <= many).drop("n_children"), ["depth", "pa", "pb"])
    return rest.select("depth", "ka", "kb", "parent").union(looked.filter("of_busy IS NOT NULL").select("depth", "ka", "kb", "of_busy"))


ORACLE = """
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM t),
crc AS (
  SELECT conv_id, conv_id::VARCHAR AS s, 1 AS c, 8 AS bit, 4294967295::BIGINT AS v FROM ids
  UNION ALL
  SELECT conv_id, s, CASE WHEN bit = 8 THEN c + 1 ELSE c END, CASE WHEN bit = 8 THEN 0 ELSE bit + 1 END,
    CASE WHEN bit = 8 THEN xor(v, ascii(s[c])::BIGINT) WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END
  FROM crc WHERE NOT (bit = 8 AND c > length(s))),
h AS (SELECT conv_id, xor(v, 4294967295::BIGINT) % 9 AS h FROM crc WHERE bit = 8 AND c > length(s)),
heads AS (SELECT h.conv_id, t.i, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND t.i <= h.h),
rests AS (SELECT h.conv_id, t.i + 1000000000 AS i, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.i > h.h),
rebuilt AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth
            FROM (SELECT * FROM heads UNION ALL SELECT * FROM rests)),
lists AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY depth) AS turns FROM rebuilt GROUP BY conv_id),
prefixes AS (
  SELECT conv_id, depth, turns[1:depth] AS p, turns[1:depth - 1] AS up, strlen(turns[depth].text) AS bytes, depth = len(turns) AS is_end
  FROM lists, range(1, len(turns) + 1) r(depth)
  UNION ALL
  SELECT ids.conv_id, 0, [], NULL, 0, l.conv_id IS NULL FROM ids LEFT JOIN lists l ON l.conv_id = ids.conv_id),
nodes AS (
  SELECT depth, p, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
    sha256(coalesce(string_agg(CASE WHEN is_end THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, p),
kids AS (SELECT depth - 1 AS depth, up AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.depth = nodes.depth AND kids.p = nodes.p),
sub AS (
  SELECT r.depth, x.p[1:r.depth] AS p, sum(x.saved) AS saved, count(*) FILTER (x.n_children = 0) AS leaves
  FROM full_nodes x, range(0, x.depth + 1) r(depth) GROUP BY 1, 2)
SELECT x.conv_id, x.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, sub.leaves AS n_leaves,
  sub.saved::BIGINT AS saved_tokens, x.ends_sha256
FROM full_nodes x JOIN sub ON sub.depth = x.depth AND sub.p = x.p LEFT JOIN full_nodes u ON u.depth = x.depth - 1 AND u.p = x.up
"""
