"""The prefix trie against rebuilt texts in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from exprlake.llm import prefixes as module
from exprlake.llm.prefixes import PRIME, power, prefix_trie
from exprlake.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id bigint, turn int, role string, text string, key int, depth int, place int, h1 string, base int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "h", 4) for r in rows], SCHEMA)


def crc(c):
    return zlib.crc32(str(c).encode()) % 9


def brute(rows, base=lambda c: c - c % 5, head=crc):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    rebuilt = {c: own.get(base(c), [])[: head(c)] + x[head(c) :] for c, x in own.items()}
    nodes = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = set()
    below = {p: [x for x in nodes if x[: len(p)] == p] for p in nodes}
    for p, members in nodes.items():
        children = [x for x in below[p] if len(x) == len(p) + 1]
        ending = sorted(c for c in members if len(rebuilt[c]) == len(p))
        out.add((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children),
            sum(not any(len(y) > len(x) for y in below[x]) for x in below[p]),
            sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below[p] if x),
            hashlib.sha256(",".join(map(str, ending)).encode()).hexdigest(),
        ))
    return out


def rows_of(seed, convs=60, most=12, words=3):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice(["user", "user", None]), rng.choice(["a", "bé", "", None][:words] + ["long text"]))
        for c in rng.sample(range(1, 4 * convs), convs) for t in range(rng.randrange(1, most))
    ]


def trie(spark, rows, **kwargs):
    found = prefix_trie(frame(spark, rows).repartition(3), F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string")) % 9, **kwargs)
    assert found.columns[:8] == COLUMNS
    got = [tuple(r)[:8] for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed, words", [(1, 2), (2, 3), (3, 1)])
def test_equals_brute_force(spark, seed, words):
    rows = rows_of(seed, words=words)
    assert trie(spark, rows) == brute(rows)


def test_small_stretches_and_busy_parents(spark, monkeypatch):
    for name, value in (("STRETCH", 2), ("CHILDREN", 1), ("PARENTS", 10**9), ("RANGE_BITS", 1)):
        monkeypatch.setattr(module, name, value)
    rows = rows_of(5)
    assert trie(spark, rows) == brute(rows)


def test_plain_conversations(spark):
    rows = rows_of(7, convs=25)
    got = {tuple(r)[:8] for r in prefix_trie(frame(spark, rows)).collect()}
    assert got == brute(rows, lambda c: c, lambda c: 0)


def test_long_heads(spark):
    rows = rows_of(8, convs=20)
    got = {tuple(r)[:8] for r in prefix_trie(frame(spark, rows), F.col("conv_id") % 7, F.col("conv_id") % 30).collect()}
    assert got == brute(rows, lambda c: c % 7, lambda c: c % 30)


def test_awkward_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (1, 5, "user", "x" * 300_000), (2, 1, None, "a"), (None, 1, "user", "lost"), (None, None, None, None),
        (6, 1, "u", "b"), (6, 2, "u", "b"), (7, 1, "ub", ""), (8, 1, "", "ub"), (10, -3, "é", "😀"), (10, -2, "é", "😀"), (11, 0, "é", "😀"), (-4, 0, "u", "z"), (-5, 0, "u", "y"),
        *[(2000 + n, 0, "user", "same") for n in range(300)], *[(3000, n, "user", "same") for n in range(400)],
    ]
    def base(c):
        return c - (abs(c) % 5) * (1 if c >= 0 else -1)

    assert trie(spark, rows) == brute(rows, base)
    tied = [(1, 3, "u", "a"), (1, 3, "u", "b"), (1, None, "u", "first"), (1, 3, "u", "a")]
    once, again = trie(spark, tied), trie(spark, tied[::-1])
    assert once == again and len(once) <= 5
    assert prefix_trie(frame(spark, rows).filter(F.lit(False))).count() == 0


def test_members_without_turns(spark):
    """A conversation no longer than its head, whose base is absent."""
    absent = next(c for c in range(1, 200) if c % 5 and crc(c) >= 2)
    rows = [(absent, 0, "u", "a"), (absent, 1, "u", "b")]
    got = trie(spark, rows)
    assert got == {(absent, 0, None, 1, 0, 1, 0, hashlib.sha256(str(absent).encode()).hexdigest())} == brute(rows)


def test_collisions_are_found_and_mended(spark, monkeypatch):
    """All fingerprints of the first seed are equal; the check must notice and another seed must be taken."""
    rows = [(c, t, "u", str(c * 10 + t)) for c in range(1, 20) for t in range(3)]
    real, calls = module.fingerprints, []

    def broken(seed):
        calls.append(seed)
        if seed == 0:
            return F.struct(*(F.lit(1).cast("bigint").alias(c) for c in ("ka", "kb", "pa", "pb")))
        return real(seed)

    monkeypatch.setattr(module, "fingerprints", broken)
    got = {tuple(r)[:8] for r in prefix_trie(frame(spark, rows)).collect()}
    assert calls == [0, 1] and got == brute(rows, lambda c: c, lambda c: 0)


def test_powers():
    at = np.array([0, 1, 2, 30, 12345, -1, -7, 2**40])
    for b in module.bases(3):
        assert power(b, at).tolist() == [pow(b, int(x), PRIME) for x in at]
    assert len(set(module.bases(0)) | set(module.bases(1))) == 8


def test_query_matches_sql(spark, small_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small_dir}/conversations.parquet'")
    want = con.sql(ORACLES["op13_prefix_fingerprints"]).select(", ".join(COLUMNS)).fetchall()
    got = QUERIES["op13_prefix_fingerprints"](spark, small_dir).select(*COLUMNS).collect()
    assert set(map(tuple, got)) == set(want) and len(got) == len(want)
