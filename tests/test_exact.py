"""Exact Mann-Whitney, hashes of large files, and products of listed pairs."""

import hashlib
import itertools
import math
import tempfile

import numpy as np
import pytest

from exprlake.operators import stats
from exprlake.operators import vectors as ve
from exprlake.sources import sinks


@pytest.mark.parametrize("m, n", [(1, 1), (2, 3), (3, 7), (4, 4), (1, 20)])
def test_exact_distribution(m, n):
    us = [sum(r) - m * (m + 1) // 2 for r in itertools.combinations(range(1, m + n + 1), m)]
    for u in range(m * n // 2 + 1):
        assert stats.exact_u_p(m, n, u) == pytest.approx(min(1.0, 2 * sum(x <= u for x in us) / len(us)))


def test_exact_for_small_arms_without_ties(spark):
    rng = np.random.default_rng(0)
    groups = {"exact": (5, 40, False), "ties": (5, 40, True), "large": (9, 9, False), "one": (1, 3, False)}
    rows = []
    for g, (n1, n0, ties) in groups.items():
        values = rng.permutation(n1 + n0).astype(float)
        if ties:
            values[1] = values[0]
        rows += [(g, int(i < n1), float(v)) for i, v in enumerate(values)]
    got = {r["g"]: r for r in stats.mann_whitney(spark.createDataFrame(rows, "g string, y int, v double"), ["g"], "y", "v").collect()}
    for g, (n1, n0, _) in groups.items():
        a, b = ([v for h, y, v in rows if h == g and y == k] for k in (1, 0))
        u = sum((x > z) + 0.5 * (x == z) for x in a for z in b)
        assert got[g]["u"] == pytest.approx(u)
        if g in ("exact", "one"):
            ways = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n0 + 1), n1)] if math.comb(n1 + n0, n1) < 2e6 else None
            low = min(u, n1 * n0 - u)
            assert got[g]["p_value"] == pytest.approx(min(1.0, 2 * sum(w <= low for w in ways) / len(ways)))
        else:
            n = n1 + n0
            counts = np.unique([v for h, _, v in rows if h == g], return_counts=True)[1]
            sigma = math.sqrt(n1 * n0 / 12 * (n + 1 - (counts**3 - counts).sum() / (n * (n - 1))))
            z = max((max(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / sigma, 0.0)
            assert got[g]["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_inventory_in_pieces(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    data = {"a.txt": b"x" * 100, "b c.csv": bytes(range(256)) * 40, "d.gz": b"\x1f\x8b" + b"y" * 5000}
    for name, content in data.items():
        with open(f"{base}/{name}", "wb") as f:
            f.write(content)

    def found():
        return {r["path"].rsplit("/", 1)[1].replace("%20", " "): (r["bytes"], r["sha256"]) for r in sinks.content_inventory(spark, base).collect()}

    want = {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items()}
    assert found() == want
    monkeypatch.setattr(sinks, "WHOLE_FILE", 50)
    monkeypatch.setattr(sinks, "PIECE", 999)
    assert found() == want


def test_local_files_are_no_large_cells(spark):
    """Spark refuses cells above the limit; files up to 1 GB were once read as one."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    size, key = (20 << 20) + 3, "spark.sql.sources.binaryFile.maxLength"
    for name in ("small.txt", "large.bin"):
        with open(f"{base}/{name}", "wb") as f:
            f.truncate(9 if name == "small.txt" else size)
    spark.conf.set(key, sinks.PIECE * 2)
    try:
        got = {r["bytes"]: r["sha256"] for r in sinks.content_inventory(spark, base).collect()}
    finally:
        spark.conf.unset(key)
    assert got == {n: hashlib.sha256(bytes(n)).hexdigest() for n in (9, size)}


def test_file_above_two_gigabytes(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    size = (2 << 30) + 5
    with open(f"{base}/large.bin", "wb") as f:
        f.truncate(size)  # takes no room on the disk
    digest = hashlib.sha256()
    zeros = bytes(1 << 20)
    for _ in range(2048):
        digest.update(zeros)
    digest.update(bytes(5))
    row = sinks.content_inventory(spark, base).first()
    assert row["bytes"] == size and row["sha256"] == digest.hexdigest()


@pytest.mark.parametrize("features, samples, pairs", [(256, 2048, 2048), (2, 3, 1)])
def test_listed_products(spark, monkeypatch, features, samples, pairs):
    for name, value in (("FEATURES", features), ("SAMPLES", samples), ("PAIRS", pairs)):
        monkeypatch.setattr(ve, name, value)
    rng = np.random.default_rng(1)
    cells = {(s, f"g{g}"): float(rng.integers(0, 6)) for s in range(14) for g in range(7) if rng.random() < 0.7}
    cells |= {(s, "lonely"): 1.0 for s in (100, 101)}
    df = spark.createDataFrame([(s, g, v) for (s, g), v in cells.items()], "sample_id int, feature string, value double")
    edges = [(a, b, 1) for a in ("g0", "g1", "g2") for b in ("g3", "g4", "g5", "g6")] + [("g0", "lonely", 0), ("g0", "absent", 0), ("g1", "g1", 1)]
    got = {(r["a"], r["b"]): r for r in ve.coexpression(df, spark.createDataFrame(edges, "a string, b string, label int")).collect()}

    def ranks(g):
        own = {s: v for (s, h), v in cells.items() if h == g}
        r = {s: sum(w < v for w in own.values()) + (sum(w == v for w in own.values()) + 1) / 2 - (len(own) + 1) / 2 for s, v in own.items()}
        norm = math.sqrt(sum(v * v for v in r.values()))
        return {s: v / norm if norm else 0.0 for s, v in r.items()}

    for a, b, label in edges:
        x, y = ranks(a), ranks(b)
        if set(x) & set(y):
            want = sum(x[s] * y[s] for s in set(x) & set(y))
            assert got[a, b]["correlation"] == pytest.approx(want, abs=1e-12) and got[a, b]["abs_correlation"] == pytest.approx(abs(want), abs=1e-12)
            assert got[a, b]["label"] == label
        else:
            assert (a, b) not in got
