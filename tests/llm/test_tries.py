"""Partial matching over the whole of tries larger than any one task holds."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprlake.llm import ppm
from exprlake.llm.common import words
from tests.llm.conftest import frame


def plainly(rows, learned):
    """Score per id by whole tries, one per group, all in one process."""
    groups = sorted({lang for i, _, lang, _ in rows if i in learned}, key=lambda g: (-sum(r[2] == g for r in rows if r[0] in learned), g))
    tries, weights = [], []
    for g in groups:
        counts = Counter(w for i, t, lang, _ in rows if i in learned and lang == g for w in words(t))
        tries.append(ppm.Trie.of_nodes(*ppm.node_counts(list(counts), np.array(list(counts.values())))))
        weights.append(sum(r[2] == g for r in rows if r[0] in learned) / len(learned))
    share = len(learned) / (len(learned) + sum(len(words(t)) for i, t, *_ in rows if i in learned))
    out = {}
    for i, t, *_ in rows:
        if i % 40 == 0:
            grams = ppm.top_grams(words(t))[0].tolist()
            logs = [math.log10(w) + sum(map(trie.code, grams)) for trie, w in zip(tries, weights, strict=True)]
            out[i] = math.log10(sum(10 ** (x - max(logs)) for x in logs)) + max(logs) + len(words(t)) * math.log10(1 - share) + math.log10(share)
    return out


@pytest.mark.parametrize("frequent", [20, 300_000])
def test_ppm_scores_with_all_contexts(spark, monkeypatch, frequent):
    monkeypatch.setattr(ppm, "FREQUENT", frequent)
    rng = random.Random(5)
    letters = {"xx": "abcdefghijklmnop", "yy": "klmnopqrstuvwxyzé"}
    rows = []
    for i in range(800):
        lang = rng.choice(["xx", "yy"])
        rows.append((i, " ".join(rng.choice(["the", "".join(rng.choices(letters[lang], k=rng.randint(1, 15)))]) for _ in range(200)), lang, None))
    learned = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 1}
    assert sum(len(ppm.node_counts(sorted({w for i, t, lang, _ in rows if i in learned and lang == g for w in words(t)}), np.ones(10**6))[0]) for g in letters) > 600_000
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    got = {r["doc_id"]: r["score"] for r in ppm.score(frame(spark, rows), learn, group="lang").collect()}
    expected = plainly(rows, learned)
    assert len(got) == len(rows) and {i: got[i] for i in expected} == pytest.approx(expected, rel=1e-9)


def test_places_sort_contexts_before_those_that_continue_them():
    nodes, _ = ppm.node_counts([b"abab", b"xab", b"\x00\xff"], np.array([1, 1, 1]))
    at = ppm.places(nodes)
    assert ppm.packed_grams(at).tolist() == nodes.tolist() and len(set(at.tolist())) == len(nodes)
    seen = set()
    for node in ppm.packed_grams(np.sort(at)).tolist():
        order, context = node >> int(ppm._TOP), ppm.context_of(node)
        assert order < 1 or any(x >> int(ppm._TOP) == order - 1 and x & int(ppm._MASKS[order - 1] >> np.uint64(ppm.BITS)) == context & int(ppm._MASKS[order - 1] >> np.uint64(ppm.BITS)) for x in seen)
        seen.add(context)


@pytest.mark.parametrize("frequent", [20, 300_000])
def test_ppm_contexts_run_on_over_words(spark, monkeypatch, frequent):
    """Against one whole trie over the symbols of whole texts; the same words in another order once had the same score."""
    monkeypatch.setattr(ppm, "FREQUENT", frequent)
    rng = random.Random(6)
    some = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(some, k=rng.randint(0, 25))), None, None) for i in range(60)]
    rows += [(60, "alpha beta gamma delta", None, None), (61, "delta alpha gamma beta", None, None), (62, "alpha beta gamma delta", None, None), (63, None, None, None)]
    learned = set(range(61))

    def grams(t):
        stream = [ppm.START] * 5 + [x for w in words(t) for x in [*w, ppm.END]]
        return [sum(stream[i - k] << (ppm.BITS * k) for k in range(6)) | 5 << (ppm.BITS * ppm.ORDER) for i in range(5, len(stream))]

    seen: dict[int, dict[int, int]] = {}
    for i, t, *_ in rows:
        for g in grams(t) if i in learned else ():
            for k in range(6):
                low = (g & ((1 << (ppm.BITS * (k + 1))) - 1)) | k << (ppm.BITS * ppm.ORDER)
                at = seen.setdefault(ppm.context_of(low), {})
                at[g & ppm._SYMBOL] = at.get(g & ppm._SYMBOL, 0) + 1
    trie = ppm.Trie()
    for context in sorted(seen):
        trie.put(context, seen[context])
    share = len(learned) / (len(learned) + sum(len(words(t)) for i, t, *_ in rows if i in learned))
    want = {i: sum(map(trie.code, grams(t))) + len(words(t)) * math.log10(1 - share) + math.log10(share) for i, t, *_ in rows}
    got = {r["doc_id"]: r for r in ppm.score(frame(spark, rows), F.col("doc_id") < 61, across=True).collect()}
    assert {i: r["score"] for i, r in got.items()} == pytest.approx(want, rel=1e-9)
    assert got[60]["score"] == got[62]["score"] > got[61]["score"] + 1
    bound = {r["doc_id"]: r for r in ppm.score(frame(spark, rows), F.col("doc_id") < 61).collect()}
    for c in ("n_tokens", "n_known", "train_tokens", "base_score"):
        assert {i: r[c] for i, r in got.items()} == pytest.approx({i: r[c] for i, r in bound.items()})
