"""Whole results of op1, op3, op7 and op10 against plain Python; only the seeded hashes that order rows come from Spark."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from exprlake.llm import imatch
from exprlake.llm.common import unsigned_order
from exprlake.llm.imatch import edited_fingerprints
from exprlake.llm.langid import SLOTS, fit, identify
from exprlake.llm.mixing import mix, weights
from exprlake.llm.sharding import interleave
from tests.llm.conftest import frame, random_rows

HALF = 0xFFFFFFFF


@pytest.mark.parametrize("shards", [1, 7, 90])
def test_interleave_equals_a_sort(spark, shards):
    rows = [*random_rows(70, 4), (900, None, "xx", None), (901, "", "xx", "lone"), (902, "same", "xx", "a"), (902, "same", "xx", "a")]
    docs = frame(spark, rows)
    crc = F.crc32(F.coalesce("text", F.lit("")))
    order = {(r["doc_id"], r["c"]): r["u"] for r in docs.select("doc_id", crc.alias("c"), unsigned_order(11, F.col("doc_id"), crc).alias("u")).collect()}
    strata = defaultdict(list)
    for i, text, _, source in rows:
        body = (text or "").encode()
        c = zlib.crc32(body)
        strata[("0" if source is None else "1") + (source or "")].append((order[i, c], i, c, len(body) + 8))
    placed = []
    for s, members in strata.items():
        placed += [((r + 0.5) / len(members), s, r, i, c, size) for r, (_, i, c, size) in enumerate(sorted(members))]
    placed.sort()
    want, slots = Counter(), Counter()
    for g, (_, _, _, i, c, size) in enumerate(placed):
        shard = g * shards // len(rows)
        want[(i, size, c, shard, slots[shard])] += 1
        slots[shard] += 1
    got = interleave(docs, shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert Counter(map(tuple, got)) == want


def rotated(x, n):
    return (x << n | x >> 32 - n) & HALF


def murmur(values, seed=42):
    """Spark's hash of an array of longs."""
    h = seed
    for v in values:
        for k in (v & HALF, v >> 32 & HALF):
            k = rotated(k * 0xCC9E2D51 & HALF, 15) * 0x1B873593 & HALF
            h = (rotated(h ^ k, 13) * 5 + 0xE6546B64) & HALF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & HALF
        h = (h ^ h >> 13) * 0xC2B2AE35 & HALF
        h ^= h >> 16
    return h


def test_fingerprints_equal_plain_hashes(spark):
    rows = [(i, t, lang, s) for i, t, lang, s in random_rows(60, 9)] + [(100, None, "xx", "a"), (101, "zz only here", "xx", "a"), (102, "", "xx", "a")]
    texts = {i: t or "" for i, t, *_ in rows}

    def terms(text):
        return {xxhash.xxh64_intdigest(w.encode(), seed=42) for w in text.lower().split()}

    seen = Counter(t for x in texts.values() for t in terms(x))
    low, high = max(2.0, imatch.LEAST_SHARE * len(rows)), max(2.0, imatch.MOST_SHARE * len(rows))
    bits = {t >> 64 - imatch.LEXICON_BITS for t, n in seen.items() if low <= n <= high}

    def marks(text):
        own = terms(text)
        chosen = {t for t in own if t >> 64 - imatch.LEXICON_BITS in bits} or own
        signed = sorted(t - (1 << 64) if t >> 63 else t for t in chosen)
        out, skipped = [], 0
        for level in range(imatch.LEVELS):
            size = imatch.SUBSETS * 4**level
            for k in range(imatch.SUBSETS):
                inside = [t for t in signed if ((t & (1 << 64) - 1) >> skipped) % size == k]
                out.append(murmur(inside) if inside else 0)
            skipped += size.bit_length() - 1
        return out

    def alike(a, b):
        either = sum(x != 0 or y != 0 for x, y in zip(a, b, strict=True))
        return sum(x == y != 0 for x, y in zip(a, b, strict=True)) / either if either else 1.0

    ids = sorted(texts)
    got = {r["doc_id"]: r for r in edited_fingerprints(frame(spark, rows)).collect()}
    assert sorted(got) == ids
    for n, i in enumerate(ids):
        text, following = texts[i], texts[ids[(n + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed = marks(text), marks(edited)
        assert got[i]["fingerprint"] == "".join(f"{m:08X}" for m in own)
        assert got[i]["edited_fingerprint"] == "".join(f"{m:08X}" for m in changed)
        assert got[i]["near_edited"] == pytest.approx(alike(own, changed)) and got[i]["near_next"] == pytest.approx(alike(own, marks(following)))


def test_mixture_equals_running_totals(spark):
    rows = random_rows(50, 6) + [(200 + i, "one two three", "xx", "rare") for i in range(3)]
    docs, block = frame(spark, rows), 300
    out = mix(docs, block_tokens=block).collect()
    tokens = {r["doc_id"]: r["tokens"] for r in out}
    base = spark.createDataFrame([(i, "1" + s, tokens[i]) for i, _, _, s in rows], "k bigint, s string, tokens bigint")
    plan = {r["s"]: r for r in weights(base, "s", "tokens", 0.95, 2.0, None).collect()}
    copies = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(3))))
    hashes = copies.withColumn("tokens", F.col("tokens").cast(dict(docs.transform(lambda d: mix(d)).dtypes)["tokens"]))
    hashes = hashes.select("k", "copy", unsigned_order(13, F.col("copy"), F.col("k"), F.col("tokens")).alias("u"), unsigned_order(14, F.col("copy"), F.col("k"), F.col("tokens")).alias("v"))
    order = {(r["k"], r["copy"]): (r["u"], r["v"]) for r in hashes.collect()}
    n_blocks = max(1, -(-sum(p["budget"] for p in plan.values()) // block))
    placed = defaultdict(list)
    for s, p in plan.items():
        own = [i for i, _, _, source in rows if "1" + source == s]
        begin = 0
        for copy in range(math.ceil(p["passes"])):
            for i in sorted(own, key=lambda i: (order[i, copy][0], i)):
                if begin < p["budget"]:
                    placed[math.floor(begin / p["budget"] * n_blocks)].append((order[i, copy][1], s, begin, i, copy))
                begin += tokens[i]
    want = {(i, copy, b, pos) for b, members in placed.items() for pos, (_, _, _, i, copy) in enumerate(sorted(members))}
    assert {(r["doc_id"], r["copy"], r["block"], r["pos"]) for r in out} == want and len(out) == len(want)


def plain_counts(text):
    """Letter 1- to 3-grams of a text between spaces, hashed to slots, one at a time; what isn't a letter ends a word, as the end does."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in letters:
        letters = letters.replace("  ", " ")
    letters = f" {letters.lstrip()} "
    one = [ord(c) * 0x9E3779B1 & HALF for c in letters]
    two = [((a ^ b >> 7) * 0x85EBCA6B + 1) & HALF for a, b in zip(one, one[1:])]
    three = [((a ^ b >> 11) * 0xC2B2AE35 + 2) & HALF for a, b in zip(two, one[2:])]
    shift = 32 - (SLOTS.bit_length() - 1)
    return Counter(x >> shift for x in [c * 0x27D4EB2F & HALF for c in one] + two + three)


def test_languages_equal_plain_cosines(spark):
    rng = random.Random(1)
    words = {"xx": ["kar", "molo", "tisen"], "yy": ["üb", "straß", "enge"], "zz": ["qui", "oro", "vais"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(4, 30))) + rng.choice(["", ".", " 42 !"]), lang, "a") for i, lang in enumerate(list(words) * 20)]
    docs = frame(spark, rows)
    model = fit(docs.filter("doc_id % 5 <> 0"))
    idf = np.asarray(model.idf)
    for r in identify(docs, model).select("text", "guess.*").collect():
        v = np.zeros(SLOTS)
        for slot, n in plain_counts(r["text"]).items():
            v[slot] = math.log1p(n) * idf[slot]
        near = np.asarray(model.centroids, float) @ (v / np.linalg.norm(v))
        assert r["score"] == pytest.approx(near.max(), abs=1e-5) and near[[i for i, x in enumerate(model.langs) if x == r["lang_pred"]]].max() == pytest.approx(near.max(), abs=1e-5)
        assert r["rejected"] == bool(near.max() < model.floors[near.argmax()]) or abs(near.max() - model.floors[near.argmax()]) < 1e-5
