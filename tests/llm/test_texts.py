"""Toxicity, code lengths, fingerprints, near-duplicates and passages against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from exprlake.llm import imatch, links, passages, ppm, toxicity
from exprlake.llm.common import word_ids
from exprlake.llm.links import components, forest, shared_counts
from exprlake.llm.neardup import SIDE, near_duplicates, shingles
from exprlake.llm.passages import cuts, remove_passages, repeated_passages, without
from tests.llm.conftest import awkward_rows, frame, random_rows, sentence


def groups(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {
        "path": [(i, i + 1) for i in range(40)], "star": [(7, i) for i in range(30)] + [(50, 51)], "none": [(3, 3)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(3, 3), (1, 2), (2, 1)],
    }[kind]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == groups([e for e in edges if e[0] != e[1]])


def test_small_helpers_of_links():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(12)]
    assert (shared_counts(sets[:5], sets[5:], columns=7) == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]).all()
    assert forest(np.array([1, 2, 1, 4]), np.array([2, 3, 3, 5])) == [0, 1, 3]


def brute_near(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    edges = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return sets, groups(edges)


def near_rows():
    """Exact and near copies, a chain of copies of copies that drifts away, and a crowd around a template."""
    rng = random.Random(6)
    rows = random_rows(50)
    text = sentence(rng, 120).split()
    for i in range(40):  # each a little further from the first
        text[rng.randrange(len(text))] = f"w{i}"
        rows.append((1000 + i, " ".join(text), None, None))
    template = sentence(rng, 150).split()
    for i in range(120):
        own = list(template)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = f"z{rng.random()}"
        rows.append((3000 - i, " ".join(own), None, None))
    rng.shuffle(rows)
    return rows


def test_near_duplicates(spark):
    rows = near_rows()
    sets, component = brute_near(rows)
    for r in near_duplicates(frame(spark, rows)).collect():
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == component.get(r["doc_id"], r["doc_id"])
        assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_near_copies_with_outsiders(spark, monkeypatch):
    """A large group whose tables stay open: every member is dealt once per first sub-key at most, and groups stay exact."""
    rng = random.Random(31)
    base = sentence(rng, 100).split()
    rows = []
    for i in range(240):
        own = list(base)
        for at in rng.sample(range(5, 95), 1 if i % 6 else rng.choice([4, 5])):
            own[at] = f"w{rng.randrange(10**9)}"
        rows.append((i, " ".join(own), None, None))
    dealt, seen = links.dealt, []

    def counted(members, size):
        seen.append((members.count(), members.select("id").distinct().count()))
        return dealt(members, size)

    monkeypatch.setattr(links, "dealt", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows)).collect()}
    _, component = brute_near(rows)
    assert got == {i: component.get(i, i) for i in got} and len(set(got.values())) > 10
    assert seen and all(n <= SIDE * ids for n, ids in seen)


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    _, component = brute_near([r for r in awkward_rows() if r[0] is not None])
    got = near_duplicates(awkward).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in awkward_rows())
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else component.get(r["doc_id"], r["doc_id"]))
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
    assert near_duplicates(nothing).count() == 0


def test_shingles():
    assert len(shingles(None)) == len(shingles(" \n")) == 0 and len(shingles("a b")) == 1
    assert shingles("A b c d e")[0] == shingles("a B\tc\nd e")[0] and shingles("a b")[0] != shingles("a b c")[0]


def test_passages_are_found_and_cut(spark):
    rng = random.Random(8)
    passages = [sentence(rng, n) for n in (55, 70, 120)]
    rows, expected = [], {}
    for i in range(60):
        before, after = sentence(rng, rng.randrange(5, 90)), sentence(rng, rng.randrange(5, 90))
        if i % 4 == 0:
            p = passages[i // 4 % 3]
            rows.append((i, f"{before} {p} {after}", None, None))
            expected[i] = (p, len(before.split()), len(p.split()), f"{before} {after}")
        else:
            rows.append((i, f"{before} {after}", None, None))
    docs = frame(spark, rows)
    found = repeated_passages(docs)
    got = {r["doc_id"]: r for r in found.collect()}
    kept, hit = {}, 0
    for i, (p, start, n, _) in sorted(expected.items()):
        if p not in kept:
            kept[p] = i
            assert i not in got
        else:
            hit += 1
            assert (got[i]["start_word"], got[i]["n_words"], got[i]["first_doc_id"]) == (start, n, kept[p])
    assert len(got) == hit
    cleaned = {r["doc_id"]: r["text"] for r in remove_passages(docs, found).collect()}
    for i, t, *_ in rows:
        assert cleaned[i] == (expected[i][3] if i in got else t)


def test_passages_of_awkward_rows(spark, awkward, nothing):
    got = {(r["doc_id"], r["first_doc_id"]): r["n_words"] for r in repeated_passages(awkward).collect()}
    assert got[(107, 106)] == 70 and got[(111, 106)] == 70 and not {d for d, _ in got} & {104, 105, 106, None}
    out = remove_passages(awkward, repeated_passages(awkward))
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert repeated_passages(nothing).count() == 0 and remove_passages(nothing, repeated_passages(nothing)).count() == 0


def test_blocks_are_bounded_and_skip_settled_components(spark):
    # one key: a component of 3,000, one of 100 and 40 of a single member; others: two members each
    rows = [(1, 0, i, 0) for i in range(3000)] + [(1, 0, 4000 + i, 4000) for i in range(100)] + [(1, 0, 5000 + i, 5000 + i) for i in range(40)]
    rows += [(k, 0, 6000 + 2 * k + x, 6000 + 2 * k + x) for k in range(2, 500) for x in (0, 1)]
    size = 64
    got = links.dealt(spark.createDataFrame(rows, "key bigint, bucket int, id bigint, component bigint"), size).toPandas()
    assert got.groupby("batch").size().max() <= max(4 * size, 2 * links.BATCH)
    hot = got[got["key"] == 1]
    # a member meets the blocks of others, not those of its own component
    assert len(hot[hot["component"] == 0]) == 3000 * 3 and len(hot) < 3000 * 3 + 200 * 60
    met = Counter()
    for (_, i, j), cell in hot.groupby(["batch", "i", "j"]):
        left, right = cell[cell["own"] == i], cell[cell["own"] == j]
        for a, c in zip(left["id"], left["component"], strict=True):
            met.update((min(a, b), max(a, b)) for b, d in zip(right["id"], right["component"], strict=True) if c != d and (i != j or a < b))
    sizes = [3000, 100, *[1] * 40]
    assert set(met.values()) == {1} and len(met) == (sum(sizes) ** 2 - sum(n * n for n in sizes)) // 2


def edited(passage, places):
    words = passage.split()
    for at in places:
        words[at] = f"changed{at}"
    return " ".join(words)


def test_passages_with_changed_words(spark):
    rng = random.Random(21)
    rows, expected = [], {}
    for i in range(0, 240, 2):
        n, places = [(60, [30]), (95, [47]), (200, [40, 80, 120, 160])][i // 2 % 3]
        passage, sides = sentence(rng, n), [f"edge{i}a{k} {sentence(rng, 30)} edge{i}b{k}" for k in range(4)]
        rows += [(i, f"{sides[0]} {passage} {sides[1]}", None, None), (i + 1, f"{sides[2]} {edited(passage, places)} {sides[3]}", None, None)]
        expected[i + 1] = (32, n, i)
    got = Counter((r["doc_id"], r["start_word"], r["n_words"], r["first_doc_id"]) for r in repeated_passages(frame(spark, rows)).collect())
    whole = {k: got[(k, *x)] for k, x in expected.items()}
    # the 30 words on each side of the change may be without a whole paragraph
    assert sum(whole.values()) >= 0.95 * len(expected)
    assert all(whole[k] == 1 for k, x in expected.items() if x[1] > 60)


def test_long_copies_are_hashed_once_a_pair(monkeypatch):
    """However many words of two long texts differ, their shingles are hashed once and sets of spans are marked, not sorted."""
    rng = np.random.default_rng(23)
    x = rng.integers(1, 2**63, 9000, dtype=np.uint64)
    y = x.copy()
    changed = np.concatenate([np.arange(20, 3000, 30), np.arange(3000, 6000, 3), np.arange(6020, 9000, 40)])
    y[changed] = rng.integers(1, 2**63, len(changed), dtype=np.uint64)
    row = dict(doc=1, start=6100, end=6110, doc0=0, start0=6100, end0=6110, cluster=7, at=6100, at0=6100, lo=0, hi=9000, total=9000, lo0=0, hi0=9000, total0=9000)
    calls = []
    monkeypatch.setattr(passages, "rolling", lambda h, whole=passages.rolling: calls.append(len(h)) or whole(h))

    class Pairs:
        def mapInArrow(self, run, schema):
            return run(iter([pa.RecordBatch.from_pylist([row | {"words": x.tobytes(), "words0": y.tobytes()}])]))

    (out,) = passages.agreements(Pairs(), 50, 75)
    assert [(r["edge"], r["begin"], r["stop"]) for r in out.to_pylist()] == [(False, 5998, 9000)]  # the two words after the last of the many changes belong to it
    assert len(calls) == 2


def test_passages_hide_behind_no_phrase(spark):
    rng = random.Random(22)
    rows, expected = [], {}
    for i in range(0, 400, 10):
        passage, side = sentence(rng, 60).split(), [f"edge{i}a{k} {sentence(rng, 30)} edge{i}b{k}" for k in range(14)]
        if i % 40 == 0:  # earlier documents have a phrase of it each
            stock, ahead = [passage[20:42]], ""
        elif i % 40 == 10:
            stock, ahead = [passage[:20], passage[20:40], passage[40:]], ""
        elif i % 40 == 20:  # the same first document has a phrase before
            stock, ahead = [], " ".join(passage[20:42])
        else:  # no paragraph begins in what follows for longer than one look
            stock, ahead, passage = [], "", passage + ["la"] * 300
        rows += [(i + k, f"{side[k]} {' '.join(x)} {side[k + 4]}", None, None) for k, x in enumerate(stock)]
        rows += [(i + k, f"{ahead} {side[k]} {' '.join(passage)} {side[k + 4]}" if k == 8 else f"{side[k]} {' '.join(passage)} {side[k + 4]}", None, None) for k in (8, 9)]
        expected[i + 9] = (32, len(passage), i + 8)
    got = Counter((r["doc_id"], r["start_word"], r["n_words"], r["first_doc_id"]) for r in repeated_passages(frame(spark, rows)).collect())
    assert {k: got[(k, *x)] for k, x in expected.items()} == dict.fromkeys(expected, 1)


def test_cuts_do_not_depend_on_what_is_around():
    rng = random.Random(9)
    passage, other = sentence(rng, 200), sentence(rng, 37)
    alone, within = cuts(word_ids(passage)), cuts(word_ids(f"{other} {passage}"))
    assert set(alone[1:] + 37) - set(within) == set() or len(set(alone[2:] + 37) - set(within)) == 0
    assert cuts(word_ids("")).tolist() == [] and cuts(word_ids("a " * 300)).tolist() == [0]


def test_without():
    assert without("a b  c\nd e", [(1, 2)]) == "a d e"
    assert without("a b c", [(0, 2), (1, 2)]) == "" and without("a", [(5, 2)]) == "a" and without(None, [(0, 1)]) is None


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_ppm_baseline_and_probability(spark, awkward):
    rows = awkward_rows()
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(False))
    got = ppm.score(awkward, learn, group="lang").collect()
    assert len(got) == len(rows)
    counts, total = Counter(), 0
    for i, t, *_ in rows:
        if i is not None and fold(i) != 1:
            own = (t or "").encode().lower().split() + [None]
            counts.update(own)
            total += len(own)
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append((t or "").encode().lower().split() + [None])
    for r in got:
        assert r["train_tokens"] == total and r["score"] < 0
        fits = [
            own for own in texts[r["doc_id"]]
            if len(own) == r["n_tokens"] and sum(counts[w] > 0 for w in own) == r["n_known"]
            and math.isclose(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in own), r["base_score"], rel_tol=1e-9)
        ]
        assert fits


def test_ppm_is_a_distribution_and_excludes():
    found = [b"abab", b"abc", b"b"]
    trie = ppm.Trie.of_nodes(*ppm.node_counts(found, np.array([3, 2, 1])))
    for context in (b"", b"a", b"ab", b"q"):
        whole = 0.0
        for symbol in [*range(256), ppm.END]:
            packed = symbol
            symbols = [ppm.START, *context][-(ppm.ORDER - 1):]
            for k, s in enumerate(reversed(symbols), 1):
                packed |= s << (ppm.BITS * k)
            whole += 10 ** trie.code(packed | len(symbols) << (ppm.BITS * ppm.ORDER))
        assert whole == pytest.approx(1.0, abs=1e-9)
    # after the start: a (5 of 6 words) and b (1); two kinds, so the escape is 1 of 6
    assert 10 ** trie.code(ord("a") | ppm.START << ppm.BITS | 1 << (ppm.BITS * ppm.ORDER)) == pytest.approx(4.5 / 6)


def test_ppm_learns(spark, nothing):
    rng = random.Random(1)
    rows = [(i, sentence(rng, 60), None, None) for i in range(80)]
    learn = F.col("doc_id") < 60
    got = ppm.score(frame(spark, rows), learn).collect()
    held = [r for r in got if r["doc_id"] >= 60]
    uniform = [len(" ".join(t.split())) * -math.log10(257) for i, t, *_ in rows if i >= 60]
    assert sum(r["score"] for r in held) > 0.5 * sum(uniform)
    assert ppm.score(nothing, learn).count() == 0
    assert all(r["base_score"] == 0 for r in ppm.score(frame(spark, [(1, None, None, None)]), F.lit(False)).collect())


def test_fingerprints(spark, awkward, nothing):
    rows = sorted({(i, t or "") for i, t, *_ in awkward_rows() if i is not None})
    after = {a[0]: b[1] for a, b in zip(rows, [*rows[1:], rows[0]], strict=True)}
    text = dict(rows)
    got = imatch.edited_fingerprints(awkward).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in awkward_rows() if i is not None)
    by_text = defaultdict(set)
    for r in got:
        t = text[r["doc_id"]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[r["doc_id"]][:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[t].add(r["fingerprint"])
        by_text[edited].add(r["edited_fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert imatch.edited_fingerprints(nothing).count() == 0
    alone = imatch.edited_fingerprints(frame(spark, [(5, "a b c d", None, None)])).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()


def test_fingerprints_are_near_where_texts_are(spark):
    got = imatch.edited_fingerprints(frame(spark, [(i, t * 2, None, None) for i, t, *_ in random_rows(80, 4)])).collect()
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got])


def toxic_rows(n=240):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, 40).split()
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            words[rng.randrange(40)] = rng.choice(["grobnix", "grobnixen", "vlotschid", "vlotschide"])
        rows.append((i, " ".join(words), None, None))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, awkward, nothing):
    rows, labels = toxic_rows()
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (10**6, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(frame(spark, rows), known, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(frame(spark, rows), model).collect()}
    held = [(got[i] >= 0.3) == bool(y) for i, y in labels if i % 4 == 2]
    assert np.mean(held) > 0.95
    out = toxicity.score(awkward, model)
    assert out.columns == [*awkward.columns, "toxicity"] and out.filter("toxicity BETWEEN 0 AND 1").count() == awkward.count()
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.fit(nothing, known) is None and toxicity.fit(frame(spark, rows), known.filter("toxic = 0")) is None
    assert {r["toxicity"] for r in toxicity.score(awkward, None).collect()} == {0.0}


def test_kneser_ney_is_a_distribution():
    n = Counter(g for w in ["abc", "abd", "abc", "bcd"] for g in toxicity.word_grams(w))
    grams = sorted(n)
    ratios = toxicity.Ratios(toxicity.Counts(grams, np.array([n[g] for g in grams]), np.zeros(len(grams), int)))
    letters = [*{g[-1] for g in grams}, "?"]
    for context in ("", "a", "b", "bc"):
        assert sum(ratios.backoff(context + x) for x in letters) == pytest.approx(1.0)
