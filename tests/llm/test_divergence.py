"""Count-cell ranking against plain Python with whole numbers."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from exprlake.llm import divergence as module
from exprlake.llm.divergence import divergence, term_counts
from exprlake.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import awkward_rows, frame

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def brute(rows, least, top):
    group, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = TERM.findall(low(text or ""))
        group[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in docs:
        sources = sorted(s for x, s in group if x == lang)
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = {t: sum(group[lang, s][t] for s in sources) for t in kept}

        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = p(whole)
        for s in sources:
            own = p(group[lang, s])
            others = [(sum(abs(own[t] - p(group[lang, o])[t]) for t in kept), o) for o in sources if o != s]
            terms = [(own[t] - q[t], t) for t in kept if group[lang, s][t] > 0 and own[t] > q[t]]
            for part, found, limit in (("pair", others, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, n + 1) for n, (value, item) in enumerate(found[:limit])}
    return out


def rows_of(seed, sources=5, vocabulary=30, n=150):
    rng = random.Random(seed)
    words = [rng.choice(["", "É", "z"]) + "".join(rng.choices("abc", k=2)) for _ in range(vocabulary)] + ["Äpfel", "日本", "x1y"]
    return [
        (i, " ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["xx", "xx", "yy", None]), f"s{min(rng.randrange(sources), rng.randrange(sources))}")
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("tile, terms, held", [(128, 256, 300_000), (2, 3, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, tile, terms, held):
    monkeypatch.setattr(module, "TILE", tile)
    monkeypatch.setattr(module, "TERMS", terms)
    monkeypatch.setattr(module, "HELD", held)
    rows = rows_of(seed)
    got = [tuple(r) for r in divergence(frame(spark, rows).repartition(3), 4, 7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 4, 7)


def test_ties_at_the_last_rank(spark):
    """Forty terms of equal counts: the ranks end inside one value, in UTF-8 order."""
    terms = [f"t{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(38)] + ["é", "😀"]
    rows = [(i, " ".join(terms), "xx", "a") for i in range(3)] + [(9, "other", "xx", "b"), (10, "", "xx", "c")]
    got = {tuple(r) for r in divergence(frame(spark, rows), 1, 39).collect()}
    assert got == brute(rows, 1, 39)
    named = sorted((r[5], r[3]) for r in got if r[1] == "a" and r[2] == "term")
    assert [t for _, t in named] == sorted(terms, key=str.encode)[:39]


def test_awkward_rows(spark, awkward, nothing):
    rows = awkward_rows()
    assert {tuple(r) for r in divergence(awkward, 3, 5).collect()} == brute(rows, 3, 5)
    high = divergence(awkward, 10**6, 5).collect()  # no term is kept anywhere
    assert {tuple(r) for r in high} == brute(rows, 10**6, 5) and all(r["value"] == 0 and r["part"] == "pair" for r in high)
    assert divergence(nothing, 1, 5).count() == 0


def test_large_counts_are_exact(spark):
    n = 900_000_000_000_000_000
    got = spark.createDataFrame([(n, n * 3, 7)], "n bigint, total bigint, v bigint").select(module.share("n", "total", "v")).first()[0]
    assert got == 1 + 1_000_000_000 * (n + 5) // (3 * n + 35)


def test_counts(spark):
    got = {tuple(r) for r in term_counts(frame(spark, [(1, "A a É-b", "xx", "s"), (2, "a", "xx", "s"), (3, None, "xx", "t")])).collect()}
    assert got == {("xx", "s", "a", 3, 2), ("xx", "s", "É", 1, 1), ("xx", "s", "b", 1, 1)}


def test_query_matches_sql(spark, small_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small_dir}/documents.parquet'")
    want = con.sql(ORACLES["op12_source_divergence"]).select("lang, source, part, item, value, rank").fetchall()
    got = QUERIES["op12_source_divergence"](spark, small_dir).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)
