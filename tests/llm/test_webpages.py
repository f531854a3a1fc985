"""Page differencing against hand-written pages and a plain longest common subsequence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprlake.llm import webpages
from exprlake.llm.webpages import aligned, extract, page_lines

SCHEMA = "page_id bigint, url string, html string, key string, text string, path string, range int, own int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "t", "p", 1, 2) for i, u, h in rows], SCHEMA)


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in extract(frame(spark, rows)).collect()}


def kept(html):
    """A page by itself: what its markup says."""
    lines = [x for x in page_lines(html) if not x[1]]
    return [t for t, _, level in lines if level == max(x[2] for x in lines)]


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("letters", [1, 2, 5, 40])
def test_alignment_is_longest_and_common(letters):
    rng = random.Random(letters)
    for _ in range(60):
        a, b = ([rng.randrange(letters) for _ in range(rng.randrange(30))] for _ in range(2))
        found = aligned(np.array(a, np.uint64), np.array(b, np.uint64))
        assert found.sum() == longest(a, b)
        rest = iter(b)
        assert all(x in rest for x in np.array(a)[found].tolist())


def test_long_alignment():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50, 6000).astype(np.uint64), rng.integers(0, 50, 6000).astype(np.uint64)
    found = np.flatnonzero(aligned(a, b))
    rest = iter(b.tolist())
    assert len(found) == webpages.common_lengths(a, b)[-1] > 1000 and all(x in rest for x in a[found].tolist())


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a\n  b<br>c</p><p>d", ["a b c", "d"]),
        ("<article><h1>A &amp; B &am</h1><p><b>x<br><p>y</article><footer>f", ["A & B &am", "x", "y"]),
        ("<nav><ul><li>n</ul></nav><main><header><h1>t</h1></header>one<aside>two</aside></main>", ["t", "one"]),
        ("<article>a<div class='comments'><article>c</article></div></article>", ["a"]),
        ("<div class='cookie-notice'>n</div><div class='content with-sidebar'>a<div id=sidebar>s</div></div>", ["a"]),
        ("<script>if (a < b) '</p>'</script><p>x<style>p{}</style>y<!-- <p>z --></p>", ["xy"]),
        ("<article><table><tr><td>1<td>2</table><ul><li>a<li>b<ul><li>c</ul></ul></article>", ["1", "2", "a", "b", "c"]),
        ("<article>1 < 2 &lt; 3 &#8212; <em>e</em>m</article>", ["1 < 2 < 3 — em"]),
        ("<article>a<form><p>f</p></form>b<span class='share'>s</span></article>", ["a", "b"]),
        ("<p title='unclosed>x</p><p>y</p>", ["x", "y"]),
        ("<p hidden>a</p><p style='display: none'>b</p><div aria-hidden=true>c</div><p>d", ["d"]),
        ("</div></p>x</b>", ["x"]),
        ("<article>a</article><!-- cut", ["a"]),
        ("<article>a<script>cut", ["a"]),
    ],
)
def test_markup(html, want):
    assert kept(html) == want


def test_shared_lines_go(spark):
    def page(body, tail="Read more"):
        return f"<div>Site name</div><div>Menu</div>{body}<div>{tail}</div><div>All rights</div>"

    rows = [
        (1, "http://a.example/x/1", page("<p>first one, of some length</p><p>Menu of the day</p>")),
        (2, "http://a.example/x/2", page("<p>second text, of some length</p><p>All in all</p>", "Other")),
        (3, "http://a.example/y/9", page("<p>third, which is longer than all that the site adds to it</p>")),
        (4, "http://b.example/x/1", page("<p>alone</p>")),
        (5, "HTTPS://user@A.example:80/y/8?q=1#top", page("<p>fifth, which is longer than all that the site adds to it</p>")),
    ]
    found = texts(spark, rows)
    assert found[1] == "first one, of some length\nMenu of the day\nRead more"  # page 2 is nearest, and has another line there
    assert found[2] == "second text, of some length\nAll in all\nOther"
    long = "which is longer than all that the site adds to it"
    assert found[3] == f"third, {long}" and found[5] == f"fifth, {long}"
    assert found[4] == "Site name\nMenu\nalone\nRead more\nAll rights"  # a host of one page has nothing to be compared with


def test_article_and_copies_stay(spark):
    shared = "<p>a passage that both pages quote at length and in full</p>"
    rows = [
        (1, "http://a.example/1", f"<div>top</div><article>{shared}<p>one</p></article>"),
        (2, "http://a.example/2", f"<div>top</div><article>{shared}<p>two</p></article>"),
        (3, "http://c.example/1", f"<div>t</div>{shared}<p>same</p>"),
        (4, "http://c.example/1?page=2", f"<div>t</div>{shared}<p>same</p>"),
        (5, "http://c.example/1?page=2", f"<div>t</div>{shared}<p>same</p>"),
    ]
    found = texts(spark, rows)
    passage = "a passage that both pages quote at length and in full"
    assert found[1] == f"{passage}\none" and found[2] == f"{passage}\ntwo"
    assert found[3] == found[4] == found[5] == f"t\n{passage}\nsame"


def brute(rows):
    """All pages of a host in order, each with its neighbours."""
    import re
    from os.path import commonprefix

    placed = []
    for i, u, h in rows:
        m = re.match(r"[a-z]+://([^/?#]*)([^#]*)", u)
        placed.append((m.group(1), m.group(2), f"{i:016x}", page_lines(h)))
    placed.sort()
    out = {}
    for n, (host, path, i, lines) in enumerate(placed):
        near = [placed[k] for k in (n - 1, n + 1) if 0 <= k < len(placed) and placed[k][0] == host]
        near.sort(key=lambda x: -len(commonprefix([x[1], path])))
        own = [not site for _, site, _ in lines]
        level = max((x[2] for x in lines if not x[1]), default=0)
        size = sum(len(t) for t, site, _ in lines if not site)
        gone = np.zeros(len(lines), bool)
        for other in near:
            names = {t: k for k, t in enumerate({x[0] for x in lines} | {x[0] for x in other[3]})}
            shared = aligned(np.array([names[x[0]] for x in lines], np.uint64), np.array([names[x[0]] for x in other[3]], np.uint64))
            if 2 * sum(len(t) for (t, site, _), s in zip(lines, shared, strict=True) if s and not site) < size:
                gone = shared
                break
        out[int(i, 16)] = "\n".join(t for (t, _, lv), o, g in zip(lines, own, gone, strict=True) if o and lv == level and (lv >= 2 or not g))
    return out


def test_ranges_do_not_show(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        host = rng.choice(["h", "h", "h", "g", "k"])
        site = [f"<div>{host} line {n}</div>" for n in range(6) if rng.random() < 0.8]
        body = [f"<p>word {rng.randrange(4000)} of {i}</p>" for _ in range(rng.randrange(1, 6))]
        rows.append((i, f"http://{host}.example/{rng.choice('ab')}/{rng.randrange(90)}", "".join(site[:3] + body + site[3:])))
    want = brute(rows)
    for size in (7, 100, 2000):
        monkeypatch.setattr(webpages, "PAGES", size)
        assert texts(spark, rows) == want


def test_awkward_pages(spark):
    rows = [
        (1, None, "<p>a</p>"), (2, "", "<p>b</p>"), (3, "no url at all", ""), (4, "http://a.example", None), (None, "http://a.example/1", "<p>c</p>"),
        (5, "http://a.example/2", "<p>" + "w " * 200_000), (6, "http://a.example/3", "<div>" * 20_000 + "deep"), (7, "http://a.example/3", "<"), (7, "http://a.example/3", "<"),
        (8, "http://a.example/4", "<p> \n</p><p title=\"" * 2000), (9, "http://\0b.example/4", "é&eacute;😀".encode("utf-16", "surrogatepass").decode("utf-16")),
    ]
    out = extract(frame(spark, rows))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = out.collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    by = {r["page_id"]: r["text"] for r in found}
    assert by[1] == "a" and by[2] == "b" and by[3] == by[4] == "" and by[None] == "c" and by[6] == "deep" and by[7] == "<" and by[9] == "éé😀"
    assert len(by[5]) == 399_999
    assert extract(frame(spark, []).filter(F.lit(False))).count() == 0


def test_all_pages_of_the_table(spark, small_dir):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert found[r["page_id"]] == "\n".join(b for b in blocks if b)
