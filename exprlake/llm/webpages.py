"""Main text of web pages by differencing with the page of the nearest URL.

The pages of a host are put in the order of their paths. Each is compared with the neighbour whose path has the longer
common start; the lines of both are aligned by their longest common subsequence, and shared lines are deleted: they are
the site's, not the article's. A neighbour that shares half of the text or more is a copy, which tells nothing; then the
other one is taken, and where both are copies nothing is deleted.

Differencing alone can't keep a passage that two articles share lawfully, nor find a menu that differs from page to page.
So the markup has a say: lines inside menus, headers, footers, side columns, notices, adverts, forms and comments are the
site's even where the neighbour has others, and lines inside an ``article`` or ``main`` element stay although the
neighbour has the same. All other lines stand or fall by the comparison.

Null or empty html gives an empty text. Null, empty and malformed URLs are pages of the host ''. Markup that is cut off,
unclosed or crossed is read as far as it goes. Repeated rows are pages of their own, and copies of each other. Very long
pages are held one at a time, beside their two neighbours. An empty table gives no rows.
"""

from __future__ import annotations

import html as references
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML and usual names of page parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - set("body head html caption tbody td tfoot th thead tr option title legend".split())
SAME = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
#: Elements that end the search for an open element of ``SAME``.
INSIDE = {"ul", "ol", "menu", "dir", "dl", "table", "select", "article", "section", "div", "main", "body"}
SITE_ELEMENTS = set(
    "nav footer aside form button select option datalist noscript template object svg canvas audio video dialog menu head "
    "applet map math".split()
)
SITE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist".split())
SITE_NAMES = set(
    "nav navbar navigation menu menus header masthead topbar footer sidebar aside ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "discussion reply replies respond disqus breadcrumb breadcrumbs pagination pager toolbar widget widgets copyright".split()
)
ARTICLE_ROLES = {"main", "article"}
ARTICLE_NAMES = set("article articlebody content maincontent post entry story main".split())
AGAINST = {"with", "has", "no", "without"}

NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+)(\s*=\s*)?")
BARE = re.compile(r"[^\s>]*")
PLACED = re.compile(r"[a-z][a-z0-9+.-]*:/*(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", re.I)
#: Pages of a range of URLs, and ranges at most.
PAGES, RANGES = 2_000, 20_000
READ = "range int, key string, own boolean, page_id bigint, url string, path string, hashes binary, sizes binary, kinds binary, lines binary"


def attributes(text: str, at: int, state: dict[str, bool]) -> tuple[dict[str, str], int]:
    """The attributes from ``at`` to the end of a tag, and the place behind it. A quote that isn't closed is part of a bare value."""
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(text, at)
        if not m:
            end = text.find(">", at)
            return found, len(text) if end < 0 else end + 1
        name, at = m.group(1).lower(), m.end()
        value = ""
        if m.group(2):
            quote = text[at : at + 1]
            close = -1
            if quote in ('"', "'") and not state.get(quote):
                close = text.find(quote, at + 1)
                state[quote] = close < 0  # nor is any later one closed
            if close >= 0:
                value, at = text[at + 1 : close], close + 1
            else:
                m = BARE.match(text, at)
                value, at = m.group(), m.end()
        found.setdefault(name, value)


def tokens(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """``("text", text, {})``, ``("start", name, attributes)`` and ``("end", name, {})`` in page order."""
    at, state = 0, {}
    while at < len(text):
        start = text.find("<", at)
        if start < 0:
            start = len(text)
        if start > at:
            yield "text", text[at:start], {}
        if start >= len(text):
            return
        follows = text[start + 1 : start + 2]
        if follows in ("!", "?"):
            mark = ("-->", 4, 3) if text.startswith("<!--", start) else (">", 2, 1)
            end = text.find(mark[0], start + mark[1])
            if end < 0:
                return
            at = end + mark[2]
            continue
        closing = follows == "/"
        m = NAME.match(text, start + 1 + closing)
        if not m:
            if closing:  # a comment that nobody meant
                end = text.find(">", start)
                at = len(text) if end < 0 else end + 1
            else:
                yield "text", "<", {}
                at = start + 1
            continue
        name = m.group().lower()
        found, at = attributes(text, m.end(), state)
        if closing:
            yield "end", name, {}
            continue
        yield "start", name, found
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(text, at)
            if end:
                at = end.start()
            elif text[at - 2 : at] != "/>":  # such an element of a drawing is empty
                at = len(text)


def named(found: dict[str, str]) -> set[str]:
    """The words of an element's class and id, without what they say that it is without."""
    words: set[str] = set()
    for value in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        for word in re.split(r"[^a-z0-9]+", value):
            if word in AGAINST:
                break
            words.add(word)
    return words


def part(name: str, found: dict[str, str], site: bool, level: int) -> tuple[bool, int]:
    """Whether an element is the site's, and how surely it holds the article: 0 unknown, 1 by its name, 2 ``main``, 3 ``article``."""
    if name in RAW:  # its text is never read, so it doesn't part a line
        return site, level
    if site or name in SITE_ELEMENTS or (name == "header" and not level):
        return True, level
    if not found or name in ("html", "body"):
        return False, max(level, {"article": 3, "main": 2}.get(name, 0))
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    words = named(found)
    marked = words & SITE_NAMES - ({"header"} if level else set())
    if role in SITE_ROLES or hidden or marked:
        return True, level
    level = max(level, {"article": 3, "main": 2}.get(name, 0))
    if role in ARTICLE_ROLES or found.get("itemprop") == "articleBody":
        level = max(level, 2)
    return False, max(level, 1 if words & ARTICLE_NAMES else 0)


def page_lines(text: str | None) -> list[tuple[str, bool, int]]:
    """The text lines of a page, one a block: ``(text, whether it is the site's, level)``."""
    out: list[tuple[str, bool, int]] = []
    if not text:
        return out
    stack: list[tuple[str, bool, int]] = [("", False, 0)]
    opened: Counter = Counter()
    words: list[str] = []

    def flush() -> None:
        line = " ".join("".join(words).split())
        if line:
            out.append((line, *stack[-1][1:]))
        words.clear()

    def close(names: set[str], stop: frozenset | set = frozenset()) -> None:
        """Close the innermost open element of ``names``, with what is open inside."""
        if not any(opened[n] for n in names):
            return
        for n in range(len(stack) - 1, 0, -1):
            if stack[n][0] in names:
                if any(x[0] in BLOCK or x[1:] != stack[n - 1][1:] for x in stack[n:]):
                    flush()
                opened.subtract(x[0] for x in stack[n:])
                del stack[n:]
                return
            if stack[n][0] in stop:
                return

    for kind, value, found in tokens(text):
        if kind == "text":
            if stack[-1][0] not in RAW:
                words.append(references.unescape(value) if "&" in value else value)
        elif kind == "end":
            if value == "br":
                words.append(" ")
            else:
                close({value})
        elif value in VOID:
            if value in BLOCK:
                flush()
            words.append(" " if value == "br" else "")
        else:
            if value in CLOSES_P:
                close({"p"}, {"table", "button", "object", "td", "th"})
            if value in SAME:
                close(SAME[value], INSIDE - SAME[value])
            site, level = part(value, found, *stack[-1][1:])
            if value in BLOCK or (site, level) != stack[-1][1:]:
                flush()
            stack.append((value, site, level))
            opened[value] += 1
    flush()
    return out


def common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every beginning of ``b``, by bit-parallel rows."""
    where: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def aligned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` are in a longest common subsequence with ``b``. Memory grows with the lengths, not with their product."""
    out = np.zeros(len(a), bool)
    work = [(0, len(a), 0, len(b))]
    while work:
        i, end, j, stop = work.pop()
        while i < end and j < stop and a[i] == b[j]:
            out[i] = True
            i, j = i + 1, j + 1
        while i < end and j < stop and a[end - 1] == b[stop - 1]:
            out[end - 1] = True
            end, stop = end - 1, stop - 1
        # only what both have can be shared
        left = i + np.flatnonzero(np.isin(a[i:end], b[j:stop]))
        right = j + np.flatnonzero(np.isin(b[j:stop], a[i:end]))
        if len(left) == 0:
            continue
        if len(left) < end - i or len(right) < stop - j:
            out[left[aligned(a[left], b[right])]] = True
        elif len(left) == 1:
            out[left[0]] = True
        else:
            middle = (i + end) // 2
            ahead, behind = common_lengths(a[i:middle], b[j:stop]), common_lengths(a[middle:end][::-1], b[j:stop][::-1])
            cut = j + int(np.argmax(ahead + behind[::-1]))
            work += [(i, middle, j, cut), (middle, end, cut, stop)]
    return out


def kept_lines(page: dict, neighbours: list[dict]) -> np.ndarray:
    """Numbers of a page's lines that are its article."""
    own = ~page["site"]
    level = page["level"]
    if own.any():
        own &= level == level[own].max()
    # the longer common start of the path is the nearer page; of two as near, the earlier one
    for other in sorted(neighbours, key=lambda x: -len(commonprefix([page["path"], x["path"]]))):
        shared = aligned(page["hashes"], other["hashes"])
        size = page["sizes"]
        if 2 * size[shared & ~page["site"]].sum() < size[~page["site"]].sum() or not own.any():
            own &= ~shared | (level >= 2)
            break
    return np.flatnonzero(own)


def boundaries(pages: DataFrame) -> list[tuple[str, str]]:
    """First and last key of every range of pages in the order of their keys; at most ``RANGES`` of them."""
    n = pages.count()
    ranges = min(RANGES, -(-n // PAGES)) or 1
    ends = pages.select("key").repartitionByRange(ranges, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("a"), F.max("key").alias("b"))
    return sorted((r["a"], r["b"]) for r in ends.collect())


def keyed(pages: DataFrame) -> DataFrame:
    """``key, page_id, url, html``: a key that sorts by host, then path, then page."""
    url = F.coalesce(F.col("url"), F.lit(""))
    pattern = f"(?i)^{PLACED.pattern}"
    host, path = F.lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)
    return pages.select(
        F.concat_ws("\0", host, path, F.coalesce(F.lpad(F.hex("page_id"), 16, "0"), F.lit(""))).alias("key"),
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), F.col("html"),
    )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``)."""
    rows = keyed(pages)
    limits = boundaries(rows)
    firsts, lasts = [a for a, _ in limits], [b for _, b in limits]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages with their lines; the outermost ones of a range also go to the range beside it, as guests."""
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for key, page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "url", "html")), strict=True):
                lines = page_lines(html)
                own = [text for text, site, _ in lines if not site]
                packed = zlib.compress("\n".join(own).encode("utf-8", "surrogatepass"), 3)
                row = (
                    page_id, url, key.split("\0")[1], np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t, *_ in lines], np.uint64).tobytes(),
                    np.array([len(t) for t, *_ in lines], np.int64).tobytes(), bytes(level * 2 + site for _, site, level in lines), packed,
                )
                n = min(bisect_left(lasts, key), len(limits) - 1)
                out.append((n, key, True, *row))
                guest = (*row[:6], b"")
                if n > 0 and key == firsts[n]:
                    out.append((n - 1, key, False, *guest))
                if n + 1 < len(limits) and key == lasts[n]:
                    out.append((n + 1, key, False, *guest))
                held += len(packed)
                if held > 1 << 24:
                    yield table(out)
                    out, held = [], 0
            yield table(out)

    schema = pa.schema([
        ("range", pa.int32()), ("key", pa.string()), ("own", pa.bool_()), ("page_id", pa.int64()), ("url", pa.string()), ("path", pa.string()),
        ("hashes", pa.binary()), ("sizes", pa.binary()), ("kinds", pa.binary()), ("lines", pa.binary()),
    ])

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        before = now = None
        for after in (*_pages(batches), None):
            if now is not None and now["own"]:
                beside = [x for x in (before, after) if x is not None and x["range"] == now["range"] and x["host"] == now["host"]]
                lines = zlib.decompress(now["lines"]).decode("utf-8", "surrogatepass").split("\n")
                number = np.cumsum(~now["site"]) - 1
                text = "\n".join(lines[number[i]] for i in kept_lines(now, beside))
                done.append((now["page_id"], now["url"], text, len(text)))
                if len(done) >= 500:
                    yield result(done)
                    done = []
            before, now = now, after
        yield result(done)

    def result(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [()] * 4
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "text", "n_chars"])

    sent = rows.mapInArrow(read, READ).repartition(max(1, len(limits)), "range").sortWithinPartitions("range", "key")
    return sent.mapInArrow(compare, "page_id bigint, url string, text string, n_chars bigint")


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The pages of sorted batches with their lines' hashes, sizes and kinds as arrays."""
    for batch in batches:
        for row in (dict(zip(batch.schema.names, x, strict=True)) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            kinds = np.frombuffer(row["kinds"], np.uint8)
            row |= {
                "host": row["key"].split("\0")[0], "hashes": np.frombuffer(row["hashes"], np.uint64), "sizes": np.frombuffer(row["sizes"], np.int64),
                "site": (kinds & 1).astype(bool), "level": kinds >> 1,
            }
            yield row
