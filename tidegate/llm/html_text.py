"""Main text of web pages by differencing each page against its nearest one.

A page is read into lines: the texts of its blocks, each with the region it stands in. Pages are paired by
URL path within their host: in the order of (host, path) the nearest page is the neighbour before or behind,
whichever has more of the path in common, unless it is a copy of the page; then the other one. The lines of the two are aligned by a
longest common subsequence; lines they share are what the site prints on every page, and are deleted.

Regions bound what differencing may do. What stands in menus, page headers, footers, sidebars, notices,
adverts, forms, comments or scripts goes even if it is unlike the neighbour's, as such lines often change from
page to page. What stands in an article element stays even if a neighbour has it too, as pages also share
whole passages; the remaining lines are differencing's to judge.

Pages are dealt by ranges of (host, path), so a hot host spreads over tasks, and each range also gets the pages
next to its ends. Range bounds come from a bounded sample of the URLs; each task streams over its
pages and holds three of them.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import need, quoted, schema

#: Names of HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul".split())
CHROME = frozenset("nav footer aside form menu button select dialog svg canvas object audio video map fieldset datalist head search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog note".split())
#: Words in class or id that name page furniture, chosen here.
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert disclaimer sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager widget widgets related recommended recommendations comment comments commentlist respond replies reply disqus discussion".split())
COMMENTS = frozenset("comment comments commentlist respond replies reply disqus discussion".split())
CONTENT = frozenset("article articlebody content maincontent post entry story".split())

_TAG = re.compile(r"""<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*|\d+")
_SPACE = re.compile(r"\s+")
_OPEN_COMMENT = re.compile(r"<[!?]")
SAMPLE_A_RANGE = 16


@dataclass
class Line:
    text: str
    level: int  # 3 article, 2 main, 1 content by name, 0 elsewhere
    furniture: bool


@dataclass
class Element:
    name: str
    level: int
    furniture: bool
    header: bool = False  # a header inside an article keeps its headings only


def _look(name: str, attrs: str, up: Element) -> Element:
    """What a start tag makes of the region it opens."""
    got = {k.lower(): _html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(attrs)} if attrs and "=" in attrs or "hidden" in attrs else {}
    words = {w.lower() for w in _WORDS.findall(f"{got.get('class', '')} {got.get('id', '')}")}
    role = got.get("role", "").lower()
    level, furniture, header = up.level, up.furniture, up.header
    if name in CHROME or name in RAW or role in ROLES and name != "body":
        furniture = True
    elif "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
        furniture = True
    elif name == "header" or "header" in words and name in ("div", "section"):
        if level >= 2:
            header = True
        elif name == "header" or words & {"page", "site", "header"} == {"header"} or words & {"page", "site"}:
            furniture = True
    if name not in ("html", "body", "main") and words & (COMMENTS if name == "article" or name in HEADINGS else FURNITURE):
        furniture = True
    if not furniture:
        if name == "article" or role == "article" or got.get("itemprop", "").lower() == "articlebody":
            level = 3
        elif name == "main" or role == "main":
            level = max(level, 2)
        elif name in ("div", "section", "td") and words & CONTENT:
            level = max(level, 1)
    return Element(name, level, furniture, header)


#: Elements out of which end tags of other names don't reach, and names whose end tags do.
BARRIERS = frozenset("article main td th table body".split())
REACHING = frozenset("html body article main table tr".split())
#: Elements in which a paragraph that stays open isn't closed by a block inside.
HOLDS_P = ("article", "main", "td", "th", "table", "button", "div", "section", "li", "blockquote", "aside", "nav", "footer", "header", "form")


class Stack:
    """Open elements, and the places of each name among them, so that no tag costs a walk down the stack."""

    def __init__(self):
        self.elements = [Element("", 0, False)]
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []

    def push(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self.elements))
        if element.name in BARRIERS:
            self.barriers.append(len(self.elements))
        self.elements.append(element)

    def last(self, names) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        found, places = 0, self.places
        for name in names:
            at = places.get(name)
            if at and at[-1] > found:
                found = at[-1]
        return found

    def cut(self, at: int) -> bool:
        """Close all from this place on; whether a block was among them."""
        block = False
        for element in reversed(self.elements[at:]):
            self.places[element.name].pop()
            if element.name in BARRIERS:
                self.barriers.pop()
            block |= element.name in BLOCK
        del self.elements[at:]
        return block


def read_lines(page: str) -> list[Line]:
    """The blocks of a page in order, their character references decoded and white space made single."""
    out: list[Line] = []
    stack = Stack()
    text: list[str] = []

    def end_block() -> None:
        if text:
            got = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
            if got:
                top = stack.elements[-1]
                kept = not top.header or stack.last(HEADINGS) > 0
                out.append(Line(got, top.level, top.furniture or not kept))
            text.clear()

    def close(names: tuple[str, ...], within: tuple[str, ...]) -> None:
        i = stack.last(names)
        if i and i > stack.last(within):
            end_block()
            stack.cut(i)

    at, n, last_end = 0, len(page), page.rfind(">")
    while at < n:
        tag = _TAG.search(page, at) if at <= last_end else _OPEN_COMMENT.search(page, at)
        if tag is None:
            text.append(page[at:])
            break
        if tag.start() > at:
            text.append(page[at : tag.start()])
        if at > last_end:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            if tag[0].startswith("<![CDATA["):
                text.append(_html.escape(tag[0][9:].removesuffix("]]>")))
            continue
        ending, attrs = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if ending:
            i = stack.last((name,))
            if name == "br" or name == "p" and not i:
                text.append(" ") if name == "br" else end_block()
            elif i and (name in REACHING or not stack.barriers or stack.barriers[-1] <= i):
                outer, inner = stack.elements[i - 1], stack.elements[i]
                if name in BLOCK or inner.furniture != outer.furniture or any(e.name in BLOCK for e in stack.elements[i:]):
                    end_block()
                stack.cut(i)
            continue
        if name in BLOCK:
            close(("p",), HOLDS_P)
            if name in CLOSES_SAME:
                same, within = CLOSES_SAME[name]
                close(tuple(same.split()), within)
            end_block()
        if name == "br" or name == "img" or name == "wbr":
            text.append(" " if name == "br" else "")
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            close_at = page.find(">", end.end()) if end else -1
            at = close_at + 1 if close_at >= 0 else n
            continue
        element = _look(name, attrs, stack.elements[-1])
        if name not in BLOCK and element.furniture != stack.elements[-1].furniture:
            end_block()
        if not (attrs.rstrip().endswith("/") and name in ("svg", "path", "rect", "use", "circle")):
            stack.push(element)
    end_block()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of the two lists."""
    only = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in only]
    return {at[i] for i in _align([a[i] for i in at], [x for x in b if x in only])}


#: Pairs of equal lines, for each line, up to which they are gone through one by one; bytes of bit rows that are kept for lines.
FEW_PAIRS, ROW_BYTES = 32, 1 << 26


def _align(a: list[str], b: list[str]) -> set[int]:
    """common(): by the pairs of equal lines if they are few; else a is halved, and b where rows of bits say that the halves' subsequences are longest together,
    so that memory stays in proportion to the lines."""
    lo, ha, hb = 0, len(a), len(b)
    while lo < ha and lo < hb and a[lo] == b[lo]:
        lo += 1
    out = set(range(lo))
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
        out.add(ha)
    a, b = a[lo:ha], b[lo:hb]
    where: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    if len(a) < 2 or sum(len(where.get(x, ())) for x in a) <= FEW_PAIRS * (len(a) + len(b)):
        return out | {lo + i for i in _by_pairs(a, where)}
    half = len(a) // 2
    front, back = _longest(a[:half], b), _longest(a[: half - 1 : -1], b[::-1])
    cut = int((front + back[::-1]).argmax())
    return out | {lo + i for i in _align(a[:half], b[:cut])} | {lo + half + i for i in _align(a[half:], b[cut:])}


def _by_pairs(a: list[str], where: dict[str, list[int]]) -> Iterator[int]:
    ends: list[int] = []  # least end in b of a subsequence of each length
    last: list[tuple[int, object]] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect_left(ends, j)
            link = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            elif j < ends[k]:
                ends[k], last[k] = j, link
    link = last[-1] if last else None
    while link is not None:
        yield link[0]
        link = link[1]


def _longest(a: list[str], b: list[str]) -> np.ndarray:
    """Length of a longest common subsequence of a with each head of b: rows of bits as whole numbers, a step a line of a."""
    n = len(b)
    names = {x: i for i, x in enumerate(dict.fromkeys(b))}
    of = np.fromiter((names[x] for x in b), np.int64, n)
    rows: dict[str, int] = {}
    full = row = (1 << n) - 1
    for x in a:
        mask = rows.get(x)
        if mask is None:
            mask = int.from_bytes(np.packbits(of == names[x], bitorder="little").tobytes(), "little") if x in names else 0
            if (len(rows) + 1) * (n // 8 + 64) <= ROW_BYTES:
                rows[x] = mask
        part = row & mask
        row = ((row + part) | (row - part)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


#: Share of a page's text in lines of its neighbour from which the two count as copies, which tell nothing about the site.
COPY = 0.8


def main_text(lines: list[Line], partners: Iterable[tuple[object, list[Line]]] = ()) -> tuple[str, int, object]:
    """(text, lines shared with the partner, the partner's name). The partner is the first that isn't a copy of the page."""
    shared, partner = set(), None
    total = sum(len(x.text) for x in lines if not x.furniture)
    for name, other in partners:
        got = common([x.text for x in lines], [x.text for x in other])
        if sum(len(lines[i].text) for i in got if not lines[i].furniture) < COPY * total or not total:
            shared, partner = got, name
            break
    kept = [(i, x) for i, x in enumerate(lines) if not x.furniture and (x.level == 3 or i not in shared)]
    top = max((x.level for _, x in kept), default=0)
    return "\n\n".join(x.text for _, x in kept if x.level == top), len(shared), partner


def place(url: str | None) -> tuple[str, str, str]:
    """(host, path, query) of a URL; what can't be parsed has no host."""
    try:
        got = urlsplit((url or "").strip())
        return (got.hostname or ""), got.path or "/", got.query
    except ValueError:
        return "", url or "", ""


def likeness(a: str, b: str) -> tuple[int, int]:
    """Path segments, then characters, that two paths have in common from the left."""
    chars = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    segments = next((i for i, (x, y) in enumerate(zip(a.split("/"), b.split("/"))) if x != y), min(a.count("/"), b.count("/")) + 1)
    return segments, chars


RESULT = schema(page_id="long", url="string", text="string", n_chars="long", n_shared_lines="int", partner_id="long")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over pages in the order of (range, key); each is finished when the page behind it is known."""
    before = now = None
    rows: list[tuple] = []

    def finish(page, behind) -> None:
        if page is None or page[5]:
            return
        choices = [p for p in (before, behind) if p is not None and p[0] == page[0] and p[2] and p[2] == page[2]]
        choices.sort(key=lambda p: likeness(p[3], page[3]), reverse=True)
        text, shared, partner = main_text(page[4], [(p[1], p[4]) for p in choices])
        rows.append((page[1], page[6], text, len(text), shared, partner))

    def emit() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64()))], RESULT.names)
        rows.clear()
        return got

    for batch in batches:
        part, ids, urls, pages, halo = (batch.column(i) for i in range(5))
        for k in range(batch.num_rows):
            host, path, _ = place(urls[k].as_py())
            behind = (part[k].as_py(), ids[k].as_py(), host, path, read_lines((pages[k].as_py() or "").replace("\0", "�")), halo[k].as_py(), urls[k].as_py())
            finish(now, behind)
            before, now = now, behind
        yield emit()
    finish(now, None)
    yield emit()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", range_pages: int = 512) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared_lines, partner_id) for each row of pages.

    text: the main text, blocks in page order with an empty line between; empty if there is none, as for null
    html. n_chars: its code points. Pages without URL or host, and the only page of a host, have no partner; structure
    alone decides then, as where both neighbours are copies of the page. Pages with equal URLs are ordered by id and are each other's nearest. A page is
    read whole, in time that grows with its length, however many tags stay open; lines that many lines of the neighbour equal cost their
    product, 64 pairs in a step. Each row gives a row,
    repeated ones too; an empty table gives an empty table. Other columns are ignored. A range has about range_pages pages, more beyond
    50,000 ranges; its bounds come from about SAMPLE_A_RANGE URLs for each. Neither changes results.
    """
    need(pages, (id_col, url_col, html_col), "extract")
    spark = pages.sparkSession
    url = quoted(url_col).cast("string")
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    key = F.concat_ws("\u0001", host, path, F.lpad(F.coalesce(quoted(id_col).cast("string"), F.lit("")), 20, "0"))
    rows = pages.select(quoted(id_col).cast("long").alias("id"), url.alias("url"), quoted(html_col).cast("string").alias("html"), key.alias("key"))
    light = rows.select("key")
    n = light.count()
    ranges = max(1, min(n // range_pages, 50_000))
    wanted = min(1.0, SAMPLE_A_RANGE * ranges / max(1, n))
    some = sorted(r["key"] for r in light.where(F.xxhash64("key") <= int(-(2**63) + 2**64 * wanted) if wanted < 1 else F.lit(True)).collect())
    bounds = sorted({some[len(some) * i // ranges] for i in range(1, ranges)}) if some else []

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, object), keys.to_numpy(object), "right").astype(np.int32), index=keys.index)

    rows = rows.withColumn("part", range_of("key") if bounds else F.lit(0))
    if bounds:
        ends = sorted((r["part"], r["low"], r["high"]) for r in rows.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect())
        also: dict[str, list[int]] = {}
        for (p, _, high), (q, low, _) in zip(ends, ends[1:]):
            also.setdefault(high, []).append(q)
            also.setdefault(low, []).append(p)
        # two rows a range at most
        halo = F.broadcast(spark.createDataFrame([(k, v) for k, v in also.items()] or [("", [])], "k string, also array<int>"))
        rows = rows.join(halo, F.col("key") == F.col("k"), "left").drop("k")
        places = F.concat(F.array(F.struct("part", F.lit(False).alias("halo"))), F.coalesce(F.transform("also", lambda p: F.struct(p.alias("part"), F.lit(True).alias("halo"))), F.array().cast("array<struct<part:int,halo:boolean>>")))
        rows = rows.select("id", "url", "html", "key", F.explode(places).alias("p")).select("p.part", "id", "url", "html", "p.halo", "key")
    else:
        rows = rows.select("part", "id", "url", "html", F.lit(False).alias("halo"), "key")
    dealt = rows.repartition(-(-ranges // 2), "part").sortWithinPartitions("part", "key").select("part", "id", "url", "html", "halo")
    out = dealt.mapInArrow(_run, RESULT)
    return out.withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
