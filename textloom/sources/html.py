"""Paragraphs, links and verses of HTML pages (standard library parser in Arrow batches, then native filters)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import script_class, strip
from textloom.operators.clean import LOADER_SCRIPTS, PAGE_BOILERPLATE, PAGE_FRAGMENTS, canonical_url, distinct_first, is_boilerplate, is_foreign, is_link_dense, is_navigation

_SKIP = {"script", "style", "noscript", "iframe", "nav", "header", "footer"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Attributes and patterns of the div that holds a document; the first pattern that any div matches decides.
CONTAINERS = [("class", r"doc[-_]?body"), ("class", r"content[-_]?body"), ("id", r"main[-_]?content"), ("class", r"entry[-_]?content")]
_CONTAINERS = [(name, re.compile(pattern, re.IGNORECASE)) for name, pattern in CONTAINERS]
#: A page number in brackets.
PAGE_MARK = r"(?i)\[p[g.\s]*\d+\]"


class _Paragraphs(HTMLParser):
    """Texts of p and blockquote elements with the characters of links in them and the containers around them.

    Elements nest as they are written: an end tag closes the last open element of its name and all within it. A p
    closes an open p.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        #: Open elements: name, and containers that start there; how many are open of each name; open paragraphs.
        self.open: list[tuple[str, set]] = []
        self.counts: Counter = Counter()
        self.paragraphs: list[dict] = []
        self.seen: set = set()
        self.within: Counter = Counter()
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if tag == "p" and self.counts["p"]:
            self.handle_endtag("p")
        own: set = set()
        if tag == "div" and not self.skipped:
            values = dict(attrs)
            own = {n for n, (name, pattern) in enumerate(_CONTAINERS) if n not in self.seen and pattern.search(values.get(name) or "")}
        elif tag == "body" and "body" not in self.seen:
            own = {"body"}
        self.seen |= own
        self.within.update(own)
        if tag in ("p", "blockquote") and not self.skipped:
            self.paragraphs.append({"parts": [], "link_chars": 0, "links": 0, "depth": len(self.open), "within": set(+self.within)})
            self.found.append(self.paragraphs[-1])
        elif tag == "a":
            for paragraph in self.paragraphs:
                paragraph["links"] += 1
        self.skipped += tag in _SKIP
        self.open.append((tag, own))
        self.counts[tag] += 1

    def handle_endtag(self, tag):
        if not self.counts[tag]:
            return
        closed = None
        while closed != tag:
            closed, own = self.open.pop()
            self.counts[closed] -= 1
            self.within.subtract(own)
            self.skipped -= closed in _SKIP
            if self.paragraphs and self.paragraphs[-1]["depth"] == len(self.open):
                self.paragraphs.pop()
            elif closed == "a":
                for paragraph in self.paragraphs:
                    paragraph["links"] -= 1

    def handle_data(self, data):
        if not self.skipped:
            for paragraph in self.paragraphs:
                paragraph["parts"].append(data)
                paragraph["link_chars"] += paragraph["links"] * len(data)


def page_paragraphs(page: str | None) -> list[tuple[str, int]]:
    """(text, characters in links) of a page's paragraphs within its container, the body where it has none."""
    reader = _Paragraphs()
    reader.feed(page or "")
    reader.close()
    container = next((c for c in (*range(len(_CONTAINERS)), "body") if c in reader.seen), None)
    found = [p for p in reader.found if container is None or container in p["within"]]
    return [(" ".join(" ".join(filter(None, (x.strip() for x in p["parts"]))).split()), p["link_chars"]) for p in found]


class _Reader(HTMLParser):
    """Collects links, and verse spans with what follows them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[str] = []
        self.verses: list[str] = []
        self.skip = 0
        self.label: list[str] | None = None
        self.verse: list[str] | None = None

    def _close_verse(self) -> None:
        if self.verse is not None:
            text = " ".join("".join(self.verse).split()).lstrip("0123456789").strip()
            if text:
                self.verses.append(text)
        self.verse = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        if tag == "a" and attrs.get("href"):
            self.links.append(attrs["href"].strip())
        if self.skip:
            return
        if tag == "span" and "verse" in (attrs.get("class") or "").split():
            self._close_verse()
            self.label = []

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        if not self.skip and tag == "span" and self.label is not None:
            self.verse = [] if "".join(self.label).strip().isdigit() else None
            self.label = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.label is not None:
            self.label.append(data)
        elif self.verse is not None:
            self.verse.append(data)


def read_page(page: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader._close_verse()
    return reader


#: Characters of rows that are handed on together.
SLAB = 1 << 20


def _rows_of(pages: DataFrame, columns: list[str], schema: str, read: Callable[..., list[tuple]]) -> DataFrame:
    """The rows that ``read`` makes of each page: pages are taken from Arrow one at a time and rows handed on by the megabyte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for at in range(b.num_rows):
                own = read(*(b.column(c)[at].as_py() for c in range(b.num_columns)))
                rows += own
                size += sum(len(x) for r in own for x in r if isinstance(x, str)) + 64 * len(own)
                if size >= SLAB:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [(n, types[t]) for n, t in (f.split() for f in schema.split(", "))]
    return pages.select(*columns).mapInArrow(run, schema)


def raw_paragraphs(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, pos, text, link_chars of all paragraphs of a page's container, without any filter."""

    read = lambda i, page: [(i, n, *p) for n, p in enumerate(page_paragraphs(page))]
    return _rows_of(pages, [page_id, html], "page_id long, pos int, text string, link_chars int", read)


def paragraph_filter(text: Column, link_chars: Column, least: int = 40) -> Column:
    return (F.length(text) >= least) & ~is_navigation(text) & ~is_boilerplate(text, PAGE_FRAGMENTS, PAGE_BOILERPLATE) & ~is_link_dense(text, link_chars) & ~is_foreign(text, script_class(LOADER_SCRIPTS))


def paragraphs(pages: DataFrame, least: int = 40) -> DataFrame:
    """Paragraphs that are text: page marks cut, then length, navigation, boilerplate, link share and script tests."""
    rows = raw_paragraphs(pages).withColumn("text", strip(F.regexp_replace("text", PAGE_MARK, "")))
    return rows.where(paragraph_filter(F.col("text"), F.col("link_chars"), least)).select("page_id", "pos", "text")


def documents(pages: DataFrame, part: str = "/", index: DataFrame | None = None, asked: DataFrame | None = None, least: int = 40, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """doc_id, page_no, pos, text: the paragraphs of the pages that an index page links to, each text once a document.

    Pages are taken in the order of the index page's links (index: page_id, pos, link; by default those of ``links``)
    and found by canonical URL, of several the smallest id; links to no page are passed over. Of equal paragraphs the
    first counts. A page without links is its own document, as it is. ``asked`` (page_id) names the index pages, by
    default all pages.
    """
    index = links(pages, part, page_id, url, html) if index is None else index
    asked = pages.select(F.col(page_id).alias("page_id")) if asked is None else asked
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))
    text = paragraphs(rows, least)
    places = pages.groupBy(canonical_url(F.col(url)).alias("_key")).agg(F.min(page_id).alias("page_id"))
    chapters = index.join(asked.distinct(), "page_id", "left_semi").select(F.col("page_id").alias("doc_id"), F.col("pos").alias("page_no"), canonical_url(F.col("link")).alias("_key")).join(places, "_key").drop("_key")
    # One row a document and text, by a minimum that combines before the shuffle.
    linked = distinct_first(chapters.join(text, "page_id").withColumn("_at", F.struct("page_no", "pos")), F.col("text"), "_at", "doc_id")
    lone = asked.join(index.select("page_id"), "page_id", "left_anti")
    alone = text.join(lone, "page_id", "left_semi").withColumnsRenamed({"page_id": "doc_id"}).withColumn("page_no", F.lit(0))
    names = ["doc_id", "page_no", "pos", "text"]
    return linked.select(names).unionByName(alone.select(names))


def distinct_paragraphs(paragraphs: DataFrame, *within: str) -> DataFrame:
    """Of equal paragraphs of a document the first (page, pos)."""
    rows = paragraphs.withColumn("_order", F.struct("page_id", "pos"))
    return distinct_first(rows, F.col("text"), "_order", *within).drop("_order")


def links(pages: DataFrame, part: str = "/", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, pos, link of same-site links with ``part`` in them, each once a page by its canonical form."""

    def read(i, base, page):
        rows, site = [], urlsplit(base or "").netloc
        for n, href in enumerate(read_page(page).links):
            if href.startswith(("#", "mailto:", "javascript:")):
                continue
            try:
                link = urljoin(base or "", href)
                if urlsplit(link).netloc == site and part in link:
                    rows.append((i, n, link))
            except ValueError:
                continue
        return rows

    found = _rows_of(pages, [page_id, url, html], "page_id long, pos int, link string", read)
    return distinct_first(found, canonical_url(F.col("link")), "pos", "page_id")


def chapter_verses(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, pos, text of verses: what follows a numbered verse span, up to the next."""

    read = lambda i, page: [(i, n, t) for n, t in enumerate(read_page(page).verses)]
    return _rows_of(pages, [page_id, html], "page_id long, pos int, text string", read)
