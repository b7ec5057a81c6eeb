"""Main text of HTML pages: structure first, then substrings that a host repeats.

Elements that hold no article (menus, headers, footers, forms, adverts, comments, ...) are known by tag, role, class or
id. A page with an article or main element keeps that element's blocks, another page the blocks outside marked elements
that are not mostly links. What is kept is one token stream a page. Hosts are cut into units of UNIT pages or so. A
unit's streams are concatenated and their suffixes sorted; neighbours with WINDOW tokens in common are runs of one
substring, and runs from enough distinct pages name the substrings that may be boilerplate. What reaches a share of a
host's pages reaches it in one of the host's units at least, so nothing is missed; what units name is then counted over
all pages of the host. Sentences whose tokens are all covered by repeated substrings go, as whole sentences only. Articles
have a guard: more articles must repeat what is taken from them, and what repeats elsewhere on pages is no evidence.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import HOT_SHARE, attach_groups, cut, map_texts
from textloom.llm.suffix import suffix_ranks

#: Tokens of a repeated substring at least (a shorter block counts as a whole, outside articles); share of a block's characters in links at most.
WINDOW, LINK_SHARE = 8, 0.6
#: Distinct pages of a host that repeat a substring at least, as a number and in percent; the same within articles, where only articles count.
LEAST_PAGES, LEAST_PERCENT = 3, 30
ARTICLE_PAGES, ARTICLE_PERCENT = 4, 50
#: Pages that are searched for candidates together.
UNIT = 64

_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "select", "button", "canvas", "title", "xmp"}
_OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "fieldset"}
_BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | _OUTSIDE
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"}
#: Words of class and id values that mark elements outside the article.
_MARKS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar", "side", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "comment", "comments", "disqus", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "skip", "hidden"}
#: Of these, words that tell of an article or main element after the first that it is none. No word of _MARKS tells anything after one of _LAYOUT ("no-comments", "has-sidebar").
_ASIDES = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "comment", "comments", "disqus", "related", "recommended", "hidden"}
_LAYOUT = {"no", "without", "has", "with"}
#: Parts of class and id values that say nothing beside a mark: "ad-slot", "site-header", "comments-list" are marked, "side-effects" and "related-work" aren't.
_PLAIN = {"area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "col", "column", "component", "container", "content", "css", "div", "element", "global", "group", "id", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "module", "outer", "page", "panel", "placeholder", "policy", "post", "posts", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "stories", "thread", "top", "unit", "wrap", "wrapper", "zone"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold blocks.
_HOLDERS = {"article", "aside", "center", "details", "div", "dl", "figure", "main", "ol", "section", "table", "tbody", "td", "tr", "ul"}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PARTS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
#: Start tags that end an open paragraph, and for items the tags that they end and those beyond which they don't look.
_ENDS_P = _BLOCKS - {"html", "body", "head", "caption", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
_ITEMS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}),
}
_P_SCOPE = {"table", "td", "th", "caption", "html"}


def _names(value: str, marks: set[str]) -> bool:
    """Whether a word of a class or id value marks an element: all of its parts are marks or plain parts, one is a mark."""
    for word in value.split():
        parts = _PARTS.findall(_CAMEL.sub(r"\1 \2", word).lower())
        if not marks.isdisjoint(parts) and _LAYOUT.isdisjoint(parts) and all(x in marks or x in _MARKS or x in _PLAIN or x.isdigit() for x in parts):
            return True
    return False


def _marked(tag: str, attrs: str, marks: set[str]) -> bool:
    """Whether a class, or the id of an element that holds blocks, marks the element; headings never are: their ids tell of their text."""
    if tag in _HEADINGS:
        return False
    return any(_names("".join(values), marks) for name, *values in _ATTR.findall(attrs) if name.lower() == "class" or tag in _HOLDERS and name.lower() == "id")


def _is_outside(tag: str, attrs: str) -> int:
    """0 if the element may hold an article; 1 if a class or id says otherwise; 2 if its tag or role does."""
    if tag in _OUTSIDE:
        return 2
    if tag in ("html", "body") or not attrs:
        return 0
    if any(n == "hidden" or n == "role" and v in _ROLES for n, v in ((n.lower(), "".join(v).lower()) for n, *v in _ATTR.findall(attrs))):
        return 2
    return int(_marked(tag, attrs, _MARKS))


def _is_main(tag: str, attrs: str) -> bool:
    return tag in ("article", "main") or "role" in attrs and any(n.lower() == "role" and "".join(v).lower() == "main" for n, *v in _ATTR.findall(attrs))


def _is_hidden(attrs: str) -> bool:
    return "hidden" in attrs and any(name.lower() == "hidden" for name, *_ in _ATTR.findall(attrs))


def parse(page: str) -> tuple[list[str], list[tuple[str, float, bool]], bool]:
    """(blocks of the main element, other blocks with their share of link text and whether marked as outside, has a main element).

    Open elements are a stack; end tags that HTML implies (of paragraphs, list items, table cells) are supplied, so an
    unclosed element ends where its parent or the next of its kind does. The first article or main element counts even
    within an element that a class marks as outside, as wrappers do; within a menu, footer or the like none does.
    """
    main: list[str] = []
    other: list[tuple[str, float, bool]] = []
    parts: list[str] = []
    # Of each open element: its tag, and whether its parent was outside (0, 1, 2) and in a main element.
    stack: list[tuple[str, int, bool]] = []
    links = at = outside = 0
    in_link = in_main = seen_main = False
    end_of_page = len(page)

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                if in_main and not outside:
                    main.append(text)
                else:
                    other.append((text, links / len(text), bool(outside)))
            parts.clear()
        links = 0

    def close(n: int) -> None:
        """Pops elements down to the n-th."""
        nonlocal outside, in_main
        if any(x[0] in _BLOCKS for x in stack[n:]) or (stack[n][1], stack[n][2]) != (outside, in_main):
            flush()
        _, outside, in_main = stack[n]
        del stack[n:]

    def find(tags: set[str], until: set[str]) -> int:
        """Place of the outermost open element of tags above the last of until; -1 if none."""
        found = -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in until:
                break
            if stack[i][0] in tags:
                found = i
        return found

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text = html_lib.unescape(page[at : m.start()])
            parts.append(text)
            if in_link:
                links += len(text)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closes, attrs = tag.lower(), bool(m[1]), m[3]
        if tag in _RAW:
            if not closes and not attrs.endswith("/"):
                found = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = found.end() if found else end_of_page
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = not closes
        if tag in _BLOCKS:
            flush()
        if tag in _VOID:
            continue
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in _BLOCKS and stack[i][0] in _BLOCKS:
                    break  # an inline end tag ends no block
            continue
        if tag in _ENDS_P and (i := find({"p"}, _P_SCOPE)) >= 0:
            close(i)
        if tag in _ITEMS and (i := find(*_ITEMS[tag])) >= 0:
            close(i)
        if attrs.endswith("/") and tag not in _BLOCKS:
            continue
        parent = (tag, outside, in_main)
        if _is_main(tag, attrs):
            if not _is_hidden(attrs) and not (seen_main and _marked(tag, attrs, _ASIDES)) and outside < (1 if seen_main else 2):
                flush()
                outside, in_main, seen_main = 0, True, True
            elif not outside:
                flush()
                outside = 1
        elif not outside and (found := _is_outside(tag, attrs)):
            flush()
            outside = found
        elif outside == 1 and _is_outside(tag, attrs) == 2:
            outside = 2
        stack.append(parent)
    if at < end_of_page:
        parts.append(html_lib.unescape(page[at:]))
    flush()
    return main, other, seen_main


_BASES = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


class _Fingerprints:
    """64-bit fingerprints of token windows: sums of token hashes by powers of an odd number, so the same in all tasks."""

    def __init__(self, most: int = 1 << 18) -> None:
        self.of: dict[str, int] = {}
        self.most = most

    def hashes(self, tokens: list[str]) -> np.ndarray:
        of = self.of
        if len(of) > self.most:
            of.clear()
        for t in set(tokens).difference(of):
            of[t] = xxhash.xxh3_64_intdigest(t)
        return np.fromiter(map(of.__getitem__, tokens), np.uint64, len(tokens))

    def suffixes(self, tokens: list[str]) -> np.ndarray:
        """Of each suffix's first WINDOW tokens; none of shorter streams."""
        h, n = self.hashes(tokens), len(tokens) - WINDOW + 1
        return sum((h[k : k + n] * _BASES[k] for k in range(WINDOW)), np.zeros(n, np.uint64)) if n > 0 else np.zeros(0, np.uint64)

    def whole(self, tokens: list[str]) -> np.ndarray:
        """Of a block below WINDOW tokens, in an array of one; it differs from that of any window."""
        return (self.hashes(tokens) * _BASES[: len(tokens)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(tokens))

    def page(self, kept: list[str], other: list[str]) -> np.ndarray:
        """Distinct fingerprints of a page: of the stream of kept blocks, of each other block, of short blocks as a whole."""
        parts = [self.suffixes(" ".join(kept).split(" "))]
        for block in other:
            parts.append(self.suffixes(block.split(" ")))
        parts += [self.whole(t) for b in (*kept, *other) if len(t := b.split(" ")) < WINDOW]
        return np.unique(np.concatenate(parts))


def _pages(unit: dict) -> list[tuple[list[str], list[str]]]:
    """(kept blocks, other blocks) of each page of a unit."""
    lines = zstandard.ZstdDecompressor().decompress(unit["blocks"]).decode("utf-8", "surrogatepass").split("\n") if unit["blocks"] else []
    out, at = [], 0
    for kept, rest in zip(unit["n_kept"], unit["n_rest"], strict=True):
        out.append((lines[at : at + kept], lines[at + kept : at + kept + rest]))
        at += kept + rest
    return out


def _compress(lines: list[str], level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress("\n".join(lines).encode("utf-8", "surrogatepass"))


def _streams():
    """Pages' kept and other blocks, of no line feeds; key: a hash of both."""

    def run(texts):
        rows = []
        for page in texts:
            main, other, has_main = parse(page)
            keeps = [not has_main and not marked and share <= LINK_SHARE for _, share, marked in other]
            kept = main if has_main else [t for (t, *_), k in zip(other, keeps, strict=True) if k]
            rest = [t for (t, *_), k in zip(other, keeps, strict=True) if not k]
            key = xxhash.xxh3_64_intdigest("\n".join([*kept, "", *rest]).encode("utf-8", "surrogatepass")) - (1 << 63)
            rows.append(([len(kept)], [len(rest)], _compress([*kept, *rest]), has_main, key))
        return list(zip(*rows, strict=True))

    return run


def _repeated_in_unit(pages: list[tuple[list[str], list[str]]], least: float) -> np.ndarray:
    """Fingerprints of substrings of WINDOW tokens, and of shorter blocks, that ``least`` of the pages have.

    A suffix array of the concatenated streams: its neighbours with WINDOW tokens in common form runs.
    """
    prints, number, short = _Fingerprints(), {}, Counter()
    symbols, owner = [], []
    for i, (kept, other) in enumerate(pages):
        for stream in (" ".join(kept), *other):
            symbols += [number.setdefault(t, len(number) + 2) for t in stream.split(" ")]
            symbols.append(1)  # ends a stream
            owner += [i] * (len(symbols) - len(owner))
        short.update({int(prints.whole(t)[0]) for b in (*kept, *other) if len(t := b.split(" ")) < WINDOW})
    found = [h for h, n in short.items() if n >= least]
    if len(symbols) >= WINDOW:
        stream, owner = np.array(symbols), np.array(owner)
        windows = np.lib.stride_tricks.sliding_window_view(stream, WINDOW)
        places = np.flatnonzero((windows > 1).all(axis=1))
        places = places[np.argsort(suffix_ranks(stream, WINDOW)[places], kind="stable")]
        runs = np.cumsum((windows[places[1:]] != windows[places[:-1]]).any(axis=1)) if len(places) else np.zeros(0, np.int64)
        runs = np.concatenate([np.zeros(min(1, len(places)), np.int64), runs])
        pairs = np.unique(runs * len(pages) + owner[places]) // len(pages)
        run, n = np.unique(pairs, return_counts=True)
        first = places[np.searchsorted(runs, run[n >= least])]
        tokens = list(number)
        found += [int(prints.suffixes([tokens[x - 2] for x in windows[p]])[0]) for p in first.tolist()]
    return np.array(found, np.uint64).view(np.int64)


UNITS = "host string, page_ids array<long>, urls array<string>, has_main array<boolean>, leads array<boolean>, n_kept array<int>, n_rest array<int>, blocks binary, n_pages long, candidates array<long>"


def _unit(table):
    """A unit's pages in one row; of equal ones the first leads, copies that another unit has don't."""
    import pyarrow as pa

    rows = table.to_pylist()
    seen, leads, lines = set(), [], []
    for r in rows:
        leads.append(not r["copy"] and r["key"] not in seen)
        seen.add(r["key"])
    pages = [_pages(r)[0] for r in rows]
    for kept, rest in pages:
        lines += [*kept, *rest]
    own = [p for p, lead in zip(pages, leads, strict=True) if lead]
    least = max(LEAST_PERCENT * len(own) / 100, LEAST_PAGES if rows[0]["single"] else 1)
    out = {
        "host": [rows[0]["host"]],
        "page_ids": [[r["page_id"] for r in rows]],
        "urls": [[r["url"] for r in rows]],
        "has_main": [[r["has_main"] for r in rows]],
        "leads": [leads],
        "n_kept": [[len(kept) for kept, _ in pages]],
        "n_rest": [[len(rest) for _, rest in pages]],
        "blocks": [_compress(lines, 7) if lines else None],
        "n_pages": [len(own)],
        "candidates": [_repeated_in_unit(own, least).tolist() if own else []],
    }
    kinds = {"page_ids": pa.list_(pa.int64()), "has_main": pa.list_(pa.bool_()), "leads": pa.list_(pa.bool_()), "n_kept": pa.list_(pa.int32()), "n_rest": pa.list_(pa.int32()), "blocks": pa.binary(), "n_pages": pa.int64(), "candidates": pa.list_(pa.int64())}
    return pa.table({k: pa.array(v, kinds.get(k, pa.list_(pa.string()) if k == "urls" else pa.string())) for k, v in out.items()})


def _counted(batches):
    """Pages of a task that hold each candidate of their host, and those that hold it in what they keep."""
    prints, found = _Fingerprints(), Counter()
    for batch in batches:
        for unit in batch.to_pylist():
            candidates = np.array(unit["candidates"], np.int64)
            for (kept, rest), lead in zip(_pages(unit), unit["leads"], strict=True):
                if lead:
                    held = np.intersect1d(prints.page(kept, rest).view(np.int64), candidates)
                    found.update((unit["host"], h, False) for h in held.tolist())
                    own = np.intersect1d(prints.page(kept, []).view(np.int64), held) if kept else held[:0]
                    found.update((unit["host"], h, True) for h in own.tolist())
        if len(found) > 1 << 18:
            yield _flat(found)
            found.clear()
    if found:
        yield _flat(found)


def _flat(found: Counter):
    import pyarrow as pa

    columns = [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64())]
    columns += [pa.array([n * (k[2] == own) for k, n in found.items()], pa.int64()) for own in (False, True)]
    return pa.RecordBatch.from_arrays(columns, ["host", "h", "n", "n_kept"])


_SENTENCE_END = re.compile(r"[.!?…։。！？][\"'”’)\]»]*$")


def _unique_runs(blocks: list[str], repeated: np.ndarray, has_main: bool, prints: _Fingerprints) -> list[str]:
    """The blocks without the sentences that repeated suffixes cover from end to end; a block that ends without a mark ends a sentence."""
    tokens = [b.split(" ") for b in blocks]
    suffixes = prints.suffixes([t for ts in tokens for t in ts]).view(np.int64)
    covers = np.zeros(sum(map(len, tokens)) + 1, np.int64)
    starts = np.flatnonzero(np.isin(suffixes, repeated))
    np.add.at(covers, starts, 1)
    np.add.at(covers, starts + WINDOW, -1)
    unique, kept, at = np.cumsum(covers) == 0, [], 0
    for ts in tokens:
        own, left, first = unique[at : at + len(ts)], [], 0
        at += len(ts)
        if not has_main and len(ts) < WINDOW and prints.whole(ts).view(np.int64)[0] in repeated:
            continue
        if own.all():
            kept.append(" ".join(ts))
            continue
        for i, t in enumerate(ts, 1):
            if i == len(ts) or _SENTENCE_END.search(t):
                if own[first:i].any():
                    left += ts[first:i]
                first = i
        if left:
            kept.append(" ".join(left))
    return kept


def _texts(batches):
    import pyarrow as pa

    prints = _Fingerprints()
    for batch in batches:
        for unit in batch.to_pylist():
            repeated = {main: np.array(unit["in_articles" if main else "elsewhere"] or [], np.int64) for main in (True, False)}
            texts = []
            for (blocks, _), has_main in zip(_pages(unit), unit["has_main"], strict=True):
                if blocks and len(repeated[has_main]):
                    blocks = _unique_runs(blocks, repeated[has_main], has_main, prints)
                texts.append("\n\n".join(blocks))
            arrays = [pa.array(unit["page_ids"], pa.int64()), pa.array(unit["urls"], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text (blocks joined by blank lines; empty if none), n_chars of every row.

    Null and empty pages have an empty text; a page with a null or relative url has a host of its own; pages of equal
    blocks are one page of their host; null page ids stay null; other columns are ignored.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    )
    fields = "n_kept array<int>, n_rest array<int>, blocks binary, has_main boolean, key long"
    hosted, lone = (map_texts(rows.where(f"host IS {kind}NULL"), _streams, fields, text="html") for kind in ("NOT ", ""))
    sizes = cut(rows.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n")), "html-hosts")
    # Copies of one page, if these are many, are dealt over the host's units, as only the first counts: below HOT_SHARE keys.
    # Pages are read once for this and once for units, which takes less than to write all blocks in between.
    n_rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    copied = hosted.groupBy("host", "key").agg(F.count("*").alias("n_copies"), F.min("page_id").alias("first")).where((F.col("n_copies") > UNIT) & (F.col("n_copies") * HOT_SHARE > n_rows))
    sized = attach_groups(hosted, sizes, "host", F.xxhash64("page_id", "url"), "n").join(F.broadcast(copied.select("host", "key", "n_copies", "first")), ["host", "key"], "left")
    n_units = F.ceil(F.col("n") / UNIT)
    copy = F.col("n_copies").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    dealt = sized.withColumns({"copy": copy, "salt": F.pmod(F.when(copy, F.xxhash64("page_id", "url")).otherwise(F.col("key")), n_units), "single": n_units == 1})
    units = dealt.select("host", "salt", "page_id", "url", "n_kept", "n_rest", "blocks", "has_main", "key", "copy", "single").groupBy("host", "salt").applyInArrow(_unit, UNITS)
    units = cut(units, "html-units")

    asked = units.select("host", F.explode("candidates").alias("h")).groupBy("host").agg(F.collect_set("h").alias("candidates"))
    asked = cut(asked.join(sizes, "host"), "html-candidates")
    spread = F.xxhash64("blocks")
    leads = attach_groups(units.select("host", "leads", "n_kept", "n_rest", "blocks"), asked, "host", spread, "n").where("candidates IS NOT NULL").drop("n")
    counts = leads.mapInArrow(_counted, "host string, h long, n long, n_kept long").groupBy("host", "h").agg(F.sum("n").alias("held"), F.sum("n_kept").alias("held_kept"))
    pages_of = units.groupBy("host").agg(F.sum("n_pages").alias("n_pages"))
    percent = 100 * F.col("held")
    of = counts.join(pages_of, "host").where((F.col("held") >= LEAST_PAGES) & (percent >= LEAST_PERCENT * F.col("n_pages")))
    guarded = (F.col("held_kept") >= ARTICLE_PAGES) & (100 * F.col("held_kept") >= ARTICLE_PERCENT * F.col("n_pages"))
    lists = of.groupBy("host").agg(F.collect_list(F.when(guarded, F.col("h"))).alias("in_articles"), F.collect_list("h").alias("elsewhere"))
    lists = cut(lists.join(sizes, "host"), "html-repeated")
    marked = attach_groups(units.select("host", "page_ids", "urls", "has_main", "n_kept", "n_rest", "blocks"), lists, "host", spread, "n").drop("n")
    none = F.lit(None).cast("array<long>")
    lone = lone.select("host", F.array("page_id").alias("page_ids"), F.array("url").alias("urls"), F.array("has_main").alias("has_main"), "n_kept", "n_rest", "blocks", none.alias("in_articles"), none.alias("elsewhere"))
    return marked.unionByName(lone).mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
