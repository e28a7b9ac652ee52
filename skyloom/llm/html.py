"""Main text of web pages: site templates go by subtree hashes counted per host, other boilerplate by kind.

A page is parsed into elements (open tags end where HTML lets them be left out; scripts, styles and comments hold
no text). Each block element has a hash of its subtree (tag, class, texts and child hashes; of a menu, footer or the like
the source). Hashes are counted per host over all pages, in the main part and around it; one that occurs on SHARE of a
host's pages and on MIN_PAGES of them or more is template, and goes. Inside <article> and <main>, pages of one main
text count as one page, and headings and plain paragraphs (no class or id, no block element within) do not go for being
repeated, since sites do publish the same paragraph twice.

What is boilerplate on few pages only is told by kind: elements that are menus, footers, sidebars, notices, adverts,
forms, reader comments and the like by tag, role or class go; a class or id must be a listed name as a whole. Names are
not looked at on headings, on <main>, on paragraphs of the main part, and on what holds the page's <main> or <article>
that has fewest named elements around it (articles in lists of comments or of other articles are not the page's). The
main part is all that is in <article> or <main>, or the whole body of a page without them. n_template counts a page's
elements that are templates, n_listed those that only their kind tells.

Text breaks into blocks at block elements and <br>. Character references are decoded, white space in a block becomes
one space, empty blocks vanish, blocks are joined by one line feed. Null or empty html gives empty text; broken or
truncated markup is read as far as it goes; pages without a host are compared with none. Null ids are rows like others;
repeated rows stay repeated (and count for the shares, but for copies inside <article> and <main>); an empty table gives
no rows; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, valid

SHARE, MIN_PAGES = 0.5, 5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "select"}
_GONE = {"head", "nav", "footer", "aside", "form", "button", "select", "template", "svg", "dialog", "menu", "object", "canvas", "audio", "video", "map"}
_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "respond", "share", "social", "related", "widget", "pagination"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
_MAIN = ("article", "main")
#: Names of lists of comments and other articles, whose articles are not the page's own.
_LISTS = {"comment", "comments", "respond", "related"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class _Element:
    __slots__ = ("tag", "name", "gone", "named", "main", "parent", "kids", "value", "plain", "span")

    def __init__(self, tag: str, name: str, gone: bool, named: int, parent: _Element | None) -> None:
        self.tag, self.name, self.gone, self.named, self.parent = tag, name, gone, named, parent
        self.main = tag if tag in _MAIN else parent.main if parent else ""
        self.kids: list[str | _Element] = []
        self.value = 0
        self.span: list[int] = []  # of the source of what is gone by its tag or role
        self.plain = not name.strip()  # neither class or id nor, as far as read, a block element within


def _gone(tag: str, attributes: str, inside: str) -> tuple[bool, int, str]:
    """Whether an element is boilerplate by its kind, whether it is by its name (2: a list of comments or articles),
    unless it holds the main part, and its class and id."""
    if tag in _GONE or tag == "header" and not inside:
        return True, 0, ""
    if not attributes or tag in ("html", "body", "main"):
        return False, 0, ""
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
    if not found:
        return False, 0, ""
    name = f"{found.get('class', '')} {found.get('id', '')}".lower()
    if tag != "article" and found.get("role", "").lower() in _ROLES:
        return True, 0, name
    if tag in _HEADINGS or tag == "p" and inside:
        return False, 0, name
    parts = set(name.split())
    named = 2 if parts & _LISTS else int(bool(parts & _NAMES) or (not inside and "header" in parts))
    return False, named, name


def _settle(seen: list[_Element], html: str) -> None:
    """Spare what holds the page's main part, drop other elements with listed names, and hash the subtrees."""
    within: list[tuple[int, _Element]] = []
    for e in seen:
        if e.tag in _MAIN:
            around, up = 0, e
            while up is not None and (up.named < 2 or e.tag == "main"):
                around += up.named > 0
                up = up.parent
            if up is None:
                within.append((around, e))
    fewest = min((n for n, _ in within), default=0)
    for n, e in within if fewest else ():
        up = e if n == fewest else None
        while up is not None:
            up.named = 0
            up = up.parent
    for e in seen:
        e.gone = e.gone or e.named > 0 or e.parent.gone
    for e in reversed(seen):
        digest = xxhash.xxh64(f"{e.tag} {e.name}")
        if e.span:
            digest.update(" ".join(html[slice(*e.span)].split()))
        for kid in e.kids:
            # what goes by its kind doesn't tell what holds it apart from others
            own = not isinstance(kid, str) and kid.gone and not e.gone
            digest.update(kid if isinstance(kid, str) else f"\0{kid.tag}" if own else kid.value.to_bytes(8, "little", signed=True))
        e.value = digest.intdigest() - (1 << 63)


def parse(html: str) -> tuple[list[tuple[str, _Element]], list[_Element]]:
    """Blocks of text outside boilerplate, each with its element, and the elements but those in ones gone by tag or role."""
    root = _Element("", "", False, 0, None)
    top, seen, blocks, held, owner = root, [], [], [], root
    end, at = len(html), 0

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((text, owner))
                e = owner
                while e.tag not in _BLOCK and e.parent is not None:  # an inline element may have ended already
                    e = e.parent
                e.kids.append(text)

    def close(upto: _Element) -> None:
        nonlocal top
        while top is not upto.parent:
            if top.span:
                top.span[1] = at
            if top.named:
                flush()
            if held and top.tag in _BLOCK:
                top.kids.append("".join(held))
            top = top.parent

    while at < end:
        m = _TOKEN.search(html, at)
        if m is None or m.start() > at:
            if not top.gone:
                if not held:
                    owner = top
                held.append(html[at : m.start() if m else end])
            if m is None:
                break
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0] == "<" and not top.gone:
                if not held:
                    owner = top
                held.append("&lt;")
            continue
        tag = tag.lower()
        if tag in _BLOCK or tag == "br":
            flush()
        elif tag in ("td", "th") and held:
            held.append(" ")
        if m[1]:
            e = top
            while e.parent is not None and e.tag != tag:
                if tag not in _BLOCK and e.tag in _SCOPE:  # a stray end tag of an inline element ends nothing outside
                    e = root
                    break
                e = e.parent
            if e.parent is not None:
                close(e)
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\b", re.I).search(html, at)
            at = stop.start() if stop else end
            if stop:
                at = html.find(">", at) + 1 or end
            continue
        if tag in _VOID:
            continue
        if tag in _BLOCK:
            e = top
            while e.parent is not None and e.tag not in _SCOPE:
                if e.tag == "p":
                    close(e)
                    break
                e = e.parent
        if tag in _CLOSES:
            e = top
            while e.parent is not None and e.tag not in (_SCOPE if tag not in ("td", "th", "tr") else {"table"}):
                if e.tag in _CLOSES[tag]:
                    close(e)
                    e = top
                    continue
                e = e.parent
        if m[3].endswith("/") and tag not in _BLOCK:
            continue
        gone, named, name = (True, 0, "") if top.gone else _gone(tag, m[3], top.main)
        if (gone or named) and not top.gone:
            flush()
        if tag in _BLOCK:
            e = top
            while e is not None and e.plain:
                e.plain = False
                e = e.parent
        around, top = top, _Element(tag, name, gone, named, top)
        if gone:
            top.span = [m.start(), end]
        if not around.gone:
            seen.append(top)
            around.kids.append(top)
    flush()
    _settle(seen, html)
    return [(text, e) for text, e in blocks if not e.gone], seen


def main_blocks(html: str) -> tuple[list[tuple[str, list[int]]], list[int], list[int], int | None]:
    """Blocks of the main part, each with the hashes of the subtrees it is in; all hashes where repetition may tell a
    template; those of elements that are gone by their kind; and the hash of the main text if it is in <article> or <main>."""
    blocks, seen = parse(html)
    whole = None
    if any(e.main and not e.gone for e in seen):
        blocks = [(text, e) for text, e in blocks if e.main]
        whole = xxhash.xxh64("\n".join(text for text, _ in blocks)).intdigest() - (1 << 63)
    counted = {e.value for e in seen if _counted(e)}
    listed = {e.value for e in seen if e.gone and not e.parent.gone and _counted(e)}
    return [(text, _path(e)) for text, e in blocks], sorted(counted), sorted(listed), whole


def _counted(e: _Element) -> bool:
    """Whether an element may be a template: an inline one may not, as its block goes on after it."""
    if e.tag not in _BLOCK or e.tag in ("html", "body", *_MAIN):
        return False
    return e.gone or not (e.main and (e.plain or e.tag in _HEADINGS))


def _path(e: _Element | None) -> list[int]:
    out = []
    while e is not None:
        if _counted(e):
            out.append(e.value)
        e = e.parent
    return out


def extract(pages: DataFrame, *, share: float = SHARE, min_pages: int = MIN_PAGES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_template, n_listed) of every row of pages."""
    kind = pages.schema[id_column].dataType.simpleString()
    host = F.lower(F.regexp_extract(url_column, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.when(host != "", host).alias("host"), valid(html_column).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [main_blocks(h.as_py() or "") for h in part.column(3)]
                blocks = pa.array([[{"text": t, "path": p} for t, p in f[0]] for f in found], pa.list_(pa.struct([("text", pa.string()), ("path", pa.list_(pa.int64()))])))
                hashes, listed = (pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (1, 2))
                wholes = pa.array([f[3] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], blocks, hashes, listed, wholes], names=["page_id", "url", "host", "blocks", "hashes", "listed", "whole"])

    parsed = rows.mapInArrow(run, f"page_id {kind}, url string, host string, blocks array<struct<text: string, path: array<long>>>, hashes array<long>, listed array<long>, whole long")
    parsed = saved(parsed, "parsed", rows=1000)
    hosted = parsed.where("host is not null")
    # copies of a main text count once, which sums of pages by text give without any set of them
    alike = F.when(F.col("whole").isNull(), F.col("n")).otherwise(1)
    sizes = hosted.groupBy("host", "whole").agg(F.count("*").alias("n")).groupBy("host").agg(F.sum(alike).alias("pages"))
    found = hosted.select("host", "whole", F.explode("hashes").alias("hash")).groupBy("host", "hash", "whole").agg(F.count("*").alias("n"))
    counts = found.groupBy("host", "hash").agg(F.sum(alike).alias("n"))
    repeated = counts.where(F.col("n") >= min_pages).join(sizes, "host").where(F.col("n") >= share * F.col("pages"))
    # at most 1 / share times the elements of the host's mean page; a table of its own, so that Spark can split the pages of a host
    templates = saved(repeated.groupBy("host").agg(F.collect_list("hash").alias("template")), "templates")
    none = F.array().cast("array<bigint>")
    kept = parsed.join(templates, "host", "left").withColumn("template", F.coalesce("template", none))
    lines = F.transform(F.filter("blocks", lambda b: ~F.coalesce(F.arrays_overlap(b["path"], "template"), F.lit(False))), lambda b: b["text"])
    return kept.select(
        "page_id",
        "url",
        F.array_join(lines, "\n").alias("text"),
        F.size(F.array_intersect("hashes", "template")).cast("long").alias("n_template"),
        F.size(F.array_except("listed", "template")).cast("long").alias("n_listed"),
    )
