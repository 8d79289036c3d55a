"""HTML extraction by template deduction over the pages of a host.

Pages are read as blocks of text below their elements. Over all pages of a host with
distinct contents every token - an element's path, an element at its place among its
siblings, or a text at a path - has an occurrence vector: how often it stands on each
page. Tokens of equal vectors are one equivalence class. A class on the share ``SPAN`` of
at least two pages is valid, that is part of the host's template, if it has ``MIN_CLASS``
tokens or stands on the share ``NEARLY`` of them. Valid classes lie inside one
another as the places of their elements do: the tree of these places is the template, and what
lies below a place and in no class is its slot. The text slot is found by going down the tree
from the page while one place holds the share ``MAIN_SHARE`` of the text outside
links; a place with a heading of its own is not left. Texts of valid classes are
template, paths whose text is mostly links are menus, and an element whose class only
sounds like something beside the text (``NAMED``) is so inside an article if its path
is one of the template's. Where a page has an article, elements break the tie: all of it
is the text slot but for elements, roles and whole class names that leave no doubt.

A vector is kept as its page count and two sums of hashes, so classes come from
aggregates that combine before the shuffle, and no host is gathered; a template
is no larger than a few pages. The stored templates are measured and broadcast
while they are small, so pages are not dealt by host; beyond, they meet by a join
whose hot hosts adaptive execution splits.

Defined cases: null html is empty and gives empty text; null urls are one host;
a host of one distinct page shows no repetition, so its template is empty; repeated pages
count once; unclosed and crossing elements end where their parents do. Columns beyond
the three that are read are not returned.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm.common import pieces, spread, stored, table
from lexmill.operators.common import broadcast_if_small

MOST_LINKS = 0.5
SPAN = 0.5
NEARLY = 0.9
MIN_CLASS = 2
MAIN_SHARE = 0.75
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "iframe", "template", "svg", "select"}
VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = set(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark noscript object q s samp small span strike strong sub sup time tt u var wbr "
    "math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
#: An element of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_P = INLINE | {"body", "html"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "label", "fieldset", "dialog", "menu", "head"}
NAMED = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted recommended related reply replies "
    "share sharing sidebar signup skip social sponsor sponsored sponsoring subscribe subscription teaser toolbar topbar widget".split()
)
#: Class names that leave no doubt, taken whole; inside an article only these count by themselves.
CERTAIN = set("ad ads advert adverts advertisement advertising breadcrumbs comment comments cookie-banner cookie-notice navbar navigation newsletter pagination sidebar sponsored".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that may hold a whole text; a text slot is one of these.
HOLDERS = {"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td"}


class Place:
    """An element at its place: its token, its parent's place and whether it holds a heading."""

    __slots__ = ("token", "parent", "path", "shape", "seen")

    def __init__(self, path: str, parent: Place | None, holder: bool):
        self.path, self.parent = path, parent
        self.token = _token("place", path) if parent else 0
        self.shape = int(holder)  # 0 a piece of text, 1 may hold a text, 2 with a heading of its own
        self.seen: Counter = Counter()

    def below(self, label: str, holder: bool) -> Place:
        self.seen[label] += 1
        return Place(f"{self.path}/{label}:{self.seen[label]}", self, holder)


class Block:
    """Text of one block, its path, and what holds it."""

    __slots__ = ("path", "parts", "linked", "aside", "main", "doubts", "place")

    def __init__(self, path: str, aside: bool, main: bool, doubts: tuple[int, ...], place: Place):
        self.path, self.aside, self.main, self.doubts, self.place = path, aside, main, doubts, place
        self.parts: list[str] = []
        self.linked = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())

    def within(self, token: int) -> bool:
        at: Place | None = self.place
        while at is not None and at.token != token:
            at = at.parent
        return at is not None


def _named(attributes: str) -> tuple[str, bool, bool]:
    """Class and id of a tag, whether it surely stands beside the text, and whether its names sound so."""
    label, certain, sounds = "", False, False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "role":
            certain |= value.lower() in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            certain = True
        elif name in ("class", "id"):
            label += "." + value
            certain |= any(w in CERTAIN for w in value.lower().split())
            sounds |= any(w in NAMED for w in re.split(r"[^a-z]+", re.sub("(?<=[a-z])(?=[A-Z])", " ", value).lower()))
    return label, certain, sounds


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order; scripts, styles and comments left out."""
    out: list[Block] = []
    # (element, path, beside the text, inside the article, inside a link, paths that sound beside the text, place)
    stack: list[tuple[str, str, bool, bool, bool, tuple[int, ...], Place]] = [("", "", False, False, False, (), Place("", None, True))]
    now: Block | None = None
    at = 0

    def add(raw: str) -> None:
        nonlocal now
        if not raw:
            return
        _, path, aside, main, link, doubts, place = stack[-1]
        if now is None or now.path != path or now.aside != aside:
            now = Block(path, aside, main, doubts, place)
            out.append(now)
        text = entities.unescape(raw)
        now.parts.append(text)
        if link:
            now.linked += len(text)

    def close(name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                del stack[i:]
                return

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name not in INLINE:
                now = None
            close(name)
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}[\\s>]", re.I).search(page, at)
            at = end.start() if end else size
            if end:
                at = page.find(">", at) + 1 or size
            continue
        if name == "br":
            if now is not None:
                now.parts.append("\n")
            continue
        if name not in INLINE:
            now = None
            if name not in KEEPS_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ENDS.get(name, ()):
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "div"):
                    break
        if name in VOID or m[3].rstrip().endswith("/") and name in ("svg", "path"):
            continue
        _, path, aside, main, link, doubts, place = stack[-1]
        if name in INLINE:
            stack.append((name, path, aside or (name == "noscript" and not main), main, link or name == "a", doubts, place))
            continue
        label, certain, sounds = _named(m[3]) if m[3] else ("", False, False)
        here = f"{path}/{name}{label}"
        beside = certain or name in ASIDE
        if sounds and main:
            doubts = (*doubts, _token("path", here))
        else:
            beside |= sounds
        if name in HEADINGS:
            if main and any(s[0] == "header" for s in stack) and not any(s[2] and s[0] != "header" for s in stack):
                aside = beside = False  # the article's own headline
            place.shape = max(place.shape, 2 * (place.shape > 0))
        beside &= name not in ("html", "body") and name not in MAIN
        stack.append((name, here, aside or beside, main or name in MAIN, link, doubts, place.below(name + label, name in HOLDERS)))
    return [b for b in out if b.text()]


def _token(kind: str, path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{kind}\0{path}\0{text}") - (1 << 63)


TOKENS = pa.schema([("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64()), ("parent", pa.int64()), ("shape", pa.int32())])


def page_tokens(page: str) -> dict[tuple[int, int], list[int]]:
    """(kind, token) -> n, chars, linked, parent, shape: paths are 1, texts at a path 2, places 3.

    A path and a place count for every element above a block. Chars of a place leave out what stands beside the text.
    """
    found: dict[tuple[int, int], list[int]] = {}
    for b in blocks(page):
        text = b.text()
        size, linked = len(text), min(b.linked, len(text))
        for key in ((1, _token("path", b.path)), (2, _token("text", b.path, text))):
            row = found.setdefault(key, [0, 0, 0, 0, 0])
            row[0], row[1], row[2] = row[0] + 1, row[1] + size, row[2] + linked
        for token in b.doubts:  # the element itself, if its text lies in elements below it
            found.setdefault((1, token), [1, 0, 0, 0, 0])
        at = b.place
        while at.parent is not None:
            row = found.setdefault((3, at.token), [1, 0, 0, at.parent.token, at.shape])
            if not b.aside:
                row[1], row[2] = row[1] + size, row[2] + linked
            at = at.parent
    return found


def _tokens(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of every page; token 0 stands once on each."""
    for part in pieces(parts, 2):
        rows: list[tuple] = []
        for host, page, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
            rows.append((host, page, 0, 0, 1, 0, 0, 0, 0))
            rows += [(host, page, token, kind, *row) for (kind, token), row in page_tokens(html or "").items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), TOKENS, strict=True)], schema=TOKENS)


def host_column(url):
    """Host of a url in lower case; empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _distinct(pages: DataFrame) -> DataFrame:
    """(host, key, html) of the distinct contents of each host; only contents that repeat are moved."""
    marked = pages.select("host", F.xxhash64(F.coalesce("html", F.lit(""))).alias("key"), "html")
    repeated = broadcast_if_small(stored(marked.groupBy("host", "key").count().where("count > 1")))
    both = marked.join(repeated, ["host", "key"], "left")
    once = both.where("count is null").select("host", "key", "html")
    return once.unionAll(both.where("count is not null").select("host", "key", "html").dropDuplicates(["host", "key"]))


def text_slot(places: list[tuple[int, int, int, int]]) -> int:
    """Place of the text in a template's tree of (token, parent, chars outside links, shape); 0 is the whole page."""
    below: dict[int, list[tuple[int, int, int]]] = {}
    for token, parent, chars, shape in places:
        below.setdefault(parent, []).append((chars, -token, shape))
    at, total = 0, sum(chars for chars, _, _ in below.get(0, ()))
    while below.get(at):
        chars, token, shape = max(below[at])
        if not shape or not chars or chars < MAIN_SHARE * total:
            break
        at, total = -token, chars
        if shape == 2:
            break
    return at


def _slots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        slots = [text_slot([tuple(p.values()) for p in places]) for places in part.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(slots, pa.int64())], names=["host", "fixed", "menus", "placed", "slot"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, fixed, menus, placed, slot): tokens of texts that are part of the template, of paths that hold links, of all its
    paths, and the place of its text slot.

    ``pages`` has host and html.
    """
    kinds = "host string, page long, token long, kind int, n long, chars long, linked long, parent long, shape int"
    tokens = _distinct(pages).mapInArrow(_tokens, kinds)
    part = [F.pmod(F.xxhash64(*c), F.lit(1 << 31)) for c in (("page", "n"), ("n", "page"))]
    sums = [F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.max("parent").alias("parent"), F.max("shape").alias("shape")]
    vectors = tokens.groupBy("host", "kind", "token").agg(F.count("*").alias("pages"), F.sum(part[0]).alias("s1"), F.sum(part[1]).alias("s2"), *sums)
    vectors = stored(vectors.where("pages > 1"))
    roots = vectors.where("kind = 0").select("host", F.col("pages").alias("all"))
    known = stored(vectors.where("kind > 0").join(broadcast_if_small(roots), "host").where(F.col("pages") >= SPAN * F.col("all")))
    classes = known.groupBy("host", "pages", "s1", "s2").agg(F.count("*").alias("size")).where(F.col("size") >= MIN_CLASS)
    known = known.join(broadcast_if_small(stored(classes)), ["host", "pages", "s1", "s2"], "left")
    valid = F.col("size").isNotNull() | (F.col("pages") >= NEARLY * F.col("all"))
    menu = F.col("linked") > MOST_LINKS * F.col("chars")
    place = F.struct("token", "parent", (F.col("chars") - F.col("linked")).alias("chars"), "shape")
    trees = known.where(valid).groupBy("host").agg(
        F.collect_list(F.when(F.col("kind") == 2, F.col("token"))).alias("fixed"),
        F.collect_list(F.when((F.col("kind") == 1) & menu, F.col("token"))).alias("menus"),
        F.collect_list(F.when(F.col("kind") == 1, F.col("token"))).alias("placed"),
        F.collect_list(F.when(F.col("kind") == 3, place)).alias("places"),
    )
    lists = "fixed array<long>, menus array<long>, placed array<long>"
    return trees.mapInArrow(_slots, f"host string, {lists}, slot long")


def main_text(page: str, fixed: set[int], menus: set[int], placed: set[int] = frozenset(), slot: int = 0) -> str:
    """Slots of a page that hold its text."""
    found = [b for b in blocks(page) if not b.aside and placed.isdisjoint(b.doubts)]
    kept = [b for b in found if b.main]
    if not kept:
        kept = [b for b in found if _token("path", b.path) not in menus and _token("text", b.path, b.text()) not in fixed]
        kept = [b for b in kept if b.within(slot)] or kept
    return "\n\n".join(b.text() for b in kept)


def _extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(parts, 2):
        rows = zip(*(part.column(i).to_pylist() for i in range(2, 7)), strict=True)
        texts = [main_text(html or "", set(fixed or ()), set(menus or ()), set(placed or ()), slot or 0) for html, fixed, menus, placed, slot in rows]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def html_extraction(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    kind = dict(pages.dtypes)[id_col]
    source = spread(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))).withColumn("host", host_column(F.col("url")))
    known = broadcast_if_small(stored(templates(source)))
    joined = source.join(known, "host", "left").select("page_id", "url", "html", "fixed", "menus", "placed", "slot")
    out = joined.mapInArrow(_extract, f"page_id {kind}, url string, text string")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op3_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html_extraction(table(spark, sf, "pages"))
