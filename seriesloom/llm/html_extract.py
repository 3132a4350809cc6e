"""Main-text extraction from raw pages with removal of site templates.

A page is parsed once into blocks of text. Every block-level element is hashed bottom-up from its tag
and content, whatever it is called, and covers a run of blocks; a subtree of links alone is hashed
without their labels and number, so that menus recur though their entries differ. Spark counts the subtrees of
each host over pages with distinct main text, and those that recur across many of them are deleted.
What elements and roles declare as navigation, forms and the like goes next, then what class names
suggest, unless it holds most of the text left. Of the rest the article is given.

Shared paragraphs are an article's own text: inside articles, ``main`` and elements whose class names
content, single paragraphs are no candidates, and containers must recur on half of the pages. An
element that contains an article is none.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm._store import Scratch

# Element names and role words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
MUTE = frozenset("script style noscript template iframe object embed svg canvas audio video map head title button select textarea xmp noembed noframes".split())
REGIONS = frozenset("nav aside footer form menu dialog".split())
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr caption figure figcaption address hr header footer nav aside form fieldset details summary center hgroup menu dialog".split()
)
CONTAINERS = frozenset("section div ul ol dl table figure details header fieldset center address".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr caption figcaption summary blockquote pre thead tbody tfoot hgroup".split())
ROOTS = frozenset("article main".split())
REGION_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CONTENT_WORDS = frozenset("content article post entry story main".split())
# Words of class names and ids. Those of the second line suggest little unless all names of the element are known.
STRONG_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsored promo cookie cookies consent gdpr popup modal newsletter sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs masthead footer related recommended pagination".split())
WEAK_WORDS = frozenset("sponsor promotion banner notice notices overlay subscribe signup share sharing social widget widgets toolbar pager login search".split())
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies".split())
KIND_WORDS = frozenset("bar box button buttons link links list form icons wrapper container section area block slot unit thread panel message inner outer top bottom left right".split())

MIN_PAGES = 5
MIN_SHARE = 0.25
MIN_SHARE_INSIDE = 0.5
MENU_LINKS = 3
STRONG, WEAK, COMMENT = 1, 2, 3
#: Rank of the title of a main element, which stays beside its article. Ranks in declared regions are lower by HARD.
TITLE, HARD = 4, 8
#: How many times the text of an article or main element must stand outside of it to be the page's text, and of another named content.
OUTSIDE, BESIDE = 4, 2

_OTHER = r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
_TAG = re.compile(_OTHER + r"""((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
_BARE_TAG = re.compile(_OTHER + r"([^>]*)>", re.S)
_HEAD = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z0-9]+")
_CLOSES_P = BLOCKS - {"html", "body"}
_ITEM = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
_P_SCOPE = ("td", "th", "li", "article", "main", "body", "div", "section")
_INLINE_SCOPE = ("td", "th", "table", "article", "main", "body")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _names(attributes: dict[str, str]) -> list[list[str]]:
    """The parts of each class name and id."""
    return [p for p in (_PART.findall(x) for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()) if p]


def _means(parts: list[str], words: frozenset[str]) -> bool:
    """Whether a name says one of ``words``: as its last part, or first before a word for a kind of box."""
    if parts[0] in ("has", "with", "no", "without", "is"):
        return False
    return parts[-1] in words or (parts[0] in words and all(x in KIND_WORDS or x.isdigit() for x in parts[1:]))


def suggestion(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """What class names and the id suggest of an element that may be no content; 0 for nothing."""
    if tag not in CONTAINERS and tag not in ("p", "li", "article"):
        return 0
    names = _names(attributes)
    if any(_means(p, COMMENT_WORDS) for p in names):
        return COMMENT
    if tag == "article":
        return 0
    if any(_means(p, STRONG_WORDS) for p in names):
        return STRONG
    if any(_means(p, WEAK_WORDS) for p in names) and not (inside and tag in ("p", "li")):
        return WEAK if all(_means(p, WEAK_WORDS | KIND_WORDS) for p in names) else -WEAK
    return 0


class _Open:
    __slots__ = ("tag", "hard", "mute", "root", "first", "mark", "parts", "shape", "links", "plain", "holds_root")

    def __init__(self, tag: str, hard: bool, mute: bool, root: int, first: int, mark: int):
        self.tag, self.hard, self.mute, self.root, self.first, self.mark = tag, hard, mute, root, first, mark
        self.parts: list[str] = []
        self.shape: list[str] = []
        self.links, self.plain, self.holds_root = 0, False, tag in ROOTS


class Page:
    """Blocks of a page and what covers them.

    ``texts``, ``ranks`` (3 in an article, 2 in main, 4 in the title of main, 1 in an element named content,
    else 0; less 8 in declared regions), ``subtrees`` as (first block, after last, hash), and ``marks`` as (first, after
    last, suggestion), outer ones before inner ones.
    """

    def __init__(self):
        self.texts: list[str] = []
        self.ranks: list[int] = []
        self.subtrees: list[tuple[int, int, int]] = []
        self.marks: list[tuple[int, int, int]] = []


def parse_page(html: str) -> Page:
    """Parse in one pass; time and size are linear in the page whatever its nesting."""
    page = Page()
    stack = [_Open("", False, False, 0, 0, 0)]
    open_at: dict[str, list[int]] = {}
    pieces: list[str] = []
    pos, size = 0, len(html)

    def last(*tags: str) -> int:
        return max((at[-1] for tag in tags if (at := open_at.get(tag))), default=0)

    def flush():
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                page.texts.append(text)
                page.ranks.append(stack[-1].root - HARD * stack[-1].hard)

    def close(to: int):
        while len(stack) > to:
            top = stack[-1]
            if top.tag in BLOCKS:
                flush()
            stack.pop()
            open_at[top.tag].pop()
            above = stack[-1]
            above.holds_root |= top.holds_root
            if top.mute:
                continue
            if top.tag in ("wbr", "br") or not (top.parts or top.shape):
                continue
            digest = xxhash.xxh64_hexdigest(f"{top.tag}\0" + "\0".join(top.parts))
            shape = xxhash.xxh64_hexdigest(f"{top.tag}\0" + "\0".join(top.shape))
            above.parts.append(digest)
            if above.shape[-1:] != [shape]:  # a run of equal entries is one, so that menus may differ in length
                above.shape.append(shape)
            above.links += top.links + (top.tag == "a")
            above.plain |= top.plain and top.tag != "a"
            if top.tag not in BLOCKS or top.tag in ("html", "body"):
                continue
            lo, hi = top.first, len(page.texts)
            if lo == hi:
                continue
            menu = not top.plain and top.links >= MENU_LINKS
            inside = top.root > 0 and not top.hard
            if not top.holds_root and not (inside and top.tag in LEAVES) and not (page.subtrees and page.subtrees[-1][:2] == (lo, hi)):
                value = int(shape if menu else digest, 16) - (1 << 63)
                page.subtrees.append((lo, hi, (value & ~1) | inside))
            if top.mark > 0 or (top.mark < 0 and not top.plain):
                page.marks.append((lo, hi, abs(top.mark)))

    def add(text: str):
        top = stack[-1]
        if not text or top.mute:
            return
        pieces.append(text)
        word = " ".join(text.split())
        if word:
            top.parts.append(word)
            top.plain = True

    tags = _TAG
    while pos < size:
        at = html.find("<", pos)
        if at < 0:
            add(html[pos:])
            break
        m = tags.match(html, at)
        if not m and _HEAD.match(html, at):
            # a quote never ends: from here on tags end at the next sign, so that no text is searched through twice
            tags = _BARE_TAG
            m = tags.match(html, at)
            if not m:
                add(html[pos:])
                break
        if not m:
            add(html[pos : at + 1])
            pos = at + 1
            continue
        add(html[pos:at])
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                add(" ")
            at = last(tag)
            if at and (tag in BLOCKS or last(*_INLINE_SCOPE) <= at):
                close(at)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            pos = end.end() if end else size
            continue
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            elif tag in ("br", "wbr", "img", "input"):
                add("" if tag == "wbr" else " ")
            continue
        if tag in _CLOSES_P and (at := last("p")) > last(*_P_SCOPE):
            close(at)
        if tag in _ITEM and (at := last(*_SAME.get(tag, (tag,)))) > last(*_ITEM[tag]):
            close(at)
        if tag in BLOCKS:
            flush()
        elif tag in ("td", "th"):
            add(" ")
        if m[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        top = stack[-1]
        attributes = _attributes(m[3]) if m[3].strip() else {}
        root = top.root
        mark = suggestion(tag, attributes, top.root > 0) if attributes else 0
        if tag in ROOTS and mark != COMMENT:
            root = 3 if tag == "article" or root == 3 else 2
        elif root == 0 and attributes and tag in CONTAINERS and any(not CONTENT_WORDS.isdisjoint(p) for p in _names(attributes)):
            root = 1
        hidden = bool(attributes) and ("hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style", ""))))
        form = tag == "form" and root == 0  # one that holds most of the page is none
        declared = (tag in REGIONS and not form) or (tag == "header" and root == 0) or (bool(attributes) and tag not in ROOTS and attributes.get("role", "").strip().lower() in REGION_ROLES)
        mute = top.mute or tag in MUTE or hidden or (declared and tag not in BLOCKS)
        mark = 0 if mute else mark or STRONG * form
        if tag == "h1" and root == 2:
            root = TITLE
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(_Open(tag, top.hard or declared, mute, root, len(page.texts), mark))
    close(1)
    flush()
    page.marks.sort(key=lambda r: (r[0], -r[1]))
    return page


def main_blocks(texts: list[str], ranks: np.ndarray, subtrees: tuple[np.ndarray, ...], marks: list[tuple[int, int, int]], gone: np.ndarray) -> list[str]:
    """The blocks of the main text when the subtrees with a hash in ``gone`` are deleted."""
    n = len(texts)
    if not n:
        return []
    alive = np.ones(n, bool)
    if len(gone):
        lo, hi, value = subtrees
        hit = np.isin(value, gone)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, lo[hit], 1)
        np.add.at(step, hi[hit], -1)
        alive = np.cumsum(step[:n]) == 0
    alive &= ranks >= 0
    if marks:
        sizes = np.array([len(t) for t in texts]) * alive
        total, before = int(sizes.sum()), np.concatenate(([0], np.cumsum(sizes)))
        cut = np.zeros(n + 1, np.int64)
        done = 0
        for lo, hi, mark in marks:
            if lo < done:  # within one that goes
                continue
            inside = int(before[hi] - before[lo])
            if inside < total if mark == COMMENT else 2 * inside <= total:
                cut[lo] += 1
                cut[hi] -= 1
                done = hi
                total -= inside
        alive &= np.cumsum(cut[:n]) == 0
    if not alive.any():
        return []
    chosen = main_ranks({int(r): int(sum(len(texts[i]) for i in np.flatnonzero(alive & (ranks == r)))) for r in np.unique(ranks[alive])})
    return [texts[i] for i in np.flatnonzero(alive & np.isin(ranks, chosen))]


def main_ranks(held: dict[int, int]) -> list[int]:
    """Which ranks are the main text, by the characters that each of them holds.

    Articles win over the main element around them unless it holds more beside them, whose title stays
    either way; both win over other text unless that holds ``OUTSIDE`` times as much. An element named
    content wins over the rest unless that holds ``BESIDE`` times as much.
    """
    article, main, named, rest = (held.get(r, 0) for r in (3, 2, 1, 0))
    title = held.get(TITLE, 0)
    inside = article + main + title
    if inside and OUTSIDE * inside >= named + rest:
        if article >= main:
            return [3, TITLE]
        return [2, TITLE] if 2 * article < main else [2, 3, TITLE]
    if inside == named == 0 or rest > BESIDE * named:
        return [0, 1]
    return [1]


def _arrays(page: Page) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    cols = np.array(page.subtrees, np.int64).reshape(-1, 3)
    return np.array(page.ranks, np.int64), (cols[:, 0], cols[:, 1], cols[:, 2])


def page_text(html: str, gone: set[int] | frozenset[int] = frozenset()) -> str:
    """The main text of one page, with the subtrees in ``gone`` deleted."""
    page = parse_page(html)
    return "\n".join(main_blocks(page.texts, *_arrays(page), page.marks, np.array(sorted(gone), np.int64)))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


PARSED = "page_id long, url string, host string, page long, blocks string, ranks array<tinyint>, firsts array<int>, afters array<int>, subtrees array<long>, marks array<int>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parsed pages; ``page`` is a hash of the main text before any template is known."""
    none = np.zeros(0, np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            cols: list[list] = [[] for _ in range(8)]
            for url, html in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                page = parse_page(html or "")
                ranks, subtrees = _arrays(page)
                own = "\n".join(main_blocks(page.texts, ranks, subtrees, page.marks, none))
                row = (host_of(url), xxhash.xxh64_intdigest(own) - (1 << 63), "\n".join(page.texts), page.ranks, *subtrees, [x for mark in page.marks for x in mark])
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
            types = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                ["page_id", "url", "host", "page", "blocks", "ranks", "firsts", "afters", "subtrees", "marks"],
            )


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    for batch in batches:
        texts = []
        rest = [batch.column(i) for i in range(2, 8)]
        for blocks, ranks, firsts, afters, subtrees, marks, gone in zip(*(c.to_pylist() for c in rest), batch.column(8).to_pylist(), strict=True):
            found = tuple(np.array(x, np.int64) for x in (firsts, afters, subtrees))
            triples = list(zip(marks[::3], marks[1::3], marks[2::3], strict=True))
            texts.append("\n".join(main_blocks(blocks.split("\n") if blocks else [], np.array(ranks, np.int64), found, triples, none if gone is None else np.array(gone, np.int64))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def template_subtrees(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_share_inside: float = MIN_SHARE_INSIDE) -> DataFrame:
    """``host, subtree`` of the subtrees that recur: on ``min_pages`` pages of a host and a share of them.

    Pages of a host with equal main text count once, so that copies of an article do not make its parts
    a template. The share is ``min_share_inside`` for subtrees inside an article (odd hashes). Counts
    are exact. Pages without a host make no templates. A host has at most 1 / ``min_share`` times as
    many templates as its pages have subtrees on average.
    """
    known = parsed.where("host <> ''")
    pages = known.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    found = known.select("host", "page", F.explode(F.array_distinct("subtrees")).alias("subtree")).distinct()
    counted = found.groupBy("host", "subtree").agg(F.count("*").alias("on")).where(F.col("on") >= min_pages)
    share = F.when(F.col("subtree").bitwiseAND(1) == 1, min_share_inside).otherwise(min_share)
    return counted.join(pages, "host").where(F.col("on") >= F.col("pages") * share).select("host", "subtree")


def extract_main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row for each input row of ``pages(page_id, url, html)``: ``page_id, url, text, n_chars``.

    Blocks are in page order, joined by a line feed, each with its white space as single spaces and
    character references decoded. A null or empty html, or one without content, gives an empty text.
    A null or broken url has no host and no templates. Rows that repeat are kept; other columns are
    ignored. An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = scratch.table(rows.mapInArrow(_parse, PARSED), "parsed", "zstd")
    templates = template_subtrees(parsed, min_pages, min_share).groupBy("host").agg(F.collect_list("subtree").alias("gone"))
    # a row a host, written, so that Spark broadcasts it only if its size allows; a hot host's pages may be split
    templates = scratch.table(templates, "templates")
    joined = parsed.join(templates, "host", "left").select("page_id", "url", "blocks", "ranks", "firsts", "afters", "subtrees", "marks", "gone")
    return joined.mapInArrow(_finish, "page_id long, url string, text string, n_chars long")
