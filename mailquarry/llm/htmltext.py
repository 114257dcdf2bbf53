"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one line per block element, inline markup joins without a gap, and end tags that HTML lets
out are supplied. Lines of menus, headers, footers, sidebars, notices, adverts, forms, comments and hidden elements have
no text of their own and so split the distribution. Elements that are told by a class name, an id or a role alone, forms and asides
keep their lines if they hold most of the page's text and no article stands beside them. The text lengths are summed over windows of ``WINDOW`` lines; a
surge point is where the sum rises over the threshold, a dive point where it falls to zero again. The main text reaches from
the first surge to the last dive and, across gaps, on to the next menu or the end of the page. If article or main elements
hold the larger part of this range, it is narrowed to them; an article that it touches is taken whole.

Character references are decoded, white space inside a block becomes one blank, blocks are joined by one blank. Null and
empty pages have an empty text; pages without a surge are taken whole; pages cut off in the middle of a tag lose this tag.
Ties and repeated rows have no influence, other columns are ignored, pages are read whole, in a time that follows their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
THRESHOLD = 80              # characters outside links in a window
LINK_SHARE = 0.5            # lines with more of their text in links are menus
TEXTS = "page_id long, url string, text string"
_BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title head option optgroup select textarea button".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_DROPPED = frozenset("nav footer head title script style noscript iframe template svg canvas object select option button textarea input label menu audio video map math".split())
_DOUBTFUL = frozenset("aside form fieldset dialog".split())              # dropped unless they hold most of the text
_MARKS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer sidebar aside widget related recommended cookie cookies consent gdpr "
                   "notice notices notification notifications alert banner ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
                   "comment comments disqus respond replies newsletter subscribe signup login search share sharing social popup modal overlay "
                   "main-nav site-nav top-nav nav-menu nav-bar site-menu main-menu site-footer page-footer side-bar left-sidebar right-sidebar "
                   "cookie-banner cookie-notice cookie-consent cookie-bar site-ad ad-banner banner-ad ad-container ad-slot ad-unit ad-box google-ad text-ad "
                   "social-share share-buttons related-posts related-articles comment-list comments-area comment-section newsletter-signup".split())
_HEAD_MARKS = frozenset("header masthead topbar site-header page-header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar".split())
# A quote opens a string only behind an equals sign; a tag whose string never ends is over at the next bracket.
_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*+(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]*+))*+)>"""
                    r"""|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_CELLS = frozenset(("td", "th"))
_SCOPES = frozenset(("td", "th", "caption", "table"))                     # end tags of other elements don't reach beyond
# Start tags that end open elements: those, and where the search for them stops.
_ENDS = {"li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
         "td": (_CELLS, frozenset(("tr", "table"))), "th": (_CELLS, frozenset(("tr", "table"))), "tr": (frozenset(("tr",)), frozenset(("table",))),
         **{x: (frozenset(("thead", "tbody", "tfoot")), frozenset(("table",))) for x in ("thead", "tbody", "tfoot")},
         "option": (frozenset(("option",)), frozenset(("select",))), "optgroup": (frozenset(("optgroup", "option")), frozenset(("select",)))}
KEPT, DOUBTFUL, DROPPED = range(3)


def judged(name: str, attributes: str, inside: bool) -> int:
    """Whether an element belongs to the text; ``inside`` tells that it stands in an article."""
    if name in _DROPPED or name == "header" and not inside:
        return DROPPED
    if name in ("html", "body"):
        return KEPT
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    if "hidden" in found or _HIDDEN.search(found.get("style", "")):
        return DROPPED
    marks = {*found.get("class", "").lower().split(), *found.get("id", "").lower().split()}
    if name in _DOUBTFUL or marks & _MARKS or not inside and marks & _HEAD_MARKS or found.get("role", "").lower() in _ROLES:
        return DOUBTFUL
    return KEPT


@dataclass
class Line:
    """A line of a page: text, characters in links, number of its article (0: none) and of the doubtful elements around it."""

    text: str
    linked: int = 0
    article: int = 0
    doubtful: tuple[int, ...] = ()


@dataclass
class _Open:
    """An open element; ``gate`` is what it does to the text in it."""

    name: str
    gate: int
    article: bool


class _Page:
    """Lines of a page, collected tag by tag."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.stack: list[_Open] = []
        self.count: Counter[str] = Counter()
        self.dropped = self.links = self.inside = self.articles = self.numbers = 0
        self.doubtful: tuple[int, ...] = ()
        self.parts: list[str] = []
        self.linked = 0

    def add(self, part: str) -> None:
        if part and not self.dropped:
            self.parts.append(part)
            self.linked += len(part) if self.links else 0

    def end_line(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.lines.append(Line(text, self.linked, self.articles if self.inside else 0, self.doubtful))
            self.parts, self.linked = [], 0

    def gap(self) -> None:
        """Dropped markup: a line without text."""
        if self.lines and self.lines[-1].text:
            self.lines.append(Line(""))

    def pop(self) -> None:
        top = self.stack.pop()
        self.count[top.name] -= 1
        self.dropped -= top.gate == DROPPED
        self.links -= top.name == "a"
        self.inside -= top.article
        if top.gate == DOUBTFUL:
            self.doubtful = self.doubtful[:-1]

    def _end(self, names: frozenset[str], stop: frozenset[str]) -> None:
        """Closes the innermost of these elements that stands before a stop."""
        if not any(self.count[x] for x in names):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k].name in stop:
                return

    def start(self, name: str, attributes: str) -> bool:
        """Opens an element; tells whether it is dropped."""
        if name in _BLOCKS and name != "br":
            self._end(frozenset(("p",)), _SCOPES)
        if name in _ENDS:
            self._end(*_ENDS[name])
        gate = judged(name, attributes, self.inside > 0)
        if gate != KEPT and not self.dropped:
            if name in _BLOCKS or name in _RAW:
                self.end_line()
            if gate == DROPPED or name in _BLOCKS:
                self.gap()
        if name in _VOID or name in _RAW or not (name in _BLOCKS or name == "a" or gate == DROPPED):
            return gate == DROPPED
        if gate == DOUBTFUL:
            self.numbers += 1
            self.doubtful = (*self.doubtful, self.numbers)
        article = name in ("article", "main") and gate != DROPPED
        if article and not self.inside:
            self.articles += 1
        self.stack.append(_Open(name, gate, article))
        self.count[name] += 1
        self.dropped += gate == DROPPED
        self.links += name == "a"
        self.inside += article
        return gate == DROPPED

    def end(self, name: str) -> None:
        if not self.count[name]:
            return
        if name in _BLOCKS:
            self._end(frozenset((name,)), _SCOPES - {name} if name not in ("tr", "tbody", "thead", "tfoot", "table") else frozenset(("table",)) - {name})
        elif self.stack[-1].name == name:
            self.pop()
        else:                                            # inline: what was opened later stays open
            self._end(frozenset((name,)), _BLOCKS)


def lines(page: str) -> list[Line]:
    """The lines of a page, gaps included."""
    out = _Page()
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        out.add(page[at:m.start() if m else end])
        if not m:
            break
        at, name = m.end(), (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name in _BLOCKS and not out.dropped:
            out.end_line()
        if m["close"] or m["close2"]:
            out.end(name)
            continue
        attributes = m["attrs"] or ""
        out.start(name, attributes)
        if name in _RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
    if not out.dropped:
        out.end_line()
    return _settled(out.lines)


def _settled(found: list[Line]) -> list[Line]:
    """Gaps in place of doubtful elements, but for those that hold most of the text; beside an article they hold it only with an article in them."""
    size: Counter[int] = Counter()
    for line in found:
        for number in line.doubtful:
            size[number] += len(line.text)
    total = sum(len(line.text) for line in found)
    main = {number for number, n in size.items() if 2 * n > total}
    if any(line.article and not line.doubtful for line in found):
        main &= {number for line in found if line.article for number in line.doubtful}
    return [line if main.issuperset(line.doubtful) else Line("") for line in found]


def between(sizes: list[int], threshold: int, window: int = WINDOW) -> list[bool]:
    """Marks of the lines between surge and dive points."""
    n = len(sizes)
    sums = [sum(sizes[i:i + window]) for i in range(n)]
    keep, i = [False] * n, 0
    while i < n:
        if sizes[i] and sums[i] >= threshold:            # surge
            while i < n and (sizes[i] or sums[i] >= threshold):
                keep[i] = True
                i += 1                                   # up to the dive
        else:
            i += 1
    return keep


def outer(keep: list[bool], menus: list[bool]) -> list[bool]:
    """The range from the first to the last marked line, widened on both sides up to a menu."""
    first, last = keep.index(True), len(keep) - 1 - keep[::-1].index(True)
    while first and not menus[first - 1]:
        first -= 1
    while last + 1 < len(keep) and not menus[last + 1]:
        last += 1
    return [first <= i <= last for i in range(len(keep))]


def main_text(page: str) -> str:
    found = lines(page)
    menus = [not x.article and x.linked > LINK_SHARE * len(x.text) for x in found]
    sizes = [max(0, len(x.text) - x.linked) if menu else len(x.text) for x, menu in zip(found, menus, strict=True)]
    keep = between(sizes, THRESHOLD)
    keep = outer(keep, menus) if any(keep) else [True] * len(sizes)      # short pages without a surge
    reached = [(x, s) for x, s, k in zip(found, sizes, keep, strict=True) if k]
    if 2 * sum(s for x, s in reached if x.article) >= sum(s for _, s in reached) > 0:
        articles = {x.article for x, _ in reached if x.article}
        return " ".join(x.text for x in found if x.article in articles and x.text)
    return " ".join(x.text for x, s in reached if s)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row with columns page_id, url and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = [main_text(p) for p in pc.fill_null(part.column("html"), "").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, TEXTS)
