"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title select canvas audio video noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp nobr".split()
)
ASIDE = frozenset("head nav footer aside form button dialog menu fieldset".split())
#: Asides that may also be put around a whole page.
WRAPPERS = frozenset("form fieldset".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl td th article section div main body html".split())

#: Classes, ids and roles (whole ones) that are evidence against main text; _OUTER only where no article holds the
#: element, and only _COMMENTS on an article and the elements that hold the page.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus gdpr login menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pagination pager popup promo promoted promotion recommended related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags toolbar trending widget complementary contentinfo dialog alert form".split()
)
_OUTER = frozenset("header footer masthead top bottom".split())
_COMMENTS = frozenset("comment comments commentlist".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^<>\"']*+(?:(?:\"[^\"<>]*+\"|'[^'<>]*+')[^<>\"']*+)*+)>")
#: Tags whose quoted values hold < or > are scanned from quote to quote; those that never end so end at the first >.
_NAME, _STOP = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)"), re.compile(r"[>\"']")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：\"'()]")
_CUT = re.compile(r"<[a-zA-Z][^>]*$")

#: What the scores of paths below an element that speaks against main text are multiplied by.
EVIDENCE = 0.1
#: Elements whose class is part of the path.
_CLASSED = frozenset("div section ul ol table form aside header footer".split())


def _aside(tag: str, inside: bool) -> bool:
    return tag in ASIDE and tag not in WRAPPERS or (tag == "header" and not inside)


def _named(tag: str, attrs: str, inside: bool) -> bool:
    """Whether its name, or tag, makes an element an aside unless it holds most of the page's text."""
    if tag in WRAPPERS:
        return True
    if not attrs:
        return False
    names = {x for m in _NAMED.finditer(attrs) for x in (m[1] or m[2] or m[3] or "").lower().split()}
    if tag in ("html", "body", "main", "article"):
        return not names.isdisjoint(_COMMENTS)
    return not names.isdisjoint(_NAMES) or (not inside and not names.isdisjoint(_OUTER))


def _tag_end(html: str, at: int, dead: set[int]) -> int:
    """The place of the > outside quotes that ends a tag whose name ends at `at`; -1 without one.

    dead: places of opening quotes from which no such > follows, so that a page's failing scans open each quote once.
    """
    opened = []
    while (m := _STOP.search(html, at)) and m[0] != ">":
        opened.append(m.start())
        at = -1 if m.start() in dead else html.find(m[0], m.end())
        if at < 0:
            break
        at += 1
    if at >= 0 and m:
        return m.start()
    dead.update(opened)
    return -1


@dataclass
class Page:
    """A page's elements in the order in which they open, and its blocks of text.

    parent, last (the last element opened inside), path, article and main (the outermost one around, or itself; -1
    without one) are by element; `doubt` has the elements that speak against main text, True where the element still
    may be the frame of the page. blocks are (element, text, characters in links), in page order.
    """

    parent: list[int] = field(default_factory=lambda: [-1])
    last: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    article: list[int] = field(default_factory=lambda: [-1])
    main: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: [""])
    doubt: dict[int, bool] = field(default_factory=dict)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


class _Tree:
    """Open elements. Places by tag let every tag open or close in constant time for each element that it closes."""

    def __init__(self) -> None:
        self.page, self.open = Page(), [0]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []
        self.wide: list[int] = []  # scopes but cells
        self.paths: dict[tuple[int, str], int] = {}

    def _close_from(self, place: int) -> None:
        for i in range(len(self.open) - 1, place - 1, -1):
            node = self.open.pop()
            self.page.last[node] = len(self.page.parent) - 1
            self.at[self.page.tags[node]].pop()
            for held in (self.scopes, self.wide):
                if held and held[-1] == i:
                    held.pop()

    def close(self, tag: str) -> None:
        if self.at[tag]:
            self._close_from(self.at[tag][-1])

    def start(self, tag: str, attrs: str) -> None:
        shut = ("p",) if tag in CLOSES_P else OWN_KIND.get(tag, ())
        place = max((self.at[t][-1] for t in shut if self.at[t]), default=0)
        fence = self.wide if tag in ("tr", "td", "th") else self.scopes
        # an element that is a scope itself can be closed, but not through another scope
        if place and (not fence or fence[-1] <= place):
            self._close_from(place)
        page, up, node = self.page, self.open[-1], len(self.page.parent)
        page.parent.append(up)
        page.last.append(node)
        page.tags.append(tag)
        named = _CLASS.search(attrs) if attrs and tag in _CLASSED else None
        label = f"{tag}.{(named[1] or named[2] or named[3] or '').lower()}" if named else tag
        page.path.append(self.paths.setdefault((page.path[up], label), len(self.paths) + 1))
        inside = page.article[up] >= 0
        if _aside(tag, inside):
            page.doubt[node] = False
        elif _named(tag, attrs, inside):
            page.doubt[node] = True
        for outer, kind in ((page.article, "article"), (page.main, "main")):
            outer.append(node if outer[up] < 0 and tag == kind else outer[up])
        self.at[tag].append(len(self.open))
        if tag in SCOPES:
            self.scopes.append(len(self.open))
            if tag not in ("td", "th"):
                self.wide.append(len(self.open))
        self.open.append(node)


def parse(html: str) -> Page:
    """A page's elements and blocks, in one pass. Character references are decoded, and runs of white space are one space.

    Text of scripts, styles and other elements without running text is left out, and so are blocks without text.
    """
    tree = _Tree()
    text: list[str] = []
    links, in_link = 0, False
    at, n, dead = 0, len(html), set()
    no_end: set[str] = set()  # raw elements that nothing closes from here on

    def flush() -> None:
        nonlocal links
        if text:
            clean = " ".join(unescape("".join(text)).split())
            if clean:
                tree.page.blocks.append((tree.open[-1], clean, links))
            text.clear()
        links = 0

    while at < n:
        cut = html.find("<", at)
        if cut < 0:
            cut = n
        if cut > at:
            text.append(html[at:cut])
            links += cut - at if in_link else 0
            at = cut
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        m, end = _TAG.match(html, at), -1
        if m:
            end = m.end() - 1
        elif m := _NAME.match(html, at):
            end = _tag_end(html, m.end(), dead)
            if end < 0:
                m = _LOOSE.match(html, at)
                end = m.end() - 1 if m else -1
        if not m:
            if html.startswith(("<!", "<?", "</"), at):  # declarations, or an end tag without a name
                end = html.find(">", at)
                at = n if end < 0 else end + 1
            elif _CUT.match(html, at):  # a tag that the page's end cuts off
                at = n
            else:
                text.append("<")
                at += 1
            continue
        at = end + 1
        closing, tag, attrs = m[1], m[2].lower(), html[m.end(2) : end]
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                end = None if tag in no_end else re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(html, at)
                if end is None:
                    no_end.add(tag)
                at = n if not end else html.find(">", end.start()) + 1 or n
        elif tag == "hr":
            flush()
        elif tag in VOID:
            text.append(" " if tag == "br" else "")
        elif tag in INLINE:
            if tag == "a":
                in_link = not closing
        else:
            flush()
            if closing:
                in_link = False
                tree.close(tag)
            else:
                tree.start(tag, attrs)
    flush()
    tree._close_from(1)
    tree.page.last[0] = len(tree.page.parent) - 1
    return tree.page


def weights(page: Page) -> list[float]:
    """For each element what its blocks' scores are multiplied by: EVIDENCE for each element around that speaks against it.

    An element that does so by its name alone, or as a form, does not if it holds more than half of the page's text
    outside the other elements that do.
    """
    sure = [False] * len(page.parent)
    for node in range(1, len(sure)):
        sure[node] = sure[page.parent[node]] or page.doubt.get(node) is False
    size = [0] * (len(sure) + 1)
    for node, text, _ in page.blocks:
        size[node + 1] += 0 if sure[node] else len(text)
    for i in range(1, len(size)):
        size[i] += size[i - 1]
    out = [1.0] * len(sure)
    for node in range(1, len(out)):
        doubt = page.doubt.get(node)
        frame = doubt and 2 * (size[page.last[node] + 1] - size[node]) > size[-1]
        out[node] = out[page.parent[node]] * (1.0 if doubt is None or frame else EVIDENCE)
    return out


def path_scores(page: Page) -> dict[int, float]:
    """Each tag path's score: the root of its smoothed text ratio times its smoothed punctuation ratio, less for links.

    The ratios are a path's characters and punctuation marks for each of its nodes; smoothing over the blocks in page
    order gives a path a part of its neighbours' ratios.
    """
    size, marks, nodes, linked = (defaultdict(int) for _ in range(4))
    paths = [page.path[node] for node, *_ in page.blocks]
    for path, (_, text, links) in zip(paths, page.blocks, strict=True):
        size[path] += len(text)
        marks[path] += len(_PUNCT.findall(text))
        nodes[path] += 1
        linked[path] += min(links, len(text))

    def smooth(x: list[float]) -> list[float]:
        wide = [x[0], *x, x[-1]]
        return [(wide[i] + 2 * wide[i + 1] + wide[i + 2]) / 4 for i in range(len(x))]

    sums: dict[int, float] = defaultdict(float)
    if paths:
        for path, a, b in zip(paths, smooth([size[p] / nodes[p] for p in paths]), smooth([marks[p] / nodes[p] for p in paths]), strict=True):
            sums[path] += (a * (1 + b)) ** 0.5
    return {p: s / nodes[p] * (1 - linked[p] / size[p]) * nodes[p] ** 0.5 for p, s in sums.items()}


def _roots(page: Page, chosen: list[tuple[int, str, int]]) -> tuple[list[int], set[int]]:
    """(outermost elements by element, those of them that are content roots).

    The roots are the articles, else the main elements, that hold the greater part of the chosen text. Where the
    articles hold less, and no main element has text, those that hold every h1 of the page still count: the page names
    them its subject. Else it is the deepest element around all chosen blocks, which is its own outermost one.
    """
    total = sum(len(text) for _, text, _ in chosen)
    for outer in (page.article, page.main):
        within = [(outer[node], len(text)) for node, text, _ in chosen]
        if 2 * sum(n for at, n in within if at >= 0) > total:
            return outer, {at for at, _ in within if at >= 0}
        if outer is page.article and all(page.main[node] < 0 for node, *_ in page.blocks):
            titled = {outer[i] for i, tag in enumerate(page.tags) if tag == "h1"}
            if titled and -1 not in titled:
                return outer, titled | {at for at, _ in within if at >= 0}
    low, high = min(x[0] for x in chosen), max(x[0] for x in chosen)
    root = low
    while page.last[root] < high:
        root = page.parent[root]
    if len(chosen) == 1 and root:
        root = page.parent[root]
    return [root if root <= i <= page.last[root] else -1 for i in range(len(page.parent))], {root}


def main_text(html: str | None, part: float = 0.5) -> str:
    """The page's main text: blocks joined by an empty line.

    Paths whose score, times the evidence against them (see weights), is `part` of the best one or more are content.
    Every block under the content roots (see _roots) is taken, so that short paragraphs and headings stay, but for
    those that evidence speaks against and whose own score does not make them content.
    """
    page = parse(html or "")
    if not page.blocks:
        return ""
    score, weight = path_scores(page), weights(page)
    worth = [score[page.path[node]] * weight[node] for node, *_ in page.blocks]
    least = part * max(worth)
    chosen = [x for x, w in zip(page.blocks, worth, strict=True) if w >= least and w > 0] or page.blocks
    outer, roots = _roots(page, chosen)
    kept = [text for (node, text, _), w in zip(page.blocks, worth, strict=True) if outer[node] in roots and (weight[node] == 1 or w >= least > 0)]
    return "\n\n".join(kept)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages; null and empty html give the empty text.

    n_chars counts code points. Rows with equal or null ids each get a row; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = rows.mapInArrow(_run, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
