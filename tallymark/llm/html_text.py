"""Main text of web pages by tag-path ratios.

A page is cut into blocks: text between the edges of block elements.  Each block has a path,
the open elements from the root to it with their classes; inline elements are no part of it.
For every path text length, punctuation and link text are added up over its blocks, which
gives a length ratio and a punctuation ratio.  Ratios are smoothed with those of the paths
beside it (same parent, weighted by text), fused into one score, and set against the best score of
the page: paths below the threshold go.  Paths inside one ``article`` or ``main`` element are
smoothed as a family, so a heading or a short paragraph stands and falls with its article.
On a page without these elements the container that holds the best paths is the family, less its
links, and first headings belong to it, so lists, table cells and titles stay.
Elements that say they are no article (navigation, footer, aside, forms, adverts, notices,
comments, by tag, role or class) have ratio 0; one compound class such as ``long-form`` does not
say so of an element with most of the text of the page.
Formulas and text of drawings are part of their block.

Blocks of the paths that are left are joined by one line feed in page order; character
references are decoded and white space inside a block becomes one space.  Nothing is capped.

* null or empty html: empty text, ``n_chars`` 0; a null url stays null
* broken markup: end tags without start are passed over, unclosed elements end with their parents,
  an unclosed comment, script or tag takes the rest of the page
* repeated rows and equal ``page_id``s come out as often as they came; other columns are ignored
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallymark.llm.scratch import short_batches
from tallymark.llm.textscan import chunks

#: Share of the best path's score that a path needs.
THRESHOLD = 0.05
#: Weight of the paths with the same parent.
BESIDE = 0.15
#: What a path of an article has at least of the best score in that article.
FAMILY = 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes template canvas audio video select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset("nav footer aside form button menu dialog fieldset".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that hold a piece of a text, not the whole.
PIECES = frozenset("p ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address h1 h2 h3 h4 h5 h6 hgroup".split())
FOREIGN = frozenset(("svg", "math"))
#: Words in a class, id or role that mark what is no article.
MARKS = frozenset(
    """ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo
    cookie cookies copyright disclaimer discussion disqus dialog footer footnav form gdpr header login masthead menu modal nav navbar navigation
    newsletter notice notices notification pagination popup promo promotion recommended related replies reply respond search share
    sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets""".split()
)
#: Beside these a mark tells of the layout only, as in ``has-sidebar``.
LAYOUT = frozenset("has with without no content main page layout wrap wrapper container body article entry".split())
#: A start tag of the key ends an open element of the values, up to the element that bounds it.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|[\"'][^>]*+(?:>|\Z)|\Z)", re.S
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.S)
_UNSEEN = re.compile(r"<(annotation|annotation-xml|title|desc|metadata|style|script)(?=[\s/>])[^>]*(?<!/)>.*?</\1\s*>", re.I | re.S)
_POINTS = re.compile(r"[.,;:!?…¡¿،؛。，、！？；：]")
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _says_no(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The label of an element in a path, whether it says that it is no article, and whether a single compound name alone says so."""
    no = tag in NEVER or tag == "header"
    if not attributes or attributes.isspace():
        return tag, no, False
    label, marks = tag, []
    for name, a, b, c in _NAMED.findall(attributes):
        name, value = name.lower(), (a or b or c)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            no = True
        elif name != "aria-hidden" and value:
            label += "." + ".".join(value.split())
            if tag not in ("html", "body", "article", "main") or name != "class":
                marks += [x for x in value.split() if _marked(x)]
    if tag in ARTICLE and any(p in ("comment", "teaser", "reply", "related", "sponsored", "promo") for p in re.findall("[a-z]+", label.lower())):
        no = True
    if not no and len(marks) == 1 and marks[0].lower() not in MARKS:
        return label, False, True
    return label, no or bool(marks), False


def _marked(name: str) -> bool:
    parts = {p.lower() for p in _PARTS.findall(name)} | set(re.findall("[a-z]+", name.lower()))
    return bool(parts & MARKS) and not parts & LAYOUT


class _Paths:
    """Paths as numbered nodes of a tree; sums of text, points, link text and blocks at each."""

    def __init__(self):
        self.known: dict[tuple[int, str, bool, bool], int] = {}
        self.parent, self.tag, self.no, self.doubtful = [-1], [""], [False], [False]
        self.length, self.points, self.links, self.blocks = [0], [0], [0], [0]

    def child(self, parent: int, tag: str, label: str, no: bool, doubtful: bool) -> int:
        at = self.known.get((parent, label, no, doubtful))
        if at is None:
            at = self.known[(parent, label, no, doubtful)] = len(self.parent)
            for column, value in ((self.parent, parent), (self.tag, tag), (self.no, no), (self.doubtful, doubtful)):
                column.append(value)
            for sums in (self.length, self.points, self.links, self.blocks):
                sums.append(0)
        return at

    def _families(self) -> tuple[list[bool], list[int]]:
        """Whether a path is in no article for sure, and the article it is in; parents come before their children."""
        n = len(self.parent)
        within = [0] * n  # text but links, without what is surely no article
        for p in range(n - 1, -1, -1):
            within[p] = 0 if self.no[p] and self.tag[p] != "header" else within[p] + self.length[p] - self.links[p]
            if p:
                within[self.parent[p]] += within[p]
        off, family = [False] * n, [-1] * n
        for p in range(1, n):
            up = self.parent[p]
            no = self.no[p] or (self.doubtful[p] and 2 * within[p] <= within[0])
            off[p] = off[up] or (no and not (self.tag[p] == "header" and family[up] >= 0))
            family[p] = p if self.tag[p] in ARTICLE and not off[p] else family[up]
            if self.tag[p] == "noscript":
                family[p] = -1
        return off, family

    def _container(self, used: list[int], score: dict[int, float]) -> list[int]:
        """Of ``used`` those in the container that holds the best paths, and first headings."""
        n, best = len(self.parent), max(score.values())
        high, some = [0] * n, [0] * n  # best paths and paths in and under each
        for p in used:
            high[p], some[p] = int(score[p] >= FAMILY * best), 1
        for p in range(n - 1, 0, -1):
            high[self.parent[p]] += high[p]
            some[self.parent[p]] += some[p]
        top = max(p for p in range(n) if high[p] == high[0])
        # a piece, or a path with nothing but its own text, is in its container
        if some[top] == 1 and top:
            top = self.parent[top]
        while top and self.tag[top] in PIECES:
            top = self.parent[top]
        inside, unseen = [False] * n, [False] * n
        for p in range(n):
            up = self.parent[p]
            inside[p] = p == top or (p > 0 and inside[up])
            unseen[p] = self.tag[p] == "noscript" or (p > 0 and unseen[up])
        return [p for p in used if not unseen[p] and (inside[p] or self.tag[p] == "h1")]

    def selected(self) -> set[int]:
        off, family = self._families()
        used = [p for p, n in enumerate(self.blocks) if n and not off[p]]
        if not used:
            return set()
        beside: dict[int, list[float]] = {}
        for p in used:
            sums = beside.setdefault(self.parent[p], [0.0, 0.0, 0.0])
            for i, x in enumerate((self.length[p], self.length[p] ** 2 / self.blocks[p], self.length[p] * self.points[p] / self.blocks[p])):
                sums[i] += x
        score: dict[int, float] = {}
        best_of: dict[int, float] = {}
        for p in used:
            mass, n = self.length[p], self.blocks[p]
            others = beside[self.parent[p]]
            total = mass + BESIDE * (others[0] - mass)
            long = (mass * mass / n + BESIDE * (others[1] - mass * mass / n)) / total
            points = (mass * self.points[p] / n + BESIDE * (others[2] - mass * self.points[p] / n)) / total
            score[p] = long * (points + 0.1) * (1 - self.links[p] / mass) ** 2
            f = family[p]
            best_of[f] = max(best_of.get(f, 0.0), score[p])
        for p in used:
            if family[p] >= 0:
                score[p] = max(score[p], FAMILY * best_of[family[p]])
        # a page with an article is judged by its articles
        inside = [score[p] for p in used if family[p] >= 0]
        if inside:
            return {p for p in used if family[p] >= 0 and score[p] >= THRESHOLD * max(inside)}
        best = max(score.values())
        for p in self._container(used, score):
            score[p] = max(score[p], FAMILY * best * (1 - self.links[p] / self.length[p]) ** 2)
        return {p for p in used if score[p] >= THRESHOLD * best}


def main_text(page: str | None) -> str:
    """The article of a page, a block a line."""
    if not page:
        return ""
    paths = _Paths()
    stack: list[tuple[str, int]] = [("", 0)]  # open elements and their paths; inline ones have their parent's
    open_count: dict[str, int] = {}
    blocks: list[tuple[int, str]] = []
    said: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal linked
        if said:
            text = " ".join("".join(said).split())
            said.clear()
            if text:
                p = stack[-1][1]
                blocks.append((p, text))
                paths.length[p] += len(text)
                paths.points[p] += len(_POINTS.findall(text))
                paths.links[p] += min(linked, len(text))
                paths.blocks[p] += 1
        linked = 0

    def pop_to(depth: int) -> None:
        if any(tag not in INLINE for tag, _ in stack[depth:]):
            close_block()
        for tag, _ in stack[depth:]:
            open_count[tag] -= 1
        del stack[depth:]

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            said.append(text)
            if open_count.get("a"):
                linked += len(text.strip())

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if open_count.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                # an end tag of an inline element does not close the blocks around it
                if tag not in INLINE or all(t in INLINE for t, _ in stack[depth:]):
                    pop_to(depth)
            elif tag == "p":
                close_block()
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            elif tag == "br":
                said.append(" ")
            continue
        if tag in FOREIGN:
            end = None if m[3].rstrip().endswith("/") else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end:
                inner = _UNSEEN.sub("", page[at : end.start()])
                add(_TAG.sub("", inner) if tag == "math" else " " + _TAG.sub(" ", inner) + " ")
                at = end.end()
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE:
            if tag == "a" and open_count.get("a"):
                open_count["a"] -= 1
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "a":
                        del stack[i]
                        break
            stack.append((tag, stack[-1][1]))
            open_count[tag] = open_count.get(tag, 0) + 1
            continue
        close_block()
        if open_count.get("p"):
            depth = len(stack) - 1
            while stack[depth][0] != "p":
                depth -= 1
            pop_to(depth)
        if tag in ENDS:
            closes, bounds = ENDS[tag]
            depth, found = len(stack) - 1, 0
            while depth > 0 and stack[depth][0] not in bounds:
                if stack[depth][0] in closes:
                    found = depth
                depth -= 1
            if found:
                pop_to(found)
        else:
            # inline elements left open end with the block before
            depth = len(stack)
            while stack[depth - 1][0] in INLINE and stack[depth - 1][0] != "a":
                depth -= 1
            if depth < len(stack):
                pop_to(depth)
        label, no, doubtful = _says_no(tag, m[3])
        stack.append((tag, paths.child(stack[-1][1], tag, label, no, doubtful)))
        open_count[tag] = open_count.get(tag, 0) + 1
    close_block()
    chosen = paths.selected()
    return "\n".join(text for p, text in blocks if p in chosen)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html"):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages (page_id, url, html)``."""
    short_batches(pages.sparkSession)
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
