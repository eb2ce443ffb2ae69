"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams tags and text. Text is collected in lines, one per block
element. Each line has a ratio of text to tags; the ratios are smoothed with a Gaussian and split
in two clusters at a threshold. The lines above it are the cores of content regions, which grow to
the block around them, so that their short lines stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import slices

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend"
    " li main menu nav ol option p pre search section summary table tbody td tfoot th thead title"
    " tr ul".split()
)
VOID = frozenset(
    "area base basefont bgsound br col embed frame hr img input link meta param source track"
    " wbr".split()
)
UNSEEN = frozenset(
    "applet audio canvas embed head iframe math noembed noframes noscript object script style svg"
    " template title video".split()
)
CONTROLS = frozenset("button datalist input option select textarea".split())
BESIDE = frozenset("aside dialog fieldset footer form header menu nav search".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that only part the text of the block around them.
TEXT_BLOCKS = HEADINGS | frozenset(
    "address blockquote caption dd details dl dt figcaption figure hgroup hr legend li ol p pre"
    " summary table tbody td tfoot th thead tr ul".split()
)
HOLDERS = BLOCKS - TEXT_BLOCKS
#: Words of class and id attributes, and roles, of what stands beside the text. A compound counts
#: if all its parts are such words, or one is and the others only say which or where.
BESIDE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising advertorial breadcrumb breadcrumbs"
    " comment commentlist comments cookie cookies disqus footer gdpr masthead menu menubar"
    " nav navbar navigation newsletter pagination popup promo promoted promotion"
    " recommendations recommended related replies share sharing sidebar sitemap social sponsor"
    " sponsored subscribe subscription toolbar".split()
)
#: Outside an article or main element only; inside they may name a part of the text.
OUTSIDE_WORDS = frozenset(
    "banner consent copyright header modal respond skip widget widgets".split()
)
#: As the last ones, but inside a main element of blocks only: a paragraph of that name is text.
NOTICE_WORDS = frozenset("alert alerts disclaimer notice notices".split())
WHICH_WORDS = frozenset(
    "area articles banner bar block body bottom box btn button buttons consent container content"
    " error form global group icons info item items left legal link links list main message overlay"
    " page panel placeholder policy post posts primary reader right secondary section site slot"
    " sticky stories success text thread top unit user warning widget widgets".split()
)
BESIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation"
    " search".split()
)
SPACE = re.compile(r"\s+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def names_beside(value: str, inside: bool, paragraph: bool = False) -> bool:
    """Whether a token of a class or id attribute names what stands beside the text."""
    words = BESIDE_WORDS if inside else BESIDE_WORDS | OUTSIDE_WORDS
    if not (inside and paragraph):
        words = words | NOTICE_WORDS
    for token in value.split():
        parts = [w.lower() for w in _PART.findall(token)]
        if any(w in words for w in parts) and all(w in words or w in WHICH_WORDS for w in parts):
            return True
    return False


class _Line:
    __slots__ = ("text", "tags", "linked", "node")

    def __init__(self, node: int) -> None:
        self.text: list[str] = []
        self.tags = 0
        self.linked = 0
        self.node = node


class _Lines(HTMLParser):
    """Collects the lines of a page and the elements they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        # Of every element: the one around it, tag, whether it is said to stand beside the text.
        self.parents, self.names, self.beside = [-1], [""], [False]
        # node, tag, unseen, line that goes on after it
        self._open: list[tuple[int, str, bool, _Line | None]] = []
        self._count: dict[str, int] = {}  # open elements by tag
        self._shut = self._main = self._links = 0
        self._line: _Line | None = None
        self._tags = 0

    def _unseen(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in UNSEEN or tag in CONTROLS:
            return True
        return tag not in ("html", "body", *MAIN) and any(
            name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs
        )

    def _beside(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in BESIDE:
            # The heading of an article stands in its own header element.
            return not (tag == "header" and self._main)
        # An article within another may be a reader's comment.
        if tag in ("html", "body", *MAIN) and not (tag == "article" and self._main):
            return False
        for name, value in attrs:
            if name in ("class", "id") and value:
                if names_beside(value, self._main > 0, tag not in HOLDERS):
                    return True
            elif name == "role" and value and value.strip().lower() in BESIDE_ROLES:
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if not self._shut:
            self._tags += 1
        if tag in BLOCKS:
            self._line = None
        elif tag == "br" and self._line is not None:
            self._line.text.append(" ")
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self._open:
            if self._open[-1][1] == tag:  # its end tag was left out
                self._pop()
        unseen = self._unseen(tag, attrs)
        beside = not unseen and self._beside(tag, attrs)
        node = len(self.parents)
        self.parents.append(self._open[-1][0] if self._open else 0)
        self.names.append(tag)
        self.beside.append(beside)
        self._open.append((node, tag, unseen, self._line))
        self._count[tag] = self._count.get(tag, 0) + 1
        self._shut += unseen
        self._links += tag == "a"
        self._main += tag in MAIN
        if beside:
            self._line, self._tags = None, 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "script", "iframe"):
            self.handle_endtag(tag)

    def _pop(self) -> None:
        node, tag, unseen, line = self._open.pop()
        self._count[tag] -= 1
        self._shut -= unseen
        self._links -= tag == "a"
        self._main -= tag in MAIN
        if self.beside[node]:  # its tags don't count for what follows
            self._line, self._tags = None if tag in BLOCKS else line, 0

    def handle_endtag(self, tag: str) -> None:
        if not self._shut:
            self._tags += 1
        if tag in BLOCKS:
            self._line = None
        if tag in VOID or not self._count.get(tag):
            return
        for at in range(len(self._open) - 1, -1, -1):
            if self._open[at][1] == tag:
                while len(self._open) > at:
                    self._pop()
                if tag in BLOCKS:
                    self._line = None
                return
            # An inline element doesn't end the block it stands in.
            if self._open[at][1] in BLOCKS and tag not in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if not data or self._shut:
            return
        if self._line is None:
            self._line = _Line(self._open[-1][0] if self._open else 0)
            self.lines.append(self._line)
        line = self._line
        line.tags += self._tags
        self._tags = 0
        line.text.append(data)
        if self._links:
            line.linked += len(data.strip())

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """What the standard library does not know as a marked section is passed over."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self._passed_over(i)

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self._passed_over(i)

    def _passed_over(self, i: int) -> int:
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else -1


class _Tree:
    """What the lines' elements are to each other, in a few passes over the elements.

    An element's number is greater than that of the one around it, and the lines within an element
    follow one another, so the passes run along the numbers and no line keeps a list of ancestors.
    """

    def __init__(self, parser: _Lines, nodes: list[int], weights: np.ndarray) -> None:
        names, parents = parser.names, parser.parents
        count = len(names)
        self.marked = [False] * count  # in an article or main element, or one
        self.heading = [False] * count
        self.place = [0] * count  # the outermost main element, else the nearest holder
        self.beside = [x for x in range(count) if parser.beside[x]]
        for x in range(count):
            up = parents[x]
            self.marked[x] = names[x] in MAIN or up >= 0 and self.marked[up]
            self.heading[x] = names[x] in HEADINGS or up >= 0 and self.heading[up]
            if up >= 0 and self.marked[up]:
                self.place[x] = self.place[up]
            elif names[x] in MAIN or names[x] in HOLDERS:
                self.place[x] = x
            else:
                self.place[x] = self.place[up] if up >= 0 else 0
        self.first, self.last = [len(nodes)] * count, [-1] * count  # lines within
        self.mass, self.heavy = [0.0] * count, [0] * count
        for i, x in enumerate(nodes):
            self.first[x], self.last[x] = min(self.first[x], i), max(self.last[x], i)
            self.mass[x] += float(weights[i])
            self.heavy[x] += bool(weights[i] > 0)
        # Main elements with lines that an element holds: 1 for an article, 2 for main.
        self.holds = [0] * count
        for x in range(count - 1, 0, -1):
            up = parents[x]
            if self.last[x] < 0:
                continue
            self.first[up] = min(self.first[up], self.first[x])
            self.last[up] = max(self.last[up], self.last[x])
            self.mass[up] += self.mass[x]
            self.heavy[up] += self.heavy[x]
            self.holds[up] |= self.holds[x] | (names[x] == "article") | 2 * (names[x] == "main")


def shown(tree: _Tree, nodes: list[int], total: float) -> np.ndarray:
    """Which lines don't stand beside the text.

    An element that is said to stand beside it is opened if it holds a main element; and, as long as
    no article or main element is open, if it holds one or, in several lines, most of the text that
    isn't linked. Heavy elements are asked first.
    """
    blocked = np.zeros(len(nodes) + 1, np.int64)
    held = [x for x in tree.beside if tree.last[x] >= 0]
    for x in held:
        blocked[tree.first[x]] += 1
        blocked[tree.last[x] + 1] -= 1
    blocked = np.cumsum(blocked)[:-1]
    marked = np.array([tree.marked[x] for x in nodes])
    open_marks = int((marked & (blocked == 0)).sum())
    for x in sorted(held, key=lambda x: (-tree.mass[x], x)):
        if tree.holds[x] & 2:
            opens = True
        elif open_marks:
            opens = False
        else:
            opens = tree.holds[x] > 0 or tree.heavy[x] > 1 and 2 * tree.mass[x] > total
        if opens:
            own = slice(tree.first[x], tree.last[x] + 1)
            blocked[own] -= 1
            open_marks += int((marked[own] & (blocked[own] == 0)).sum())
    return blocked == 0


def grown(tree: _Tree, nodes: list[int], core: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The lines of the regions around the core lines.

    In an article or main element (the outermost) a region is the whole of it. Elsewhere it is the
    block around the paragraphs, lists and tables, less its mostly linked lines and inner blocks
    without a core line; headings right before a region belong to it.
    """
    places = [tree.place[x] for x in nodes]
    regions = {p for p, c in zip(places, core) if c}
    keep = np.array(
        [p in regions and (tree.marked[x] or not k) for p, x, k in zip(places, nodes, linked)]
    )
    for i in range(len(nodes) - 2, -1, -1):
        if keep[i + 1] and not linked[i] and tree.heading[nodes[i]]:
            keep[i] = True
    return keep


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the outermost values go on."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def threshold(values: np.ndarray) -> float:
    """Between two clusters: the mean of their means, repeated until it stays. Lines of one kind
    make one cluster, all of it above."""
    low, high = float(values.min()), float(values.max())
    if high - low <= 0.25 * high:
        return low
    cut = float(values.mean())
    for _ in range(32):
        above, below = values[values > cut], values[values <= cut]
        if not len(above) or not len(below):
            break
        new = (float(above.mean()) + float(below.mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def extract(html: str | None, sigma: float = 1.0, joint: str = "\n\n") -> str:
    """The main text of a page; empty for null, empty and text-free input.

    Lines inside menus, headers, footers, sidebars, adverts, forms, comments and elements that are
    not shown are out, unless such an element is the page's frame (``shown``). Of the others the
    clustering chooses cores, outside marked elements (``article``, ``main``) only lines that are
    not mostly linked, and the text is the regions around them (``grown``).
    """
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines, texts = [], []
    for line in parser.lines:
        text = SPACE.sub(" ", "".join(line.text)).strip()
        if text:
            lines.append(line)
            texts.append(text)
    if not lines:
        return ""
    nodes = [x.node for x in lines]
    weights = np.array([max(len(t) - x.linked, 0) for x, t in zip(lines, texts)], float)
    tree = _Tree(parser, nodes, weights)
    seen = np.flatnonzero(shown(tree, nodes, float(weights.sum()))).tolist()
    if not seen:
        return ""
    nodes = [nodes[i] for i in seen]
    lengths = np.array([len(texts[i]) for i in seen], float)
    ratios = weights[seen] / np.array([max(lines[i].tags, 1) for i in seen])
    smooth = smoothed(np.log1p(ratios), sigma)
    core = smooth >= threshold(smooth)
    linked = weights[seen] < 0.5 * lengths
    marked = np.array([tree.marked[x] for x in nodes])
    keep = grown(tree, nodes, core & (marked | ~linked), linked)
    return joint.join(texts[i] for i, k in zip(seen, keep) if k)


def extract_pages(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, text, n_chars (code points).

    Row by row, so there is no shuffle; nulls and repeated rows stay, other columns are ignored.
    """
    wanted = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = [wanted.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(h, sigma) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return wanted.mapInArrow(
        task, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long"
    )
