"""Main-text extraction from HTML.

The standard library's parser streams events; block elements cut the page into
lines.  Lines have a text-to-tag ratio, which is smoothed by a Gaussian kernel; lines
whose level reaches a threshold are content.  Structure supports that choice: a line
in a part marked as something else (menus, notices, adverts, reader comments) has the
level 0.  The content lines point out the region that holds the article, and short
lines of that region join them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votegrid.llm.common import python_ready

SIGMA = 1.0
#: A line is content if its smoothed ratio is at least this many standard deviations.
THRESHOLD = 1.0
#: Shares of the content that point out an element: one that is named as the article's,
#: and any other.
NAMED_SHARE, PLAIN_SHARE = 0.5, 0.8

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot "
    "thead tr ul".split()
)
_CONTAINER = frozenset("article body center div form header main section table td blockquote".split())
#: Elements whose content is no text of the page.
_MUTE = frozenset("button canvas datalist head iframe label legend noscript object option script select style svg template textarea title".split())
#: Elements that never hold the article, and such that may stand around it.
_APART, _AROUND = frozenset("aside dialog footer menu nav".split()), frozenset("form header".split())
_APART_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class names and ids that mark such parts.
_MARKS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentlist "
    "comments consent cookie cookies disqus dialog discussion footer form gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice outbrain pagination pager paywall popup promo promoted promotion "
    "reactions related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription taboola toolbar widget widgets".split()
)
_DISCUSSION = frozenset("comment comments commentlist discussion disqus replies respond reactions".split())
#: Words that say nothing beside a mark: ``share-buttons`` is marked, ``share-holders`` is not.
_NEUTRAL = frozenset(
    "area articles bar block body bottom box button buttons container content entry footer group header holder icon icons "
    "inline inner item items left link links list main message outer page panel policy post posts right row section site slot "
    "sticky story stories text thread title top unit wrap wrapper".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = frozenset("blockquote dd dt figcaption li p pre".split()) | _HEADING
_MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
_OUTER = frozenset("article main".split())
#: A start tag that ends an open element of the second kind, up to the third.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
_WORDS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


def _words(*values: str | None) -> list[str]:
    return [w.lower() for v in values if v for w in _WORDS.findall(v)]


def _marks(name: str | None, alone: bool) -> set[str]:
    """Marking words of a class or id: of each name in it that holds nothing but marks
    and, unless ``alone``, neutral words and numbers."""
    found: set[str] = set()
    for part in (name or "").split():
        words = _words(part)
        marks = _MARKS.intersection(words)
        if marks and all(w in _MARKS or (not alone and (w in _NEUTRAL or w.isdigit() or len(w) == 1)) for w in words):
            found |= marks
    return found


class _Line:
    """A block's text, the tags before its end, its linked characters, the node and
    the tag of the block it stands in."""

    __slots__ = ("text", "tags", "linked", "node", "block")

    def __init__(self, text: str, tags: int, linked: int, node: int, block: str):
        self.text, self.tags, self.linked, self.node, self.block = text, tags, linked, node, block


class _Node:
    """A container or marked element.  ``mark``: 0 none, 1 may stand around the
    article, 2 never holds it; ``name``: 0 none, 1 named as the article's, 2 an
    article or main element."""

    __slots__ = ("parent", "mark", "name")

    def __init__(self, parent: int, mark: int, name: int):
        self.parent, self.mark, self.name = parent, mark, name


class _Reader(HTMLParser):
    """Collects lines, and nodes as a tree in which parents come first.

    ``open`` holds (tag, node, own node, muted so far, marked so far); counts by tag
    say at once that nothing is to be looked for, which keeps deep pages linear."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.nodes = [_Node(-1, 0, 0)]
        self.open: list[tuple[str, int, bool]] = []  # tag, innermost node, muted
        self._count: Counter[str] = Counter()
        self._blocks = ["body"]
        self._text: list[str] = []
        self._tags = self._linked = 0

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append(_Line(text, self._tags, self._linked, self.open[-1][1] if self.open else 0, self._blocks[-1]))
        self._text, self._tags, self._linked = [], 0, 0

    def _close(self, k: int) -> None:
        gone = self.open[k:]
        before = self.open[k - 1][1] if k else 0
        if any(t in _BLOCK for t, _, _ in gone) or self.nodes[gone[-1][1]].mark and gone[-1][1] != before:
            self._flush()
        for tag, _, _ in gone:
            self._count[tag] -= 1
            if tag in _BLOCK:
                self._blocks.pop()
        del self.open[k:]

    def _find(self, tags: tuple[str, ...], stop: frozenset[str] | tuple[str, ...]) -> int | None:
        if not any(self._count[t] for t in tags):
            return None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                return k
            if self.open[k][0] in stop:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in _VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self._text.append(" ")
            return
        if tag in _IMPLIED:
            if (k := self._find(*_IMPLIED[tag])) is not None:
                self._close(k)
        elif tag in _BLOCK and (k := self._find(("p",), _CONTAINER)) is not None:
            self._close(k)
        if tag in _BLOCK and (k := self._find(("head",), ())) is not None:
            self._close(k)
        node, muted = self.open[-1][1:] if self.open else (0, False)
        at = dict(attrs)
        mark = 0 if muted else self._mark(tag, at)
        if tag in _BLOCK or mark:
            self._flush()
        elif tag in ("td", "th"):
            self._text.append(" ")
        if tag in _CONTAINER or mark:
            words = _words(at.get("class"), at.get("id"), at.get("itemprop"), at.get("role"))
            name = 2 if tag in _OUTER else int(tag in _CONTAINER and bool(_MAIN_WORDS & {*words, "".join(words)}))
            self.nodes.append(_Node(node, mark, name))
            node = len(self.nodes) - 1
        self._count[tag] += 1
        if tag in _BLOCK:
            self._blocks.append(tag)
        self.open.append((tag, node, muted or tag in _MUTE))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: the slash means nothing

    def _mark(self, tag: str, at: dict[str, str | None]) -> int:
        inside = self._count["article"] or self._count["main"]
        if tag in _APART or "hidden" in at or at.get("aria-hidden") == "true":
            return 2
        if (at.get("role") or "") in _APART_ROLES and not (inside and tag == "header"):
            return 1 if at["role"] in ("form", "banner") else 2
        if tag in _HEADING or tag in ("html", "body"):
            return 0
        # the sections of an article have ids made from their titles
        found = _marks(at.get("class"), False) | _marks(at.get("id"), bool(inside))
        if found & _DISCUSSION:
            return 2
        if tag in _OUTER:
            return 0
        return 1 if found or tag == "form" or tag == "header" and not inside else 0

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in _VOID:
            return
        stop = () if tag in _CONTAINER or tag in _MUTE or tag in _APART or tag == "html" else _CONTAINER
        k = self._find((tag,), stop)
        if k is not None:
            self._close(k)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2]:
            return
        self._text.append(data)
        if self._count["a"]:
            self._linked += len(data)

    def finish(self) -> None:
        self.close()
        self._flush()


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing whose kernel is normalised over what lies inside."""
    if sigma <= 0 or len(values) < 2:
        return values
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[reach : reach + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def content_lines(lines: list[_Line], support: list[bool], sigma: float, threshold: float) -> list[bool]:
    """Lines whose smoothed text-to-tag ratio reaches the threshold; where structure
    gives no support the level is 0.  The threshold 0 takes every line."""
    ratio = np.array([(len(x.text) - x.linked) / max(1, x.tags) for x in lines], dtype=float)
    able = np.array(support, dtype=bool)
    level = smooth(np.maximum(ratio, 0), sigma) * able
    high = level >= min(threshold * float(level.std()), float(level.max(initial=0.0)))
    return (high & able if threshold > 0 else high).tolist()


def _masses(nodes: list[_Node], lines: list[_Line], counted: list[bool]) -> list[int]:
    """Characters of the counted lines in each node."""
    mass = [0] * len(nodes)
    for x, yes in zip(lines, counted, strict=True):
        if yes:
            mass[x.node] += len(x.text)
    for n in range(len(nodes) - 1, 0, -1):
        mass[nodes[n].parent] += mass[n]
    return mass


def _supported(nodes: list[_Node], lines: list[_Line], sigma: float, threshold: float) -> list[bool]:
    """Whether a line stands in no marked part.  A mark that may stand around the
    article counts for nothing on an element with the bulk of the content in it, and
    with the article or main element if the page has one."""
    apart = [False] * len(nodes)
    for n in range(1, len(nodes)):
        apart[n] = apart[nodes[n].parent] or nodes[n].mark == 2
    rest = [not apart[x.node] for x in lines]
    mass = _masses(nodes, lines, [a and b for a, b in zip(content_lines(lines, rest, sigma, threshold), rest, strict=True)])
    around = [x.name == 2 and not a for x, a in zip(nodes, apart, strict=True)]
    for n in range(len(nodes) - 1, 0, -1):
        around[nodes[n].parent] |= around[n]
    for n in range(1, len(nodes)):
        bulk = 2 * mass[n] >= mass[0] and (around[n] or not around[0])
        apart[n] = apart[nodes[n].parent] or nodes[n].mark == 2 or (nodes[n].mark == 1 and not bulk)
    return [not apart[x.node] for x in lines]


def _region(nodes: list[_Node], lines: list[_Line], chosen: list[bool]) -> int:
    """The outermost article or main with the bulk of the content lines, or else the
    innermost element, one named as the article's first."""
    mass = _masses(nodes, lines, chosen)
    held = Counter(x.node for x in lines)
    outer = [n for n in range(1, len(nodes)) if nodes[n].name == 2 and mass[n] >= NAMED_SHARE * mass[0]]
    if outer:
        return outer[0]
    for n in range(len(nodes) - 1, 0, -1):
        held[nodes[n].parent] += held[n]
    able = [n for n in range(1, len(nodes)) if mass[n] >= (NAMED_SHARE if nodes[n].name else PLAIN_SHARE) * mass[0] and (nodes[n].name or held[n] > 1)]
    return max(able, key=lambda n: (nodes[n].name > 0, n), default=0)


def extract(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The main text; blocks in page order, two newlines between them."""
    reader = _Reader()
    reader.feed(html or "")
    reader.finish()
    nodes, lines = reader.nodes, reader.lines
    if not lines:
        return ""
    support = _supported(nodes, lines, sigma, threshold)
    if not any(support) and threshold > 0:
        return ""
    chosen = content_lines(lines, support, sigma, threshold)
    best = _region(nodes, lines, [a and b for a, b in zip(chosen, support, strict=True)])
    within = [n == best for n in range(len(nodes))]
    for n in range(1, len(nodes)):
        within[n] = within[n] or within[nodes[n].parent]
    support = [s and within[x.node] for x, s in zip(lines, support, strict=True)]
    if not nodes[best].name:  # lines of links are no article's, unless there is nothing else
        prose = [s and 2 * x.linked < len(x.text) for x, s in zip(lines, support, strict=True)]
        support = prose if any(prose) else support
    chosen = content_lines(lines, support, sigma, threshold)
    at = [k for k, yes in enumerate(chosen) if yes]
    if nodes[best].name:  # its begin and end are known
        first, last = 0, len(lines)
    else:  # from the first content line to the last, and the headings and paragraphs next to them
        plain = lambda k: support[k] and lines[k].block in _PROSE
        first, last = at[0], at[-1] + 1
        while first and plain(first - 1):
            first -= 1
        while last < len(lines) and plain(last):
            last += 1
    return "\n\n".join(x.text for k, (x, c, s) in enumerate(zip(lines, chosen, support, strict=True)) if c or (s and first <= k < last))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points).

    Null and empty html give an empty text; null ids and urls are carried along;
    repeated rows are treated alike; an empty table gives an empty result; extra
    columns are ignored.  Broken markup is read as browsers would, roughly.
    """
    python_ready(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole page of ``pages``."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
