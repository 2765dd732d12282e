"""Main text of web pages.

The standard library's parser streams a page as events, from which come lines: runs of text between block tags, each with its
characters, tags and link characters, and the container that it stands in. A line's ratio of text to tags is nought inside menus,
headers, footers, sidebars, notices, adverts, forms and comments; the others' ratios are smoothed with a Gaussian. Lines over the
threshold (the mean of the smoothed ratios less a share of their deviation) cluster into content. The region is the container that
agrees best with the clusters: the harmonic mean of the share of its text that is in clusters and of the share of the clusters'
text that is in it, times a factor for an article or main element, which is one signal more. The page's text are the region's lines
in clusters and its short ones beside them, whose level isn't nought. All steps take time in proportion to the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import slices

# Elements of HTML by what they mean here.
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title select option button textarea datalist".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol section table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
_HINT = re.compile(r"(?:^|[\s_-])(?:ads?|adv|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|sidebar|side|widget|related|recommend(?:ed|ations)?|share|social|breadcrumbs?|nav|navbar|navigation|menu|toolbar|pagination|pager|footer|comments?|commentlist|disqus|replies|respond|masthead|site-header|page-header|topbar)(?:$|[\s_-])", re.I)
_UNFINISHED = re.compile("<[A-Za-z/!?]")
SIGMA, DEVIATIONS = 1.0, 0.5
#: By how much an article or main element is preferred to another container that agrees as well with the clusters.
LANDMARK = {"article": 1.5, "main": 1.4}


@dataclass
class Node:
    """A container of the page; `skip` if it, or one that it stands in, isn't main text; `inside`: it is, or stands in, an article or
    main element; `signal`: its factor."""

    tag: str
    parent: int
    skip: bool
    inside: bool
    signal: float


@dataclass
class Line:
    node: int
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0


class Events(HTMLParser):
    """Lines of a page from the parser's events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", -1, False, False, 1.0)]
        self.stack: list[int] = [0]
        self.open: dict[str, list[int]] = {}  # where on the stack a tag's containers are
        self.lines: list[Line] = [Line(0)]
        self.silent: list[str] = []
        self.hushed: dict[str, int] = {}  # how often a tag is in silent
        self.links = 0

    def broken(self) -> None:
        if self.lines[-1].parts:
            self.lines.append(Line(self.stack[-1]))
        else:
            self.lines[-1].node = self.stack[-1]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent.append(tag)
            self.hushed[tag] = self.hushed.get(tag, 0) + 1
            return
        if self.silent:
            if tag == "body" or tag in ("article", "main") and self.silent[-1] in ("head", "title"):
                self.silent.clear()
                self.hushed.clear()
            else:
                return
        if tag in CONTAINERS:
            up = self.nodes[self.stack[-1]]
            said = {k: v or "" for k, v in attrs}
            role = said.get("role", "").lower()
            skip = up.skip or tag in BOILERPLATE or role in ROLES or "hidden" in said or said.get("aria-hidden") == "true"
            skip = skip or tag == "header" and not up.inside
            if not skip and tag not in ("html", "body", "article", "main"):
                skip = bool(_HINT.search(said.get("class", "")) or _HINT.search(said.get("id", "")))
            self.open.setdefault(tag, []).append(len(self.stack))
            self.nodes.append(Node(tag, self.stack[-1], skip, up.inside or tag in LANDMARK, LANDMARK.get(tag, LANDMARK.get(role, 1.0))))
            self.stack.append(len(self.nodes) - 1)
        if tag in BLOCKS:
            self.broken()
        self.lines[-1].tags += 1
        if tag == "a":
            self.links += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, the slash of <p/> is ignored

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            while self.hushed.get(tag):
                self.hushed[last := self.silent.pop()] -= 1
                if last == tag:
                    break
            return
        if self.open.get(tag):
            for k in reversed(self.stack[(i := self.open[tag][-1]) :]):
                self.open[self.nodes[k].tag].pop()
            del self.stack[i:]
        if tag in BLOCKS:
            self.broken()
        self.lines[-1].tags += 1
        if tag == "a" and self.links:
            self.links -= 1

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        line = self.lines[-1]
        if not line.parts and data.isspace():
            return
        line.parts.append(data)
        if self.links:
            line.linked += len(data)


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Convolved with a Gaussian, whose weights beyond the ends are left out."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    ones = np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]
    return np.convolve(x, kernel)[reach : reach + len(x)] / ones


def closed(html: str) -> str:
    """html without a tag that it ends in, and without the starts of comments that nothing ends, if there are many: the parser would
    look for the end of each."""
    if found := _UNFINISHED.search(html, html.rfind(">") + 1):
        html = html[: found.start()]
    at = html.rfind("-->") + 1
    return html if html.count("<!--", at) < 100 else html[:at] + html[at:].replace("<!--", "")


def main_text(html: str | None, deviations: float = DEVIATIONS) -> tuple[str, int]:
    """The text, and how many lines the page has. Without any line outside of menus and the like the text is empty."""
    events = Events()
    events.feed(closed(html or ""))
    events.close()
    nodes = events.nodes
    lines = [(x, " ".join("".join(x.parts).split())) for x in events.lines]
    lines = [(x, t) for x, t in lines if t]
    own = np.array([not nodes[x.node].skip for x, _ in lines], bool)
    if not own.any():
        return "", len(lines)
    level = np.zeros(len(lines))
    level[own] = smoothed(np.array([(len(t) + 1 - min(x.linked, len(t))) / max(1, x.tags) for (x, t), k in zip(lines, own.tolist(), strict=True) if k]))
    mean, deviation = level[own].mean(), level[own].std()
    content = level >= mean - deviations * min(mean, deviation)
    # Text, and text of the clusters, by container, what stands in it included; a container's nodes are numbered from it on.
    where, chars = np.array([x.node for x, _ in lines]), np.array([len(t) for _, t in lines], float)
    held = np.bincount(where, chars, len(nodes)).tolist()
    good = np.bincount(where, chars * content, len(nodes)).tolist()
    size = [1] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k].parent
        held[up] += held[k]
        good[up] += good[k]
        size[up] += size[k]
    agrees = [n.signal * g / (h + good[0]) for n, g, h in zip(nodes, good, held, strict=True)]
    best = max(range(len(nodes)), key=agrees.__getitem__)
    return " ".join(t for (x, t), k in zip(lines, (content | (level > 0)).tolist(), strict=True) if k and best <= x.node < best + size[best]), len(lines)


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars, n_lines. A null or empty html has an empty text; repeated
    rows and null ids are rows like others; very long pages are read whole; other columns are ignored; an empty table gives no row."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_lines"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(look, "page_id long, url string, text string, n_chars long, n_lines long")
