"""Main text of web pages: text-to-tag ratio by line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser gives events. Each block (a paragraph, heading, list item, table cell, ...)
is one line with its text length and the number of tags in it; its ratio is text by tags. Lines inside elements that
are never content (menus, headers, footers, sidebars, notices, adverts, forms, scripts, reader comments: told by
element, role, or words of class and id) have ratio 0; lines inside <article> or <main> weigh more. Ratios are
smoothed along the page with a Gaussian kernel, and lines above the threshold (the smoothed ratios' standard
deviation) form clusters. A region is what the outermost sectioning element below <body>, or below <article> or <main>,
has around a line. It is content if it has a line in a cluster; all of its lines are then kept, short ones too, and so
are lines between the page's first and last cluster. If the page has an <article> or <main>, only lines in it can be
content, and there a region without a cluster goes only if most of its text is in links: short paragraphs in elements
of their own are part of an article, lists of links are not.

Defined results: null, empty or text-free html gives an empty text; entities are decoded; white space inside a block
becomes one space; blocks are joined by two newlines; broken markup is read as the parser recovers it; repeated rows
are each extracted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("head title nav header footer aside form script style noscript template svg iframe object button select textarea dialog menu canvas audio video map math".split())
MAIN = frozenset(("article", "main"))
REGIONS = frozenset("article main section div body td blockquote".split())
#: The outermost of these is the region of all that is in it; the rest of the page, of an article, or of main is one.
OUTER = frozenset("article main section div".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what is not the article.
WORDS = frozenset(
    "ad ads adbox adslot adunit adcontainer adsense announcement cta outbrain taboola sidenav topnav subnav topbar offcanvas dropdown commentbox commentform usercomments advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription sidebar widget widgets related recommended recommendations share sharing social menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer copyright comment comments commentlist disqus respond reply replies login signup register form search toolbar pagination pager skip hidden paywall".split()
)
NOT_A_MARK = frozenset(("has", "with", "no", "without"))
#: Elements whose class says how the page is laid out, not what they hold.
LAYOUT = frozenset(("html", "body", "main", "article"))
SIGMA, MAIN_WEIGHT = 1.0, 8.0
#: An open element of the first kind ends where one of the second kind starts.
ENDS = {
    "p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)),
    "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr", "tbody", "tfoot")), "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
}


class Line(NamedTuple):
    text: str
    tags: int
    never: bool
    main: bool
    region: int
    #: Characters of the text that are in links.
    linked: int


def is_marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether the element is never part of the article."""
    if tag in NEVER:
        return True
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value or tag in LAYOUT:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id"):
            for token in value.split():
                words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", token)
                words = [w.lower() for w in words]
                if words and words[0] not in NOT_A_MARK and not WORDS.isdisjoint((words[0], words[-1], token.lower())):
                    return True
    return False


class _Lines(HTMLParser):
    """Events into lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        #: Open elements: (tag, never content, in the article, region, whether its block is never content, whether inner elements are regions).
        self.open: list[tuple[str, bool, bool, int, bool, bool]] = [("", False, False, 0, False, True)]
        self.regions = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, _, main, region, never, _ = self.open[-1]
            self.lines.append(Line(text, self.tags, never, main, region, self.linked))
        self.parts, self.tags, self.linked = [], 0, 0

    def close_to(self, depth: int) -> None:
        self.links -= sum(x[0] == "a" for x in self.open[depth:])
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            while len(self.open) > 1 and (ends := self.ended_by(tag)):
                self.close_to(ends)
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        _, never, main, region, block, divides = self.open[-1]
        is_main = tag in MAIN or ("role", "main") in attrs
        if is_main or (tag in OUTER and divides):
            self.regions += 1
            region, divides = self.regions, is_main
        never = never or is_marked(tag, attrs)
        self.links += tag == "a"
        self.open.append((tag, never, main or is_main, region, never if tag in BLOCKS else block, divides))

    def ended_by(self, tag: str) -> int:
        """How many elements stay open when an open p, li, ... ends because tag starts; 0: none ends."""
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name in ENDS and tag in ENDS[name]:
                return k
            if name in BLOCKS:
                return 0
        return 0

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe", "script", "style", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if tag in BLOCKS:
                    self.end_line()
                self.close_to(k)
                return
            if self.open[k][0] in REGIONS and tag not in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        _, never, _, _, block, _ = self.open[-1]
        if not never or block:  # else it is an inline script, button, advert, ... in a block of text
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def lines_of(html: str) -> list[Line]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return parser.lines


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is cut and weighed anew."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = kernel[abs(i - j)]
            total, weight = total + w * values[j], weight + w
        out.append(total / weight)
    return out


def main_text(html: str) -> str:
    """The blocks of the article, joined by two newlines."""
    lines = lines_of(html)
    has_main = any(x.main and not x.never for x in lines)
    ratios = [0.0 if x.never or (has_main and not x.main) else len(x.text) / max(1, x.tags) * (MAIN_WEIGHT if x.main else 1) for x in lines]
    if not any(ratios):
        return ""
    soft = smoothed(ratios)
    mean = sum(soft) / len(soft)
    threshold = min(math.sqrt(sum((s - mean) ** 2 for s in soft) / len(soft)), max(s for s, r in zip(soft, ratios, strict=True) if r))
    clustered = [i for i, (s, r) in enumerate(zip(soft, ratios, strict=True)) if r and s >= threshold]
    content = {lines[i].region for i in clustered}
    if has_main:
        text, linked = Counter(), Counter()
        for x, r in zip(lines, ratios, strict=True):
            if r:
                text[x.region] += len(x.text)
                linked[x.region] += x.linked
        content |= {k for k in text if 2 * linked[k] <= text[k]}
    return "\n\n".join(x.text for i, (x, r) in enumerate(zip(lines, ratios, strict=True)) if r and (x.region in content or clustered[0] <= i <= clustered[-1]))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row for each row of pages."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b["html"].to_pylist()]
            yield pa.record_batch([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    types = dict(pages.dtypes)
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(extracted, f"page_id {types['page_id']}, url string, text string, n_chars long")
