"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Block elements and line
breaks end a line; a line has its text, the tags that went by, the share of its
text in links, and the structural elements around it. Elements that are no part
of an article whatever their text (menus, forms, scripts, notices, comments, by
tag, role and class) take their lines away; a form, or an element that role or names
alone mark, does not if it holds most of the page's text and all of its articles.
The ratio of text to tags per line is smoothed with a Gaussian; lines above the
threshold form the content clusters. The elements that hold them, all articles if
there are any, give the main text: short lines between long ones belong to it, lines
of links alone do not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br head title".split()
)
#: Elements whose text is never shown as part of an article.
NEVER = frozenset("script style noscript template head nav aside footer button select option textarea iframe object svg math canvas dialog menu".split())
STRUCTURE = frozenset("article main section div td body html".split())
#: A start of one of these ends an open paragraph.
ENDS_P = BLOCK - {"br", "option", "body", "html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot"}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ALWAYS_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner cookie cookies consent gdpr comment comments disqus reply replies respond "
    "sponsor sponsored promo promotion newsletter subscribe signup popup modal nav navbar navigation breadcrumb breadcrumbs menu notice alert "
    "social share sharing related recommended recommendations pagination pager login skip copyright".split()
)
MAYBE_NOISE = frozenset("sidebar side header footer masthead widget widgets toolbar search tags legal aside rail topbar".split())
CONTENT = frozenset("article content main post entry story body text".split())
#: In an id these name no topic; a class that starts with one of ABOUT speaks of the page, not of its element.
GENERIC = frozenset(
    "box block list section area wrapper wrap container content bar link links item items main top bottom left right form button panel inner outer "
    "article articles post posts story stories site page global primary secondary".split()
)
ABOUT = frozenset("has no with without is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Characters given to the parser at a time.
PART = 1 << 16


@dataclass
class Line:
    around: tuple[int, ...]
    in_list: bool
    tags: int = 0
    linked: int = 0
    heading: str = ""
    parts: list[str] = field(default_factory=list)
    text: str = ""


class Lines(HTMLParser):
    """Collects the lines of a page outside of elements that are never content."""

    def __init__(self, spared: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        #: Marked elements by number, in order of their starts: those that stay, and (text, text in articles) in each.
        self.spared, self.marked = spared, []
        #: Text outside of links and of elements that never have any, that in articles of it; open elements that never have any.
        self.plain = self.told = self.never = 0
        self.lines: list[Line] = []
        self.kinds: list[str] = []
        self.open: list[tuple[str, int, bool, int]] = []  # tag, structural number or -1, dropped, marked number or -1
        self.dropped = self.links = self.lists = self.inside = 0
        self.around: list[int] = []
        self.heading = ""
        self.line = Line((), False)

    def end_line(self) -> None:
        line = self.line
        line.text = " ".join("".join(line.parts).split())
        if line.text or line.tags:
            self.lines.append(line)
        self.line = Line(tuple(self.around), self.lists > 0, heading=self.heading)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P and any(one[0] == "p" for one in self.open[-8:]):
            self.handle_endtag("p")
        if tag in ("li", "option") and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)
        if tag == "body" and any(one[0] == "head" for one in self.open):
            self.handle_endtag("head")
        number = -1
        drop, mark = tag in NEVER or bool(attrs) and is_hidden(dict(attrs)), -1
        never = drop
        if tag not in VOID and not never and (tag == "form" or (bool(attrs) or tag == "header") and self.is_noise(tag, dict(attrs))):
            mark = len(self.marked)
            self.marked.append((-self.plain, -self.told))
            drop = mark not in self.spared
        if tag in STRUCTURE:
            number = len(self.kinds)
            self.kinds.append(tag)
        if tag not in VOID:
            self.open.append((tag, number, drop, mark))
            self.never += never
            if number >= 0:
                self.around.append(number)
            self.inside += tag in ("article", "main")
            self.dropped += drop
            self.links += tag == "a"
            self.lists += tag in ("ul", "ol")
            if tag in ("h1", "h2"):
                self.heading = tag
        if tag in BLOCK:
            self.end_line()
        if not self.dropped:
            self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in NEVER or tag == "form"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                break
        else:
            return
        self.line.tags += not self.dropped
        # An inline end tag closes its element alone, a block's all that is open in it.
        closed = self.open[depth:] if tag in BLOCK else [self.open[depth]]
        del self.open[depth : depth + len(closed)]
        for name, number, drop, mark in closed:
            if mark >= 0:
                self.end_mark(mark)
            self.never -= drop and mark < 0
            if number >= 0:
                self.around.remove(number)
            self.inside -= name in ("article", "main")
            self.dropped -= drop
            self.links -= name == "a"
            self.lists -= name in ("ul", "ol")
            if name == self.heading:
                self.heading = ""
        if tag in BLOCK:
            self.end_line()

    def end_mark(self, mark: int) -> None:
        plain, told = self.marked[mark]
        self.marked[mark] = (plain + self.plain, told + self.told)

    def to_spare(self) -> frozenset[int]:
        """Marked elements that hold most of the text, and all that articles have, if anything."""
        for _, _, _, mark in self.open:
            if mark >= 0:
                self.end_mark(mark)
        return frozenset(mark for mark, (plain, told) in enumerate(self.marked) if 2 * plain > self.plain and told == self.told)

    def handle_data(self, data: str) -> None:
        if not self.never and not self.links:
            n = len(data.strip())
            self.plain += n
            self.told += n if self.inside else 0
        if not self.dropped:
            self.line.parts.append(data)
            if self.links:
                self.line.linked += len(data.strip())

    def is_noise(self, tag: str, attrs: dict) -> bool:
        """By role and the words of class and id; a header counts unless it is that of the article.

        An id with a word of its own names a topic, and so does that of a heading.
        """
        if tag in ("html", "body", "article", "main", "h1"):
            return False
        if attrs.get("role") in ROLES:
            return True
        words: set[str] = set()
        for one in (attrs.get("class") or "").split():
            parts = [word.lower() for word in NAME.findall(one)]
            if parts and parts[0] not in ABOUT:
                words.update(parts)
        named = {word.lower() for word in NAME.findall(attrs.get("id") or "")}
        if tag not in HEADINGS and all(word in ALWAYS_NOISE or word in MAYBE_NOISE or word in GENERIC or word.isdigit() for word in named):
            words |= named
        if words & ALWAYS_NOISE:
            return True
        return (tag == "header" or bool(words & MAYBE_NOISE)) and not words & CONTENT and not (self.inside and (tag == "header" or "header" in words))


def is_hidden(attrs: dict) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(HIDDEN.search(attrs.get("style") or ""))


def lines_of(html: str) -> tuple[list[Line], list[str]]:
    """The lines of a page that could be content, and the kinds of its structural elements."""
    spared: frozenset[int] = frozenset()
    while True:
        parser = Lines(spared)
        for start in range(0, len(html), PART):
            parser.feed(html[start : start + PART])
        parser.close()
        parser.end_line()
        # Which elements are marked does not depend on the spared ones: a second reading is the last.
        if spared or not (spared := parser.to_spare()):
            return parser.lines, parser.kinds


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; borders count as they are."""
    reach = max(1, round(3 * sigma))
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def content_lines(lines: list[Line], kinds: list[str], sigma: float = 1.0) -> list[Line]:
    """The lines of the main text."""
    ratios = np.array([(len(line.text) - min(line.linked, len(line.text))) / max(line.tags, 1) for line in lines])
    high = smoothed(ratios, sigma)
    # Two clusters: what lies at a standard deviation or more above nothing, and the rest.
    chosen = high >= high.std()
    weight: dict[int, int] = {}
    total = 0
    for line, above in zip(lines, chosen):
        if above:
            total += len(line.text)
            for number in line.around:
                weight[number] = weight.get(number, 0) + len(line.text)
    kept, clusters = set(), [line for line, above in zip(lines, chosen) if above and line.text]
    for kind in ("article", "main"):
        own = {number for number, name in enumerate(kinds) if name == kind and weight.get(number)}
        if sum(len(line.text) for line in clusters if own.intersection(line.around)) >= 0.4 * total > 0:
            kept = own
            break
    told = bool(kept)
    covering = [number for number, n in weight.items() if n >= 0.8 * total]
    if not told and covering:
        # Clusters outside count with their innermost element, or alone if that is around the large one.
        least = max(covering)
        outer = {number for line in clusters if least in line.around for number in line.around if number < least}
        kept = {least} | {line.around[-1] for line in clusters if line.around and least not in line.around} - outer
    out = []
    titles = [line for line in lines if line.heading == "h1" and line.text]
    for line, above in zip(lines, chosen):
        if not line.text:
            continue
        # Without an article, clusters outside of the elements kept are text, too.
        inside = bool(kept.intersection(line.around)) or bool(above) and not told
        links_only = line.in_list and line.linked >= 0.9 * len(line.text.replace(" ", ""))
        if inside and not (links_only and not above) or not inside and titles == [line]:
            out.append(line)
    return out


def main_text(html: str | None) -> str:
    """The lines of the main text, joined by spaces; empty if the page has none."""
    if not html:
        return ""
    lines, kinds = lines_of(html)
    if not any(line.text for line in lines):
        return ""
    return " ".join(line.text for line in content_lines(lines, kinds))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points).

    A null or empty page, and one without text outside of menus and the like, has
    the empty text. Pages of any length are parsed whole, in parts. Text without
    any markup is its own main text.
    """

    @F.pandas_udf("string")
    def look(texts: pd.Series) -> pd.Series:
        return texts.map(main_text)

    return (
        pages.withColumn("text", look.asNondeterministic()(F.coalesce(F.col(html), F.lit(""))))
        .withColumn("n_chars", F.char_length("text").cast("long"))
    )
