"""Main text of web pages: text-to-tag ratios of lines, smoothed and clustered.

The events of the standard library's HTML parser are turned into lines, a line being the text
between two block boundaries. Its text-to-tag ratio is its visible characters over its tags;
characters inside links, of lines that are mostly links and inside page furniture (menus, banners, asides, adverts, notices,
forms, comments, by element, ARIA role or class and id words) count nothing. Ratios are smoothed
over neighbouring lines with a Gaussian kernel, and two-means clustering of their logarithms
finds the threshold between the lines of content and the rest. Content lines choose a *region*, not single lines:
the articles or the main element that hold them, or else the deepest container that holds most
of their text. All lines of the region are returned, short ones too, except furniture and the
link-dominated parts that hold no content line. So a page's sparse paragraphs stay, and no cutoff
on the ratio is fixed.

Work is a single pass of ``mapInPandas`` over the pages, without a shuffle; a task holds one
page's lines at a time. Defined results: a null or empty page, and a page with no text outside
furniture, give an empty text. Ids may be null or repeated, each row gives one row; other
columns of the input pass through unread.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of the HTML standard, by what they do to the text around them.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split()
)
UNSEEN = frozenset(
    "script style template noscript noframes iframe object embed applet svg math canvas audio video map head title "
    "button select textarea datalist option input label fieldset form dialog".split()
)
FURNITURE = frozenset("nav footer aside menu search".split())
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status note".split()
)
# Words of class and id attributes that name furniture, compared whole after splitting.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot banner banners sponsor "
    "sponsored sponsors promo promos promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal "
    "overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies disqus "
    "share sharing social related recommended recommendations widget widgets skip hidden".split()
)
# Words that say a class name speaks of the page's layout, as in "has-sidebar".
LAYOUT_WORDS = frozenset("has with no without".split())
# Words that make a header the article's own.
ARTICLE_WORDS = frozenset("article post entry story content".split())
# Elements whose start or end tag another tag implies, as browsers have it.
_CLOSES = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dt", ("dl",)),
    "dd": ("dd", ("dl",)),
    "tr": ("tr", ("table",)),
    "td": ("td", ("tr", "table")),
    "th": ("th", ("tr", "table")),
    "option": ("option", ("select", "datalist")),
}
_CONTAINERS = frozenset(["", *"html body div section article main td center details".split()])
_P_ENDERS = BLOCKS - {"body", "html", "head", "title", "option", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}

_WHITE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z]+")
_CUT_OFF = re.compile(r"<(?:[a-zA-Z/?]|!--)")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Element:
    """An open element; up is its parent. The sums are over the lines inside it."""

    __slots__ = ("depth", "furniture", "in_article", "in_main", "kept", "linked", "name", "rich", "size", "unseen", "up", "weight")

    def __init__(self, name: str, up: _Element | None, furniture: bool, unseen: bool):
        self.name, self.up = name, up
        self.depth = up.depth + 1 if up else 0
        self.furniture, self.unseen = furniture, unseen
        self.in_article = name == "article" or (up is not None and up.in_article)
        self.in_main = self.in_article or name == "main" or (up is not None and up.in_main)
        self.size = self.linked = self.weight = 0
        self.rich = self.kept = False


class _Line:
    __slots__ = ("chars", "element", "linked", "tags", "text")

    def __init__(self, text: str, tags: int, linked: int, element: _Element):
        self.text, self.tags, self.linked, self.element = text, tags, linked, element
        self.chars = 0 if element.furniture or 2 * linked > len(text) else len(text) - linked


def _words(value: str | None) -> set[str]:
    """Lower-case words of a class or id, sideBar being both one word and two."""
    given = value or ""
    return {*_SPLIT.split(given.lower()), *_SPLIT.split(_CAMEL.sub(" ", given).lower())}


class _Lines(HTMLParser):
    """Cuts a page into lines as its events arrive."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = _Element("", None, False, False)
        self.elements = [self.at]  # parents before children
        self.lines: list[_Line] = []
        self.pieces: list[str] = []
        self.tags = 0
        self.links = 0
        self.linked = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line and column numbers are not needed."""
        return j

    def _end_line(self) -> None:
        if not self.pieces:
            return
        text = _WHITE.sub(" ", "".join(self.pieces)).strip()
        if text:
            self.lines.append(_Line(text, self.tags, min(self.linked, len(text)), self._block()))
            self.tags = 0
        self.pieces, self.linked = [], 0

    def _block(self) -> _Element:
        """The innermost open block; an unseen or furniture inline element counts as one."""
        at = self.at
        while at.up is not None and at.name not in BLOCKS and not (at.furniture and not at.up.furniture):
            at = at.up
        return at

    def _is_furniture(self, name: str, attrs: list[tuple[str, str | None]]) -> bool:
        up = self.at
        if up.furniture or name in FURNITURE:
            return True
        if name == "article":
            # An article inside an article is a reader's comment on it.
            return up.in_article
        if name == "header" and not up.in_main:
            return True
        if not attrs or name in ("html", "body", "main", "p", "h1"):
            return False
        given = dict(attrs)
        if "hidden" in given or (given.get("aria-hidden") or "").lower() == "true":
            return True
        if (given.get("role") or "").strip().lower() in FURNITURE_ROLES:
            return True
        named = _words(given.get("class")) | _words(given.get("id"))
        if named & LAYOUT_WORDS:
            return False
        return bool(named & FURNITURE_WORDS) or ("header" in named and not up.in_main and not named & ARTICLE_WORDS)

    def _close(self, name: str, until: tuple[str, ...] = ()) -> bool:
        """Close the nearest open element of that name; False if there is none before ``until``."""
        at = self.at
        while at.up is not None and at.name != name:
            if at.name in until:
                return False
            at = at.up
        if at.up is None:
            return False
        while self.at is not at:
            self._leave()
        self._leave()
        return True

    def _leave(self) -> None:
        if self.at.name in BLOCKS or self.at.furniture and not self.at.up.furniture:
            self._end_line()
        if self.at.name == "a":
            self.links -= 1
        self.at = self.at.up

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.pieces.append(" ")
            self.tags += 1
            return
        if tag in VOID:
            if tag in BLOCKS:
                self._end_line()
            self.tags += not self.at.unseen
            return
        if tag in _P_ENDERS:
            self._close("p", ("article", "section", "div", "td", "th", "li", "body", "button"))
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        furniture = self._is_furniture(tag, attrs)
        if tag in BLOCKS or furniture and not self.at.furniture:
            self._end_line()
        unseen = self.at.unseen or tag in UNSEEN
        if not unseen:
            self.tags += 1
        self.links += tag == "a"
        self.at = _Element(tag, self.at, furniture, unseen)
        self.elements.append(self.at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # A slash at the end of a start tag means nothing, save on foreign elements.
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.unseen and self.at.name == tag and tag not in ("script", "style", "title", "textarea"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
        elif tag in BLOCKS:
            # Inline elements left open do not keep a block open, nor does a stray end tag close one.
            self._close(tag)
        else:
            self._close(tag, tuple(BLOCKS))

    def handle_data(self, data: str) -> None:
        if not self.at.unseen:
            self.pieces.append(data)
            if self.links > 0:
                self.linked += len(_WHITE.sub(" ", data).strip())

    def finish(self) -> list[_Line]:
        if _CUT_OFF.match(self.rawdata):
            # A tag or comment that never ends takes the rest of the page, as in browsers.
            self.rawdata = ""
        self.close()
        self._end_line()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with the kernel renormalised at both ends."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def two_means(values: np.ndarray) -> float:
    """The threshold midway between two clusters of ``values`` (Lloyd's rule from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(64):
        middle = (low + high) / 2
        upper = values > middle
        if not upper.any() or upper.all():
            break
        moved = float(values[~upper].mean()), float(values[upper].mean())
        if moved == (low, high):
            break
        low, high = moved
    return (low + high) / 2


def _regions(elements: list[_Element], share: float) -> list[_Element]:
    """The elements whose lines are the main text, by the content that each holds."""
    least = share * elements[0].weight
    for name in ("article", "main"):
        # Nested ones are furniture or lie in a chosen one. A page that lists several articles has all.
        held = [e for e in elements if e.name == name and e.weight]
        if held and sum(e.weight for e in held if not e.up.in_article) >= least:
            return held
    large = (e for e in elements if e.weight >= least and e.name in _CONTAINERS)
    return [max(large, key=lambda e: e.depth)]


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.8) -> str:
    """The main text of one page, a block a line.

    ``sigma`` is the width of the smoothing in lines. ``share`` is the part of the content
    lines' characters that an element must hold to be their region.
    """
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    lines = parser.finish()
    counted = np.array([x.chars > 0 for x in lines], dtype=bool)
    if not counted.any():
        return ""
    ratios = np.array([x.chars / max(1, x.tags) for x in lines])
    level = np.log1p(smoothed(ratios, sigma))
    content = counted & (level > two_means(level))
    if not content.any():
        content = counted
    for line, chosen in zip(lines, content.tolist(), strict=True):
        element = line.element
        element.size += len(line.text)
        element.linked += line.linked
        if chosen:
            element.weight += line.chars
            element.rich = True
    elements = parser.elements
    for element in reversed(elements):
        if (up := element.up) is not None:
            up.size += element.size
            up.linked += element.linked
            up.weight += element.weight
            up.rich |= element.rich
    regions = {id(e) for e in _regions(elements, share)}
    for element in elements:
        if id(element) in regions:
            element.kept = True
        elif element.up is not None:
            # Link lists without a content line are dropped whole; a linked paragraph stays.
            poor = not element.rich and 2 * element.linked > element.size and element.name != "p"
            element.kept = element.up.kept and not element.furniture and not poor
    return "\n".join(x.text for x in lines if x.element.kept)


def page_texts(pages: DataFrame, html: str = "html", sigma: float = 1.0, share: float = 0.8) -> DataFrame:
    """``pages`` with the main text of column ``html`` in its place: columns text and n_chars follow.

    Existing columns named text or n_chars are replaced.
    """
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    # pandas would turn long ids with nulls among them into doubles: Arrow keeps them.
    def extract(batches):
        for batch in batches:
            texts = pa.array([main_text(x.as_py(), sigma, share) for x in batch.column(html)], pa.string())
            arrays = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, texts], [*kept, "text"])

    fields = [f"`{c.replace('`', '``')}` {pages.schema[c].dataType.simpleString()}" for c in kept]
    read = pages.select(*[F.col(f"`{c.replace('`', '``')}`") for c in kept], F.col(html).cast("string").alias(html))
    return read.mapInArrow(extract, ", ".join([*fields, "text string"])).withColumn(
        "n_chars", F.char_length("text").cast("bigint")
    )

