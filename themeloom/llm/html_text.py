"""Main text of web pages: parser events, text-to-tag ratios, smoothing and a threshold between two clusters.

The standard library's streaming parser turns a page into lines: runs of text between block elements. The ratio of text to tags of each line is
smoothed over its neighbours with a Gaussian, and the threshold between a low and a high cluster of the smoothed values marks
content. A region of content grows by a few lines on either side, so that headings and short paragraphs are not lost; longer runs of
lines below the threshold are no content, inside an article element too. Elements that never hold the article (menus, footers, forms and the
like) are left out first, and where a page has article elements, regions outside of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from themeloom.llm.common import slices, table

SIGMA = 1.0
# Text inside these is never article text.
DROPPED = frozenset(
    "script style head title nav header footer aside form button select textarea input noscript template iframe object svg canvas "
    "dialog menu label option fieldset".split()
)
# Elements whose content the parser gives as text though it isn't any, or that have no content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure "
    "figcaption address details summary hr br center".split()
)
CONTAINERS = frozenset(("article", "main"))
# Parts of class, id and role names that stand for page furniture, and parts that say nothing about it. A name counts if it has one of the
# former and no part beside these: "site-header" does, "entry-header" and "share-price" do not.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "aside footer masthead header cookie cookies consent notice notices alert popup modal newsletter subscribe signup login share sharing "
    "social related recommended comment comments replies respond disqus pagination pager toolbar widget search searchbox complementary "
    "contentinfo".split()
)
NEUTRAL = frozenset(
    "site page main global top bottom left right primary secondary sub box bar block wrap wrapper container outer inner list item items area "
    "section group links posts buttons form js".split()
)
# What a start tag ends that was left open, up to the element that keeps it in: an item by the next one, and so on.
ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "a": (("a",), ()),
} | {block: (("p",), ("td", "th", "li", "div", "article", "main", "section", "body")) for block in BLOCKS - {"br", "html", "body", "li", "dt", "dd", "tr", "td", "th"}}
# Lines that a region of content takes in on either side, and characters a tag above which a line is never tag-dense: inside an article
# element, whose short paragraphs are its text, and in pages without one.
REACH = 3
DENSE, DENSE_OPEN = 2.0, 10.0
# Two clusters of smoothed logarithms that are less apart are one.
APART = 1.0


@dataclass
class Line:
    """A run of text between block elements."""

    text: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    dropped: bool = False
    container: int = 0

    @property
    def words(self) -> str:
        return " ".join("".join(self.text).split())


class LineParser(HTMLParser):
    """Collects a page's lines from its parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # element, dropped, container, link
        self.places: dict[str, list[int]] = {}  # where the open elements of each name are
        self.links = 0
        self.containers = 0
        self.line = Line()

    def _around(self) -> tuple[bool, int]:
        return self.open[-1][1:3] if self.open else (False, 0)

    def _next(self) -> None:
        self.lines.append(self.line)
        dropped, container = self._around()
        self.line = Line(dropped=dropped, container=container)

    def _last(self, *names: str) -> int:
        """The innermost open element of some names; -1 without one."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS:
            ended, keepers = ENDS[tag]
            at = self._last(*ended)
            if at >= 0 and at > self._last(*keepers, *CONTAINERS):
                self._cut(at)
        if tag in VOID:
            if tag in BLOCKS:
                self._next()
            self.line.tags += 1
            return
        dropped, container = self._around()
        named = dropped or tag in DROPPED or self._furniture(tag, attrs)
        if tag in CONTAINERS and not named and not container:
            self.containers += 1
            container = self.containers
        link = tag == "a" and any(name == "href" for name, _ in attrs)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, named, container, link))
        if tag in BLOCKS or tag in CONTAINERS or named != dropped:
            self._next()
        self.links += link
        self.line.tags += 1

    @staticmethod
    def _furniture(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in ("html", "body", "article", "main"):
            return False
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for word in value.lower().replace("_", "-").split():
                    parts = {part.strip("0123456789") for part in word.split("-")} - {""}
                    if parts & FURNITURE and parts <= FURNITURE | NEUTRAL:
                        return True
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True
        return False

    def _cut(self, at: int) -> None:
        """Ends an open element and all that is open inside it."""
        before, block = self._around(), False
        for name, _, _, link in reversed(self.open[at:]):
            self.places[name].pop()
            self.links -= link
            block = block or name in BLOCKS or name in CONTAINERS
        del self.open[at:]
        if block or before != self._around():
            self._next()

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        at = self._last(tag)
        # An inline element that was never closed does not hold back the end of what is around it, but an
        # end tag without a start closes nothing beyond the next container.
        if at >= 0 and (tag in ("body", "html") or at >= self._last(*CONTAINERS)):
            self._cut(at)
        self.line.tags += 1

    def handle_data(self, data: str) -> None:
        self.line.text.append(data)
        if self.links:
            self.line.linked += len(data.strip())

    def finish(self) -> list[Line]:
        self.close()
        self.lines.append(self.line)
        return self.lines


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; beyond the ends the weights are renormalised."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    ones = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / ones


def threshold(values: np.ndarray, least_gap: float = APART) -> float:
    """The middle between the means of a low and a high cluster (two-means from the extremes); below all values if these are not apart."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        above = values > (low + high) / 2
        if not above.any() or above.all():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high - low >= least_gap else float(values.min())


def grown(content: np.ndarray, allowed: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Content with up to ``reach`` allowed lines next to it on either side; a run of allowed lines between two regions has to be that short."""
    out = content.copy()
    for step in (1, -1):
        near = content[::step].copy()
        for _ in range(reach):
            near[1:] |= near[:-1] & allowed[::step][1:]
        out |= near[::step]
    return out


def main_text(html: str, sigma: float = SIGMA, reach: int = REACH, dense: float = DENSE, dense_open: float = DENSE_OPEN) -> str:
    """The article's text of one page; empty if it has none."""
    parser = LineParser()
    parser.feed(html)
    lines = [line for line in parser.finish() if not line.dropped]
    texts = [line.words for line in lines]
    keep = [i for i, text in enumerate(texts) if text]
    if not keep:
        return ""
    lines, texts = [lines[i] for i in keep], [texts[i] for i in keep]
    # Logarithms, so that one long paragraph does not make all others low.
    ratio = np.array([(len(text) - min(line.linked, len(text))) / max(1, line.tags) for line, text in zip(lines, texts)])
    score = smoothed(np.log1p(ratio), sigma)
    container = np.array([line.container for line in lines])
    content = score >= np.minimum(threshold(score), np.log1p(np.where(container > 0, dense, dense_open)))
    inside = np.isin(container, np.unique(container[content & (container > 0)])) if (content & (container > 0)).any() else np.ones(len(lines), bool)
    unlinked = np.array([2 * line.linked <= len(text) for line, text in zip(lines, texts)])
    # Regions grow inside the article elements that hold content; what is outside of all of these is not part of the article.
    content &= inside & (unlinked | (container > 0))
    kept = grown(content, inside & unlinked, reach)
    return " ".join(text for text, good in zip(texts, kept) if good)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``<id, url, text>`` of every row; a null or empty page and one without an article have an empty text.

    White space inside a block becomes one space, and blocks are joined in page order by one space. Rows with null or repeated ids
    stay; an empty table gives an empty result; other columns are ignored. Pages are independent, so nothing is shuffled.
    """
    narrow = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    return narrow.mapInArrow(_extract, "id bigint, url string, text string")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))
