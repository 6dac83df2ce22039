"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped, and with it elements that are page furniture (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments); each block element gives one line, and each border of a container an empty one. A line weighs its
characters outside of links, more where an element marks it as a paragraph or as the article, little beside a marked article.
Weights summed over a sliding window of lines show where the text surges and dives, on every page by the same rule: what lies
between a rise and the next dive is kept where the sum reaches the threshold in between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Elements that start a new line, whose content isn't text, that are furniture, that are the article.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style template noscript iframe object svg math canvas textarea select button title head applet audio video map".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id attributes and of roles that mark furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer discussion "
    "footer header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
    "related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget "
    "complementary contentinfo search alert toc tags".split()
)
#: An article with one of these is furniture all the same.
REPLY_WORDS = frozenset("comment comments reply replies ad ads advert promo related sponsored".split())
ARTICLE_WORDS = frozenset(["article", "main", "articlebody"])
#: Elements that such a word can mark as the article; a heading or a paragraph is only a part of it.
CONTAINERS = frozenset("body center div section table tbody td tr".split())
#: What may stand in a head; anything else that starts ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: A `p` or list item that is still open ends where one of these starts.
_CLOSES = {"p": BLOCKS - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Containers: their borders are empty lines. Elements of running text.
BORDERS = frozenset("address article aside blockquote body details div dl fieldset figure footer form header li main nav ol section table td th tr ul".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption li dd dt td th".split())
#: Lines of a window, and empty lines at which the sum counts as dived.
WINDOW, DIVE = 3, 2
#: Characters by which a window surges at most, and the share of the page's largest window by which a lesser one does.
SURGE, SURGE_SHARE = 150.0, 0.3
#: Added to a line of running text and to one inside the marked article; factor of a line beside it.
PARAGRAPH_LIFT, ARTICLE_LIFT, BESIDE = 60.0, SURGE, 0.05
#: A line with a larger share of its characters in links weighs nothing, nor does a short line with a copyright sign.
LINK_SHARE, NOTICE_CHARS = 0.6, 200
_NOTICE = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b)", re.I)
#: HTML's white space and the no-break space, as str.split sees them.
_SPACE = re.compile(r"\s+")


#: A tag's name; quoted values, and the sign that ends the tag.
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_TAG_END = re.compile(r"""=\s*"[^"]*"|=\s*'[^']*'|>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_MARKS = ("class", "id", "role", "itemprop")
_RAW_ENDS = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


@dataclass(slots=True)
class Line:
    """Text of a block and its characters inside links; whether running text and inside a marked article. Empty: a border."""

    text: str
    linked: int = 0
    paragraph: bool = False
    article: bool = False


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", tag, attributes) and ("end", tag, "") in page order; comments, declarations and the content
    of raw elements are left out. Every character is looked at a bounded number of times, whatever the page holds."""
    at, n, last = 0, len(html), html.rfind(">")
    while at < n:
        sign = html.find("<", at)
        if sign < 0:
            yield "text", html[at:], ""
            return
        after = html[sign + 1 : sign + 2]
        if after in ("!", "?"):
            if sign > at:
                yield "text", html[at:sign], ""
            comment = html.startswith("<!--", sign)
            end = html.find("-->" if comment else ">", sign + (2 if comment else 1))
            if end < 0:
                return
            at = end + (3 if comment else 1)
            continue
        name = _NAME.match(html, sign + 1)
        if not name:
            yield "text", html[at : sign + 1], ""
            at = sign + 1
            continue
        if sign > at:
            yield "text", html[at:sign], ""
        if sign > last:
            return
        end = next((m.start() for m in _TAG_END.finditer(html, name.end()) if m[0] == ">"), -1)
        if end < 0:
            return
        tag, given, at = name[1].lower(), html[name.end() : end], end + 1
        if after == "/":
            yield "end", tag, ""
            continue
        yield "start", tag, given
        if tag in RAW and not given.endswith("/"):
            close = _RAW_ENDS[tag].search(html, at)
            if not close:
                return
            at = close.start()


@lru_cache(maxsize=4096)
def _marks(tag: str, given: str) -> tuple[bool, bool, bool]:
    """Of a start tag: is furniture by its element, class or state; is furniture by its element alone; may be the article."""
    attributes = {}
    for m in _ATTRIBUTE.finditer(given):
        value = m[2] or ""
        attributes.setdefault(m[1].lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    words = set(re.split(r"[^a-z0-9]+", " ".join(attributes.get(k, "") for k in _MARKS).lower()))
    marked = bool(words & FURNITURE_WORDS)
    article = (tag in ARTICLE and not words & REPLY_WORDS) or bool(words & ARTICLE_WORDS and tag in CONTAINERS and not marked)
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))
    page = tag in ("html", "body")
    return not page and (hidden or (marked and not article)), tag in FURNITURE, article


class _Lines:
    """The lines of a page; silent elements and furniture leave none."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool, bool, bool]] = []  # tag; inside: silent or furniture, article, link, paragraph
        self.counts: dict[str, int] = {}
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = 0

    def _state(self) -> tuple[bool, bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, False, False)

    def _flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                _, article, _, paragraph = self._state()
                self.lines.append(Line(text, self.linked, paragraph, article))
            self.parts, self.linked = [], 0

    def _border(self, n: int = 1) -> None:
        self.lines += [Line("")] * n

    def _pop(self) -> None:
        tag, _, article, _, _ = self.open.pop()
        self.counts[tag] -= 1
        if article and not self._state()[1]:
            self._border(DIVE)

    def _close(self, tag: str) -> None:
        while self.counts.get(tag):
            top = self.open[-1][0]
            self._pop()
            if top == tag:
                break

    def _end_head(self, anywhere: bool) -> None:
        """Ends a head that is still open, ``anywhere``: with what is open in it."""
        if self.counts.get("head") and (anywhere or self.open[-1][0] == "head"):
            self._close("head")

    def start(self, tag: str, given: str) -> None:
        if tag not in HEAD:
            self._end_head(tag == "body")
        if tag in BLOCKS:
            self._flush()
            if self.open and tag in _CLOSES.get(self.open[-1][0], ()):
                self._pop()
        if tag in VOID or given.endswith("/"):
            return
        out, article, link, paragraph = self._state()
        furniture, by_element, own_article = _marks(tag, given)
        out = out or tag in SILENT or furniture or (by_element and not (tag == "header" and article))
        inside = article or (own_article and not out)
        if not out and tag in BORDERS:
            self._border(DIVE if inside and not article else 1)
        self.open.append((tag, out, inside, link or tag == "a", tag in PARAGRAPHS or (paragraph and tag not in BLOCKS)))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if self.counts.get(tag):
            out = self._state()[0]
            self._close(tag)
            if tag in BORDERS and not out:
                self._border()

    def text(self, data: str) -> None:
        if data.isspace():
            if self.parts:
                self.parts.append(" ")
            return
        self._end_head(False)
        out, _, link, _ = self._state()
        if not out:
            data = unescape(data) if "&" in data else data
            self.parts.append(data)
            self.linked += len(data) if link else 0

    def of(self, html: str) -> list[Line]:
        act = {"text": lambda data, _: self.text(data), "start": self.start, "end": lambda tag, _: self.end(tag)}
        for kind, what, given in events(html):
            act[kind](what, given)
        self._flush()
        return self.lines


def weights_of(lines: list[Line]) -> list[float]:
    """Where what a page marks as its article holds more than half of its text outside of links, the marks count."""
    plain = [len(x.text) - (0 if x.article else x.linked) for x in lines]
    marked = 2 * sum(n for n, x in zip(plain, lines) if x.article) > sum(plain)
    out = []
    for x in lines:
        n = len(x.text)
        if not n:
            weight = 0.0
        elif marked and x.article:
            weight = n + ARTICLE_LIFT
        elif x.linked > LINK_SHARE * n or (n <= NOTICE_CHARS and _NOTICE.search(x.text)):
            weight = 0.0
        else:
            weight = (n - x.linked + PARAGRAPH_LIFT * x.paragraph) * (BESIDE if marked else 1.0)
        out.append(weight)
    return out


def surges(weights: list[float]) -> list[tuple[int, int]]:
    """Ranges of lines from a rise to the next dive in which the sum over ``WINDOW`` lines of the range reaches the threshold.

    The sum dives where ``DIVE`` lines in a row weigh nothing. The threshold is ``SURGE``, or ``SURGE_SHARE`` of the page's
    largest sum where that is less, so that a page of a few words still has its surge.
    """
    ranges, start, empty = [], None, 0
    for i, w in enumerate(weights):
        if w > 0:
            start, empty = i if start is None else start, 0
        elif start is not None and (empty := empty + 1) == DIVE:
            ranges.append((start, i - DIVE + 1))
            start, empty = None, 0
    if start is not None:
        ranges.append((start, len(weights) - empty))
    peaks = [max(sum(weights[i : min(i + WINDOW, end)]) for i in range(start, end)) for start, end in ranges]
    least = min(SURGE, SURGE_SHARE * max(peaks, default=0.0))
    return [r for r, peak in zip(ranges, peaks) if peak >= least]


def main_text(html: str | None) -> str:
    """The lines of all surges in page order, joined by one space; and lines of running text that lie between two surges."""
    lines = _Lines().of(html or "")
    weights = weights_of(lines)
    out, before = [], None
    for start, end in surges(weights):
        if before is not None:
            out += [lines[i].text for i in range(before, start) if weights[i] and lines[i].paragraph]
        out += [lines[i].text for i in range(start, end) if weights[i]]
        before = end
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page, from its whole html; null or empty html gives an empty text.

    A map over Arrow batches: nothing is shuffled; repeated rows stay, null ids and urls among them; other columns aren't read,
    whatever their names; an empty table gives an empty one. The time of a page is linear in its length, however its tags nest
    or stay open, and memory holds one batch of pages.
    """
    prepare(pages.sparkSession)
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(x) for x in batch.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)

