"""The main text of web pages by the distribution of text over lines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SURGE = 100

# Element names of HTML by what they mean for a text.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title iframe xmp noembed noframes".split())
_BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
_NO_TEXT = set(
    "script style textarea title iframe xmp noembed noframes head noscript template nav aside footer dialog menu search "
    "button select datalist svg object audio video canvas".split()
)
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words in a class or an id that name what is not part of an article.
_HINTS = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination masthead topbar header footer colophon copyright "
    "sidebar aside widget widgets cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe "
    "signup login search".split()
)
_READERS = set("comment comments commentlist disqus respond replies".split())
_UNLESS = set("no has with without".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z|[\"'][^>]*+(?:>|\Z))"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[a-z]+")
_RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.IGNORECASE)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in _RAW}
# Which open elements a start tag ends, and where the search for them stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

_SHOWN, _SOFT, _HARD = 0, 1, 2


@dataclass
class Line:
    """The text of a block, how much of it is no link, and whether the page marks it as its article."""

    text: str = ""
    own_chars: int = 0
    marked: str = ""


@dataclass
class _Open:
    name: str
    hidden: int
    marked: str


def _hidden_by(name: str, attributes: str, marked: str) -> int:
    """What an element's name, role, classes and id say about its text."""
    if name in _NO_TEXT:
        return _HARD
    found = _SOFT if name == "form" or (name == "header" and not marked) else _SHOWN
    if name in ("html", "body") or "=" not in attributes:
        return found
    for kind, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        if kind.lower() == "role":
            if _ROLES.intersection(value.lower().split()):
                found = max(found, _SOFT)
            continue
        for entry in value.split():
            words = _WORD.findall(_CAMEL.sub(" ", entry).lower())
            if not words or words[0] in _UNLESS or (name in ("article", "main") and len(words) > 1):
                continue
            if _READERS.intersection(words):
                return _HARD
            hints = _HINTS.intersection(words)
            if hints and not (marked and hints == {"header"}):
                found = max(found, _SOFT)
    return found


@dataclass
class _Page:
    """One pass over a page's tags that collects its lines; a part left out leaves ``gap`` blank lines."""

    gap: int
    lines: list[Line] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    count: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    in_link: bool = False

    @property
    def hidden(self) -> int:
        return self.stack[-1].hidden if self.stack else _SHOWN

    @property
    def marked(self) -> str:
        return self.stack[-1].marked if self.stack else ""

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and not (not self.marked and _RIGHTS.match(text)):
            self.lines.append(Line(text, max(0, len(text) - self.link_chars), self.marked))
        self.parts, self.link_chars = [], 0

    def blank(self) -> None:
        self.lines += [Line() for _ in range(self.gap)]

    def text(self, raw: str) -> None:
        if self.hidden == _SHOWN:
            decoded = unescape(raw)
            self.parts.append(decoded)
            if self.in_link:
                self.link_chars += len(" ".join(decoded.split()))

    def pop_to(self, place: int) -> None:
        if any(element.name in _BLOCKS for element in self.stack[place:]):
            self.flush()
        while len(self.stack) > place:
            self.count[self.stack.pop().name] -= 1

    def start(self, name: str, attributes: str) -> None:
        block = name in _BLOCKS
        if block:
            self.flush()
            if self.count["p"] and name != "br":
                self._end_within({"p"}, _BLOCKS - {"p"})
        if name in _ENDS:
            self._end_within(*_ENDS[name])
        if name == "a":
            self.in_link = True
        if name in _VOID:
            return
        own = _hidden_by(name, attributes, self.marked)
        if not (block or own or self.count[name]):
            return
        hidden, marked = max(own, self.hidden), self.marked
        if name in ("article", "main") and own == _SHOWN:
            # what the page calls its article is shown, whatever the boxes around it are called
            hidden = _SHOWN if self.hidden < _HARD else _HARD
            marked = "article" if "article" in (name, marked) else name
        if block and hidden and not self.hidden:
            self.blank()
        self.stack.append(_Open(name, hidden, marked))
        self.count[name] += 1

    def _end_within(self, names: set[str], stop: set[str]) -> None:
        if not any(self.count[name] for name in names):
            return
        place, found = len(self.stack), None
        while place and self.stack[place - 1].name not in stop:
            place -= 1
            if self.stack[place].name in names:
                found = place
        if found is not None:
            self.pop_to(found)

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if name in _BLOCKS:
            self.flush()
        if not self.count[name]:
            return
        place = len(self.stack) - 1
        while self.stack[place].name != name:
            if name not in _BLOCKS and self.stack[place].name in _BLOCKS:
                return
            place -= 1
        self.pop_to(place)


def page_lines(html: str, gap: int = WINDOW) -> list[Line]:
    """The lines of a page without its markup: a line per block, ``gap`` blank ones for each part left out."""
    page, at = _Page(gap), 0
    while True:
        tag = _TAG.search(html, at)
        page.text(html[at : tag.start()] if tag else html[at:])
        if tag is None:
            break
        at, name = tag.end(), (tag["name"] or "").lower()
        if not name:
            continue
        if tag["end"]:
            page.end(name)
            continue
        page.start(name, tag["rest"])
        if name in _RAW:
            close = _RAW_END[name].search(html, at)
            at = close.start() if close else len(html)
    page.flush()
    return page.lines


def surges(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """First line and line past the end of each stretch of text.

    The distribution is the sum of weights over ``window`` lines from each line on. A stretch begins at the surge point,
    the first line that weighs and from which that sum is over ``surge``, and ends at the dive point, from which the sum
    is nothing.
    """
    sums, total = [0] * len(weights), 0
    for at in range(len(weights) - 1, -1, -1):
        total += weights[at] - (weights[at + window] if at + window < len(weights) else 0)
        sums[at] = total
    found, begin = [], None
    for at, size in enumerate(sums):
        if begin is None and size > surge and weights[at]:
            begin = at
        elif begin is not None and not size:
            found.append((begin, at))
            begin = None
    if begin is not None:
        found.append((begin, len(weights)))
    return found


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> tuple[str, list[tuple[int, int]]]:
    """The main text of a page and its stretches of lines.

    Where the page marks an article, or else a main part, only lines in it weigh, and any text is a surge. Without
    such marks a line weighs what of it is no link, and a stretch must reach ``surge`` characters in ``window`` lines;
    if none does, the densest place counts.
    """
    lines = page_lines(html, window)
    for mark in ("article", "main"):
        weights = [len(line.text) if line.marked == mark or line.marked == "article" else 0 for line in lines]
        if any(weights):
            stretches = surges(weights, window, 0)
            break
    else:
        weights = [line.own_chars for line in lines]
        densest = max((sum(weights[at : at + window]) for at in range(len(weights))), default=0)
        stretches = surges(weights, window, min(surge, densest - 1)) if densest else []
        mark = ""
    kept = [
        line.text
        for begin, end in stretches
        for line, weight in zip(lines[begin:end], weights[begin:end])
        if line.text and (weight or not mark)
    ]
    return " ".join(kept), stretches


def _extracted(keys: int, window: int, surge: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(html or "", window, surge) for html in batch.column(keys).to_pylist()]
            columns = [*batch.columns[:keys]]
            columns.append(pa.array([text for text, _ in found], pa.string()))
            columns.append(pa.array([len(text) for text, _ in found], pa.int64()))
            spans = [[{"surge": begin, "dive": end} for begin, end in spans] for _, spans in found]
            columns.append(pa.array(spans, schema))
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return run


def extract(
    pages: DataFrame, keep: list[str] | None = None, html: str = "html", window: int = WINDOW, surge: int = SURGE
) -> DataFrame:
    """The columns ``keep`` of each page (by default ``page_id, url``) with ``text``, ``n_chars`` and ``stretches``.

    Each page by itself, whole, in one pass and without a shuffle. Markup is stripped into lines, one per block; menus,
    headers, footers, side bars, notices, adverts, forms, scripts, styles and reader comments leave blank lines in their
    place. The lengths of lines are summed over sliding windows, surge and dive points are located, and the text between
    them is kept: character references decoded, white space in a block one space, blocks joined by one space.
    ``n_chars`` counts code points; ``stretches`` holds the line numbers of each surge and dive.

    A null, empty or textless page has an empty text. Repeated rows stay, each with its own result; columns not in
    ``keep`` are not read, so other columns may have any names. No pages give no rows. Unclosed elements
    end where the next block or the page ends them, unclosed comments with the page, unclosed quotes with their tag. A ``header`` within an article is part of it.
    """
    keep = keep or ["page_id", "url"]
    places = pa.list_(pa.struct([("surge", pa.int32()), ("dive", pa.int32())]))
    rows = pages.select(*[pages[f"`{c}`"].alias(f"c{i}") for i, c in enumerate([*keep, html])])
    kinds = ", ".join(f"c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    more = [f"c{len(keep)} string", f"c{len(keep) + 1} long", f"c{len(keep) + 2} array<struct<surge:int,dive:int>>"]
    found = rows.mapInArrow(_extracted(len(keep), window, surge, places), ", ".join([kinds, *more]))
    return found.toDF(*keep, "text", "n_chars", "stretches")
