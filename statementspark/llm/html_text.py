"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams a page's events into lines, one for each block of text. A line's ratio is its
number of characters over the tags met in it, link text counting as tags. Ratios are smoothed with a Gaussian window, so that a
long line among short ones is damped and a short one among long ones is lifted, and lines above a threshold, the mean of the
page's smoothed ratios and ``spread`` of their standard deviations, are clustered. They select the content region: the
innermost container that holds all clustered lines. Its lines are the result, in page order; where no element holds them all, so are
the lines between the first and the last of them.

Tags, and words of class, id and role, are weights: a line in a menu, footer, sidebar, form, notice, advert or comment section
weighs nothing in the ratios, one in an ``article`` or ``main`` element double. They never empty a page: a mark counts only inside
the content region (there such parts are cut), an element that holds the page's heading, ``article`` or ``main`` is not marked by
its class, nor is one that is also called content, and where all text is marked, marks do not weigh.

A page is a row and is parsed whole in its task: no shuffle, memory for one Arrow batch. Time is linear in the page: open
elements are kept with the place of each name's last one, end tags that browsers imply close ``p``, ``li``, ``td``, ``head`` and the
like, and a line knows its element's number alone, elements being numbered as they open with the last number inside.

Null or empty html, or no text: the empty text. Broken or very deep markup is read as browsers do where the parser allows. Very
long pages: whole. Null or repeated ids, repeated rows: each row by itself. Equal ratios: all are clustered or none. Empty table: no
rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page at all.
NEVER = frozenset("head title script style noscript template button select textarea iframe svg canvas object".split())
#: Elements that may stand in a head; any other start tag, and text, ends a head that was left open.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Elements that mark boilerplate by their name.
MARKED = frozenset("nav footer aside form dialog menu".split())
#: Words of class, id and role that mark boilerplate, and those that speak against it.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|cookies?|comments?|consent|copyright|disqus|footer|gdpr|header|menu|nav|navbar|navigation"
    r"|newsletter|notice|pagination|popup|promo|promoted|related|replies|reply|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
CONTENT = re.compile(r"(?:^|[_-])(?:article|body|content|entry|main|page|story|text)(?:$|[_-])", re.IGNORECASE)
LACKS = re.compile(r"(?:no|has|with|without)[_-]", re.IGNORECASE)
#: An end tag of one of these closes all that was left open in it; other end tags stop there.
SCOPES = frozenset("article aside body div footer form header html main nav section table ul ol dl td th".split())
#: Elements that may be the content region; a paragraph or a list is only a part of one.
CONTAINERS = frozenset("article aside body div footer form header html main nav section td".split())
#: What a start tag closes by itself, if it stands open in the same scope.
IMPLIED = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody"),
}
#: Blocks before which an open paragraph ends.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIGMA = 1.0
SPREAD = 0.5
INSIDE = 2.0


class Lines(HTMLParser):
    """Blocks of text of one page: (text, tags, element); and of each element its parent, name, marks and the last number in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[int] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # where in ``open`` each name stands
        self.scopes: list[int] = []
        self.names: list[str] = []
        self.parents: list[int] = []
        self.lasts: list[int] = []
        self.marks: list[int] = []  # 0 none, 1 by a word, 2 by its name, 3 no text
        self.never = 0
        self.lines: list[tuple[str, int, int]] = []
        self.text: list[str] = []
        self.tags, self.links = 0, 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text and not self.never:
            self.lines.append((text, self.tags + self.links, self.open[-1] if self.open else -1))
        self.text, self.tags, self.links = [], 0, 0

    def _close(self, place: int) -> None:
        while len(self.open) > place:
            number = self.open.pop()
            name = self.names[number]
            self.lasts[number] = len(self.names) - 1
            self.places[name].pop()
            if name in SCOPES:
                self.scopes.pop()
            self.never -= self.marks[number] == 3

    def _close_name(self, name: str) -> None:
        """The last open element of this name in the present scope, and all in it."""
        places = self.places[name]
        if places and (not self.scopes or places[-1] >= self.scopes[-1]):
            self._close(places[-1])

    def _leave_head(self, whatever: bool = False) -> None:
        """Ends a head whose end tag was left out; ``whatever`` stands open in it."""
        head = self.places["head"]
        if head and (whatever or len(self.open) == head[-1] + 1):
            self._end_line()
            self._close(head[-1])

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_line()
        if tag == "body" or tag not in IN_HEAD:
            self._leave_head(tag == "body")
        self.tags += 1
        if tag in ENDS_P:
            self._close_name("p")
        for name in IMPLIED.get(tag, ()):
            if name in SCOPES:  # a cell is a scope: close it where it is the innermost one
                if self.scopes and self.names[self.open[self.scopes[-1]]] == name:
                    self._close(self.scopes[-1])
            else:
                self._close_name(name)
        if tag in VOID:
            return
        mark = 3 if tag in NEVER else 2 if tag in MARKED or (tag == "header" and not self.places["article"] and not self.places["main"]) else 0
        if not mark and tag not in ("html", "body"):
            words = [w for name, value in attrs if value and name in ("class", "id", "role", "aria-label") for w in value.split()]
            marked = [bool(MARKS.search(w)) for w in words]
            if any(marked):
                mark = int(any(m and not LACKS.match(w) for m, w in zip(marked, words, strict=True)) and not any(CONTENT.search(w) and not m for m, w in zip(marked, words, strict=True)))
        number = len(self.names)
        self.names.append(tag)
        self.parents.append(self.open[-1] if self.open else -1)
        self.lasts.append(number)
        self.marks.append(mark)
        self.never += mark == 3
        self.places[tag].append(len(self.open))
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        self.open.append(number)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        places = self.places[tag]
        if places and (tag in SCOPES or not self.scopes or places[-1] >= self.scopes[-1]):
            self._close(places[-1])

    def handle_data(self, data):
        if self.places["head"] and not data.isspace():
            self._leave_head()
        self.text.append(data)
        if self.open and self.names[self.open[-1]] == "a":
            self.links += len(data.split())

    def close(self):
        super().close()
        self._end_line()
        self._close(0)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the borders the window is cut and weighs what is there. No sigma: as they are."""
    if not sigma:
        return values
    radius = max(1, int(3 * sigma))
    window = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(values, radius)
    weight = np.convolve(np.pad(np.ones(len(values)), radius), window, "valid")
    return np.convolve(padded, window, "valid") / weight


def _marks(page: Lines) -> np.ndarray:
    """For each element the number of the nearest element around it, or itself, that marks boilerplate; -1: none."""
    n = len(page.names)
    marks, lasts, parents = np.array(page.marks, int), np.array(page.lasts, int), np.array(page.parents, int)
    # Words do not mark what holds the page's heading or article.
    anchor = np.append(0, np.cumsum([name in ("h1", "article", "main") and not mark for name, mark in zip(page.names, page.marks, strict=True)]))
    marks[(marks == 1) & (anchor[lasts + 1] > anchor[:-1])] = 0
    out = np.full(n, -1)
    for k in range(n):
        out[k] = k if marks[k] else out[parents[k]] if parents[k] >= 0 else -1
    return out


def extract(html: str | None, sigma: float = SIGMA, spread: float = SPREAD) -> str:
    """The main text of one page, blocks joined by newlines."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    lines = page.lines
    if not lines:
        return ""
    at = np.array([x[2] for x in lines])
    near = np.append(_marks(page), -1)[at]  # at -1: in no element
    ratio = np.array([len(x[0]) for x in lines], float) / np.maximum(1, np.array([x[1] for x in lines]))
    if (near < 0).any():
        ratio *= near < 0
    else:
        ratio *= np.array([page.marks[k] == 1 for k in near])
        if not ratio.any():
            return ""  # menus, footers and forms alone
    if len(page.names):
        held = np.zeros(len(page.names) + 1, bool)
        for k, name in enumerate(page.names):
            held[k] = name in ("article", "main") or (page.parents[k] >= 0 and held[page.parents[k]])
        ratio *= np.where(held[at], INSIDE, 1.0)
    smoothed = smooth(ratio, sigma)
    limit = smoothed.mean() + spread * smoothed.std()
    chosen = (np.minimum(smoothed, ratio) >= limit) & (ratio > 0)
    if not chosen.any():
        chosen = (smoothed >= smoothed[ratio > 0].max()) & (ratio > 0)
    first, last = np.flatnonzero(chosen)[[0, -1]]
    # The innermost element around all clustered lines: up from the first until it ends behind the last.
    low, high = at[chosen].min(), at[chosen].max()
    region = low
    while region >= 0 and (page.lasts[region] < high or page.names[region] not in CONTAINERS):
        region = page.parents[region]
    if region < 0:
        inside = np.arange(len(lines))
        inside = (inside >= first) & (inside <= last) if len(page.names) and page.names[0] == "html" else inside >= 0
    else:
        inside = (at >= region) & (at <= page.lasts[region])
    return "\n".join(lines[k][0] for k in np.flatnonzero(inside & (near <= region)))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = pa.array([extract(x) for x in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["page_id", "url", "text"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
