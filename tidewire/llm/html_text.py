"""Main text of web pages by the distribution of text over lines.

A page is cut into lines at block elements.  Lines of page furniture (by element, role or the words of class and id)
are left out.  Each line weighs the length of its text outside of links, inside of an article or main element
the length of all its text; weights are summed over a sliding window of lines.  Between two dives, where the sum falls
to zero or an article begins or ends, all lines are kept if the sum rises above a limit there, the surge.  The limit is
a share of the largest sum, at most ``SURGE`` characters, so short pages have a surge too; inside of an article any
text is a surge.  If articles weigh as much as all other lines, they bound the search; an article that weighs less (a
teaser) does not.

Defined results: a null, empty or textless page gives the empty text; broken and unclosed markup is read as browsers
do in simple cases (an unclosed paragraph ends at the next block, unclosed furniture at the end of its parent, an
unclosed head at the first element or text that cannot be in it); time grows in proportion to the page, however deep;
repeated rows are read alike; an empty table gives an empty table.  Runs of white space in a block become one
space; blocks are joined by an empty line.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and characters in a window that make a surge at most.
WINDOW, SURGE, SHARE = 3, 80, 0.05
#: Elements whose content is not text.
_SILENT = frozenset("script style noscript template iframe svg math object canvas select textarea button head title".split())
#: Elements of page furniture.
_FURNITURE = frozenset("nav header footer aside form menu dialog".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr"
    " ul video audio".split()
)
#: Elements that may stand in a head.
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end closes blocks inside of them.
_CLOSING = _BLOCKS | _SILENT
#: Words in class, id or role that mark furniture.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adslot|banner|promo|promoted|sponsor|sponsored|cookie|cookies"
    r"|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|sidebar|side|aside|nav|navbar|navigation|menu|menus"
    r"|breadcrumb|breadcrumbs|pagination|pager|header|masthead|topbar|footer|bottombar|(?:user|reader)?comments?|commentlist|respond"
    r"|replies|discussion|disqus|related|recommended|recommendations|share|sharing|social|newsletter|subscribe|signup|login"
    r"|search|form|widget|toolbar|skip|copyright|legal|contentinfo|complementary|search)(?:\d*)(?=$|[\s_-])",
    re.I,
)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "title", "textarea", "noscript", "iframe")}
_SPACE = re.compile(r"\s+")
#: Elements that an opening element of the same family closes.
_FAMILY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Lines:
    """Lines of a page: text, characters outside of links, furniture or not, inside of an article or not."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, bool, bool]] = []
        self._parts: list[str] = []
        self._outside: list[str] = []  # parts, with a space for each part inside of a link

    def text(self, raw: str, in_link: bool) -> None:
        if raw:
            self._parts.append(raw)
            self._outside.append(" " if in_link else raw)

    def end(self, furniture: bool, article: bool) -> None:
        if self._parts:
            line = _plain(self._parts)
            if line:
                self.rows.append((line, len(_plain(self._outside)), furniture, article))
            self._parts, self._outside = [], []


def _plain(parts: list[str]) -> str:
    return _SPACE.sub(" ", html.unescape("".join(parts))).strip()


def _marked(attrs: str) -> bool:
    """Whether attributes mark an element as furniture or hidden."""
    for name, *values in _ATTRIBUTE.findall(attrs):
        value = next(filter(None, values), "")
        name = name.lower()
        if name in ("class", "id", "role") and _MARKS.search(_CAMEL.sub("-", value)):
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
    return False


class _Open:
    """Open elements of a page, each with what holds for the text inside of it."""

    def __init__(self) -> None:
        self._stack: list[tuple[str, bool, bool, int]] = []  # name, furniture, article, place of the nearest block
        self._places: dict[str, list[int]] = defaultdict(list)

    @property
    def name(self) -> str:
        return self._stack[-1][0] if self._stack else ""

    @property
    def block(self) -> str:
        """The nearest open block."""
        place = self._stack[-1][3] if self._stack else -1
        return self._stack[place][0] if place >= 0 else ""

    @property
    def state(self) -> tuple[bool, bool]:
        return self._stack[-1][1:3] if self._stack else (False, False)

    def push(self, name: str, furniture: bool, article: bool) -> None:
        place = len(self._stack) if name in _BLOCKS or not self._stack else self._stack[-1][3]
        self._places[name].append(len(self._stack))
        self._stack.append((name, furniture, article, place))

    def close(self, name: str) -> None:
        """Close the innermost element of a name with all inside of it; an inline one does not close blocks."""
        place = self._places[name][-1] if self._places[name] else -1
        if place < 0 or name not in _CLOSING and place < self._stack[-1][3]:
            return
        for held, *_ in self._stack[place:]:
            self._places[held].pop()
        del self._stack[place:]


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """Lines of a page in order."""
    out = _Lines()
    open_ = _Open()
    links = 0
    at = 0
    while at < len(page):
        match = _TOKEN.search(page, at)
        between = page[at : match.start()] if match else page[at:]
        if open_.name == "head" and not between.isspace() and between:
            open_.close("head")
            out.end(True, False)
        out.text(between, links > 0)
        if match is None:
            break
        at = match.end()
        if match["cdata"] is not None:
            out.text(match["cdata"], links > 0)
        if match["name"] is None:
            continue
        name, attrs = match["name"].lower(), match["attrs"]
        if match["close"]:
            if name == "a":
                links = max(0, links - 1)
            if name in _BLOCKS:
                out.end(*open_.state)
            open_.close(name)
            continue
        if open_.name == "head" and name not in _HEAD:
            out.end(*open_.state)
            open_.close("head")
        if name in _RAW_END and not attrs.endswith("/"):
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            out.text(" ", False)
        if name in _BLOCKS:
            out.end(*open_.state)
            links = 0
        if name in _VOID or attrs.endswith("/"):
            continue
        if name in _FAMILY:
            if open_.block in _FAMILY[name]:
                open_.close(open_.block)
        elif name in _BLOCKS and open_.name == "p":
            open_.close("p")
        furniture, article = open_.state
        own = name in _SILENT or _marked(attrs) and name not in ("html", "body", "article", "main")
        # A heading group at the top of an article belongs to it.
        own = own or name in _FURNITURE and not (name == "header" and article and not furniture)
        if name == "a":
            links += 1
        open_.push(name, furniture or own, article or name in ("article", "main"))
    out.end(*open_.state)
    return out.rows


def main_text(page: str | None) -> str:
    """The main text of a page."""
    rows = [(text, len(text) if article else size, article) for text, size, furniture, article in lines(page or "") if not furniture]
    inside = sum(weight for _, weight, article in rows if article)
    if inside and inside >= sum(weight for _, weight, article in rows if not article):
        rows = [row for row in rows if row[2]]
    runs = [list(run) for _, run in groupby(rows, key=itemgetter(2))]
    sums = [window_sums([weight for _, weight, _ in run]) for run in runs]
    largest = max(chain.from_iterable(sums), default=0)
    kept: list[str] = []
    for run, totals in zip(runs, sums, strict=True):
        limit = 0 if run[0][2] else min(SURGE, SHARE * largest)
        start, surge = 0, False
        for i, total in enumerate([*totals, 0]):
            surge = surge or total > limit
            if total == 0:  # dive
                if surge:
                    kept.extend(text for text, _, _ in run[start:i])
                start, surge = i + 1, False
    return "\n\n".join(kept)


def window_sums(weights: list[int]) -> list[int]:
    """Sums of the weights of each line and the lines after it in its window."""
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights))]


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` with ``text``, the main text, and ``n_chars``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[main_text(x) for x in batch.pop("html")])

    # Columns that are kept pass as text, so that nulls do not change numbers.
    named = pages.select(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keep)], F.col(html_column).alias("html"))
    fields = ", ".join(f"k{i} string" for i in range(len(keep)))
    found = named.mapInPandas(run, f"{fields}, text string")
    kinds = [pages.schema[c].dataType for c in keep]
    return found.select(
        *[F.col(f"k{i}").cast(kind).alias(c) for i, (c, kind) in enumerate(zip(keep, kinds, strict=True))],
        "text",
        F.length("text").cast("long").alias("n_chars"),
    )
