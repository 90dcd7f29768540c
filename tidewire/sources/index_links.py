"""Article cards and heading links of a Markdown list page.

Everything that depends on the order of links happens inside the row of the
document, on arrays already cut to the window, so that extraction needs no
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import first_date, page_date, page_date_parts, reference_year, without_dates
from tidewire.functions.sql import case, each, fold, fresh, keep, let, lit, sql_function
from tidewire.functions.text import (
    group1,
    markdown_text,
    matches,
    replaced,
    strip,
    strip_chars,
    unescape,
    without_images,
)
from tidewire.functions.urls import Url, canonical_url, item_link, resolve_from, url_parts, with_url
from tidewire.sources.landing import DOC, entry_rows
from tidewire.sources.scans import TAIL, markdown_links

# Link targets that are no articles, marks and words around titles.
_NO_ARTICLE = r"^(?:#|mailto:|javascript:)"
_IMAGE_FILE = r"(?i)^[^?]*\.(?:png|jpe?g|gif|webp|svg)(?:\?|$)"
_HEADING = r"(?U)#{2,6}\s+"
_BULLET = r"^[-*+]$"
_IMAGE_TITLE = r"!\[([^\]]+)\]"
_IMAGE_NUMBER = r"(?U)^Image\s+\d+\s*:\s*"
_SECTION_WORD = (
    r"(?iU)^(?:Announcements?|Product|Policy|Research|Company|Safety|Societal\s+Impacts?)\s+"
)
EDGE_MARKS = " -·|"
_NO_LINKS = "invalid Markdown index: no article links found"


def _links(page: Url) -> str:
    """Links with what several steps need, computed once for each.

    ``plain`` is the label without images, ``text`` the same as text; ``resolved`` is
    the target as written and ``place`` the target with references replaced.
    """

    def prepared(k: str) -> str:
        def described(plain: str, clean: str) -> str:
            return (
                f"named_struct('label', {k}.label, 'target', {k}.target, 'first', {k}.first, 'after', {k}.after,"
                f" 'lead', {k}.lead, 'tail', {k}.tail, 'plain', {plain}, 'text', {markdown_text(plain)},"
                f" 'clean', {clean}, 'resolved', {resolve_from('page_url', page, k + '.target')},"
                f" 'place', {resolve_from('page_url', page, clean)})"
            )

        return let(
            without_images(f"{k}.label"),
            lambda plain: let(unescape(strip(f"{k}.target")), lambda clean: described(plain, clean)),
        )

    return each("links", prepared)


def _leads_below(page: Url, link: Url) -> str:
    base = f"rtrim('/', {page.path})"
    return f"{link.host} = {page.host} AND {base} <> '' AND startswith({link.path}, concat({base}, '/'))"


def _is_web(link: Url) -> str:
    return f"{link.scheme} IN ('http', 'https') AND {link.host} <> ''"


def _is_candidate(k: str, page: Url) -> str:
    """Cards, headings and dated links; a bad date or URL stays and becomes an issue.

    The link leads to another host, or below the path of the page.
    """
    marked = (
        f"contains({k}.label, '![') OR {matches(k + '.lead', '^#{2,6}$')} OR {matches(k + '.plain', _HEADING)}"
        f" OR {first_date(k + '.text')}.month IS NOT NULL"
    )
    leads = with_url(
        f"{k}.place",
        lambda link: f"coalesce({_is_web(link)} AND ({link.host} <> {page.host} OR ({_leads_below(page, link)})), false)",
    )
    return (
        f"{k}.clean <> '' AND NOT {matches(k + '.clean', _NO_ARTICLE)} AND NOT {matches(k + '.clean', _IMAGE_FILE)}"
        f" AND ({marked}) AND ({k}.place IS NULL OR {leads})"
    )


# --------------------------------------------------------------------------
# Titles
# --------------------------------------------------------------------------


def _image_name(c: str) -> str:
    return strip(replaced(c, _IMAGE_NUMBER, ""))


@sql_function
def image_titles(markdown: str) -> str:
    """Distinct image titles of the page, in order."""
    cleaned = each(
        f"regexp_extract_all({markdown}, {lit(_IMAGE_TITLE)}, 1)", lambda t: markdown_text(_image_name(t))
    )
    return f"array_distinct({keep(cleaned, lambda t: f'{t} <> {lit('')}')})"


@sql_function
def longest(texts: str) -> str:
    """First of the longest texts, ``''`` for none."""
    return fold(texts, "''", lambda best, t: f"if(length({t}) > length({best}), {t}, {best})")


@sql_function
def shortest(texts: str) -> str:
    """First of the shortest non-empty texts, ``''`` for none."""
    return fold(
        texts,
        "''",
        lambda best, t: f"if({t} <> '' AND ({best} = '' OR length({t}) < length({best})), {t}, {best})",
    )


def _prefix_of(text: str, titles: str) -> str:
    plain = replaced(without_dates(text), r"(?iU)^(?:Featured\s+)?#{2,6}\s+", "")
    return let(
        f"lower({plain})",
        lambda start: longest(keep(titles, lambda t: f"startswith({start}, lower({t}))")),
    )


@sql_function
def prefix_title(label: str, titles: str) -> str:
    """The longest image title with which the label begins, ignoring case."""
    return _prefix_of(markdown_text(label), titles)


def _title_of(label: str, plain: str, text: str, published: str) -> str:
    def choose(image: str) -> str:
        heading = without_dates(markdown_text(group1(plain, r"(?sU)#{2,6}\s+(.+)")), published)
        rest = strip_chars(without_dates(text, published), EDGE_MARKS)
        return case(
            (f"{image} <> '' AND {published} = ''", image),
            default=let(
                heading, lambda h: case((f"{h} <> ''", h), (f"{image} <> ''", image), default=rest)
            ),
        )

    return let(markdown_text(_image_name(group1(label, _IMAGE_TITLE))), choose)


@sql_function
def label_title(label: str, published: str) -> str:
    """Title from the link label: image, heading, else the text without its date."""
    return let(
        without_images(label), lambda plain: _title_of(label, plain, markdown_text(plain), published)
    )


@sql_function
def slug_title(title: str, target: str) -> str:
    """Cut a flattened "title description" text after the words of the URL slug."""
    slug = with_url(target, lambda u: f"substring_index(rtrim('/', {u.path}), '/', -1)")
    safe = replaced(slug, "%(?![0-9A-Fa-f]{2})", "%25")
    words = f"regexp_extract_all(lower(url_decode(replace({safe}, '+', '%2B'))), '[a-z0-9]+', 0)"

    def cut(found: str) -> str:
        # Each atomic step runs to the next occurrence of one word.
        steps = each(
            found, lambda w: f"concat({lit('(?>.*?(?<![a-z0-9])')}, {w}, {lit('(?![a-z0-9]))')})"
        )
        pattern = f"concat({lit('(?is)^(')}, array_join({steps}, ''), ')')"
        return case((f"size({found}) > 0", f"regexp_extract({title}, {pattern}, 1)"), default="''")

    return let(let(words, cut), lambda t: f"if({t} = '', {title}, {strip(t)})")


def _hints(links: str, page: Url) -> str:
    """``array<struct<key,label>>``: plain list links below the page, by canonical URL."""

    def hint(k: str) -> str:
        label = let(
            f"coalesce({page_date(first_date(k + '.text'))}, '')",
            lambda d: f"if({d} <> '', {replaced(without_dates(k + '.text', d), _SECTION_WORD, '')}, {k}.text)",
        )
        return f"named_struct('key', {canonical_url(k + '.resolved')}, 'label', {label})"

    below = lambda k: with_url(
        f"{k}.place", lambda link: f"coalesce({_is_web(link)} AND {_leads_below(page, link)}, false)"
    )
    plain = keep(
        links,
        lambda k: f"{matches(k + '.lead', _BULLET)} AND NOT {matches(k + '.label', _HEADING)} AND {below(k)}",
    )
    return keep(each(plain, hint), lambda h: f"{h}.label <> ''")


def _rest_of(text: str, title: str, published: str) -> str:
    left = replaced(without_dates(text, published), r"(?U)^#{2,6}\s*", "")
    return let(
        left,
        lambda t: strip_chars(
            f"if(startswith({t}, {title}), substr({t}, length({title}) + 1), {t})", EDGE_MARKS
        ),
    )


@sql_function
def description(label: str, title: str, published: str) -> str:
    """What is left of the label besides date, heading marks and title."""
    return _rest_of(markdown_text(label), title, published)


# --------------------------------------------------------------------------
# Years
# --------------------------------------------------------------------------


def with_years(links: str, first_year: str) -> str:
    """Give dates without a year the year the page order implies.

    Pages list the newest first: going down from January or February to October or later
    means the year before.  An explicit year starts anew.  Dates that do not exist
    (``published`` NULL) change nothing.
    """
    carried = ("label", "target", "plain", "text", "resolved")
    kept = "array<struct<" + ",".join(f"{c}:string" for c in carried) + ",published:string>>"

    def step(acc: str, link: str) -> str:
        p = f"{link}.parts"

        def emit(year: str, date: str) -> str:
            valid = f"({date} IS NOT NULL AND {p}.month IS NOT NULL)"
            fields = ", ".join(f"'{c}', {link}.{c}" for c in carried)
            entry = f"named_struct({fields}, 'published', {date})"
            return (
                f"named_struct('year', if({valid} AND {p}.year IS NOT NULL, {p}.year, {year}),"
                f" 'month', if({valid}, {p}.month, {acc}.month),"
                f" 'done', concat({acc}.done, array({entry})))"
            )

        # The date is first read with the year so far; only if it exists there does
        # the order of months count.
        rollover = (
            f"{p}.year IS NULL AND {acc}.month <= 2 AND {p}.month >= 10"
            f" AND {page_date(p, acc + '.year')} IS NOT NULL"
        )
        year = f"if(coalesce({rollover}, false), {acc}.year - 1, {acc}.year)"
        return let(year, lambda y: let(page_date(p, y), lambda d: emit(y, d)))

    start = (
        f"named_struct('year', cast({first_year} AS INT), 'month', cast(NULL AS INT),"
        f" 'done', cast(array() AS {kept}))"
    )
    return f"{fold(links, start, step)}.done"


def _window(candidates: str) -> str:
    """The first ``window_size`` links with the date found in label and nearby text."""
    k, i = fresh("k"), fresh("i")
    # Text after a link belongs to it up to the next link, at most 100 characters.
    indexed = f"transform({candidates}, ({k}, {i}) -> named_struct('k', {k}, 'i', {i}))"

    def dated(w: str) -> str:
        room = f"coalesce(get({candidates}, {w}.i + 1).first - {w}.k.after, {TAIL})"
        tail = f"substring({w}.k.tail, 1, int(least({TAIL}, {room})))"
        return (
            f"named_struct('label', {w}.k.label, 'target', {w}.k.target, 'plain', {w}.k.plain,"
            f" 'text', {w}.k.text, 'resolved', {w}.k.resolved,"
            f" 'parts', {page_date_parts(f'concat({w}.k.plain, {tail})')})"
        )

    return each(f"slice({indexed}, 1, window_size)", dated)


def _titled(k: str) -> str:
    """Look titles up inside the page row; only window entries are looked at."""
    hint = let(
        canonical_url(f"{k}.resolved"),
        lambda key: shortest(each(keep("hints", lambda h: f"{h}.key = {key}"), lambda h: f"{h}.label")),
    )
    known = f"{k}.published IS NOT NULL AND {k}.resolved IS NOT NULL"

    def chosen(parsed: str) -> str:
        cut = f"if({matches(k + '.plain', r'(?U)####\s+')}, {slug_title(parsed, k + '.target')}, {parsed})"
        return let(
            _prefix_of(f"{k}.text", "image_titles"),
            lambda image: f"if({image} <> '', {image}, {shortest(f'array({hint}, {cut})')})",
        )

    # A broken entry is named by its label alone.
    own = _title_of(f"{k}.label", f"{k}.plain", f"{k}.text", f"if({known}, {k}.published, '')")
    return let(
        own,
        lambda parsed: f"named_struct('label', {k}.label, 'target', {k}.target, 'published', {k}.published,"
        f" 'text', {k}.text, 'resolved', {k}.resolved, 'fallback', {parsed},"
        f" 'title', if({known}, {chosen(parsed)}, ''))",
    )


def index_link_entries(docs: DataFrame) -> DataFrame:
    page = Url("page")
    linked = (
        docs.withColumn("links", markdown_links("text"))
        .withColumn("page", F.expr(url_parts("page_url")))
        .selectExpr(
            *DOC,
            "source_error",
            "page",
            f"{_links(page)} AS links",
            f"{reference_year('text')} AS year",
            f"{image_titles('text')} AS image_titles",
        )
        .withColumn("candidates", F.expr(keep("links", lambda k: _is_candidate(k, page))))
    )
    rows = (
        linked.withColumn(
            "source_error",
            F.expr(f"coalesce(source_error, if(size(candidates) = 0, {lit(_NO_LINKS)}, NULL))"),
        )
        .selectExpr(
            *DOC,
            "source_error",
            "image_titles",
            f"CASE WHEN source_error IS NULL THEN {with_years(_window('candidates'), 'year')} END AS entries",
            f"CASE WHEN source_error IS NULL THEN {_hints('links', page)} END AS hints",
        )
        .withColumn("entries", F.expr(each("entries", _titled)))
        .select(*DOC, "source_error", F.posexplode_outer("entries").alias("index", "k"))
        .selectExpr(
            *DOC,
            "source_error",
            "index + 1 AS pos",
            "k.*",
            f"{item_link('k.target', 'page_url', 'allowed_hosts')} AS checked",
        )
    )
    error = case(
        ("source_error IS NOT NULL", "NULL"),
        ("published IS NULL", "'invalid page publication date'"),
        ("resolved IS NULL", "'Invalid IPv6 URL'"),
        ("title = ''", "'empty article title'"),
        default="checked.error",
    )
    return entry_rows(
        rows,
        error=error,
        issue_title="if(title <> '', title, fallback)",
        issue_url="coalesce(resolved, target)",
        item_id=canonical_url("checked.url"),
        title="title",
        content=_rest_of("text", "title", "published"),
        url="checked.url",
        published_at="published",
    )
