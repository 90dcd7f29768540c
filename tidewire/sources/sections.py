"""Dated sections and cards of rolling Markdown pages.

A page is cut in front of every heading (and card tag).  The pieces become rows,
and what depends on earlier or later pieces is a window over the page.  A page is
never larger than the size gate, and all windows of a page share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.dates import page_date, page_date_parts
from tidewire.functions.identity import content_key
from tidewire.functions.sql import case, each, keep, let, lit, sql_function
from tidewire.functions.text import (
    clean_html,
    group1,
    html_attributes,
    markdown_body_text,
    markdown_text,
    matches,
    replaced,
    strip,
    strip_chars,
)
from tidewire.functions.urls import (
    Url,
    before_fragment,
    canonical_url,
    checked_link,
    item_link,
    link_value,
    resolve,
    resolve_from,
    url_parts,
)
from tidewire.sources.landing import DOC, entry_rows
from tidewire.sources.scans import markdown_links

# Headings, date headings and card tags.
_SECTION_START = r"(?dm)^(?=#{2,4}[ \t]+[^ \t\n])"
_SECTION_HEADING = r"(?d)^#{2,4}[ \t]+([^\n]+?)[ \t]*(?:\n|\z)"
_DATE_LABEL = r"(?iU)^date\s*:"
_TITLE_HEADING = r"(?dmU)^#{2,6}\s+(.+)$"
_CARD_TOKEN = r"(?idm)(?=^#{2,6}\s)|(?=<Card\b)|(?=</Card\s*>)"
_CARD_HEADING = r"(?dmU)\A#{2,6}\s+(.+?)\s*$"
_CARD_OPEN = r"(?i)^<Card\b([^>\r\n]*)>"
_BODY_EDGE = " \n*-"

_PAGE = ("source", "page_no")


_ZERO_WIDTH = "\u200b"
_SECTION_COLUMNS = ("source_error", "raw", "heading", "published", "kind")
_CARD_COLUMNS = ("source_error", "nearest", "token", "piece")


def _pieces(docs: DataFrame, pattern: str) -> DataFrame:
    cut = F.split(F.coalesce("text", F.lit("")), pattern)
    return docs.select(*DOC, "source_error", F.posexplode(cut).alias("n", "piece"))


def _by_page() -> Window:
    return Window.partitionBy(*_PAGE).orderBy("n")


def running(value: Column, order: Window) -> Column:
    return F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0))


def nearest_above(value: Column, order: Window) -> Column:
    """Last non-NULL value of the rows above (an as-of lookup)."""
    return F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))


def _explicit_year() -> Column:
    """The year a heading sets for the ones below it: only from a date that exists."""
    return F.expr(f"if(coalesce({page_date('parts')}, '') <> '', parts.year, NULL)")


def _gathered(df: DataFrame, group: str, columns: tuple[str, ...], text: str) -> DataFrame:
    """Join the pieces of a section or card; the first piece gives the other columns.

    Groups lie inside a page, so this uses the shuffle of the windows before it.
    """
    names = [c for c in (*DOC, *columns) if c not in _PAGE]
    pieces = F.array_sort(F.collect_list(F.struct("n", F.expr(text).alias("t"))))
    return (
        df.groupBy(*_PAGE, group)
        .agg(F.min_by(F.struct("n", *names), "n").alias("first"), pieces.alias("pieces"))
        .select(*_PAGE, group, "first.*", F.array_join(F.transform("pieces", lambda x: x["t"]), "").alias("whole"))
    )


def _numbered(df: DataFrame, kept: str, nothing: str) -> DataFrame:
    """Number the entries of a page and keep the window, or one row for a failed page."""
    by_page = _by_page()
    return (
        df.withColumn("kept", F.expr(f"if(source_error IS NULL AND {kept}, 1, 0)"))
        .withColumn("pos", running(F.col("kept"), by_page))
        .withColumn("total", F.sum("kept").over(Window.partitionBy(*_PAGE)))
        .withColumn("row", F.row_number().over(by_page))
        .withColumn("source_error", F.expr(f"coalesce(source_error, if(total = 0, {lit(nothing)}, NULL))"))
        .where("(kept = 1 AND pos <= window_size) OR (source_error IS NOT NULL AND row = 1)")
        .withColumn("pos", F.expr("if(source_error IS NULL, pos, NULL)"))
    )


# --------------------------------------------------------------------------
# Changelogs
# --------------------------------------------------------------------------


def _heading_text(c: str) -> str:
    return strip(f"replace({markdown_text(c)}, {lit(_ZERO_WIDTH)}, '')")


def section_heading_url(links: str, page_url: str, published: str) -> str:
    """Own anchor of a heading, or a link to the page itself, else an anchor from the date."""
    page = before_fragment(page_url)
    own = lambda k: case(
        (f"startswith({k}.target, '#')", f"concat({page}, {k}.target)"),
        default=let(
            resolve(page_url, f"{k}.target"),
            lambda u: f"if({canonical_url(u)} = {canonical_url(page_url)}, {u}, NULL)",
        ),
    )
    usable = keep(each(links, own), lambda u: f"{u} IS NOT NULL")
    slug = strip_chars(replaced(f"lower({published})", "[^a-z0-9]+", "-"), "-")
    return f"coalesce(get({usable}, 0), concat({page}, '#', {slug}))"


@sql_function
def section_title(content: str, source: str, published: str) -> str:
    """First heading inside the section that is no date, else "source · date".

    NULL when that heading is an impossible date.
    """

    def choose(h: str) -> str:
        return let(
            page_date(page_date_parts(h)),
            lambda d: case(
                (f"{h} <> '' AND {d} = ''", h),
                (f"{h} = '' OR {d} IS NOT NULL", f"concat({source}, ' · ', {published})"),
            ),
        )

    return let(_heading_text(group1(content, _TITLE_HEADING)), choose)


def changelog_entries(docs: DataFrame) -> DataFrame:
    """One entry per dated section; ``window_size`` counts kept and malformed ones."""
    by_page = _by_page()
    kind = case(
        ("raw = ''", "'text'"),
        ("published IS NULL", "'bad'"),
        ("length(published) = 7", "'month'"),
        ("published <> ''", "'day'"),
        (matches("heading", _DATE_LABEL), "'bad'"),
        default="'text'",
    )
    dated = (
        _pieces(docs, _SECTION_START)
        .withColumn("raw", F.expr(strip(group1("piece", _SECTION_HEADING))))
        .withColumn("heading", F.expr(_heading_text("raw")))
        .withColumn("parts", F.expr(page_date_parts("heading")))
        .withColumn("year", nearest_above(_explicit_year(), by_page))
        .withColumn("published", F.expr(page_date("parts", "year")))
        .withColumn("kind", F.expr(kind))
        .withColumn("section", running(F.expr("if(kind = 'text', 0, 1)"), by_page))
    )
    # Headings without a date belong to the section above them.
    text = f"if(kind = 'text', piece, {replaced('piece', r'(?d)^[^\n]*', '')})"
    sections = (
        _gathered(dated, "section", _SECTION_COLUMNS, text)
        .withColumn("content", F.expr(strip_chars("whole", _BODY_EDGE)))
        .withColumn("next_kind", F.lead("kind").over(by_page))
    )
    # A month heading only opens a section of its own when it has text and no days.
    kept = (
        "kind <> 'text' AND NOT (kind = 'month' AND (content = ''"
        " OR coalesce(next_kind IN ('day', 'bad'), false)))"
    )
    rows = (
        _numbered(sections, kept, "invalid Markdown changelog: no dated sections found")
        .withColumn("links", markdown_links("raw"))
        .withColumn("content", F.expr(strip("content")))
        .withColumn("section_url", F.expr(section_heading_url("links", "page_url", "published")))
        .withColumn("title", F.expr(section_title("content", "source", "published")))
        .withColumn("checked", F.expr(item_link("section_url", "page_url", "allowed_hosts")))
        .withColumn("key", F.expr(content_key("source", "published", "content")))
    )
    error = case(
        ("source_error IS NOT NULL", "NULL"),
        ("kind = 'bad'", "concat('invalid changelog date heading: ', heading)"),
        ("content = ''", "'dated changelog section has no content'"),
        ("title IS NULL", "'invalid page publication date'"),
        default="checked.error",
    )
    return entry_rows(
        rows,
        error=error,
        issue_title="heading",
        issue_url="if(kind = 'bad', page_url, section_url)",
        item_id="key",
        title="title",
        content="content",
        url="checked.url",
        published_at="published",
        category="'Changelog'",
        dedupe_key="key",
    )


# --------------------------------------------------------------------------
# Cards
# --------------------------------------------------------------------------


def card_entries(docs: DataFrame) -> DataFrame:
    """``<Card ...>body</Card>`` elements with the date of the nearest heading above."""
    by_page = _by_page()
    token = case(
        (matches("piece", _CARD_OPEN), "'open'"),
        (matches("piece", r"(?i)^<Card\b"), "'broken'"),
        (matches("piece", r"(?i)^</Card\s*>"), "'close'"),
        default="'text'",
    )
    heading = f"if(token = 'text', {group1('piece', _CARD_HEADING)}, '')"
    # '' marks a heading with an impossible date: cards below it have none.
    date = let(page_date("parts", "year"), lambda d: case((f"{d} IS NULL", "''"), (f"{d} <> ''", d)))
    tokens = (
        _pieces(docs, _CARD_TOKEN)
        .withColumn("token", F.expr(token))
        .withColumn("parts", F.expr(page_date_parts(heading)))
        .withColumn("year", nearest_above(_explicit_year(), by_page))
        .withColumn("date", F.expr(date))
        .withColumn("nearest", nearest_above(F.col("date"), by_page))
        .withColumn("card", running(F.expr("if(token = 'text', 0, 1)"), by_page))
    )
    # Headings inside a card are part of its body.
    cards = _gathered(tokens, "card", _CARD_COLUMNS, "piece").withColumn(
        "next_token", F.lead("token").over(by_page)
    )
    attrs = f"if(token = 'open', {group1('piece', _CARD_OPEN)}, {group1('whole', r'(?id)^<Card([^\n]*)')})"
    rows = (
        _numbered(cards, "token IN ('open', 'broken')", "invalid Markdown cards: no Card elements found")
        .withColumn("attrs", F.expr(html_attributes(attrs)))
        .withColumn("title", F.expr(clean_html("coalesce(try_element_at(attrs, 'title'), '')")))
        .withColumn("href", F.expr("coalesce(try_element_at(attrs, 'href'), '')"))
        # The page is parsed once, the target as a rule resolved once and the link brought into its canonical form once.
        .withColumn("page", F.expr(url_parts("page_url")))
        .withColumn("target", F.expr(link_value("href")))
        .withColumn("resolved", F.expr(resolve_from("page_url", Url("page"), "target")))
        .withColumn("checked", F.expr(checked_link("target", "resolved", "allowed_hosts")))
        .withColumn("canon", F.expr(canonical_url("checked.url")))
    )
    as_written = resolve_from("page_url", Url("page"), "href")
    error = case(
        ("source_error IS NOT NULL", "NULL"),
        ("token = 'broken'", "'Card has a malformed opening tag'"),
        ("coalesce(next_token, '') <> 'close'", "'Card is missing a closing tag'"),
        ("title = ''", "'Card is missing title'"),
        ("href = ''", "'Card is missing href'"),
        ("coalesce(nearest, '') = ''", "'Card has no preceding date heading'"),
        default="checked.error",
    )
    return entry_rows(
        rows,
        error=error,
        issue_title="title",
        issue_url=f"coalesce(if(target = href, resolved, {as_written}), href)",
        canonical="canon",
        item_id="canon",
        title="title",
        content=markdown_body_text(replaced("whole", _CARD_OPEN, "")),
        url="checked.url",
        published_at="nearest",
        category="'Model release'",
    )
