"""RSS feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import rfc822_to_beijing
from tidewire.functions.sql import case, each, keep, lit
from tidewire.functions.text import clean_html, replaced, strip
from tidewire.functions.urls import canonical_url, item_link
from tidewire.sources.landing import DOC, entry_rows

_ITEM = r"(?s)<(?:[\w.-]+:)?item(?:\s[^>]*?)?(?:/>|>.*?</(?:[\w.-]+:)?item\s*>)"
_CDATA_OR_MARKUP = r"(?s)<!\[CDATA\[.*?\]\]>|<?+[^<]++|<"
_PREFIX = r"<(/?)[A-Za-z_][\w.\-]*:"
_CHILDREN = ("title", "link", "pubDate", "guid", "description", "encoded", "creator", "author", "category")
_ENTRY = ", ".join(f"`{name}` array<string>" for name in _CHILDREN)


def _local_names(xml: str) -> str:
    """Remove name space prefixes of elements, but not inside CDATA."""
    parts = each(
        f"regexp_extract_all({xml}, {lit(_CDATA_OR_MARKUP)}, 0)",
        lambda p: f"if(startswith({p}, '<![CDATA['), {p}, {replaced(p, _PREFIX, '<$1')})",
    )
    return f"array_join({parts}, '')"


def _child(name: str) -> str:
    return f"coalesce(get(e.{name}, 0), '')"


def _either(first: str, second: str) -> str:
    return f"if({_child(first)} <> '', {_child(first)}, {_child(second)})"


def rss_entries(docs: DataFrame) -> DataFrame:
    """Entries in feed order, only the first ``window_size`` raw ones."""
    body = replaced("text", r"(?s)<!--.*?-->", "")
    whole = "from_xml(text, '_corrupt_record string', map('mode', 'PERMISSIVE'))"
    found = docs.selectExpr(
        *DOC,
        "source_error",
        f"regexp_extract_all({body}, {lit(_ITEM)}, 0) AS found",
        f"{whole}._corrupt_record IS NOT NULL AS corrupt",
    )
    error = case(
        ("source_error IS NOT NULL", "source_error"),
        ("corrupt", "'invalid RSS XML: not well-formed'"),
        ("size(found) = 0", "'invalid RSS XML: feed contains no item elements'"),
    )
    categories = keep(
        each("coalesce(e.category, cast(array() AS array<string>))", clean_html), lambda c: f"{c} <> ''"
    )
    rows = (
        found.withColumn("source_error", F.expr(error))
        .select(
            *DOC,
            "source_error",
            F.expr("posexplode_outer(if(source_error IS NULL, slice(found, 1, window_size), NULL))").alias(
                "index", "xml"
            ),
        )
        .selectExpr(
            *DOC,
            "source_error",
            "index + 1 AS pos",
            f"from_xml({_local_names('xml')}, {lit(_ENTRY)}) AS e",
        )
        .selectExpr(
            *DOC,
            "pos",
            "source_error",
            f"{strip(_child('title'))} <> '' AS has_title",
            f"{clean_html(_child('title'))} AS title",
            f"{strip(_child('link'))} AS link",
            f"{strip(_child('pubDate'))} AS pub_date",
            f"{rfc822_to_beijing(strip(_child('pubDate')))} AS published",
            f"{strip(_child('guid'))} AS guid",
            f"{clean_html(_either('description', 'encoded'))} AS content",
            f"{clean_html(_either('creator', 'author'))} AS author",
            f"array_join({categories}, ', ') AS category",
        )
        .withColumn("checked", F.expr(item_link("link", "page_url", "allowed_hosts")))
    )
    entry_error = case(
        ("source_error IS NOT NULL", "NULL"),
        ("NOT has_title", "'missing title'"),
        ("link = ''", "'missing link'"),
        ("checked.error IS NOT NULL", "checked.error"),
        ("pub_date = ''", "'missing pubDate'"),
        ("published IS NULL", "concat(\"invalid publication date: '\", pub_date, \"'\")"),
        ("title = ''", "'empty title'"),
    )
    return entry_rows(
        rows,
        error=entry_error,
        issue_title="title",
        issue_url="link",
        item_id=f"if(guid <> '', guid, {canonical_url('checked.url')})",
        title="title",
        content="content",
        url="checked.url",
        published_at="published",
        author="author",
        category="category",
        guid="guid",
    )
