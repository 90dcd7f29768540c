"""Landed documents: size and encoding gates, common entry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.identity import dedupe_key, issue_key
from tidewire.schemas import ITEM_TEXT

# How each kind of document is called in messages.
RESPONSE_NAMES = {
    "rss": "RSS",
    "markdown_index": "Markdown index",
    "markdown_changelog": "Markdown changelog",
    "markdown_cards": "Markdown cards",
    "next_data_index": "Next.js index",
}
MAX_RESPONSE_BYTES = 5 * 1024 * 1024

#: Columns that travel with every entry of a document.
DOC = ("run_id", "source", "source_ord", "page_no", "page_url", "allowed_hosts", "window_size")

#: Positions of a page's entries lie in a range of their own; an entry has some bytes, so a page within
#: the size gate has fewer.
PAGE_POSITIONS = 1 << 22


def with_page(docs: DataFrame) -> DataFrame:
    """Number the pages of each source, from 0: by fetch time, then run and id.

    Only names of pages are sorted; a page that landed twice has one number.
    """
    name = F.sha2("body", 256)
    named = docs.withColumns(
        {
            "doc_id": F.coalesce("doc_id", name) if "doc_id" in docs.columns else name,
            "fetched_at": F.col("fetched_at") if "fetched_at" in docs.columns else F.lit(None).cast("timestamp"),
        }
    )
    order = Window.partitionBy("source").orderBy(F.col("fetched_at").asc_nulls_first(), "run_id", "doc_id")
    keys = ("source", "run_id", "doc_id", "fetched_at")
    pages = named.select(*keys).distinct().withColumn("page_no", F.row_number().over(order) - 1)
    pages = pages.select(*(F.col(k).alias(f"_{k}") for k in keys), "page_no")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return named.join(pages, same).drop(*(f"_{k}" for k in keys))


#: Encodings of one byte a character in which feeds may be written, besides Latin-1; their tables are Python's.
EIGHT_BITS = (
    *(f"iso-8859-{n}" for n in (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16)),
    *(f"windows-125{n}" for n in range(9)),
    "koi8-r", "koi8-u",
)
_LATIN_1 = ("iso-8859-1", "iso_8859-1", "latin1", "latin-1", "l1", "us-ascii", "ascii")


def _tables() -> Column:
    """Encoding -> the characters that are others than in Latin-1, what they are, and bytes that are none."""
    entries = []
    for name in EIGHT_BITS:
        table = [bytes([b]).decode(name, "replace") for b in range(256)]
        other = [b for b in range(256) if table[b] not in (chr(b), "\ufffd")]
        gaps = "".join(chr(b) for b in range(256) if table[b] == "\ufffd")
        parts = {"other": "".join(map(chr, other)), "by": "".join(table[b] for b in other), "gaps": gaps}
        entries += [F.lit(name), F.struct(*(F.lit(v).alias(k) for k, v in parts.items()))]
    return F.create_map(*entries)


def with_encoding(docs: DataFrame, body: str) -> DataFrame:
    """Add the declared encoding of an XML document, and its table if it is one of ``EIGHT_BITS``, once per row."""
    start = F.substring_index(F.decode(F.col(body), "ISO-8859-1"), "?>", 1)
    named = F.lower(F.regexp_extract(start, r"(?is)^(?:\xEF\xBB\xBF)?<\?xml\s[^>]*?encoding\s*=\s*[\"']([\w.:-]+)", 1))
    named = F.regexp_replace(F.regexp_replace(named, "^cp(125[0-8])$", "windows-$1"), "^iso_?8859-", "iso-8859-")
    return docs.withColumn("_encoding", named).withColumn("_table", F.try_element_at(_tables(), F.col("_encoding")))


def xml_text(body: str) -> tuple[Column, Column]:
    """Text of an XML document by its byte order mark or declared encoding, and whether it cannot be read so."""
    raw, named, table = F.col(body).cast("string"), F.col("_encoding"), F.col("_table")
    wide = F.hex(F.substring(body, 1, 2)).isin("FEFF", "FFFE")
    # As Latin-1 every byte is the character of its number.
    bytewise = F.decode(F.col(body), "ISO-8859-1")
    latin = named.isin(*_LATIN_1)
    text = F.when(wide, F.regexp_replace(F.decode(F.col(body), "UTF-16"), "^\ufeff", "")).when(latin, bytewise)
    text = text.when(table.isNotNull(), F.call_function("translate", bytewise, table["other"], table["by"]))
    bad = F.when(wide | latin, F.lit(False))
    bad = bad.when(table.isNotNull(), F.call_function("translate", bytewise, table["gaps"], F.lit("")) != bytewise)
    text = text.otherwise(F.regexp_replace(raw, "^\ufeff", ""))
    return text, bad.otherwise(~named.isin("", "utf-8", "utf8") | ~F.is_valid_utf8(raw))


def admit(
    docs: DataFrame, sources: DataFrame, collector: str, max_bytes: int = MAX_RESPONSE_BYTES
) -> DataFrame:
    """Documents of one collector with ``text`` or a ``source_error``.

    The source table is small; Spark broadcasts it by its known size, or else
    joins by shuffle, where AQE splits a source with very many documents.
    """
    settings = sources.where(F.col("collector") == collector).select(
        "source", "source_ord", F.col("url").alias("page_url"), "allowed_hosts", "window_size"
    )
    if "collector" in docs.columns:  # landing folder partitioned by collector
        docs = docs.where(F.col("collector") == collector)
    joined = with_page(docs).select("run_id", "source", "page_no", "body").join(settings, "source")
    name = RESPONSE_NAMES[collector]
    raw = F.col("body").cast("string")
    too_big = F.octet_length("body") > max_bytes
    if collector == "rss":
        joined = with_encoding(joined, "body")
        text, bad_text = xml_text("body")
        message = "invalid RSS XML: not well-formed"
    else:
        text, bad_text, message = raw, ~F.is_valid_utf8(raw), f"{name} response is not valid UTF-8"
    error = F.when(
        too_big, F.lit(f"{name} response exceeds {max_bytes} byte limit")
    ).when(bad_text, F.lit(message))
    return joined.withColumn("source_error", error).select(
        *DOC, "source_error", F.when(F.col("source_error").isNull(), text).alias("text")
    )


def entry_rows(
    df: DataFrame, *, error: str, issue_title: str, issue_url: str, canonical: str | None = None, **fields: str
) -> DataFrame:
    """Bring the rows of an extractor into the common shape.

    All arguments are SQL expressions over ``df``.  ``pos`` starts at 1 and is NULL
    for a document that failed as a whole; a row with an ``error`` is an issue, any
    other one an item.  ``canonical``, the canonical form of ``url``, is the key of items if it is given.
    """
    key = dedupe_key("dedupe_key", "url") if canonical is None else "canonical"
    values = {name: "''" for name in ITEM_TEXT} | fields
    shaped = df.selectExpr(
        *DOC,
        f"bigint(page_no) * {PAGE_POSITIONS} + bigint(pos) AS pos",
        "bigint(pos) AS entry",
        "source_error",
        f"{error} AS error",
        f"{issue_title} AS issue_title",
        f"{issue_url} AS issue_url",
        f"{canonical or 'NULL'} AS canonical",
        *[f"{values[name]} AS {name}" for name in ITEM_TEXT],
    )
    return shaped.selectExpr(
        "run_id",
        "source",
        "source_ord",
        "page_no",
        "pos",
        "CASE WHEN source_error IS NOT NULL THEN 'failure' WHEN error IS NOT NULL THEN 'issue'"
        " ELSE 'item' END AS kind",
        "coalesce(source_error, error) AS message",
        "issue_title",
        "issue_url",
        f"CASE WHEN error IS NOT NULL THEN {issue_key('source', 'page_url', 'issue_title', 'issue_url', 'entry')}"
        " END AS item_key",
        *[name for name in ITEM_TEXT if name != "dedupe_key"],
        f"CASE WHEN source_error IS NULL AND error IS NULL THEN {key} END AS dedupe_key",
    )
