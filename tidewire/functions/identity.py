"""Deterministic identities of items and of broken entries."""

from __future__ import annotations

from tidewire.functions.sql import case, let, lit, sql_function
from tidewire.functions.text import squeeze, strip
from tidewire.functions.urls import canonical_url

# Namespaces of generated keys and keys of source-wide events.
CHANGELOG_PREFIX = "changelog:"
COLLECTION_PREFIX = "collection:"
SOURCE_KEY = "__source__"
AGE_KEY = "__age__"


def _joined_hash(*parts: str) -> str:
    """SHA-256 over the parts separated by NUL characters."""
    pieces = ", unhex('00'), ".join(f"encode({p}, 'UTF-8')" for p in parts)
    return f"sha2(concat({pieces}), 256)"


@sql_function
def content_key(source: str, published: str, content: str) -> str:
    """Identity of a dated section on a rolling page: source, date and text."""
    signature = f"sha2({squeeze(content)}, 256)"
    return f"concat({lit(CHANGELOG_PREFIX)}, {_joined_hash(source, published, signature)})"


@sql_function
def dedupe_key(explicit: str, url: str) -> str:
    """The given key when there is one, else the canonical URL."""
    return let(
        f"coalesce({strip(explicit)}, '')",
        lambda k: case((f"{k} <> ''", k), default=canonical_url(url)),
    )


@sql_function
def is_ordinary(key: str, url: str) -> str:
    """Items named by their URL also have the identities (source, id) and (source, URL)."""
    return f"({key} = {canonical_url(url)})"


@sql_function
def issue_key(source: str, page_url: str, title: str, url: str, index: str) -> str:
    """Identity of a broken entry.

    Its canonical URL when that names an article, so that the same article keeps
    one identity through all stages; else a hash over source, page and title.
    ``lower`` stands in for full case folding.
    """

    def choose(page: str) -> str:
        def key(entry: str) -> str:
            number = f"if(coalesce({index}, 0) = 0, '?', string({index}))"
            label = let(
                f"lower({squeeze(title)})",
                lambda t: case((f"{t} = ''", f"concat('index:', {number})"), default=t),
            )
            return case(
                (f"{entry} <> '' AND {entry} <> {page}", entry),
                default=f"concat({lit(COLLECTION_PREFIX)}, {_joined_hash(source, page, label)})",
            )

        return let(f"if(coalesce({url}, '') = '', '', {canonical_url(url)})", key)

    return let(canonical_url(page_url), choose)


@sql_function
def order_key(source_ord: str, pos: str) -> str:
    """One BIGINT that sorts by source priority, then by position in the source.

    Positions are below 2**40 and sources below 2**23; others are an error, never another row's key.
    """
    fits = f"bigint({pos}) >= 0 AND bigint({pos}) < {1 << 40} AND {source_ord} >= 0 AND {source_ord} < {1 << 23}"
    key = f"shiftleft(bigint({source_ord}), 40) | bigint({pos})"
    return f"if(coalesce({fits}, true), {key}, raise_error('position or source out of range'))"
