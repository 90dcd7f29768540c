"""Summaries: checking them, caching them, asking a user function for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.sql import case, each, let, lit, sql_function
from tidewire.functions.text import article_text, matches, strip
from tidewire.functions.urls import article_link, canonical_url

#: Size of an article that is still read, unless a run sets another limit.
MAX_ARTICLE_BYTES = 1024 * 1024
TOO_LARGE, NOT_UTF8, NO_TEXT = "article is too large", "article is not valid UTF-8", "article has no text"

# Fields of a summary, limits and messages.
TITLE, BULLETS = "title_zh", "bullets_zh"
MIN_BULLETS, MAX_BULLETS = 3, 5
_CJK = "[㐀-鿿]"
NOT_JSON = "model returned invalid JSON"
WRONG_FIELDS = "model output does not match the required fields"
BAD_TITLE = "model returned an invalid Chinese title"
WRONG_COUNT = "model must return 3 to 5 Chinese bullets"
BAD_BULLET = "model returned an invalid Chinese bullet"

CACHE_KEY = ("source", "item_id", "item_url", "model", "protocol", "base_url", "prompt_version")


def _chinese(c: str) -> str:
    return f"({strip(c)} <> '' AND {matches(c, _CJK)})"


def _is_text(variant: str) -> str:
    return f"coalesce(schema_of_variant({variant}) = 'STRING', false)"


def _text(variant: str) -> str:
    return f"try_variant_get({variant}, '$', 'string')"


@sql_function
def checked_summary(c: str) -> str:
    """``struct<title_zh, bullets_zh, error>`` of a JSON text; types are not coerced."""

    def judge(v: str) -> str:
        fields = f"try_variant_get({v}, '$', 'map<string,variant>')"
        title = f"try_variant_get({v}, '$.{TITLE}', 'variant')"
        bullets = f"try_variant_get({v}, '$.{BULLETS}', 'array<variant>')"
        names = f"array_sort(map_keys({fields}))"
        good_bullet = lambda b: f"coalesce({_is_text(b)} AND {_chinese(_text(b))}, false)"
        checks = case(
            (f"{v} IS NULL", lit(NOT_JSON)),
            (f"NOT coalesce({names} = array({lit(BULLETS)}, {lit(TITLE)}), false)", lit(WRONG_FIELDS)),
            (f"NOT ({_is_text(title)} AND coalesce({_chinese(_text(title))}, false))", lit(BAD_TITLE)),
            (
                f"NOT coalesce(size({bullets}) BETWEEN {MIN_BULLETS} AND {MAX_BULLETS}, false)",
                lit(WRONG_COUNT),
            ),
            (f"exists({each(bullets, good_bullet)}, ok -> NOT ok)", lit(BAD_BULLET)),
        )
        return let(
            checks,
            lambda e: f"named_struct('{TITLE}', if({e} IS NULL, {strip(_text(title))}, NULL),"
            f" '{BULLETS}', if({e} IS NULL, {each(bullets, lambda b: strip(_text(b)))}, NULL), 'error', {e})",
        )

    return let(f"try_parse_json({c})", judge)


@sql_function
def summary_content(bullets: str) -> str:
    """Bullets as the lines of a text."""
    return f"array_join({each(bullets, lambda b: f'concat({lit('• ')}, {b})')}, {lit(chr(10))})"


def with_summary(items: DataFrame) -> DataFrame:
    """Replace title and content by the summary."""
    return items.withColumn("title", F.col(TITLE)).withColumn("content", F.expr(summary_content(BULLETS)))


# --------------------------------------------------------------------------
# Cache
# --------------------------------------------------------------------------


def current_cache(log: DataFrame) -> DataFrame:
    """Latest entry of each key; an entry that does not hold a valid summary is a miss."""
    latest = log.groupBy(*CACHE_KEY).agg(F.max_by(F.struct(TITLE, BULLETS), "run_seq").alias("s"))
    return latest.select(*CACHE_KEY, "s.*").where(valid_entry())


def valid_entry():
    good = lambda c: F.expr(_chinese(c))
    return (
        F.coalesce(good(TITLE), F.lit(False))
        & F.size(BULLETS).between(MIN_BULLETS, MAX_BULLETS)
        & F.expr(f"forall({BULLETS}, b -> coalesce({_chinese('b')}, false))")
    )


def cache_lookup(items: DataFrame, log: DataFrame, **model: str) -> DataFrame:
    """Add the cached summary of each item, NULL when there is none.

    The item's key stands for both id and URL, so variants of a URL share an entry.
    """
    mine = log.where(
        (F.col("model") == model["model"])
        & (F.col("protocol") == model["protocol"])
        & (F.col("base_url") == model["base_url"])
        & (F.col("prompt_version") == model["prompt_version"])
        & (F.col("item_id") == F.col("item_url"))
    )
    # Only the entries asked for are brought up to date.
    asked = items.select("source", F.col("dedupe_key").alias("item_id"))
    mine = mine.join(asked, ["source", "item_id"], "left_semi")
    entries = current_cache(mine).select("source", F.col("item_id").alias("dedupe_key"), TITLE, BULLETS)
    return items.join(entries, ["source", "dedupe_key"], "left")


def cache_rows(items: DataFrame, **model: str) -> DataFrame:
    """Log entries for new summaries."""
    return items.select(
        "source",
        F.col("dedupe_key").alias("item_id"),
        F.col("dedupe_key").alias("item_url"),
        *[F.lit(model[k]).alias(k) for k in ("model", "protocol", "base_url", "prompt_version")],
        TITLE,
        BULLETS,
    )


# --------------------------------------------------------------------------
# Article text
# --------------------------------------------------------------------------


def with_article(
    items: DataFrame, articles: DataFrame | None, max_bytes: int = MAX_ARTICLE_BYTES
) -> DataFrame:
    """Add ``article``, the item's own text or the newest landed page of its canonical URL, and ``article_error``.

    ``items`` carry ``content_mode`` and ``allowed_hosts``.  Without usable text ``article`` is NULL and
    ``article_error`` says why.  Landed pages may have a ``fetched_at``; of equally new ones the larger body counts.
    """
    own = F.expr(f"nullif({strip('content')}, '')")
    reason = F.when(F.col("article").isNull(), F.coalesce("_reason", F.lit(NO_TEXT)))
    if articles is None:
        bare = items.withColumn("article", F.when(F.col("content_mode") == "inline", own))
        return bare.withColumn("_reason", F.lit(None).cast("string")).withColumn("article_error", reason).drop("_reason")
    keyed = items.withColumn(
        "_key",
        F.when(
            F.col("content_mode") == "article",
            F.expr(canonical_url(article_link("url", "allowed_hosts"))),
        ),
    )
    fetched = F.col("fetched_at") if "fetched_at" in articles.columns else F.lit(None).cast("timestamp")
    # Only pages that are asked for are kept, and only the newest of each is cleaned.
    newest = (
        articles.select(F.expr(canonical_url("article_url")).alias("_key"), fetched.alias("_at"), "body")
        .join(keyed.select("_key"), "_key", "left_semi")
        .groupBy("_key")
        .agg(F.max(F.struct("_at", "body")).alias("_newest"))
        .select("_key", F.col("_newest.body").alias("body"))
    )
    bad = F.when(F.octet_length("body") > max_bytes, F.lit(TOO_LARGE)).when(
        ~F.is_valid_utf8(F.col("body").cast("string")), F.lit(NOT_UTF8)
    )
    pages = newest.select("_key", "body", bad.alias("_reason")).select(
        "_key", "_reason", F.when(F.col("_reason").isNull(), F.expr(f"nullif({article_text('string(body)')}, '')")).alias("_page")
    )
    return (
        keyed.join(pages, "_key", "left")
        .withColumn("article", F.when(F.col("content_mode") == "inline", own).otherwise(F.col("_page")))
        .withColumn("article_error", reason)
        .drop("_key", "_page", "_reason")
    )


# --------------------------------------------------------------------------
# User function
# --------------------------------------------------------------------------

Summarizer = Callable[[dict, str], str]
_RESULT = "order_key long, answer string, failure string"


def ask(items: DataFrame, factory: Callable[[], Summarizer], concurrency: int = 8) -> DataFrame:
    """Ask a user function for a summary of each item; one failing row harms no other.

    ``factory`` builds one function per task.  Calls of one task overlap up to
    ``concurrency``; the number of tasks sets the rest.  The result has the columns
    ``order_key``, ``title_zh``, ``bullets_zh`` and ``error``.
    """

    def answer(one: Summarizer, row: dict) -> tuple:
        try:
            return row["order_key"], one(row, row["article"]), None
        except Exception as problem:  # noqa: BLE001 - one article must not stop the others
            return row["order_key"], None, f"{type(problem).__name__}: {problem}"

    def broken(problem: Exception) -> Summarizer:
        def fail(row: dict, article: str) -> str:
            raise RuntimeError(f"{type(problem).__name__}: {problem}")

        return fail

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = None
        try:
            with ThreadPoolExecutor(concurrency) as pool:
                for batch in batches:
                    if batch.empty:
                        continue
                    if one is None:
                        try:
                            one = factory()
                        except Exception as problem:  # noqa: BLE001
                            one = broken(problem)
                    rows = batch.to_dict("records")
                    results = list(pool.map(lambda r: answer(one, r), rows))
                    yield pd.DataFrame(results, columns=["order_key", "answer", "failure"])
        finally:
            # A client that can be closed is closed with its task.
            close = getattr(one, "close", None)
            if callable(close):
                close()

    asked = items.select("order_key", "source", "title", "url", "published_at", "article")
    return (
        asked.mapInPandas(run, _RESULT)
        .withColumn("s", F.expr(checked_summary("answer")))
        .select("order_key", f"s.{TITLE}", f"s.{BULLETS}", F.coalesce("failure", "s.error").alias("error"))
    )
