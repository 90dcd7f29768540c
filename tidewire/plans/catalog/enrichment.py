"""Summaries, cache, article texts and messages."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewire.operators.enrichment import (
    BULLETS,
    NO_TEXT,
    NOT_JSON,
    TITLE,
    ask,
    cache_lookup,
    cache_rows,
    checked_summary,
    current_cache,
    summary_content,
    with_article,
    with_summary,
)
from tidewire.operators.messages import (
    DEFAULT_LIMIT,
    envelope_bytes,
    failure_message,
    item_paragraphs,
    message_title,
    pack_messages,
    paragraph_bytes,
    with_message,
)
from tidewire.plans.catalog.common import DOC_ITEMS_SQL, RUN_DATE, canonical_sql, doc_items, pages, table
from tidewire.plans.catalog.scalars import ALLOWED, ALLOWED_SQL
from tidewire.sources.articles import NOT_ALLOWED, read_articles

# Conversation turns as answers of a model, some of them bad in one way each.
_LINES = "filter(transform(split(text, '\n'), l -> concat('要点 ', trim(l), ' ')), l -> length(l) > 4)"
_TITLE = "concat(' 标题 ', substr(text, 1, 20))"
_ANSWER = (
    "CASE WHEN turn = 5 THEN concat('x', text)"
    f" WHEN turn = 4 THEN to_json(named_struct('title_zh', {_TITLE}, 'bullets_zh', {_LINES}, 'more', 1))"
    f" WHEN role = 'system' THEN to_json(named_struct('title_zh', turn, 'bullets_zh', {_LINES}))"
    f" WHEN turn = 3 THEN to_json(named_struct('title_zh', {_TITLE}, 'bullets_zh', transform({_LINES}, l -> 'plain')))"
    f" ELSE to_json(named_struct('title_zh', {_TITLE}, 'bullets_zh', {_LINES})) END"
)


def answers(spark, folder):
    rows = table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn", f"{checked_summary(_ANSWER)} AS s"
    )
    return rows.selectExpr(
        "conv_id", "turn", "s.title_zh AS title", f"{summary_content('s.bullets_zh')} AS content", "s.error AS error"
    )


_LINES_SQL = "list_filter(list_transform(string_split(text, e'\\n'), lambda l: '要点 ' || trim(l) || ' '), lambda l: length(l) > 4)"
_ANSWER_SQL = f"""
a AS (SELECT *, {_LINES_SQL} AS lines, trim(' 标题 ' || substr(text, 1, 20), e' \\n') AS title FROM conversations),
e AS (SELECT *, CASE WHEN turn = 5 THEN 'model returned invalid JSON'
    WHEN turn = 4 THEN 'model output does not match the required fields'
    WHEN role = 'system' THEN 'model returned an invalid Chinese title'
    WHEN len(lines) NOT BETWEEN 3 AND 5 THEN 'model must return 3 to 5 Chinese bullets'
    WHEN turn = 3 THEN 'model returned an invalid Chinese bullet' END AS error FROM a)
"""


def applied(spark, folder):
    """Items with title and text replaced by their summary."""
    rows = table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn", "role AS source", "text AS content", "'' AS title",
        f"{_TITLE} AS {TITLE}", f"{_LINES} AS {BULLETS}",
    )
    return with_summary(rows).select("conv_id", "turn", "title", "content")


_MODEL = {"model": "m", "protocol": "p", "base_url": "b", "prompt_version": "1"}


def _cache_log(spark, folder):
    """Turns as versions of the summary of a conversation; some of another model."""
    rows = table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn", "role AS source", "concat('conv ', conv_id) AS dedupe_key",
        f"trim({_TITLE}) AS {TITLE}", f"{_LINES} AS {BULLETS}",
    )
    log = cache_rows(rows, **_MODEL)
    versions = rows.select(F.col("turn").alias("run_seq"), "source", F.col("dedupe_key").alias("item_id"), TITLE, BULLETS)
    return log.join(versions, ["source", "item_id", TITLE, BULLETS]).withColumn(
        "model", F.when(F.col("source") == "system", F.lit("other")).otherwise(F.col("model"))
    )


def cached(spark, folder):
    items = table(spark, folder, "conversations").selectExpr("role AS source", "concat('conv ', conv_id) AS dedupe_key").distinct()
    found = cache_lookup(items, _cache_log(spark, folder), **_MODEL)
    return found.select("source", "dedupe_key", F.coalesce(TITLE, F.lit("")).alias("title"),
                        F.coalesce(F.size(BULLETS), F.lit(-1)).alias("bullets"))


def cache_entries(spark, folder):
    rows = current_cache(_cache_log(spark, folder))
    return rows.groupBy("source", "model").agg(F.count(F.lit(1)).alias("entries"))


_CACHE_SQL = f"""
v AS (SELECT role AS source, 'conv ' || conv_id AS dedupe_key, turn, CASE WHEN role = 'system' THEN 'other' ELSE 'm' END AS model,
        trim(' 标题 ' || substr(text, 1, 20)) AS title, {_LINES_SQL} AS lines FROM conversations),
latest AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY source, dedupe_key ORDER BY turn DESC) = 1),
good AS (SELECT * FROM latest WHERE len(lines) BETWEEN 3 AND 5)
"""


def articles(spark, folder):
    """Text of each page link: its own title, or the landed page behind the canonical URL, as Markdown of its words."""
    rows = pages(spark, folder)
    words = "concat('# Page\n\n\n\n![i](x.png)', regexp_replace(html, '[^A-Za-z0-9.,]+', ' '), '[end](https://x.y/z)')"
    landed = rows.selectExpr("concat(url, if(contains(url, '#'), '', '#x')) AS article_url", f"cast({words} AS BINARY) AS body")
    landed = landed.where("NOT contains(article_url, '.html')")
    items = rows.selectExpr(
        "page_id", "replace(url, 'http://', 'https://') AS url",
        "if(startswith(url, 'https'), 'article', 'inline') AS content_mode",
        "regexp_extract(html, '<title>([^<]*)', 1) AS content",
        f"{ALLOWED} AS allowed_hosts",
    )
    found = with_article(items, landed)
    return found.selectExpr("page_id", "sha2(coalesce(article, ''), 256) AS article_sha256", "coalesce(article_error, '') AS error")


_ARTICLES_SQL = f"""
WITH p AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
        trim(regexp_extract(html, '<title>([^<]*)', 1), e' \\n') AS content,
        e'# Page\\n\\n' || regexp_replace(html, '[^A-Za-z0-9.,]+', ' ', 'g') || 'end' AS page FROM pages),
a AS (SELECT page_id, CASE WHEN NOT starts_with(url, 'https') THEN content
        WHEN NOT contains(url, '.html') AND {ALLOWED_SQL.format(h='host')} THEN page ELSE '' END AS article FROM p)
SELECT page_id, sha256(article) AS article_sha256, CASE WHEN article = '' THEN '{NO_TEXT}' ELSE '' END AS error FROM a
"""


class _Reader:
    """Stands for a user's reader: pages that say their address, and none that end in html."""

    def __call__(self, url: str) -> bytes:
        if url.endswith(".html"):
            raise FileNotFoundError(url)
        return f"# Page of {url}".encode()


def read_pages(spark, folder):
    items = pages(spark, folder).selectExpr("url", f"{ALLOWED} AS allowed_hosts", "'article' AS content_mode")
    return read_articles(items, _Reader).selectExpr(
        "article_url", "string(body) AS body", "coalesce(error, '') AS error", "fetched_at IS NOT NULL AS asked"
    )


_READ_SQL = f"""
WITH p AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages),
l AS (SELECT url, CASE WHEN starts_with(url, 'https://') AND {ALLOWED_SQL.format(h='host')} THEN regexp_replace(url, '#.*$', '') END AS link FROM p),
k AS (SELECT min(link) AS link FROM l WHERE link IS NOT NULL GROUP BY {canonical_sql('link')})
SELECT link AS article_url, CASE WHEN NOT ends_with(link, '.html') THEN '# Page of ' || link END AS body,
  CASE WHEN ends_with(link, '.html') THEN 'FileNotFoundError: ' || link ELSE '' END AS error, true AS asked FROM k
UNION ALL SELECT DISTINCT url, NULL, '{NOT_ALLOWED}', false FROM l WHERE link IS NULL
"""


class _Client:
    """Stands for a user's model client: answers users, fails for system turns, and is closed with its task."""

    def __call__(self, row: dict, article: str) -> str:
        if row["source"] == "system":
            raise ValueError("no answer")
        if row["source"] != "user":
            return article
        return json.dumps({"title_zh": f"标题{len(article)}", "bullets_zh": ["一", "二", "三"]})

    def close(self) -> None:
        pass


def asked(spark, folder):
    """Every turn of a conversation, given to a client built once per task."""
    rows = table(spark, folder, "conversations").selectExpr(
        "conv_id * 1000 + turn AS order_key", "role AS source", "'' AS title", "'' AS url", "'' AS published_at", "text AS article"
    )
    return ask(rows, _Client).selectExpr(
        "order_key", "coalesce(title_zh, '') AS title", "cast(coalesce(size(bullets_zh), 0) AS BIGINT) AS bullets",
        "coalesce(error, '') AS error",
    )


_ASKED_SQL = f"""
SELECT conv_id * 1000 + turn AS order_key, CASE WHEN role = 'user' THEN '标题' || length(text) ELSE '' END AS title,
  cast(CASE WHEN role = 'user' THEN 3 ELSE 0 END AS BIGINT) AS bullets,
  CASE role WHEN 'system' THEN 'ValueError: no answer' WHEN 'user' THEN '' ELSE '{NOT_JSON}' END AS error FROM conversations
"""


# --------------------------------------------------------------------------
# Messages
# --------------------------------------------------------------------------


def messages(spark, folder):
    items = doc_items(spark, folder)
    title = message_title(RUN_DATE, "news", F.col("source"))
    return with_message(items, title, limit=4096).select("pos", "payload", "bytes", "fits")


def _js(c: str) -> str:
    return f"cast(to_json({c}) AS VARCHAR)"


_SHOWN_SQL = (
    "CASE lang WHEN 'en' THEN '发布日期：' || strftime(day, '%Y-%m-%d') WHEN 'fr' THEN '发布日期：' || strftime(day, '%Y-%m')"
    " WHEN 'es' THEN '北京时间：' || strftime(day + 1, '%Y-%m-%d') || ' 04:30:00' ELSE '发布日期：日期未知' END"
)
_PARAGRAPHS_SQL = (
    "'[{\"tag\":\"a\",\"text\":' || " + _js("title || e'\\n'") + " || ',\"href\":' || " + _js("url") + " || '}],[{\"tag\":\"text\",\"text\":' || "
    + _js(f"'来源：' || source || ' · ' || {_SHOWN_SQL} || e'\\n' || content || e'\\n'") + " || '}]'"
)
_ENVELOPE_SQL = "'{\"msg_type\":\"post\",\"content\":{\"zh_cn\":{\"title\":\"" + RUN_DATE + " · news · ' || source || '\",\"content\":['"


def packed(spark, folder):
    """Documents of a source in messages of at most the default size."""
    title = message_title(RUN_DATE, "news", F.col("source"))
    sized = (
        doc_items(spark, folder)
        .withColumn("base", envelope_bytes(title))
        .withColumn("size", paragraph_bytes(item_paragraphs()))
        .select("source", "pos", "base", "size")
    )
    done = pack_messages(sized, "source", "pos", DEFAULT_LIMIT, segment_rows=500)
    return done.select("source", "pos", F.coalesce("batch", F.lit(-1)).cast("long").alias("batch"), "failed")


_PACK_SQL = f"""
WITH RECURSIVE {DOC_ITEMS_SQL},
s AS (SELECT source, pos, strlen({_ENVELOPE_SQL}) + 4 AS base, strlen({_PARAGRAPHS_SQL}) AS size,
        row_number() OVER (PARTITION BY source ORDER BY pos) AS n,
        bool_or(strlen({_ENVELOPE_SQL}) + 4 + strlen({_PARAGRAPHS_SQL}) > 28672) OVER (PARTITION BY source) AS failed FROM doc_items),
p AS (SELECT source, pos, n, 0 AS batch, base + size AS used FROM s WHERE n = 1
      UNION ALL
      SELECT s.source, s.pos, s.n, CASE WHEN p.used + 1 + s.size > 28672 THEN p.batch + 1 ELSE p.batch END,
             CASE WHEN p.used + 1 + s.size > 28672 THEN s.base + s.size ELSE p.used + 1 + s.size END
      FROM p JOIN s ON s.source = p.source AND s.n = p.n + 1)
SELECT s.source, s.pos, cast(CASE WHEN failed THEN -1 ELSE p.batch END AS BIGINT) AS batch, failed
FROM s JOIN p ON p.source = s.source AND p.n = s.n
"""


def failure_messages(spark, folder):
    rows = table(spark, folder, "documents").select(
        "doc_id",
        failure_message(F.lit(RUN_DATE), F.col("source"), F.col("text"), F.repeat(F.col("lang"), 60)).alias("payload"),
    )
    return rows.withColumn("bytes", F.octet_length("payload"))


_FAILURE_SQL = (
    "'{\"msg_type\":\"post\",\"content\":{\"zh_cn\":{\"title\":\"" + RUN_DATE + "\",\"content\":[[{\"tag\":\"text\",\"text\":' || "
    + _js("'来源：' || source || e'\\n文章：' || substr(text, 1, 500) || e'\\n失败阶段：' || substr(repeat(lang, 60), 1, 100) || e'\\n'")
    + " || '}]]}}}'"
)

QUERIES = {
    "read_articles_x2": read_pages,
    "checked_summary_p19": answers,
    "applied_summary_p20": applied,
    "cache_lookup_j8_k3": cached,
    "cache_entries_k3": cache_entries,
    "article_source_s9": articles,
    "asked_summaries_x3": asked,
    "message_bytes_p21_p22_g1": messages,
    "message_packing_g2": packed,
    "failure_message_p23": failure_messages,
}

ORACLES = {
    "read_articles_x2": _READ_SQL,
    "checked_summary_p19": f"""
        WITH {_ANSWER_SQL} SELECT conv_id, turn, CASE WHEN error IS NULL THEN title END AS title,
          CASE WHEN error IS NULL THEN array_to_string(list_transform(lines, lambda l: '• ' || trim(l)), e'\\n') END AS content,
          error FROM e""",
    "applied_summary_p20": f"""
        SELECT conv_id, turn, ' 标题 ' || substr(text, 1, 20) AS title,
          array_to_string(list_transform({_LINES_SQL}, lambda l: '• ' || l), e'\\n') AS content FROM conversations""",
    "cache_lookup_j8_k3": f"""
        WITH {_CACHE_SQL} SELECT DISTINCT v.source, v.dedupe_key, coalesce(g.title, '') AS title,
          coalesce(cast(len(g.lines) AS INTEGER), -1) AS bullets
        FROM v LEFT JOIN good g ON g.source = v.source AND g.dedupe_key = v.dedupe_key AND g.model = 'm'""",
    "cache_entries_k3": f"WITH {_CACHE_SQL} SELECT source, model, count(*) AS entries FROM good GROUP BY source, model",
    "article_source_s9": _ARTICLES_SQL,
    "asked_summaries_x3": _ASKED_SQL,
    "message_bytes_p21_p22_g1": f"""
        WITH {DOC_ITEMS_SQL}, m AS (SELECT pos, {_ENVELOPE_SQL} || {_PARAGRAPHS_SQL} || ']}}}}}}' AS payload FROM doc_items)
        SELECT pos, payload, cast(strlen(payload) AS INTEGER) AS bytes, strlen(payload) <= 4096 AS fits FROM m""",
    "message_packing_g2": _PACK_SQL,
    "failure_message_p23": f"""
        SELECT doc_id, payload, cast(strlen(payload) AS INTEGER) AS bytes
        FROM (SELECT doc_id, {_FAILURE_SQL} AS payload FROM documents)""",
}
