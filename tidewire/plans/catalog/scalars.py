"""Projections: URLs, texts, dates and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import dates, identity, text, urls
from tidewire.plans.catalog.common import HOST_SQL, canonical_sql, pages, text_table
from tidewire.sources.index_links import description, image_titles, label_title, slug_title
from tidewire.sources.sections import section_heading_url, section_title

ALLOWED = "array('example.com', 'example.org')"
ALLOWED_SQL = "({h} IN ('example.com', 'example.org') OR ends_with({h}, '.example.com') OR ends_with({h}, '.example.org'))"

# URLs as a careless page would write them: user info, upper case, default port, trackers.
_SHOUTED = (
    "concat(upper(regexp_extract(url, '^([a-z]+)', 1)), '://me@', upper(regexp_extract(url, '//([^/]+)', 1)), '.:',"
    " if(startswith(url, 'https'), '443', '80'), '/p', page_id, '?b=2&a&utm_medium=x&a=1&FBCLID=y&b=1#part')"
)
_SHOUTED_SQL = (
    "upper(regexp_extract(url, '^([a-z]+)', 1)) || '://me@' || upper(regexp_extract(url, '//([^/]+)', 1)) || '.:'"
    " || CASE WHEN starts_with(url, 'https') THEN '443' ELSE '80' END || '/p' || page_id"
    " || '?b=2&a&utm_medium=x&a=1&FBCLID=y&b=1#part'"
)


def canonical_urls(spark, folder):
    return text_table(spark, folder, "pages").selectExpr(
        "page_id", f"{urls.canonical_url('url')} AS key", f"{urls.canonical_url(_SHOUTED)} AS shouted_key"
    )


def html_texts(spark, folder):
    return text_table(spark, folder, "pages").selectExpr("page_id", f"{text.clean_html('html')} AS text")


_HTML_TEXT_SQL = r"""
SELECT page_id, trim(regexp_replace(
  regexp_replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '<!--.*?-->', '', 'gs'), '<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', '', 'gs'),
      '</?(?:p|div|li)\b[^>]*>|<br\b[^>]*>', ' ', 'g'), '<[/!]?[A-Za-z][^>]*>', '', 'g'),
    '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&nbsp;', ' '), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text
FROM pages
"""


def markdown_texts(spark, folder):
    marked = "concat('![pic](http://i/p.png) **', replace(text, ' ', '_ '), '** [more](http://x/', doc_id, ') <b>end</b>')"
    return text_table(spark, folder, "documents").selectExpr(
        "doc_id", f"{text.markdown_text(marked)} AS text", f"{text.markdown_body_text(marked)} AS body"
    )


_PLAIN_MD = "regexp_replace(regexp_replace(regexp_replace('**' || replace(text, ' ', '_ ') || '** more <b>end</b>', '[`*_~]', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')"


def article_texts(spark, folder):
    raw = (
        "concat('Title: ', doc_id, '\nURL Source: http://h/', doc_id, '\n\n\n\n![logo](http://i/l.png) <img src=\"x\">',"
        " text, '\t [see', doc_id, '](http://h/a) and [ref][1] <http://h/b> http://h/c?d end\n[1]: http://h/r note\n')"
    )
    return text_table(spark, folder, "documents").selectExpr(
        "doc_id",
        f"{text.article_text(raw)} AS article",
        f"{text.article_text(raw, retain_links=True)} AS with_links",
    )


# What must remain of the text above; only runs of blanks and line ends change inside.
_ARTICLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', e'\n\n', 'g') AS body FROM documents),
s AS (SELECT doc_id, CASE WHEN starts_with(body, ' ') THEN substr(body, 2) ELSE body END AS first, body FROM t)
SELECT doc_id,
  'Title: ' || doc_id || e'\n\n ' || first || CASE WHEN ends_with(first, ' ') THEN '' ELSE ' ' END
    || 'see' || doc_id || ' and ref end' AS article,
  'Title: ' || doc_id || e'\n\n ' || first || CASE WHEN ends_with(first, ' ') THEN '' ELSE ' ' END
    || '[see' || doc_id || e'](http://h/a) and [ref][1] <http://h/b> http://h/c?d end\n[1]: http://h/r note' AS with_links
FROM s
"""


def page_attributes(spark, folder):
    tag = text.group1("html", "<html([^>]*)>")
    box = text.group1("html", "<div([^>]*)>")
    return text_table(spark, folder, "pages").selectExpr(
        "page_id",
        f"{text.attribute(tag, 'lang')} AS lang",
        f"{text.attribute(box, 'class')} AS box",
        f"{text.attribute(f"concat({tag}, ' LANG = \"x&amp;y\"')", 'lang')} AS last_lang",
    )


def nav_links(spark, folder):
    """Every navigation link of every page, resolved and checked."""
    found = pages(spark, folder).selectExpr(
        "page_id", "url", "posexplode(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS (n, href)"
    )
    return found.selectExpr("page_id", "n", f"{urls.item_link('href', 'url', ALLOWED)} AS c").selectExpr(
        "page_id", "cast(n AS INT) AS n", "c.url AS url", "c.error AS error"
    )


_NAV_SQL = f"""
WITH l AS (SELECT page_id, {HOST_SQL} AS host, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin,
             unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
             generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS n FROM pages)
SELECT page_id, cast(n AS INTEGER) AS n,
  CASE WHEN {ALLOWED_SQL.format(h='host')} THEN origin || href END AS url,
  CASE WHEN NOT {ALLOWED_SQL.format(h='host')} THEN 'link host is not allowed: ' || host END AS error
FROM l
"""


def article_links(spark, folder):
    return text_table(spark, folder, "pages").selectExpr("page_id", f"{urls.article_link('url', ALLOWED)} AS article_url")


def allowed_hosts(spark, folder):
    return pages(spark, folder).selectExpr("page_id", "host", f"{urls.host_allowed('host', ALLOWED)} AS allowed")


# --------------------------------------------------------------------------
# Dates: order days shown at several precisions
# --------------------------------------------------------------------------

_STAMP = "timestampadd(HOUR, int(o_orderkey % 24), cast(o_orderdate AS TIMESTAMP_NTZ))"
_STAMP_SQL = "(o_orderdate + to_hours(cast(o_orderkey % 24 AS INTEGER)))"
_RFC = (
    f"concat(date_format({_STAMP}, 'EEE, d MMM yyyy HH:mm:ss'), CASE substr(o_orderpriority, 1, 1)"
    " WHEN '1' THEN ' +0800' WHEN '2' THEN ' GMT' WHEN '3' THEN ' -0730' WHEN '4' THEN '' ELSE ' EST' END)"
)
_RFC_UTC_SQL = (
    f"({_STAMP_SQL} - to_minutes(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 480 WHEN '2' THEN 0"
    " WHEN '3' THEN -450 WHEN '4' THEN 0 ELSE -300 END))"
)
#: Page dates must be from 20xx; four years keep the leap days.
_DAY = "add_months(date(o_orderdate), 240)"
_DAY_SQL = "cast(o_orderdate + INTERVAL 20 YEAR AS DATE)"
_PAGE_TEXT = (
    f"CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN concat('Posted ', date_format({_DAY}, 'MMMM d, yyyy'), ' by us')"
    f" WHEN '2' THEN date_format({_DAY}, \"'On 'MMM d\") WHEN '3' THEN date_format({_DAY}, 'yyyy/M/d')"
    f" WHEN '4' THEN date_format({_DAY}, 'MMM. yyyy') ELSE concat(year({_DAY}), '年', month({_DAY}), '月31日') END"
)
_MIXED = (
    "CASE WHEN o_orderpriority LIKE '4%' THEN '' WHEN o_orderpriority LIKE '5%' THEN concat('week ', o_orderkey)"
    " WHEN o_orderstatus = 'F' THEN date_format(o_orderdate, 'yyyy-MM-dd')"
    " WHEN o_orderstatus = 'P' THEN date_format(o_orderdate, 'yyyy-MM')"
    f" ELSE concat(date_format({_STAMP}, \"yyyy-MM-dd'T'HH:mm:ss\"), '-05:00') END"
)
MIXED_SQL = (
    "CASE WHEN o_orderpriority LIKE '4%' THEN '' WHEN o_orderpriority LIKE '5%' THEN 'week ' || o_orderkey"
    " WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d')"
    " WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m')"
    f" ELSE strftime({_STAMP_SQL}, '%Y-%m-%dT%H:%M:%S') || '-05:00' END"
)
BOUND_SQL = (
    "CASE WHEN o_orderpriority LIKE '4%' OR o_orderpriority LIKE '5%' THEN NULL"
    " WHEN o_orderstatus = 'F' THEN cast(o_orderdate AS DATE) WHEN o_orderstatus = 'P' THEN last_day(o_orderdate)"
    f" ELSE cast({_STAMP_SQL} + INTERVAL 13 HOUR AS DATE) END"
)


def orders_mixed(spark, folder):
    """Orders with a publication date of mixed precision."""
    return text_table(spark, folder, "orders").withColumn("published_at", F.expr(_MIXED))


def rfc_dates(spark, folder):
    return text_table(spark, folder, "orders").selectExpr(
        "o_orderkey", f"{dates.rfc822_to_beijing(_RFC)} AS published",
        f"{dates.rfc822_to_beijing('o_orderpriority')} AS no_date",
    )


def page_dates(spark, folder):
    found = text_table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_orderdate", f"{dates.page_date_parts(_PAGE_TEXT)} AS parts"
    )
    return found.selectExpr(
        "o_orderkey",
        f"{dates.page_date('parts')} AS published",
        f"{dates.page_date('parts', f'year({_DAY})')} AS with_context",
        "parts.month AS month",
        "parts.year IS NOT NULL AS has_year",
    )


_PAGE_DATE_SQL = f"""
WITH d AS (SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS p, {_DAY_SQL} AS day FROM orders),
t AS (SELECT *, strftime(day, '%Y-%m-%d') AS full_day, strftime(day, '%Y-%m') AS full_month,
        CASE WHEN date_part('day', last_day(day)) = 31 THEN strftime(day, '%Y-%m-31') END AS last FROM d)
SELECT o_orderkey,
  CASE p WHEN '1' THEN full_day WHEN '2' THEN '' WHEN '3' THEN full_day WHEN '4' THEN full_month ELSE last END AS published,
  CASE p WHEN '1' THEN full_day WHEN '2' THEN full_day WHEN '3' THEN full_day WHEN '4' THEN full_month ELSE last END AS with_context,
  cast(date_part('month', day) AS INTEGER) AS month, p <> '2' AS has_year
FROM t
"""


def reference_years(spark, folder):
    page = f"concat('Title: x\n', if(o_orderstatus = 'P', '', concat('Published Time: ', {_RFC}, '\n')), 'Body 2001')"
    return text_table(spark, folder, "orders").selectExpr("o_orderkey", f"coalesce({dates.reference_year(page)}, -1) AS year")


def dates_removed(spark, folder):
    line = f"concat('Old ', {_PAGE_TEXT}, ' and ', date_format({_DAY}, 'yyyy-MM-dd'), ' new')"
    return text_table(spark, folder, "orders").selectExpr("o_orderkey", f"{dates.without_dates(line, lit_empty())} AS rest")


def lit_empty():
    return "''"


_DATES_REMOVED_SQL = f"""
SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Old Posted by us and new'
  WHEN '2' THEN 'Old On and new' WHEN '3' THEN 'Old and new'
  WHEN '4' THEN 'Old ' || strftime({_DAY_SQL}, '%b. %Y') || ' and new'
  ELSE 'Old and new' END AS rest FROM orders
"""


def display_dates(spark, folder):
    return orders_mixed(spark, folder).selectExpr(
        "o_orderkey", f"{dates.display_time('published_at')} AS shown", f"{dates.precision('published_at')} AS precision"
    )


_DISPLAY_SQL = f"""
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '4%' THEN '日期未知' WHEN o_orderpriority LIKE '5%' THEN m
    WHEN o_orderstatus IN ('F', 'P') THEN m
    ELSE strftime({_STAMP_SQL} + INTERVAL 13 HOUR, '%Y-%m-%d %H:%M:%S') END AS shown,
  CASE WHEN o_orderpriority LIKE '4%' THEN 'none' WHEN o_orderpriority LIKE '5%' THEN 'text'
    WHEN o_orderstatus = 'F' THEN 'day' WHEN o_orderstatus = 'P' THEN 'month' ELSE 'second' END AS precision
FROM (SELECT *, {MIXED_SQL} AS m FROM orders)
"""


def date_bounds(spark, folder):
    return orders_mixed(spark, folder).selectExpr("o_orderkey", f"coalesce(string({dates.date_bound('published_at')}), '') AS bound")


# --------------------------------------------------------------------------
# Identities and titles
# --------------------------------------------------------------------------


def content_keys(spark, folder):
    return text_table(spark, folder, "documents").selectExpr(
        "doc_id", f"{identity.content_key('source', 'lang', 'text')} AS key"
    )


def issue_keys(spark, folder):
    title = "regexp_extract(html, '<title>([^<]*)', 1)"
    page_url = "concat(regexp_extract(url, '^([a-z]+://[^/]+)', 1), '/')"
    url = f"CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN {page_url} ELSE url END"
    named = f"if(startswith(url, 'https'), {title}, '')"
    return pages(spark, folder).selectExpr(
        "page_id", f"{identity.issue_key('host', page_url, named, url, 'page_id')} AS item_key"
    )


_ISSUE_KEY_SQL = f"""
WITH p AS (SELECT page_id, url, {HOST_SQL} AS host, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/' AS page_url,
    lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '\\s+', ' ', 'g'))) AS title FROM pages)
SELECT page_id, CASE WHEN NOT contains(url, '#') AND NOT contains(url, '?') THEN {canonical_sql('url')}
  ELSE 'collection:' || sha256(host || chr(0) || page_url || chr(0) ||
    CASE WHEN starts_with(url, 'https') AND title <> '' THEN title
         ELSE 'index:' || CASE WHEN page_id = 0 THEN '?' ELSE cast(page_id AS VARCHAR) END END) END AS item_key
FROM p
"""


def label_titles(spark, folder):
    """Titles and descriptions from card labels made of part rows."""
    day = "date_format(date_add(DATE'2024-01-01', int(p_partkey % 700)), 'MMM d, yyyy')"
    published = "date_format(date_add(DATE'2024-01-01', int(p_partkey % 700)), 'yyyy-MM-dd')"
    card = f"concat('![Image ', p_partkey, ': ', p_brand, '](http://i/x.png) ### ', initcap(p_name), ' ', {day})"
    flat = f"concat('#### ', initcap(p_name), ' ', p_type, ' sort of ', p_brand, ' ', {day})"
    slug = "concat('https://x.example.com/a/', replace(p_name, ' ', '-'), '/?q=1')"
    rows = text_table(spark, folder, "part").selectExpr(
        "p_partkey", f"{card} AS card", f"{flat} AS flat", f"{published} AS published", f"{slug} AS slug"
    )
    titled = rows.selectExpr(
        "p_partkey",
        f"{label_title('card', lit_empty())} AS image_title",
        f"{label_title('card', 'published')} AS heading_title",
        "flat",
        "published",
        f"{slug_title(label_title('flat', 'published'), 'slug')} AS slug_title",
    )
    return titled.selectExpr(
        "p_partkey", "image_title", "heading_title", "slug_title",
        f"{description('flat', 'slug_title', 'published')} AS rest",
    )


_NAME_SQL = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def section_titles(spark, folder):
    """Titles and links of sections made of part rows."""
    body = "concat('Text\n\n#### ', if(p_size % 2 = 0, p_name, 'Aug 13, 2026'), '\nmore')"
    day = "date_format(date_add(DATE'2024-01-01', int(p_partkey % 700)), 'yyyy-MM-dd')"
    anchor = (
        "array(named_struct('target', CASE WHEN p_size % 3 = 0 THEN concat('#part-', p_partkey)"
        " WHEN p_size % 3 = 1 THEN 'https://X.example.com/log?utm_source=a#own' ELSE '/elsewhere' END))"
    )
    return text_table(spark, folder, "part").selectExpr(
        "p_partkey",
        f"{section_title(body, 'p_brand', day)} AS title",
        f"{section_heading_url(anchor, lit_page(), day)} AS url",
    )


def lit_page():
    return "'https://x.example.com/log#top'"


_SECTION_TITLE_SQL = """
WITH p AS (SELECT *, strftime(DATE '2024-01-01' + cast(p_partkey % 700 AS INTEGER), '%Y-%m-%d') AS day FROM part)
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand || ' · ' || day END AS title,
  CASE WHEN p_size % 3 = 0 THEN 'https://x.example.com/log#part-' || p_partkey
       WHEN p_size % 3 = 1 THEN 'https://X.example.com/log?utm_source=a#own'
       ELSE 'https://x.example.com/log#' || day END AS url
FROM p
"""


def page_image_titles(spark, folder):
    """Distinct image titles of a Markdown text made of the lines of a document."""
    marked = "array_join(transform(split(text, '\n'), (l, i) -> concat('![Image ', i, ': ', translate(l, '[]()!', ''), '](x.png)')), ' ')"
    return text_table(spark, folder, "documents").selectExpr(
        "doc_id", f"explode({image_titles(marked)}) AS title"
    )


_IMAGE_TITLES_SQL = r"""
SELECT DISTINCT doc_id, title FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(trim(translate(l, '[]()!', '')), '[`*_~]', '', 'g'), '\s+', ' ', 'g')) AS title
  FROM (SELECT doc_id, unnest(string_split(text, e'\n')) AS l FROM documents)) WHERE title <> ''
"""

QUERIES = {
    "canonical_url_p1_t3": canonical_urls,
    "html_text_p2": html_texts,
    "markdown_text_p3": markdown_texts,
    "article_text_p4": article_texts,
    "item_link_p5": nav_links,
    "rfc_date_p6": rfc_dates,
    "page_date_p7": page_dates,
    "reference_year_p8": reference_years,
    "dates_removed_p9": dates_removed,
    "date_display_p10": display_dates,
    "date_bound_p11": date_bounds,
    "label_title_p12_p13": label_titles,
    "section_title_p14_p15": section_titles,
    "content_key_p16": content_keys,
    "issue_key_p17": issue_keys,
    "attributes_p18": page_attributes,
    "image_titles_a5": page_image_titles,
    "host_allowed_f2": allowed_hosts,
    "article_link_f3": article_links,
}

ORACLES = {
    "canonical_url_p1_t3": f"""
        SELECT page_id, {canonical_sql('url')} AS key, {canonical_sql('shouted')} AS shouted_key
        FROM (SELECT *, {_SHOUTED_SQL} AS shouted FROM pages)""",
    "html_text_p2": _HTML_TEXT_SQL,
    "markdown_text_p3": f"SELECT doc_id, trim({_PLAIN_MD}) AS text, trim({_PLAIN_MD}) AS body FROM documents",
    "article_text_p4": _ARTICLE_SQL,
    "item_link_p5": _NAV_SQL,
    "rfc_date_p6": f"""
        SELECT o_orderkey, strftime({_RFC_UTC_SQL} + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS published,
               cast(NULL AS VARCHAR) AS no_date FROM orders""",
    "page_date_p7": _PAGE_DATE_SQL,
    "reference_year_p8": f"""
        SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN cast(date_part('year', {_STAMP_SQL}) AS INTEGER) ELSE -1 END AS year
        FROM orders""",
    "dates_removed_p9": _DATES_REMOVED_SQL,
    "date_display_p10": _DISPLAY_SQL,
    "date_bound_p11": f"SELECT o_orderkey, coalesce(strftime({BOUND_SQL}, '%Y-%m-%d'), '') AS bound FROM orders",
    "label_title_p12_p13": f"""
        SELECT p_partkey, p_brand AS image_title, {_NAME_SQL} AS heading_title, {_NAME_SQL} AS slug_title,
               p_type || ' sort of ' || p_brand AS rest FROM part""",
    "section_title_p14_p15": _SECTION_TITLE_SQL,
    "content_key_p16": r"""
        SELECT doc_id, 'changelog:' || sha256(source || chr(0) || lang || chr(0)
          || sha256(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS key FROM documents""",
    "issue_key_p17": _ISSUE_KEY_SQL,
    "attributes_p18": """
        SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
               regexp_extract(html, '<div class="([^"]*)"', 1) AS box, 'x&y' AS last_lang FROM pages""",
    "image_titles_a5": _IMAGE_TITLES_SQL,
    "host_allowed_f2": f"""
        SELECT page_id, host, {ALLOWED_SQL.format(h='host')} AS allowed
        FROM (SELECT page_id, {HOST_SQL} AS host FROM pages)""",
    "article_link_f3": f"""
        SELECT page_id, CASE WHEN starts_with(url, 'https://') AND {ALLOWED_SQL.format(h='host')}
          THEN regexp_replace(url, '#.*$', '') END AS article_url
        FROM (SELECT *, {HOST_SQL} AS host FROM pages)""",
}
