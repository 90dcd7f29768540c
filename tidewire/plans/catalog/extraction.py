"""Extractors, on documents that Spark builds from table rows.

The SQL side computes the expected entries from the same columns without building
or reading documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.plans.catalog.common import HOST_SQL, canonical_sql, pages, table, text_table
from tidewire.sources.landing import PAGE_POSITIONS, admit, entry_rows, with_page
from tidewire.sources.registry import REGISTRY, collect, distinct_entries, entries, register
from tidewire.sources.scans import markdown_links

#: More entries than any of the documents has.
_WHOLE = 1_000_000
_NAV = "<a href=\"([^\"]*)\""


def _settings(rows, collector, window, path="/list", hosts=None):
    """One source for each distinct ``source`` of the rows."""
    return rows.select("source").distinct().selectExpr(
        "0 AS source_ord",
        "source",
        f"concat('https://', source, '{path}') AS url",
        f"{hosts or 'array(source)'} AS allowed_hosts",
        f"{window} AS window_size",
        f"'{collector}' AS collector",
        "'inline' AS content_mode",
        "false AS filter",
        "cast(NULL AS INT) AS max_age_days",
    )


def _docs(rows, run, body):
    return rows.selectExpr(f"string({run}) AS run_id", "source", f"cast({body} AS BINARY) AS body")


def _nav_rows(spark, folder):
    """Pages with their navigation words (letters only) and origin."""
    return pages(spark, folder).selectExpr(
        "page_id",
        "host AS source",
        "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin",
        f"transform(regexp_extract_all(html, '{_NAV}', 1), h -> concat('w', regexp_replace(h, '[^\\\\p{{L}}]', ''))) AS words",
    )


_NAV_SQL = f"""
nav AS (SELECT page_id, {HOST_SQL} AS host, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin,
  list_transform(regexp_extract_all(html, '{_NAV}', 1), lambda h: 'w' || regexp_replace(h, '[^\\p{{L}}]', '', 'g')) AS words FROM pages),
word AS (SELECT page_id, host, origin, words, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM nav)
"""


def _entry_frame(docs, sources, collector):
    """Items after the first-wins rule, issues and failures in one frame without NULLs."""
    item = "kind = 'item'"
    text = lambda name: f"if({item}, {name}, '') AS {name}"
    return distinct_entries(entries(docs, sources, collector)).selectExpr(
        "run_id",
        f"coalesce(pos % {PAGE_POSITIONS}, 0L) AS pos",
        "kind",
        text("item_id"),
        "CASE kind WHEN 'item' THEN title WHEN 'issue' THEN issue_title ELSE '' END AS title",
        text("content"),
        "CASE kind WHEN 'item' THEN url WHEN 'issue' THEN issue_url ELSE '' END AS url",
        text("published_at"),
        text("category"),
        "coalesce(message, '') AS message",
        "coalesce(dedupe_key, item_key, '') AS item_key",
    )


# -- feeds -----------------------------------------------------------------


def _feed_docs(spark, folder):
    rows = _nav_rows(spark, folder)
    item = (
        "concat('<item><title> ', w, ' &amp; co </title><link>', origin, '/', w, '#x</link>',"
        " if(i % 2 = 0, concat('<guid isPermaLink=\"false\">g-', i, '</guid>'), ''),"
        " '<description><![CDATA[<p>Go&nbsp;<b>', w, '</b></p><script>no</script>]]></description><pubDate>',"
        " if(i = 1, 'soon', concat('Mon, ', i + 1, ' Aug 2026 0', i, ':00:00 GMT')), '</pubDate>',"
        " '<dc:creator>me</dc:creator><category>c', i, '</category><category>x</category></item>')"
    )
    body = (
        "concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?><rss xmlns:dc=\"d\"><channel><title>t</title>',"
        f" array_join(transform(words, (w, i) -> {item}), '\n'), '</channel></rss>')"
    )
    return _docs(rows, "page_id", body), _settings(rows, "rss", 20)


def feeds(spark, folder):
    return _entry_frame(*_feed_docs(spark, folder), "rss")


_FEED_SQL = f"""
WITH {_NAV_SQL},
e AS (SELECT cast(page_id AS VARCHAR) AS run_id, cast(i + 1 AS BIGINT) AS pos, w, i, origin || '/' || w || '#x' AS url,
        {canonical_sql("(origin || '/' || w)")} AS key FROM word WHERE i < 20),
ok AS (SELECT * FROM e WHERE i <> 1 QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY pos) = 1)
SELECT run_id, pos, 'item' AS kind, CASE WHEN i % 2 = 0 THEN 'g-' || i ELSE key END AS item_id, w || ' & co' AS title,
  'Go ' || w AS content, url, '2026-08-0' || (i + 1) || 'T' || lpad(cast(i + 8 AS VARCHAR), 2, '0') || ':00:00+08:00' AS published_at,
  'c' || i || ', x' AS category, '' AS message, key AS item_key FROM ok
UNION ALL
SELECT run_id, pos, 'issue', '', w || ' & co', '', url, '', '', 'invalid publication date: ''soon''', key FROM e WHERE i = 1
"""


# -- link indexes ----------------------------------------------------------


def _index_docs(spark, folder):
    rows = _nav_rows(spark, folder)
    link = "concat(origin, '/news/', {w})"
    part = (
        "CASE i % 3 WHEN 0 THEN concat('### [', w, ' with many words](', {l}, '?utm_source=a)\nDec ', 28 - i, '\n')"
        " WHEN 1 THEN concat('[![Image ', i, ': ', w, ' pic](http://cdn/i.svg) ### ', w, ' Jan 20](', {l}, ')\n')"
        " ELSE concat('- [Short ', words[0], '](', {f}, ')\n') END"
    ).format(l=link.format(w="w"), f=link.format(w="words[0]"))
    body = (
        "concat('Title: x\nPublished Time: Mon, 09 Mar 2026 08:00:00 GMT\n\n',"
        f" array_join(transform(words, (w, i) -> {part}), ''), '### [Never Apr 31, 2026](http://[)\n')"
    )
    return _docs(rows, "page_id", body), _settings(rows, "markdown_index", 20, path="/news")


def indexes(spark, folder):
    return _entry_frame(*_index_docs(spark, folder), "markdown_index")


# Links 0, 1, 3, 4 (and 6, 7 ...) are candidates; January to December goes back one year.
_INDEX_SQL = f"""
WITH {_NAV_SQL},
e AS (SELECT *, cast(page_id AS VARCHAR) AS run_id,
        row_number() OVER (PARTITION BY page_id ORDER BY i) AS pos,
        origin || '/news/' || w || CASE WHEN i % 3 = 0 THEN '?utm_source=a' ELSE '' END AS url,
        {canonical_sql("(origin || '/news/' || w)")} AS key,
        2026 - (i // 3) AS y,
        len(words) > 2 AND w = words[1] AS hinted FROM word WHERE i % 3 <> 2),
ok AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY pos) = 1),
t AS (SELECT *, CASE WHEN i % 3 = 0 THEN w || ' with many words' ELSE w END AS label FROM ok),
u AS (SELECT *, CASE WHEN hinted AND length('Short ' || words[1]) < length(label) THEN 'Short ' || words[1] ELSE label END AS title FROM t)
SELECT run_id, pos, 'item' AS kind, key AS item_id, title, CASE WHEN starts_with(label, title) THEN '' ELSE label END AS content,
  url, CASE WHEN i % 3 = 0 THEN y || '-12-' || lpad(cast(28 - i AS VARCHAR), 2, '0') ELSE y || '-01-20' END AS published_at,
  '' AS category, '' AS message, key AS item_key FROM u
UNION ALL
SELECT cast(n.page_id AS VARCHAR), coalesce(c.n, 0) + 1, 'issue', '', 'Never', '', 'http://[', '', '',
  'invalid page publication date', 'http://['
FROM nav n LEFT JOIN (SELECT page_id, count(*) AS n FROM e GROUP BY page_id) c ON c.page_id = n.page_id
"""


# -- changelogs ------------------------------------------------------------

_LINE = "concat('Line ', trim(regexp_replace(l, '[^\\\\p{L} ]', '')), '.')"
_LOG_DAY = "date_add(DATE'2024-01-01', int(doc_id % 700))"


def _changelog_docs(spark, folder):
    rows = text_table(spark, folder, "documents").withColumn("source", F.concat("source", F.lit(".example.com")))
    heading = (
        f"CASE WHEN i = 0 THEN concat('### ', date_format({_LOG_DAY}, 'MMM d, yyyy')) WHEN i = 3 THEN concat('## Apr 31, ', year({_LOG_DAY}))"
        f" WHEN i % 2 = 0 THEN concat('### ', date_format({_LOG_DAY}, 'MMMM d')) ELSE concat('#### Notes ', i) END"
    )
    body = (
        f"concat('# Log\n\n', array_join(transform(split(text, '\n'), (l, i) -> concat({heading}, '\n\n', {_LINE}, '\n\n')), ''))"
    )
    return _docs(rows, "doc_id", body), _settings(rows, "markdown_changelog", _WHOLE)


def changelogs(spark, folder):
    return _entry_frame(*_changelog_docs(spark, folder), "markdown_changelog")


_CHANGELOG_SQL = r"""
WITH d AS (SELECT cast(doc_id AS VARCHAR) AS run_id, source || '.example.com' AS source,
    strftime(DATE '2024-01-01' + cast(doc_id % 700 AS INTEGER), '%Y-%m-%d') AS day,
    list_transform(string_split(text, e'\n'), lambda l: 'Line ' || trim(regexp_replace(l, '[^\p{L} ]', '', 'g')) || '.') AS ls FROM documents),
s AS (SELECT run_id, source, day, i // 2 + 1 + CASE WHEN i > 3 THEN 1 ELSE 0 END AS pos,
        ls[i + 1] || CASE WHEN len(ls) > i + 1 AND i <> 2 THEN e'\n\n#### Notes ' || (i + 1) || e'\n\n' || ls[i + 2] ELSE '' END AS content,
        CASE WHEN len(ls) > i + 1 AND i <> 2 THEN 'Notes ' || (i + 1) ELSE source || ' · ' || day END AS title
      FROM (SELECT *, unnest(range(0, len(ls), 2)) AS i FROM d)),
k AS (SELECT *, 'changelog:' || sha256(source || chr(0) || day || chr(0)
        || sha256(trim(regexp_replace(content, '\s+', ' ', 'g')))) AS key FROM s)
SELECT run_id, cast(pos AS BIGINT) AS pos, 'item' AS kind, key AS item_id, title, content,
  'https://' || source || '/list#' || day AS url, day AS published_at, 'Changelog' AS category, '' AS message, key AS item_key FROM k
UNION ALL
SELECT run_id, 3, 'issue', '', 'Apr 31, ' || year(CAST(day AS DATE)), '', 'https://' || source || '/list', '', '',
  'invalid changelog date heading: Apr 31, ' || year(CAST(day AS DATE)),
  'collection:' || sha256(source || chr(0) || 'https://' || source || '/list' || chr(0) || 'apr 31, ' || year(CAST(day AS DATE)))
FROM d WHERE len(ls) > 3
"""


# -- cards -----------------------------------------------------------------


def _card_docs(spark, folder):
    rows = text_table(spark, folder, "part").withColumn("source", F.lower(F.concat(F.translate("p_brand", "#", "-"), F.lit(".example.com"))))
    body = (
        "concat('# M\n\n', if(p_size > 25, '', '#### Nov. 6, 2026\n\n'), '<Card title=\"', p_name, '\" href=\"/p/', p_partkey,"
        " '?utm_campaign=c\">\n  ', p_type, ' **text**.<br />More &amp; more.\n</Card>\n\n#### Sep. 2026\n<Card title=\"', p_brand,"
        " '\" href=\"https://other.example/x\">Bad.</Card>\n<Card title=\"Open\" href=\"/o\">never\n',"
        " '<card title=''Last &amp; best'' href=''/last''>ok</card >')"
    )
    return _docs(rows, "p_partkey", body), _settings(rows, "markdown_cards", 20)


def cards(spark, folder):
    return _entry_frame(*_card_docs(spark, folder), "markdown_cards")


_CARD_SQL = """
WITH p AS (SELECT *, cast(p_partkey AS VARCHAR) AS run_id,
    'https://' || lower(replace(p_brand, '#', '-')) || '.example.com' AS origin FROM part)
SELECT run_id, cast(1 AS BIGINT) AS pos, CASE WHEN p_size > 25 THEN 'issue' ELSE 'item' END AS kind,
  CASE WHEN p_size > 25 THEN '' ELSE origin || '/p/' || p_partkey END AS item_id, p_name AS title,
  CASE WHEN p_size > 25 THEN '' ELSE p_type || ' text. More & more.' END AS content,
  origin || '/p/' || p_partkey || '?utm_campaign=c' AS url, CASE WHEN p_size > 25 THEN '' ELSE '2026-11-06' END AS published_at,
  CASE WHEN p_size > 25 THEN '' ELSE 'Model release' END AS category,
  CASE WHEN p_size > 25 THEN 'Card has no preceding date heading' ELSE '' END AS message,
  origin || '/p/' || p_partkey AS item_key FROM p
UNION ALL SELECT run_id, 2, 'issue', '', p_brand, '', 'https://other.example/x', '', '',
  'link host is not allowed: other.example', 'https://other.example/x' FROM p
UNION ALL SELECT run_id, 3, 'issue', '', 'Open', '', origin || '/o', '', '', 'Card is missing a closing tag', origin || '/o' FROM p
UNION ALL SELECT run_id, 4, 'item', origin || '/last', 'Last & best', 'ok', origin || '/last', '2026-09', 'Model release', '', origin || '/last' FROM p
"""


# -- embedded lists --------------------------------------------------------


def _embedded_docs(spark, folder):
    """Lists of all words: as JSON in a call, in the data script behind it, and in strings of two calls."""
    rows = _nav_rows(spark, folder)
    entry = "to_json(named_struct('id', concat({id}, i, '-', w), 'title', concat(w, ' &amp; co'), {href}, {date}, 'description', '<b>D</b>'))"
    listed = lambda one: f"array_join(transform(words, (w, i) -> {one}), ',')"
    direct = listed(entry.format(id="'j-'", href="'href', concat('/j/', i, w)", date="'date', '2026/09/02'"))
    data = listed(entry.format(id="'d-'", href="'url', concat('/d/', i, w)", date="'publishedAt', if(i = 1, 'not-a-date', '2026-10-11')"))
    string = listed(entry.format(id="'s-'", href="'link', concat('/s/', i, '(', w)", date="'published_at', 'Nov 3, 2026'"))
    string = f"replace(replace({string}, '\\\\', '\\\\\\\\'), '\"', '\\\\\"')"
    body = (
        f"concat('<html><script>self.__next_f.push([0,{{\"articleList\":[', {direct}, ']}}])</script>',"
        f" '<script id=\"__NEXT_DATA__\" type=\"application/json\">{{\"a\":{{\"articleList\":{{\"items\":[', {data}, ',null,', {data}, ']}}}}}}</script>',"
        f" '<p>x</p><script>self.__next_f.push([1,\"a:{{\\\\\"articleList\\\\\":[', {string}, '\"])</script>',"
        " '<script>self.__next_f.push([1,\"]}\"])</script></html>')"
    )
    return _docs(rows, "page_id", body), _settings(rows, "next_data_index", _WHOLE)


def embedded(spark, folder):
    return _entry_frame(*_embedded_docs(spark, folder), "next_data_index")


_EMBEDDED_SQL = f"""
WITH {_NAV_SQL}, n AS (SELECT *, cast(page_id AS VARCHAR) AS run_id, 'https://' || host AS page, cast(len(words) AS BIGINT) AS k FROM nav),
e AS (SELECT run_id, page, host, k, i, w, 0 AS part, i + 1 AS pos, 'j-' || i || '-' || w AS id, page || '/j/' || i || w AS url, '2026-09-02' AS day FROM word JOIN n USING (page_id, host, origin, words)
  UNION ALL SELECT run_id, page, host, k, i, w, 1, k + i + 1, 'd-' || i || '-' || w, page || '/d/' || i || w, CASE WHEN i = 1 THEN NULL ELSE '2026-10-11' END FROM word JOIN n USING (page_id, host, origin, words)
  UNION ALL SELECT run_id, page, host, k, i, w, 2, 2 * k + 1 + i + 1, 's-' || i || '-' || w, page || '/s/' || i || '(' || w, '2026-11-03' FROM word JOIN n USING (page_id, host, origin, words)),
u AS (SELECT *, {canonical_sql("url")} AS key FROM e)
SELECT run_id, cast(pos AS BIGINT) AS pos, CASE WHEN day IS NULL THEN 'issue' ELSE 'item' END AS kind, CASE WHEN day IS NULL THEN '' ELSE id END AS item_id,
  w || ' & co' AS title, CASE WHEN day IS NULL THEN '' ELSE 'D' END AS content, url, coalesce(day, '') AS published_at,
  CASE WHEN day IS NULL THEN '' ELSE 'Research' END AS category, CASE WHEN day IS NULL THEN 'articleList item has an invalid date' ELSE '' END AS message,
  key AS item_key FROM u
UNION ALL SELECT run_id, 2 * k + 1, 'issue', '', '', '', '', '', '', 'articleList item must be an object',
  'collection:' || sha256(host || chr(0) || page || '/list' || chr(0) || 'index:' || (2 * k + 1)) FROM n
"""


# -- scans and gates -------------------------------------------------------


def link_scan(spark, folder):
    """Links with nesting, escapes and titles, made of the navigation words."""
    rows = _nav_rows(spark, folder)
    text = (
        "array_join(transform(words, (w, i) -> concat('## [![pic [', i, ']](http://i/', i, '.png) ', w, '](http://h/', w, '(', i, ') \"title\")',"
        " ' ![alone](http://i/x.png) [open ', i, ' \\\\[esc\\\\] - [', w, '](<http://h/a b> \"t\")\n')), '')"
    )
    found = rows.select("page_id", F.expr(text).alias("text")).withColumn("links", markdown_links("text"))
    return found.select("page_id", F.posexplode("links").alias("n", "k")).selectExpr(
        "page_id", "cast(n AS INT) AS n", "k.label AS label", "k.target AS target", "k.lead AS lead"
    )


# Every unclosed "[open" swallows nothing: the links behind it count.
_SCAN_SQL = f"""
WITH {_NAV_SQL}
SELECT page_id, cast(2 * i AS INTEGER) AS n, '![pic [' || i || ']](http://i/' || i || '.png) ' || w AS label,
  'http://h/' || w || '(' || i || ')' AS target, '##' AS lead FROM word
UNION ALL SELECT page_id, cast(2 * i + 1 AS INTEGER), w, 'http://h/a b', '-' FROM word
"""


def gates(spark, folder):
    """Documents too large, not UTF-8, or admitted with their whole text."""
    rows = table(spark, folder, "documents")
    docs = _docs(rows, "doc_id", "text").join(
        rows.selectExpr("string(doc_id) AS run_id", "lang"), "run_id"
    ).withColumn("body", F.expr("if(lang = 'es', concat(body, unhex('FF')), body)"))
    kept = admit(docs.drop("lang"), _settings(rows, "markdown_index", 20), "markdown_index", max_bytes=2000)
    return kept.selectExpr("run_id", "source", "coalesce(source_error, '') AS error", "coalesce(length(text), -1) AS chars")


def source_pages(spark, folder):
    """Documents as pages of their source, all landed in one batch, newest day last."""
    day = "timestamp_seconds(86400 * (n_chars % 50))"
    rows = table(spark, folder, "documents").selectExpr(
        "'r' AS run_id", "source", "string(doc_id) AS doc_id", f"{day} AS fetched_at", "cast(text AS BINARY) AS body"
    )
    return with_page(rows).selectExpr("source", "doc_id", "bigint(page_no) AS page_no")


_BUILDERS = {
    "rss": (_feed_docs, _FEED_SQL),
    "markdown_index": (_index_docs, _INDEX_SQL),
    "markdown_changelog": (_changelog_docs, _CHANGELOG_SQL),
    "markdown_cards": (_card_docs, _CARD_SQL),
    "next_data_index": (_embedded_docs, _EMBEDDED_SQL),
}


def registry_counts(spark, folder):
    """Sources of all five kinds collected in one frame, from a landing folder with the kind of each page."""
    docs = sources = None
    for collector, (build, _) in _BUILDERS.items():
        landed, settings = build(spark, folder)
        landed = landed.withColumn("collector", F.lit(collector))
        docs = landed if docs is None else docs.unionByName(landed)
        sources = settings if sources is None else sources.unionByName(settings)
    rows = collect(docs, sources)
    text = F.when(F.col("kind") == "item", F.concat_ws("|", "title", "content", "url")).otherwise(F.col("issue_title"))
    return rows.groupBy("collector", "kind").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length(text)).cast("long").alias("chars")
    )


_REGISTRY_SQL = " UNION ALL ".join(
    f"""SELECT '{collector}' AS collector, kind, count(*) AS rows, cast(sum(length(
      CASE WHEN kind = 'item' THEN title || '|' || content || '|' || url ELSE title END)) AS BIGINT) AS chars FROM ({sql}) GROUP BY kind"""
    for collector, (_, sql) in _BUILDERS.items()
)

def _text_entries(docs):
    """An extractor of a user's own: a page is one entry."""
    rows = docs.withColumn("pos", F.lit(1))
    return entry_rows(
        rows, error="if(source_error IS NULL AND trim(text) = '', 'empty page', NULL)", issue_title="''", issue_url="page_url",
        item_id="sha2(text, 256)", title="substring(text, 1, 80)", content="text", url="page_url", dedupe_key="sha2(text, 256)",
    )


def own_extractor(spark, folder):
    """Documents as pages of a kind that is registered here."""
    rows = table(spark, folder, "documents")
    register("whole_text", _text_entries, "Text")
    try:
        found = collect(_docs(rows, "doc_id", "text"), _settings(rows, "whole_text", 1), ["whole_text"], max_bytes=20_000)
    finally:
        REGISTRY.pop("whole_text")
    return found.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("content").alias("texts"))


_OWN_SQL = """
SELECT source, CASE WHEN strlen(text) > 20000 THEN 'failure' WHEN trim(text, ' ') = '' THEN 'issue' ELSE 'item' END AS kind,
  count(*) AS rows, count(DISTINCT CASE WHEN strlen(text) <= 20000 THEN text END) AS texts FROM documents GROUP BY ALL
"""

QUERIES = {
    "own_extractor_x1": own_extractor,
    "landing_gates_s1_s2": gates,
    "source_pages_s1_r1": source_pages,
    "rss_items_s3": feeds,
    "index_links_s4_s4b": indexes,
    "link_scan_s4a": link_scan,
    "changelog_sections_s5_w7": changelogs,
    "cards_s6_j7": cards,
    "embedded_json_s7_a4": embedded,
    "collect_registry_s8_x1": registry_counts,
}

ORACLES = {
    "own_extractor_x1": _OWN_SQL,
    "landing_gates_s1_s2": """
        WITH d AS (SELECT *, strlen(text) + CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS bytes FROM documents)
        SELECT cast(doc_id AS VARCHAR) AS run_id, source,
          CASE WHEN bytes > 2000 THEN 'Markdown index response exceeds 2000 byte limit'
               WHEN lang = 'es' THEN 'Markdown index response is not valid UTF-8' ELSE '' END AS error,
          cast(CASE WHEN bytes > 2000 OR lang = 'es' THEN -1 ELSE length(text) END AS INTEGER) AS chars FROM d""",
    "source_pages_s1_r1": """
        SELECT source, cast(doc_id AS VARCHAR) AS doc_id,
          row_number() OVER (PARTITION BY source ORDER BY n_chars % 50, cast(doc_id AS VARCHAR)) - 1 AS page_no FROM documents""",
    "rss_items_s3": _FEED_SQL,
    "index_links_s4_s4b": _INDEX_SQL,
    "link_scan_s4a": _SCAN_SQL,
    "changelog_sections_s5_w7": _CHANGELOG_SQL,
    "cards_s6_j7": _CARD_SQL,
    "embedded_json_s7_a4": _EMBEDDED_SQL,
    "collect_registry_s8_x1": _REGISTRY_SQL,
}
