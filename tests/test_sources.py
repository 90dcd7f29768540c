import datetime
import json

import pytest

from tests.helpers import entry_list, picked, raw_docs, source, source_table
from tidewire.functions.text import clean_html
from tidewire.sources.registry import REGISTRY, collect, distinct_entries, entries, register, split_entries

FEED = """<?xml version="1.0" encoding="utf-8"?>
<rss version="2.0" xmlns:meta="urn:meta" xmlns:full="urn:full"><channel><link>https://docs.example.com/</link>
<item><link>https://docs.example.com/undated</link><title>Undated</title></item>
<item><title><![CDATA[Release <i>nine</i> & ten]]></title>
 <meta:author>R. Roe</meta:author><pubDate>Wed, 04 Mar 2026 23:15:00 -0500</pubDate>
 <link>https://docs.example.com/release/9?b=2&amp;a=1</link>
 <full:encoded>&lt;ul&gt;&lt;li&gt;faster&lt;/li&gt;&lt;li&gt;smaller&lt;/li&gt;&lt;/ul&gt;</full:encoded></item>
<item><title>Nowhere</title><pubDate>Thu, 05 Mar 2026 00:00:00 +0000</pubDate></item>
<item><guid>tag:42</guid><title>Forty-two</title><category> How </category><link> https://docs.example.com/42 </link>
 <pubDate>5 Mar 2026 16:30:59 UT</pubDate><description>plain words</description></item>
<item><title>Elsewhere</title><link>https://docs.other.example/x</link><pubDate>Fri, 06 Mar 2026 00:00:00 GMT</pubDate></item>
<item><title>Nine once more</title><link>https://docs.example.com/release/9?a=1&amp;b=2&amp;utm_source=mail</link>
 <pubDate>Fri, 06 Mar 2026 01:00:00 +0100</pubDate></item>
</channel></rss>"""

INDEX = """Published Time: Mon, 09 Mar 2026 08:00:00 +0000

# Journal
[logo](/logo.svg) ### [Way in](#start)
### [Broken bracket](http://[::)
### [Leap day Feb 29, 2025](https://docs.example.com/journal/leap)
### [Guides for everyone](https://docs.example.com/journal/guides)
March 3
[![Image 7: Quiet release](https://img.example.net/7.png) ### Quiet release It is calm. Feb 11](https://docs.example.com/journal/quiet?utm_campaign=z)
### [Sunday 日志](https://docs.example.com/journal/sunday)
2025年12月28日
* [Tips](https://docs.example.com/journal/tips)
[Tips and many other words that follow Nov 30](https://docs.example.com/journal/tips)
### [Partner post](https://partner.example/post)
October 5, 2025
"""

CHANGELOG = """# What changed

## 2026

intro that belongs to nothing

### March 18, 2026

- tables
- views

#### Why

Because.

### [March 2](#second-of-march)

Faster.

### Date: later

Nothing to see.

## February 2026

### February 30

Not a day.

### February 9

## January 2026

A quiet month.
"""

CARDS = """Intro <b>text</b>

<Card title="Too early" href="/cards/early">No heading yet.</Card>

### May 2026

<Card href="/cards/one" title="One &lt;1&gt;">
First **bold** line<br/>and [a link](https://x.example/).
</Card>

## 17 and more words

<Card title="Two" href="https://cards.example.com/cards/two#part">Second.</Card >
<Card title="" href="/cards/none">No title.</Card>
<Card title="Nowhere">No target.</Card>
### April 31, 2026
<Card title="Never" href="/cards/never">Impossible day.</Card>
### April 4, 2026
<Card title="Left open" href="/cards/open">no end
<Card title="Last" href="/cards/last">Done.</Card>
<Card title="Torn" href="/cards/torn"
"""

PAGE = """<html><head><script>self.__next_f.push([0])</script>
<script>self.__next_f.push([1,"9:[{\\"articleList\\":{\\"items\\":[{\\"title\\":\\"Split (a)\\",\\"url\\":"])</script></head>
<script>self.__next_f.push([1,"\\"/news/split\\",\\"published_at\\":\\"2026-01-31\\",\\"id\\":31}]}}]"])</script>
<script type="application/json" id=__NEXT_DATA__>{"tree":[{"articleList":[
 {"title":"Date is missing","link":"/news/undated"},
 "a string",
 {"title":"&lt;Plain&gt; title","link":"https://news.example.org/plain","date":"2026-02","description":["x",1]},
 {"title":"","href":"/news/empty","date":"2026-02-01"},
 {"title":"Null target","href":null,"date":"2026-02-01"},
 {"date":"Feb 3, 2026","href":"/news/third","title":"Third","id":true}
]}]}</script></html>"""


def test_rss(spark):
    rows = entry_list(spark, source("Docs", "https://docs.example.com/rss", "rss"), FEED)
    assert picked(rows, "item", "item_id", "title", "content", "published_at", "author", "category") == [
        ("https://docs.example.com/release/9?a=1&b=2", "Release nine & ten", "faster smaller", "2026-03-05T12:15:00+08:00", "R. Roe", ""),
        ("tag:42", "Forty-two", "plain words", "2026-03-06T00:30:59+08:00", "", "How"),
        ("https://docs.example.com/release/9?a=1&b=2", "Nine once more", "", "2026-03-06T08:00:00+08:00", "", ""),
    ]
    assert picked(rows, "issue", "pos", "issue_title", "message") == [
        (1, "Undated", "missing pubDate"),
        (3, "Nowhere", "missing link"),
        (5, "Elsewhere", "link host is not allowed: docs.other.example"),
    ]


def test_rss_window_and_failures(spark):
    two = source("Docs", "https://docs.example.com/rss", "rss", window=2)
    assert len(entry_list(spark, two, FEED)) == 2
    for body, text in (("<rss><channel>", "invalid RSS XML"), ("<rss><channel/></rss>", "no item elements")):
        (row,) = entry_list(spark, two, body)
        assert row["kind"] == "failure" and text in row["message"]


@pytest.mark.parametrize("encoding", ["utf-16", "iso-8859-1", "utf-8-sig"])
def test_rss_encodings(spark, encoding):
    name = encoding.replace("-sig", "")
    head = f"<?xml version=\"1.0\" {' ' * 300} encoding=\"{name}\"?>"
    body = head + "<rss><channel><item><title>Größe</title><link>https://docs.example.com/g</link><pubDate>5 Mar 2026 00:00:00 GMT</pubDate></item></channel></rss>"
    (row,) = entry_list(spark, source("Docs", "https://docs.example.com/rss", "rss"), body.encode(encoding))
    assert row["title"] == "Größe"


def test_index_links(spark):
    settings = source("Journal", "https://docs.example.com/journal", "markdown_index")
    rows = entry_list(spark, settings, INDEX)
    assert picked(rows, "item", "title", "published_at", "url") == [
        ("Guides for everyone", "2026-03-03", "https://docs.example.com/journal/guides"),
        ("Quiet release", "2026-02-11", "https://docs.example.com/journal/quiet?utm_campaign=z"),
        ("Sunday 日志", "2025-12-28", "https://docs.example.com/journal/sunday"),
        ("Tips", "2025-11-30", "https://docs.example.com/journal/tips"),
    ]
    assert picked(rows, "issue", "issue_title", "message") == [
        ("Broken bracket", "Invalid IPv6 URL"),
        ("Leap day", "invalid page publication date"),
        ("Partner post", "link host is not allowed: partner.example"),
    ]


def test_changelog(spark):
    settings = source("Log", "https://docs.example.com/log", "markdown_changelog")
    rows = entry_list(spark, settings, CHANGELOG)
    assert picked(rows, "item", "published_at", "title", "url") == [
        ("2026-03-18", "Why", "https://docs.example.com/log#2026-03-18"),
        ("2026-03-02", "Log · 2026-03-02", "https://docs.example.com/log#second-of-march"),
        ("2026-01", "Log · 2026-01", "https://docs.example.com/log#2026-01"),
    ]
    assert rows[0]["content"] == "tables\n- views\n\n#### Why\n\nBecause."
    assert picked(rows, "issue", "issue_title", "message") == [
        ("Date: later", "invalid changelog date heading: Date: later"),
        ("February 30", "invalid changelog date heading: February 30"),
        ("February 9", "dated changelog section has no content"),
    ]
    assert len(entry_list(spark, {**settings, "window_size": 3}, CHANGELOG)) == 3
    other = entry_list(spark, settings, CHANGELOG.replace("Faster.", "Slower."))
    assert [a["dedupe_key"] == b["dedupe_key"] for a, b in zip(rows[:2], other[:2])] == [True, False]


def test_cards(spark):
    rows = entry_list(spark, source("Cards", "https://cards.example.com/all", "markdown_cards"), CARDS)
    assert picked(rows, "item", "title", "published_at", "content", "url") == [
        ("One <1>", "2026-05", "First bold line and a link.", "https://cards.example.com/cards/one"),
        ("Two", "2026-05", "Second.", "https://cards.example.com/cards/two#part"),
        ("Last", "2026-04-04", "Done.", "https://cards.example.com/cards/last"),
    ]
    assert picked(rows, "issue", "issue_title", "message") == [
        ("Too early", "Card has no preceding date heading"),
        ("", "Card is missing title"),
        ("Nowhere", "Card is missing href"),
        ("Never", "Card has no preceding date heading"),
        ("Left open", "Card is missing a closing tag"),
        ("Torn", "Card has a malformed opening tag"),
    ]


def test_feeds_in_declared_encodings(spark):
    def feed(encoding, title, tail=b""):
        item = f"<item><title>{title}</title><link>https://docs.example.com/x</link><pubDate>5 Mar 2026 16:30:59 UT</pubDate>"
        head = f'<?xml version="1.0" encoding="{encoding}"?><rss><channel>{item}'
        return head.encode(encoding) + tail + "</item></channel></rss>".encode(encoding)

    cases = {"windows-1252": "“q” – €", "CP1252": "œuvre", "iso-8859-15": "€ Š", "ISO-8859-1": "ä", "koi8-r": "Новость",
             "windows-1251": "Весть", "iso-8859-7": "νέα", "utf-16": "日本", "utf-8": "日本"}
    pages = [(f"S{i}", feed(name, title)) for i, (name, title) in enumerate(cases.items())]
    pages.append(("gap", feed("windows-1252", "x", b"<a>\x81</a>")))
    pages.append(("odd", feed("utf-8", "x").replace(b"utf-8", b"x-no-such")))
    sources = source_table(spark, *(source(name, "https://docs.example.com/rss", "rss", hosts=("docs.example.com",)) for name, _ in pages))
    rows = {r["source"]: r for r in entries(raw_docs(spark, *pages), sources, "rss").collect()}
    assert [rows[f"S{i}"]["title"] for i in range(len(cases))] == list(cases.values())
    assert rows["gap"]["kind"] == rows["odd"]["kind"] == "failure"


def test_embedded_json(spark):
    settings = source("Site", "https://www.example.com/news/", "next_data_index", hosts=("example.com", "news.example.org"))
    rows = entry_list(spark, settings, PAGE)
    assert picked(rows, "item", "item_id", "title", "published_at", "url") == [
        ("https://news.example.org/plain", "<Plain> title", "2026-02", "https://news.example.org/plain"),
        ("True", "Third", "2026-02-03", "https://www.example.com/news/third"),
        ("31", "Split (a)", "2026-01-31", "https://www.example.com/news/split"),
    ]
    assert picked(rows, "issue", "pos", "message") == [
        (1, "articleList item date must be a string"),
        (2, "articleList item must be an object"),
        (4, "articleList item is missing title"),
        (5, "articleList item href must be a string"),
    ]


def test_embedded_lists_anywhere(spark):
    settings = source("Site", "https://www.example.com/news/", "next_data_index")

    def entry(name):
        return json.dumps({"title": name, "href": f"/{name}", "date": "2026-02-03"})

    def listed(page):
        return [r["title"] or r["message"] for r in entry_list(spark, settings, page)]

    def data(body):
        return f"<script id='__NEXT_DATA__'>{body}</script>"

    def push(*parts):
        return "<script>" + ";".join(f"self.__next_f.push({p})" for p in parts) + "</script>"

    def text(body):
        return json.dumps([1, body])

    a, b, c, d = (entry(n) for n in "abcd")
    listing = '{"articleList":[%s]}'
    # Scripts count in their order; lists in strings come behind.
    assert listed(push(text(f'x:{listing % c}'), listing % b) + data(listing % a) + push(listing % d)) == ["b", "a", "d", "c"]
    # A list in a list, items of an object, deep values, names in other values.
    inner = '{"articleList":{"items":[%s],"more":{"articleList":[%s]}},"note":"articleList"}' % (a, b)
    assert listed(data('{"x":' * 400 + inner + "}" * 400)) == ["a", "b"]
    assert listed(data('{"articleList":[%s,{"articleList":[%s]}]}' % (a, b))) == ["a", "articleList item title must be a string", "b"]
    # Strings of one call, over calls, with quotes and parentheses; calls that are not JSON are passed over.
    cut = len(f"y:{listing % a}") // 2
    whole = f"y:{listing % a} ) ("
    assert listed(push(text(whole[:cut]), "undefined", "f(1)", text(whole[cut:]))) == ["a"]
    assert listed(push('{"k\\"":["z",{"s":%s}]}' % json.dumps(f"'articleList' : [{b}] tail"))) == ["b"]
    assert listed(push(text("z" * 300_000 + '\\"' * 50_000 + listing % c))) == ["c"]
    # Data that is not JSON as a whole has no lists, an empty list has no entries.
    nothing = ["invalid Next.js index: articleList.items was not found"]
    for broken in (listing % a + " x", listing % a + "]", listing % a + ",1", "", "{}", '{"articleList":3}'):
        assert listed(data(broken)) == nothing
    assert listed(data('{"articleList":[]}')) == []
    assert listed("<!-- " + data(listing % a) + " -->" + data(listing % b)) == ["b"]


def test_no_page_stops_a_job(spark):
    deep = '{"articleList":' + "[" * 5000 + "]" * 5000 + "}"
    page = f'<script id="__NEXT_DATA__">{deep}</script>'
    (row,) = entry_list(spark, source("Site", "https://www.example.com/n", "next_data_index"), page)
    assert row["kind"] == "failure" and "was not found" in row["message"]
    for tag in ("<p " + "a" * 1_000_000, "<p " + "a" * 1_000_000 + ">", "<p " + "x='>' " * 200_000 + ">", "<!--" + "-<" * 400_000 + "-->"):
        frame = spark.createDataFrame([(f"{tag}<br>tail",)], "t string")
        assert frame.selectExpr(f"{clean_html('t')} AS c").first()["c"].endswith("tail")
    feed = FEED.replace("plain words", "<![CDATA[" + "<" * 300_000 + "]]> w")
    assert len(entry_list(spark, source("Docs", "https://docs.example.com/rss", "rss"), feed)) == 6


def test_pages_of_one_source_stay_apart(spark):
    later = CHANGELOG.replace("Faster.", "Later.")
    settings = source_table(spark, source("Log", "https://docs.example.com/log", "markdown_changelog"))
    at = [datetime.datetime(2026, 3, 20), datetime.datetime(2026, 3, 19)]
    rows = entries(raw_docs(spark, ("Log", later), ("Log", CHANGELOG), times=at), settings, "markdown_changelog").collect()
    assert len(rows) == 12 and len({r["pos"] for r in rows}) == 12
    first = [r for r in sorted(rows, key=lambda r: r["pos"]) if r["kind"] == "item"]
    assert [r["content"] for r in first if r["published_at"] == "2026-03-02"] == ["Faster.", "Later."]
    bad = "### May 1, 2026\n\n### May 2, 2026\n\nText.\n"
    pages = raw_docs(spark, ("Log", bad), ("Log", bad + "\n"))
    found = distinct_entries(entries(pages, settings, "markdown_changelog"))
    assert found.where("kind = 'issue'").count() == 2


@pytest.mark.parametrize("collector", sorted(REGISTRY))
def test_gates(spark, collector):
    settings = source("S", "https://example.com/s", collector)
    (row,) = entry_list(spark, settings, "12345", max_bytes=4)
    assert row["kind"] == "failure" and "exceeds 4 byte limit" in row["message"]
    (row,) = entry_list(spark, settings, b"<a>\xff\xfe</a>")
    assert row["kind"] == "failure" and ("UTF-8" in row["message"] or collector == "rss")
    (row,) = entry_list(spark, settings, "nothing here")
    assert row["kind"] == "failure"


def test_registry(spark):
    assert set(REGISTRY) == {"rss", "markdown_index", "markdown_changelog", "markdown_cards", "next_data_index"}
    with pytest.raises(ValueError, match="unsupported collector"):
        entries(raw_docs(spark, ("x", "y")), source_table(spark, source("x", "u", "zip")), "zip")
    table = source_table(
        spark,
        source("News", "https://docs.example.com/rss", "rss", ordinal=0),
        source("API", "https://docs.example.com/log", "markdown_changelog", ordinal=1),
    )
    docs = raw_docs(spark, ("News", FEED), ("API", CHANGELOG))
    rows = collect(docs, table)
    assert {(r["source"], r["kind"]): r["count"] for r in rows.groupBy("source", "kind").count().collect()} == {
        ("News", "item"): 2, ("News", "issue"): 3, ("API", "item"): 3, ("API", "issue"): 3,
    }
    register("custom", REGISTRY["rss"])
    try:
        custom = entries(docs, source_table(spark, source("News", "https://docs.example.com/rss", "custom")), "custom")
        assert custom.count() == 6
    finally:
        REGISTRY.pop("custom")


def _plan(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.debug.maxToStringFields")


def test_a_card_is_parsed_once(spark):
    """Attributes are read once, and four texts as URLs: page, target, link and, for issues, a target that was mended."""
    settings = source("a", "https://a.example/l", "markdown_cards")
    plan = _plan(entries(raw_docs(spark, ("a", "<Card")), source_table(spark, settings), "markdown_cards"))
    assert plan.count(r"([A-Za-z_:][\w:.-]*)\s*=\s*") == 1
    assert plan.count(r"(//[^/?#]*)?") == 7  # and three in the keys of items and issues


def test_the_encoding_of_a_feed_is_read_once(spark):
    settings = source("a", "https://a.example/l", "rss")
    plan = _plan(entries(raw_docs(spark, ("a", "<rss/>")), source_table(spark, settings), "rss"))
    assert plan.count(r"encoding\s*=") == 1
