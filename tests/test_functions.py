import datetime
import html
import random
from urllib.parse import parse_qsl, urlencode, urljoin

import pytest
from pyspark.sql import functions as F
from tidewire.functions import dates, identity, text, urls
from tidewire.sources.scans import find_links


def apply(spark, function, values, *more):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = frame.select("i", F.expr(function("x", *more)).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_columns_and_text_give_the_same(spark):
    frame = spark.createDataFrame([("HTTP://A.com:80/x#y", "z")], "a string, b string")
    row = frame.select(
        urls.canonical_url(F.col("a")).alias("c"),
        F.expr(urls.canonical_url("a")).alias("s"),
        urls.resolve(F.col("a"), F.col("b")).alias("j"),
    ).first()
    assert row["c"] == row["s"] == "http://a.com/x" and row["j"] == "HTTP://A.com:80/z".replace("HTTP", "http")


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://Example.COM:443/one?utm_source=x&b=2&a=1#section", "https://example.com/one?a=1&b=2"),
        ("  http://u:p@h.com:8080?a&b=%zz&c=~*+x&& ", "http://h.com:8080/?a=&b=%25zz&c=~%2A+x"),
        ("http://[::1]:80/x", "http://[::1]/x"),
        ("http://[bad/x#f", "http://[bad/x"),
        ("http://h:99999/#z", "http://h:99999/"),
        ("http://h:/p", "http://h/p"),
        ("http://h:0/p", "http://h:0/p"),
        ("http://h.com./A%20b/", "http://h.com/A%20b/"),
        ("http://h/?FBCLID=1&UTM_x=2&q=é", "http://h/?q=%C3%A9"),
        ("not a url#x", "not a url"),
        ("", ""),
    ],
)
def test_canonical_url(spark, url, expected):
    assert apply(spark, urls.canonical_url, [url]) == [expected]


def test_canonical_query_as_form_encoding(spark):
    rng = random.Random(7)
    queries = ["&".join("".join(rng.choice("aZ0=%+~* é_-.") for _ in range(rng.randint(0, 6))) for _ in range(4)) for _ in range(200)]
    expected = []
    for q in queries:
        encoded = urlencode(sorted(parse_qsl(q.rstrip(), keep_blank_values=True)))
        expected.append("http://h/p" + ("?" + encoded if encoded else ""))
    assert apply(spark, urls.canonical_url, ["http://h/p?" + q for q in queries]) == expected


def test_resolve_like_rfc(spark):
    base = "https://example.com/a/b;c?q=1#f"
    targets = ["c", "../c", "/d", "?x=1", "#z", "//h/p", "", "./", "..", "../../..", "a//b", "/x/./y/../z", "http://o/p?", "mailto:x", "g;x=1/../y"]
    assert apply(spark, lambda x: urls.resolve(f"'{base}'", x), targets) == [urljoin(base, t) for t in targets]
    assert apply(spark, lambda x: urls.resolve(f"'{base}'", x), ["http://["]) == [None]
    assert apply(spark, lambda x: urls.issue_url(f"'{base}'", x), ["http://[" + "x" * 3000])[0] == ("http://[" + "x" * 3000)


def test_item_link(spark):
    got = apply(
        spark,
        lambda x: urls.item_link(x, "'https://example.com/a/b'", "array('example.com')"),
        ["<c>", "#x", " ", "http://evil.com/", "https://u@example.com/", "https://www.example.com./x",
         "https://example.com:0/", "https://badexample.com/", "ftp://example.com/", "/x?a=1&amp;b=2"],
    )
    assert [r["url"] for r in got] == [
        "https://example.com/a/c", None, None, None, None, "https://www.example.com./x", None, None, None,
        "https://example.com/x?a=1&b=2",
    ]
    assert got[3]["error"] == "link host is not allowed: evil.com"
    assert got[1]["error"] == "link is not an article HTTP(S) URL"


def test_article_link_and_hosts(spark):
    values = ["https://a.com/x#y", "http://a.com/", "https://b.a.com/", "https://a.com.evil.org/", "https://u:p@a.com/", "https://a.com:x/"]
    got = apply(spark, lambda x: urls.article_link(x, "array('a.com')"), values)
    assert got == ["https://a.com/x", None, "https://b.a.com/", None, None, None]
    assert urls.checked_hosts([" A.com "]) == ["a.com"]
    for bad in ("a.com", [], [""], ["a.com/"], ["a..b"], ["https://a.com"], ["a:1"], [1], ["-a.com"], ["x" * 64 + ".com"]):
        with pytest.raises(ValueError):
            urls.checked_hosts(bad)


def test_unescape_like_the_standard(spark):
    rng = random.Random(3)
    names = ["&amp;", "&lt", "&copy", "&notit;", "&#233;", "&#x1F600;", "&#128;", "&#0;", "&bogus;", "&", "&;", "&#;",
             "&CounterClockwiseContourIntegral;", "&NotEqualTilde;", "&ampamp;", "&#x110000;", "&#xD800;", "&#11;", "&#129;", "&#13;",
             "&Tab;", "&AMP", "&nbsp;", "&frac12x", "&#99999999999999;"]
    values = ["".join(rng.choice(names + ["a", " ", ";", "#"]) for _ in range(8)) for _ in range(300)]
    assert apply(spark, text.unescape, values) == [html.unescape(v) for v in values]


def test_texts(spark):
    assert apply(spark, text.clean_html, ["<p>A&nbsp; B</p><style>hidden</style> C", "a < b", "x<!-- <p> -->y<br/>z", "<a title='>'>k</a>"]) == [
        "A B C", "a < b", "xy z", "k"]
    assert apply(spark, text.squeeze, ["\u3000a\x1c\x1db\xa0\n"]) == ["a b"]
    assert apply(spark, text.markdown_text, ["![i](u) [t](v) **b** `c` <br> &amp; ~d~"]) == ["t b c & d"]
    page = "# T\n![a](b)\nURL Source: http://x\n[text](http://u) and <http://h/a> http://h/b c\n\n\n\n[r]: http://ref x\nend"
    assert apply(spark, text.article_text, [page]) == ["# T\n\ntext and c\n\nend"]
    assert "[text](http://u)" in apply(spark, lambda x: text.article_text(x, retain_links=True), [page])[0]


def test_dates(spark):
    assert apply(spark, dates.rfc822_to_beijing, [
        "Sun, 10 Aug 2026 12:30:00 +0800", "10 Aug 2026 04:00:00", "10 Aug 2026 04:00:00 -0700", "not a date",
        "Sun, 10 Aug 2026", "10 Aug 26 23:30 EST", "31 Feb 2026 00:00:00 GMT",
    ]) == ["2026-08-10T12:30:00+08:00", "2026-08-10T12:00:00+08:00", "2026-08-10T19:00:00+08:00", None, None,
           "2026-08-11T12:30:00+08:00", None]
    day = datetime.date
    assert apply(spark, dates.date_bound, [
        "2026-08-10T23:00:00+00:00", "2026-02", "2028-02", "2026-13", "2026-02-30", " ", "Jul 20", "2026年8月", "2026-07-20", "2026-08-10T12:00",
    ]) == [day(2026, 8, 11), day(2026, 2, 28), day(2028, 2, 29), None, None, None, None, None, day(2026, 7, 20), day(2026, 8, 10)]
    assert apply(spark, dates.display_time, ["", "2026-02", "Jul 20", " 2026-08-10T12:00:00Z "]) == [
        "日期未知", "2026-02", "Jul 20", "2026-08-10 20:00:00"]
    found = apply(spark, lambda x: dates.page_date(dates.page_date_parts(x), "2025"), [
        "Aug 13, 2026", "August, 2026", "Sept. 3", "2025年11月07日", "2026/2/30", "none", "v2026-1", "12026-01-02", "Feb 29",
    ])
    assert found == ["2026-08-13", "2026-08", "2025-09-03", "2025-11-07", None, "", "2026-01", "", None]
    assert apply(spark, dates.without_dates, ["a 2026-01-02 b Jan. 3, 2026 c 2025年3月 d"]) == ["a b c 2025年3月 d"]
    assert apply(spark, dates.precision, ["", "2026-02", "2026-02-03", "2026-02-03T01:02:03+08:00", "x"]) == [
        "none", "month", "day", "second", "text"]


def test_session_time_zone_does_not_matter(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert apply(spark, dates.rfc822_to_beijing, ["8 Mar 2026 02:30:00 GMT"]) == ["2026-03-08T10:30:00+08:00"]
        assert apply(spark, dates.date_bound, ["2026-03-07T20:30:00+00:00"]) == [datetime.date(2026, 3, 8)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_identities(spark):
    key = lambda x: identity.content_key("'s'", "'2026-01'", x)
    a, b, c = apply(spark, key, ["One  two\n", "One two", "One too"])
    assert a == b != c and a.startswith("changelog:")
    assert apply(spark, lambda x: identity.dedupe_key(x, "'http://H/a#b'"), [" k ", "", None]) == ["k", "http://h/a", "http://h/a"]
    issue = lambda x: identity.issue_key("'s'", "'http://h/l'", "'A  b'", x, "3")
    assert apply(spark, issue, ["http://h/a#b", "http://h/l#x", ""])[0] == "http://h/a"
    own = apply(spark, issue, ["http://h/l#x", ""])
    assert own[0] == own[1] and own[0].startswith("collection:")


def scan(markdown):
    """Links by direct search from each bracket, as a check of the one-pass scan."""
    found, at = [], 0

    def closing(start, opener, closer):
        depth, i = 1, start
        while i < len(markdown):
            if markdown[i] == "\\":
                i += 2
                continue
            depth += {opener: 1, closer: -1}.get(markdown[i], 0)
            if depth == 0:
                return i
            i += 1
        return None

    while (at := markdown.find("[", at)) >= 0:
        end = None
        if not (at and markdown[at - 1] == "!"):
            label = closing(at + 1, "[", "]")
            if label is not None and markdown[label + 1 : label + 2] == "(":
                end = closing(label + 2, "(", ")")
        if end is None:
            at += 1
            continue
        found.append((markdown[at + 1 : label], at, end + 1))
        at = end + 1
    return found


def test_link_scan_is_exact():
    rng = random.Random(11)
    for _ in range(20000):
        markdown = "".join(rng.choice("[]()!\\a") for _ in range(rng.randint(0, 14)))
        assert [(k["label"], k["first"], k["after"]) for k in find_links(markdown)] == scan(markdown), markdown
    (link,) = find_links('  - [a](<b c> "t")tail')
    assert (link["target"], link["lead"], link["tail"]) == ("b c", "-", "tail")
    assert find_links("[a](b 'title')")[0]["target"] == "b"


@pytest.mark.parametrize(
    "page,clean",
    [
        ("[[a](b)][c]", "a"),
        ("[x][y](z)", "[x]y"),
        ("![[i](j)](k) t", "](k) t"),
        ("![p](q)![r](s)[t][u]", "t"),
        ("a <IMG\nsrc='x'> b", "a b"),
        ("![p][q](r)", "(r)"),
        (" [id]: http://x y z\nkept", "kept"),
        ("see <https://a.b/c d> or http://e.f/g) end", "see or end"),
        ("URL Source: http://x\nText", "Text"),
        ("[http://in.label/x](y)", ""),
        ("a\n \n\n\n\nb", "a\n \n\nb"),
        ("[]( x ) [a]()", "[]( x ) a"),
    ],
)
def test_article_cleanup_step_by_step(spark, page, clean):
    assert apply(spark, text.article_text, [page]) == [clean]
