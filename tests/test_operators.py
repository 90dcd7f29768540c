import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tidewire.operators.dedup import first_by, first_in_source, first_window, first_window_by_setting, with_claims
from tidewire.operators.enrichment import ask, checked_summary
from tidewire.operators.failures import alert_once
from tidewire.operators.filters import keyword_hit
from tidewire.operators.messages import pack_messages
from tidewire.operators.ordered import carry_forward, inferred_years, running_total
from tidewire.operators.seen import unseen
from tidewire.streaming.alerts import alert_stream, event_schema
from tidewire.streaming.ledger import first_seen_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_wins_cuts_rows_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("id AS pos", "string(id % 2) AS source", "1 AS source_ord", "string(id % 3) AS dedupe_key", "int(2) AS window_size")
    for frame in (first_in_source(rows), first_window(rows, 5), first_window_by_setting(rows), first_by(rows, ["dedupe_key"], ["pos"])):
        text = plan(frame)
        assert "WindowGroupLimit" in text, text
        assert text.index("Final") < text.index("Exchange") < text.index("Partial")
    assert first_window_by_setting(rows).count() == 4
    claimed = with_claims(rows)
    assert claimed.where("claimed").count() == 3 and claimed.count() == 1000


def test_unseen_equals_one_row_at_a_time(spark):
    rng = random.Random(5)
    schema = "case int, source string, pos bigint, item_id string, url string, dedupe_key string, ordinary boolean, source_ord int"
    state_schema = "source string, item_id string, url string, dedupe_key string"
    cases, expected = [], set()
    delivered = [("c0s0", "i1", "u1", "u1"), ("c1s1", "i2", "u9", "u2"), ("c2s0", "", "u3", "x")]
    baseline = [("c0s1", "", "", "u4"), ("c1s0", "i3", "u5", "x2"), ("c3s0", "i1", "", "u0")]
    keys = {r[3] for r in delivered + baseline}
    ids = {(r[0], r[1]) for r in delivered} | {(r[0], r[1]) for r in baseline if r[1]}
    links = {(r[0], r[2]) for r in delivered} | {(r[0], r[2]) for r in baseline if r[2]}
    for case in range(60):
        for s in range(2):
            source, used = f"c{case}s{s}", set()
            known_ids, known_links, known_keys = set(ids), set(links), set(keys)
            for pos in range(8):
                url = f"u{rng.randint(0, 9)}"
                ordinary = rng.random() < 0.7
                key = url if ordinary else f"k{rng.randint(0, 9)}"
                if key in used:
                    continue
                used.add(key)
                item = f"i{rng.randint(0, 4)}"
                cases.append((case, source, pos, item, url, key, ordinary, s))
                if key in known_keys or (ordinary and ((source, item) in known_ids or (source, url) in known_links)):
                    continue
                expected.add((source, pos))
                known_ids.add((source, item))
                known_keys.add(key)
                if ordinary:
                    known_links.add((source, url))
    items = spark.createDataFrame(cases, schema)
    got = unseen(items, spark.createDataFrame(delivered, state_schema), spark.createDataFrame(baseline, state_schema))
    assert {(r["source"], r["pos"]) for r in got.collect()} == expected


def timeline(spark, n=400, users=3, seed=1):
    rng = random.Random(seed)
    # One user holds most of the rows.
    rows = [(i, 0 if rng.random() < 0.7 else rng.randint(1, users), rng.choice("fro"), rng.choice([None, 1, 2, 3])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "n bigint, user int, kind string, v int").withColumn("part", F.floor(F.col("n") / 37))


def test_looking_back_over_segments(spark):
    rows, frame = timeline(spark)
    last, total, expected = {}, {}, {}
    for n, user, _, v in rows:
        total[user] = total.get(user, 0) + (v or 0)
        expected[n] = (last.get(user), total[user])
        last[user] = v if v is not None else last.get(user)
    got = running_total(
        carry_forward(frame, ["user"], "n", "part", {"before": F.col("v")}), ["user"], "n", "part", "total",
        F.coalesce("v", F.lit(0)),
    )
    assert {r["n"]: (r["before"], r["total"]) for r in got.collect()} == expected


def test_alert_once(spark):
    rows, frame = timeline(spark, seed=2)
    failing, expected = set(), set()
    for n, user, kind, _ in rows:
        if kind == "f" and user not in failing:
            failing.add(user)
            expected.add(n)
        elif kind == "r":
            failing.discard(user)
    got = alert_once(frame, ("user",), "n", "part", "kind = 'f'", "kind = 'r'")
    assert {r["n"] for r in got.collect()} == expected


def test_years_like_one_row_at_a_time(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    for key in range(30):
        year, previous = (2026 if key % 2 else None), None
        for n in range(40):
            month, explicit = rng.randint(1, 12), (rng.randint(2020, 2026) if rng.random() < 0.1 else None)
            rows.append((key, n, explicit, month, 2026 if key % 2 else None))
            if explicit is not None:
                year = explicit
            elif year is not None and previous is not None and previous <= 2 and month >= 10:
                year -= 1
            previous = month
            expected[key, n] = year
    frame = spark.createDataFrame(rows, "k int, n int, year int, month int, start int").withColumn("part", F.floor(F.col("n") / 7))
    got = inferred_years(frame, ["k"], "n", "part", "year", "month", "start")
    assert {(r["k"], r["n"]): r["inferred_year"] for r in got.collect()} == expected


@pytest.mark.parametrize("segment", [3, 10, 1000])
def test_packing_is_greedy_over_segments(spark, segment):
    rng = random.Random(9)
    limit, rows, expected = 100, [], {}
    for group in ("a", "b", "c"):
        used = batch = None
        for pos in range(120):
            size = rng.randint(1, 60)
            rows.append((group, pos, 20, size))
            if used is None:
                used, batch = 20 + size, 0
            elif used + 1 + size > limit:
                used, batch = 20 + size, batch + 1
            else:
                used += 1 + size
            expected[group, pos] = (batch, False)
    rows += [("d", 0, 20, 10), ("d", 1, 20, 81)]
    expected |= {("d", 0): (None, True), ("d", 1): (None, True)}
    frame = spark.createDataFrame(rows, "g string, pos bigint, base int, size int")
    got = pack_messages(frame, "g", "pos", limit, segment_rows=segment)
    assert {(r["g"], r["pos"]): (r["batch"], r["failed"]) for r in got.collect()} == expected


def test_keywords(spark):
    texts = ["the API is", "rapid", "发布API能力", "GPT模型", "新模型", "a_API", "fine-tuning!", "Straße c++", "None"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    hit = [r["t"] for r in frame.where(keyword_hit(["api", "模型", "Fine-Tuning", "C++"], ["t"])).collect()]
    assert hit == ["the API is", "发布API能力", "新模型", "fine-tuning!", "Straße c++"]
    assert frame.where(keyword_hit([], ["t"])).count() == 0


def test_checked_summary(spark):
    values = {
        '{"title_zh": " 标题 ", "bullets_zh": ["一", " 二 ", "三"]}': None,
        "nope": "model returned invalid JSON",
        "[1]": "model output does not match the required fields",
        '{"title_zh": "标", "bullets_zh": ["一", "二", "三"], "x": 1}': "model output does not match the required fields",
        '{"title_zh": "plain", "bullets_zh": ["一", "二", "三"]}': "model returned an invalid Chinese title",
        '{"title_zh": 1, "bullets_zh": ["一", "二", "三"]}': "model returned an invalid Chinese title",
        '{"title_zh": "标", "bullets_zh": ["一", "二"]}': "model must return 3 to 5 Chinese bullets",
        '{"title_zh": "标", "bullets_zh": "一二三"}': "model must return 3 to 5 Chinese bullets",
        '{"title_zh": "标", "bullets_zh": ["一", "二", 3]}': "model returned an invalid Chinese bullet",
        '{"title_zh": "标", "bullets_zh": ["一", "二", "x"]}': "model returned an invalid Chinese bullet",
    }
    frame = spark.createDataFrame([(v,) for v in values], "x string")
    rows = frame.select("x", F.expr(checked_summary("x")).alias("s")).collect()
    assert {r["x"]: r["s"]["error"] for r in rows} == values
    assert (rows[0]["s"]["title_zh"], rows[0]["s"]["bullets_zh"]) == ("标题", ["一", "二", "三"])


def test_a_client_that_cannot_start_fails_its_rows(spark):
    def broken():
        raise OSError("no key")

    items = spark.createDataFrame([(1, "s", "t", "u", "", "a")], "order_key long, source string, title string, url string, published_at string, article string")
    (row,) = ask(items, broken).collect()
    assert row["title_zh"] is None and "no key" in row["error"]


def test_streams_equal_the_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, None, rng.randint(0, 4), rng.choice(["error", "purchase", "view"]), 1.0, "") for i in range(300)]
    frame = spark.createDataFrame(rows, event_schema())
    for part in range(6):
        frame.where(F.col("event_id").between(part * 50, part * 50 + 49)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = alert_once(frame.withColumn("day", F.lit(0)), ("user_id",), "event_id", "day", "event_type = 'error'", "event_type = 'purchase'")
    reader = spark.readStream.schema(event_schema()).option("maxFilesPerTrigger", 1)
    stream = reader.parquet(str(tmp_path / "in")).withColumn("day", F.floor(F.col("event_id") / 10))
    alerts = alert_stream(stream, str(tmp_path / "out"), ("user_id",), "event_id", "day", "event_type = 'error'", "event_type = 'purchase'", snapshot_every=2)
    assert {r["event_id"] for r in alerts.collect()} == {r["event_id"] for r in batch.collect()}
    firsts = first_seen_stream(reader.parquet(str(tmp_path / "in")).select("user_id", "event_id"), str(tmp_path / "first"), "user_id", "event_id")
    expected = {(r["user_id"], r["e"]) for r in frame.groupBy("user_id").agg(F.min("event_id").alias("e")).collect()}
    assert {(r["user_id"], r["event_id"]) for r in firsts.collect()} == expected
    assert isinstance(firsts.schema, T.StructType)


def test_newest_article_and_reasons(spark):
    import datetime

    from tidewire.operators.enrichment import NO_TEXT, NOT_UTF8, TOO_LARGE, with_article

    at = lambda day: datetime.datetime(2026, 1, day)
    url = "https://a.example.com/{}".format
    pages = [
        (url(1), at(1), b"zz old"), (url(1), at(2), b"new text"), (url(2), at(3), b"x" * 50), (url(3), None, b"\xff\xfe"),
    ]
    articles = spark.createDataFrame(pages, "article_url string, fetched_at timestamp, body binary")
    items = spark.createDataFrame(
        [(i, url(i), "", "article", ["a.example.com"]) for i in (1, 2, 3, 4)],
        "order_key long, url string, content string, content_mode string, allowed_hosts array<string>",
    )
    found = {r.order_key: (r.article, r.article_error) for r in with_article(items, articles, 20).collect()}
    assert found == {1: ("new text", None), 2: (None, TOO_LARGE), 3: (None, NOT_UTF8), 4: (None, NO_TEXT)}


def test_blank_fields_are_missing(spark):
    from tidewire.operators.filters import first_missing

    rows = spark.createDataFrame([("\n\u00a0", "b"), ("a", "\t"), ("a", None), ("a", "b")], "title string, link string")
    found = [r[0] for r in rows.select(first_missing(title="title", link="link")).collect()]
    assert found == ["missing title", "missing link", "missing link", None]
