"""Runs in sequence over one state folder."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from tests.helpers import source, source_table
from tidewire import schemas
from tidewire.plans.run import Settings, baseline_preview, execute
from tidewire.plans.state import StateStore
from tidewire.sources.registry import Collected

DAY = datetime.date(2026, 8, 12)


def good_summary():
    def one(row, article):
        if "explode" in article:
            raise RuntimeError("model down")
        if "garbage" in article:
            return "{}"
        return json.dumps(
            {"title_zh": "标题 " + row["title"], "bullets_zh": ["要点一", "要点二", article[:40] + "要点三"]},
            ensure_ascii=False,
        )

    return one


def item(name, pos, url, title="A GPT model", content="text", published="2026-08-10", item_id=None, key=None):
    return dict(source=name, pos=pos, url=url, title=title, content=content, published_at=published,
                item_id=item_id or url, key=key or url)


class World:
    def __init__(self, spark, folder, *sources, **settings):
        self.spark = spark
        self.sources = source_table(spark, *sources)
        self.store = StateStore(spark, str(folder))
        self.settings = Settings(run_date=DAY, **settings)
        self.number = 0

    def run(self, items, issues=(), failures=(), preview=False, **more):
        self.number += 1
        run = f"run{self.number}"
        ords = {r["source"]: r["source_ord"] for r in self.sources.collect()}
        rows = [
            (run, i["source"], ords[i["source"]], i["pos"], i["item_id"], i["title"], i["content"], i["url"],
             i["published_at"], "", "", "", i["key"]) for i in items
        ]
        bad = [(run, s, ords[s], p, "parse", t, "", "broken", k) for s, p, t, k in issues]
        down = [(run, s, ords[s], "down") for s in failures]
        make = self.spark.createDataFrame
        collected = Collected(make(rows, schemas.ITEMS), make(bad, schemas.ISSUES), make(down, schemas.SOURCE_FAILURES))
        return execute(self.store, run, None, self.sources, self.settings, good_summary,
                       collected=collected, preview=preview, **more)


def counts(result):
    r = result.summary.first()
    return (r["sent"], r["failed"], r["baseline"], r["skipped"], r["previewed"])


def titles(result):
    return [r["original_title"] for r in result.messages.where("failed_stage is null").orderBy("source_ord", "pos").collect()]


def active(world):
    return sorted((r["source"], r["item_key"]) for r in world.store.active_failures().collect())


def two(**more):
    return source("A", "https://a.com/rss", "rss", ordinal=0, **more), source("B", "https://b.com/rss", "rss", ordinal=1)


def test_first_window_then_news_in_order(spark, tmp_path):
    w = World(spark, tmp_path / "s", source("A", "https://a.com/rss", "rss", ordinal=0, filter=True),
              source("B", "https://b.com/rss", "rss", ordinal=1), keywords=("GPT",))
    first = [item("A", 1, "https://x.com/1"), item("A", 2, "https://x.com/2", title="none"), item("B", 1, "https://x.com/1")]
    shown = w.run(first, preview=True)
    assert counts(shown) == (0, 0, 3, 0, 0)
    assert {(r["source"], r["items"]) for r in baseline_preview(shown.decision).collect()} == {("A", 2), ("B", 1)}
    assert w.store.runs().count() == 0
    assert counts(w.run(first)) == (0, 0, 3, 0, 0)
    assert w.store.table("baseline").count() == 3
    second = first + [
        item("A", 3, "https://x.com/3"), item("A", 4, "https://x.com/4", title="none"),
        item("B", 2, "https://x.com/3"), item("B", 3, "https://x.com/5", title="late"),
        item("B", 4, "https://x.com/6"),
    ]
    result = w.run(second)
    assert counts(result) == (3, 0, 0, 5, 0)
    assert titles(result) == ["A GPT model", "late", "A GPT model"]
    body = json.loads(result.messages.orderBy("source_ord", "pos").first()["payload"])
    assert body["content"]["zh_cn"]["title"] == "2026-08-12 · tidewire · A"
    assert counts(w.run(second)) == (0, 0, 0, 8, 0)
    assert w.store.table("summary_cache").count() == 3


def test_stages_fail_alone_and_alert_once(spark, tmp_path):
    w = World(spark, tmp_path / "s", *two(), max_payload_bytes=1500)
    w.run([])
    rows = [
        item("A", 1, "https://x.com/1", content="explode"), item("A", 2, "https://x.com/2", content="garbage"),
        item("A", 3, "https://x.com/3", content=" "), item("A", 4, "https://x.com/4", title="t" * 2000),
        item("A", 5, "https://x.com/5"), item("A", 6, "https://x.com/6", title="refused"),
    ]
    refuse = lambda m: m.where(~F.contains("payload", F.lit("refused")))
    result = w.run(rows, send=refuse)
    assert counts(result) == (1, 5, 0, 0, 0)
    stages = {r["item_key"][-1]: r["stage"] for r in result.failures.collect()}
    assert stages == {"1": "summary", "2": "summary", "3": "content", "4": "message", "6": "send"}
    assert len(active(w)) == 5
    again = w.run(rows, send=refuse)
    assert counts(again) == (0, 5, 0, 1, 0) and again.alerts.count() == 0
    # The refused article was summarised already and is sent from the cache; it recovers.
    third = w.run([r for r in rows if r["pos"] == 6])
    assert counts(third) == (1, 0, 0, 0, 0) and ("A", "https://x.com/6") not in active(w)


def test_source_down_up_down(spark, tmp_path):
    w = World(spark, tmp_path / "s", *two())
    w.run([])
    alerts = [w.run([], failures=["A"]).alerts.count() for _ in range(2)]
    w.run([])
    assert active(w) == []
    alerts.append(w.run([], failures=["A"]).alerts.count())
    assert alerts == [1, 0, 1]


def test_alert_that_fails_is_not_recorded(spark, tmp_path):
    w = World(spark, tmp_path / "s", *two())
    none = lambda alerts: alerts.limit(0)
    assert w.run([], failures=["A"], send_alerts=none).alerts.count() == 1
    assert active(w) == []
    assert w.run([], failures=["A"]).alerts.count() == 1
    assert len(active(w)) == 1


def test_issue_defers_baseline_and_recovers(spark, tmp_path):
    w = World(spark, tmp_path / "s", *two())
    bad = [("A", 2, "Bad entry", "collection:1")]
    first = w.run([item("A", 1, "https://x.com/1"), item("B", 1, "https://x.com/1")], issues=bad)
    assert counts(first) == (0, 1, 1, 0, 0)
    moved = w.run([item("A", 1, "https://x.com/1")], issues=[("A", 3, "Bad entry", "collection:1")])
    assert moved.alerts.count() == 0
    assert counts(w.run([item("A", 1, "https://x.com/1")])) == (0, 0, 1, 0, 0)
    assert active(w) == []
    assert w.run([], issues=bad).alerts.count() == 1


def test_only_persisted_items_prove_recovery(spark, tmp_path):
    w = World(spark, tmp_path / "s", source("A", "https://a.com/rss", "rss", ordinal=0, filter=True),
              source("B", "https://b.com/rss", "rss", ordinal=1), keywords=("GPT",))
    w.run([item("B", 1, "https://x.com/old")])
    key = "https://x.com/1"
    w.run([], issues=[("A", 1, "t", key), ("B", 9, "t", "https://x.com/old")])
    assert len(active(w)) == 2
    w.run([item("A", 1, key, title="nothing", content="none")])
    assert ("A", key) in active(w)
    w.run([item("A", 2, "https://x.com/old"), item("B", 9, "https://x.com/old")])
    assert active(w) == [("A", key)]


def test_url_shape_change_is_not_news(spark, tmp_path):
    w = World(spark, tmp_path / "s", *two())
    w.run([item("A", 1, "https://x.com/1", item_id="id1"), item("A", 2, "https://x.com/2", item_id="id2")])
    result = w.run([
        item("A", 1, "https://x.com/en/1", item_id="id1"), item("A", 2, "https://x.com/2", item_id="other"),
        item("A", 3, "https://x.com/3", item_id="id3"), item("A", 4, "https://x.com/de/3", item_id="id3"),
    ])
    assert counts(result) == (1, 0, 0, 3, 0)


def test_age_gate(spark, tmp_path):
    w = World(spark, tmp_path / "s", source("A", "https://a.com/rss", "rss", ordinal=0, max_age_days=30))
    w.run([])
    rows = [
        item("A", 1, "https://x.com/1", published="2026-07-12"), item("A", 2, "https://x.com/2", published="2026-07-13"),
        item("A", 3, "https://x.com/3", published="2026-06"), item("A", 4, "https://x.com/4", published="2026-07"),
        item("A", 5, "https://x.com/5", published=""),
        item("A", 6, "https://x.com/6", published="2026-07-12T15:59:59+00:00"),
    ]
    result = w.run(rows)
    assert counts(result) == (3, 1, 0, 3, 0)
    event = result.failures.first()
    assert event["title"] == "3 篇超过 30 天的文章已跳过（最老 2026-06-30，如：A GPT model）"
    assert active(w) == [("A", "__age__")]
    again = w.run(rows)
    assert counts(again) == (0, 1, 0, 6, 0) and again.alerts.count() == 0
    w.run(rows[1:2])
    assert active(w) == []


def test_commit_is_idempotent_and_compaction_keeps_state(spark, tmp_path):
    w = World(spark, tmp_path / "s", *two())
    w.run([item("A", 1, "https://x.com/1")])
    rows = [item("A", 1, "https://x.com/1"), item("A", 2, "https://x.com/2")]
    w.run(rows, issues=[("B", 1, "t", "collection:9")])
    before = {t: w.store.table(t).drop("run_seq").count() for t in schemas.STATE if t != "failure_log"}
    w.number -= 1
    w.run(rows)  # same run id again: already published
    w.store.compact("compact1")
    after = {t: w.store.table(t).drop("run_seq").count() for t in before}
    assert before == after and active(w) == [("B", "collection:9")]
    assert counts(w.run(rows)) == (0, 0, 0, 2, 0)


def test_source_table_checks(spark):
    with pytest.raises(ValueError, match="case"):
        source_table(spark, source("A", "u", "rss"), source("a", "u", "rss"))
    with pytest.raises(ValueError, match="positive"):
        source_table(spark, source("A", "u", "rss", window=0))


def test_a_crashed_attempt_is_never_read(spark, tmp_path):
    from tidewire.plans.state import StateStore

    store = StateStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("s", "k", "i", "u")], "source string, dedupe_key string, item_id string, url string")

    class Crash(Exception):
        pass

    def crashing():
        yield "baseline", rows
        raise Crash

    class Tables(dict):
        def items(self):
            return crashing()

    with pytest.raises(Crash):
        store.commit("one", Tables(baseline=rows))
    store.commit("two", {"source_state": rows.select("source")})
    assert store.table("baseline").count() == 0 and store.table("source_state").count() == 1
    store.commit("one", {"baseline": rows})
    assert store.table("baseline").count() == 1


def test_state_is_compacted_by_itself(spark, tmp_path, monkeypatch):
    from tidewire.plans import state

    monkeypatch.setattr(state, "COMPACT_AFTER", 2)
    store = state.StateStore(spark, str(tmp_path))
    for i in range(4):
        rows = spark.createDataFrame([(f"s{i}",)], "source string")
        store.commit(f"run{i}", {"source_state": rows})
    assert len(store.published()) <= 3 and store.table("source_state").count() == 4


def test_summaries_are_kept_part_by_part(spark, tmp_path):
    w = World(spark, tmp_path / "s", *two(), summary_rows=1)
    w.run([])
    rows = [item("A", i, f"https://x.com/{i}", content=f"text {i}") for i in range(1, 7)]
    folder = str(tmp_path)

    def client(deadly):
        def one(row, article):
            if article == deadly:
                raise SystemExit("killed")
            with open(f"{folder}/asked", "a") as log:
                log.write(article + "\n")
            return good_summary()(row, article)

        return lambda: one

    def run(make):
        collected = Collected(
            spark.createDataFrame(
                [("r", i["source"], 0, i["pos"], i["item_id"], i["title"], i["content"], i["url"], i["published_at"], "", "", "", i["key"])
                 for i in rows], schemas.ITEMS),
            spark.createDataFrame([], schemas.ISSUES), spark.createDataFrame([], schemas.SOURCE_FAILURES),
        )
        return execute(w.store, "second", None, w.sources, w.settings, make, collected=collected)

    with pytest.raises(Exception, match="killed|terminat|crash|exit"):
        run(client("text 3"))
    asked = open(f"{folder}/asked").read().split("\n")[:-1]
    kept = w.store.table("summary_cache").count()
    assert w.store.sequence_of("second") is None and 1 <= kept <= 5
    result = run(client(None))
    again = open(f"{folder}/asked").read().split("\n")[:-1][len(asked) :]
    assert len(again) == 6 - kept and "text 3" in again
    assert counts(result) == (6, 0, 0, 0, 0)
    assert w.store.table("run_summary").where("run_id = 'second'").first()["sent"] == 6
