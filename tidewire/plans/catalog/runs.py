"""Whole runs: decisions, counters, recoveries and streams."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from tidewire.functions.identity import AGE_KEY, SOURCE_KEY
from tidewire.operators.failures import distinct_failures, to_alert
from tidewire.plans.catalog.common import DOC_ITEMS_SQL, RUN_DATE, doc_items, table
from tidewire.plans.catalog.gates import (
    KEYWORDS,
    SOURCES_SQL,
    doc_failures,
    doc_issues_of,
    doc_sources,
    known_sources,
)
from tidewire.plans.outbox import Outbox
from tidewire.plans.run import Settings, State, baseline_preview, counters, decide, execute, summary_row
from tidewire.plans.state import StateStore
from tidewire.schemas import ISSUES, SOURCE_FAILURES
from tidewire.session import shared_dir, written
from tidewire.sources.registry import Collected
from tidewire.streaming.alerts import alert_stream
from tidewire.streaming.ledger import first_seen_stream

_SETTINGS = Settings(run_date=datetime.date.fromisoformat(RUN_DATE), keywords=KEYWORDS)


def _active(sources, delivered, short):
    """Failures that earlier runs alerted: of all sources, good documents and short entries."""
    key = lambda name: sources.select("source", F.lit(name).alias("item_key"))
    articles = delivered.select("source", F.col("dedupe_key").alias("item_key"))
    entries = short.selectExpr("source", "concat('collection:', sha2(title, 256)) AS item_key")
    return key(SOURCE_KEY).unionByName(key(AGE_KEY)).unionByName(articles).unionByName(entries).distinct()


def _decision(spark, folder):
    """Decide over all documents; a source that failed gave no items and no issues."""
    items = written(doc_items(spark, folder), "items")
    failures = written(doc_failures(spark, folder), "failures")
    sources = written(doc_sources(spark, folder), "sources")
    with_label = lambda name: items.join(
        table(spark, folder, "labels").where(F.col(name) == 1).select(F.col("doc_id").alias("pos")), "pos", "left_semi"
    )
    delivered = with_label("quality")
    came = lambda df: df.join(failures.select("source"), "source", "left_anti")
    active = written(_active(sources, delivered, items.where("length(content) < 100")), "active")
    state = State(delivered, with_label("toxic"), known_sources(spark, folder), active)
    collected = Collected(came(items), came(doc_issues_of(items)), failures)
    return decide(collected, sources, state, _SETTINGS), state


def dispositions(spark, folder):
    decision, _ = _decision(spark, folder)
    return decision.dispositions.select("source", "pos", "dedupe_key", "disposition")


def run_summary(spark, folder):
    """The counters of a preview of the run."""
    decision, _ = _decision(spark, folder)
    failed = distinct_failures(decision.events).count()
    row = counters(decision.counts, failed, decision.counts["candidate"], preview=True)
    return summary_row(spark, "run", row).drop("run_id")


def run_alerts(spark, folder):
    decision, state = _decision(spark, folder)
    return to_alert(distinct_failures(decision.events), state.active).select("source", "item_key", "stage", "title")


def run_recoveries(spark, folder):
    decision, _ = _decision(spark, folder)
    return decision.recovered.select("source", "item_key")


def run_preview(spark, folder):
    decision, _ = _decision(spark, folder)
    return baseline_preview(decision)


_RUN_SQL = f"""
{DOC_ITEMS_SQL}, {SOURCES_SQL},
mine AS (SELECT * FROM doc_items WHERE source NOT IN (SELECT source FROM failed_src)),
issues_now AS (SELECT * FROM issue_rows WHERE source NOT IN (SELECT source FROM failed_src)),
once AS (SELECT * FROM mine QUALIFY row_number() OVER (PARTITION BY source, dedupe_key ORDER BY pos) = 1),
ranked AS (SELECT o.*, r.role, r.filter, r.days, row_number() OVER (PARTITION BY dedupe_key ORDER BY o.source_ord, pos) AS claim
           FROM once o JOIN roles r ON r.source = o.source),
known AS (SELECT source, item_id, url, dedupe_key FROM delivered UNION ALL SELECT source, item_id, url, dedupe_key FROM baseline),
fresh AS (SELECT * FROM ranked f WHERE role = 'active' AND claim = 1
    AND NOT EXISTS (SELECT 1 FROM known s WHERE s.dedupe_key = f.dedupe_key)
    AND NOT (ordinary AND EXISTS (SELECT 1 FROM known s WHERE s.source = f.source AND s.item_id = f.item_id))
    AND NOT (ordinary AND EXISTS (SELECT 1 FROM known s WHERE s.source = f.source AND s.url = f.url))),
new AS (SELECT pos FROM fresh QUALIFY NOT ordinary OR row_number() OVER (PARTITION BY source, item_id ORDER BY pos) = 1),
judged AS (SELECT d.*, CASE lang WHEN 'en' THEN day WHEN 'fr' THEN last_day(day) WHEN 'es' THEN day + 1 END AS bound,
    CASE WHEN role <> 'active' THEN role WHEN claim > 1 THEN 'outranked' WHEN pos NOT IN (SELECT pos FROM new) THEN 'seen'
      WHEN filter AND NOT ({" OR ".join(f"regexp_matches(title || e'{chr(92)}n' || content, '(^|[^A-Za-z0-9_]){k.replace('.', '[.]')}($|[^A-Za-z0-9_])', 'i')" for k in KEYWORDS)}) THEN 'filtered'
      WHEN coalesce(CASE lang WHEN 'en' THEN day WHEN 'fr' THEN last_day(day) WHEN 'es' THEN day + 1 END
                    < DATE '{RUN_DATE}' - cast(days AS INTEGER), false) THEN 'stale'
      ELSE 'candidate' END AS disposition FROM ranked d),
age_events AS (SELECT source, '__age__' AS item_key, 'age' AS stage,
    count(*) || ' 篇超过 90 天的文章已跳过（最老 ' || strftime(min(bound), '%Y-%m-%d') || '，如：' || arg_min(title, pos) || '）' AS title
  FROM judged WHERE disposition = 'stale' GROUP BY source),
events_now AS (SELECT source, '__source__' AS item_key, 'collection' AS stage, '（来源采集）' AS title, 0 AS o FROM failed_src
  UNION ALL SELECT source, item_key, 'parse', CASE WHEN title = '' THEN '（列表条目 ' || pos || '）' ELSE title END, pos + 1 FROM issues_now
  UNION ALL SELECT source, item_key, stage, title, 1000000000 FROM age_events),
first_events AS (SELECT * FROM events_now QUALIFY row_number() OVER (PARTITION BY source, item_key ORDER BY o) = 1),
active AS (SELECT source, '__source__' AS item_key FROM src UNION SELECT source, '__age__' FROM src
  UNION SELECT source, dedupe_key FROM delivered
  UNION SELECT source, 'collection:' || sha256(title) FROM doc_items WHERE length(content) < 100)
"""

_RECOVERED_SQL = f"""
WITH {_RUN_SQL},
named AS (SELECT source, dedupe_key AS item_key FROM judged WHERE disposition = 'baseline'
  UNION SELECT source, '__age__' FROM roles WHERE role = 'active' AND days IS NOT NULL AND source NOT IN (SELECT source FROM age_events)
  UNION SELECT source, '__source__' FROM roles WHERE role <> 'failed'),
proven AS (SELECT source, dedupe_key AS item_key FROM judged WHERE disposition = 'seen'
  UNION SELECT source, dedupe_key FROM judged WHERE disposition = 'outranked' AND dedupe_key IN (SELECT dedupe_key FROM known))
SELECT DISTINCT a.source, a.item_key FROM active a
WHERE (a.source, a.item_key) IN (SELECT source, item_key FROM named)
   OR ((a.source, a.item_key) NOT IN (SELECT source, item_key FROM events_now)
       AND ((a.source, a.item_key) IN (SELECT source, item_key FROM proven)
            OR (starts_with(a.item_key, 'collection:') AND a.source IN (SELECT source FROM roles WHERE role <> 'failed'))))
"""


# -- two runs over a store ----------------------------------------------------


def _summary_client():
    """A model with one answer."""
    return lambda item, article: json.dumps({"title_zh": "标题", "bullets_zh": ["一", "二", "三"]})


def _message_client():
    """A client that takes every well-formed message."""

    def send(payload: str) -> None:
        json.loads(payload)["content"]["zh_cn"]["title"].index(RUN_DATE)

    return send


def two_runs(spark, folder):
    """A run over the labelled documents, then one over all of them: state, messages in order, and summaries."""
    store = StateStore(spark, _fresh_folder(spark, "store"))
    items = written(doc_items(spark, folder), "items")
    sources = items.groupBy("source", "source_ord").agg(F.first("category").alias("_")).select(
        "source_ord", "source", F.lit("https://docs.example.com/").alias("url"), F.array(F.lit("docs.example.com")).alias("allowed_hosts"),
        F.lit(20).alias("window_size"), F.lit("rss").alias("collector"), F.lit("inline").alias("content_mode"),
        F.lit(False).alias("filter"), F.lit(None).cast("int").alias("max_age_days"),
    )
    sources = written(sources, "sources")
    labelled_ids = table(spark, folder, "labels").select(F.col("doc_id").alias("pos"))
    empty = [spark.createDataFrame([], schema) for schema in (ISSUES, SOURCE_FAILURES)]
    settings = Settings(run_date=datetime.date.fromisoformat(RUN_DATE), max_payload_bytes=1 << 20)
    for run_id, part in (("first", items.join(labelled_ids, "pos", "left_semi")), ("second", items)):
        outbox = Outbox(spark, f"{store.path}/outbox")
        execute(store, run_id, None, sources, settings, _summary_client, collected=Collected(part, *empty),
                send=outbox.sender(run_id, _message_client))
    rows = lambda df, kind, place: df.select(
        F.lit(kind).alias("kind"), place.cast("long").alias("place"), "source", "dedupe_key"
    )
    summary = store.table("run_summary").select(
        "run_seq", F.col("run_id").alias("source"),
        F.concat_ws(",", "sent", "failed", "baseline", "skipped", "previewed", "exit_code", "nothing_new").alias("dedupe_key"),
    )
    none = F.lit(None)
    return (
        rows(store.table("baseline"), "baseline", none)
        .unionByName(rows(store.table("delivered"), "delivered", none))
        .unionByName(rows(outbox.messages("second"), "message", F.col("number")))
        .unionByName(rows(summary, "summary", none))
    )


_TWO_RUNS_SQL = f"""
WITH {DOC_ITEMS_SQL},
one AS (SELECT * FROM doc_items WHERE pos IN (SELECT doc_id FROM labels)),
base AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY source, dedupe_key ORDER BY pos) = 1),
once AS (SELECT * FROM doc_items QUALIFY row_number() OVER (PARTITION BY source, dedupe_key ORDER BY pos) = 1),
claimed AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY source_ord, pos) = 1),
fresh AS (SELECT * FROM claimed f WHERE dedupe_key NOT IN (SELECT dedupe_key FROM base)
    AND NOT (ordinary AND EXISTS (SELECT 1 FROM base b WHERE b.source = f.source AND b.item_id = f.item_id))
    AND NOT (ordinary AND EXISTS (SELECT 1 FROM base b WHERE b.source = f.source AND b.url = f.url))),
cand AS (SELECT * FROM fresh QUALIFY NOT ordinary OR row_number() OVER (PARTITION BY source, item_id, ordinary ORDER BY pos) = 1),
sent AS (SELECT * FROM cand WHERE regexp_matches(content, '\\S'))
SELECT 'baseline' AS kind, NULL::BIGINT AS place, source, dedupe_key FROM base
UNION ALL SELECT 'delivered', NULL, source, dedupe_key FROM sent
UNION ALL SELECT 'message', row_number() OVER (ORDER BY source_ord, pos) - 1, source, dedupe_key FROM sent
UNION ALL SELECT 'summary', NULL, 'first', '0,0,' || (SELECT count(*) FROM base) || ',' || ((SELECT count(*) FROM one) - (SELECT count(*) FROM base))
  || ',0,0,false'
UNION ALL SELECT 'summary', NULL, 'second', (SELECT count(*) FROM sent) || ',' || ((SELECT count(*) FROM cand) - (SELECT count(*) FROM sent))
  || ',0,' || ((SELECT count(*) FROM doc_items) - (SELECT count(*) FROM cand)) || ',0,'
  || CASE WHEN (SELECT count(*) FROM cand) > (SELECT count(*) FROM sent) THEN 1 ELSE 0 END || ','
  || CASE WHEN (SELECT count(*) FROM cand) = 0 THEN 'true' ELSE 'false' END
"""


def run_day(spark, folder):
    """A run at the time of the newest event: its day in Beijing, and the events of that day."""
    events = table(spark, folder, "events")
    newest = events.agg(F.max("ts")).first()[0]
    settings = Settings.now(lambda: newest.replace(tzinfo=datetime.UTC))
    of_day = F.to_date(F.expr("ts + INTERVAL 8 HOURS")) == F.lit(settings.run_date)
    return events.where(of_day).groupBy("event_type").agg(F.count(F.lit(1)).alias("events")).select(
        F.lit(settings.run_date.isoformat()).alias("run_date"), "event_type", "events"
    )


# -- streams ---------------------------------------------------------------


def _fresh_folder(spark, name):
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, folder, name):
    """The rows of a table as they would arrive."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")


def streamed_alerts(spark, folder):
    events = _stream(spark, folder, "events").withColumn("day", F.to_date("ts"))
    alerts = alert_stream(
        events, _fresh_folder(spark, "alerts"), ("user_id",), "event_id", "day",
        "event_type = 'error'", "event_type = 'purchase'",
    )
    return alerts.select("event_id", "user_id")


def streamed_first_texts(spark, folder):
    docs = _stream(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("marker"))
    return first_seen_stream(docs, _fresh_folder(spark, "ledger"), "marker", "doc_id")


QUERIES = {
    "run_date_p25_x5": run_day,
    "run_dispositions_r1": dispositions,
    "run_summary_a1_k7": run_summary,
    "run_alerts_r5_j10": run_alerts,
    "run_recoveries_j11_j12": run_recoveries,
    "run_preview_k6": run_preview,
    "two_runs_k1_k2_k5_k7_r6_x4": two_runs,
    "alert_stream_r5_r7": streamed_alerts,
    "first_seen_stream_r2": streamed_first_texts,
}

ORACLES = {
    "run_date_p25_x5": """
        WITH e AS (SELECT *, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM events)
        SELECT strftime(day, '%Y-%m-%d') AS run_date, event_type, count(*) AS events FROM e
        WHERE day = (SELECT CAST(max(ts) + INTERVAL 8 HOUR AS DATE) FROM events) GROUP BY ALL""",
    "run_dispositions_r1": f"WITH {_RUN_SQL} SELECT source, pos, dedupe_key, disposition FROM judged",
    "run_summary_a1_k7": f"""
        WITH {_RUN_SQL} SELECT 0::BIGINT AS sent, (SELECT count(*) FROM first_events) AS failed,
          count_if(disposition = 'baseline')::BIGINT AS baseline,
          (count_if(disposition IN ('outranked', 'seen', 'filtered', 'stale'))
            + (SELECT count(*) FROM mine) - (SELECT count(*) FROM once))::BIGINT AS skipped,
          count_if(disposition = 'candidate')::BIGINT AS previewed,
          ((SELECT count(*) FROM first_events) > 0)::INTEGER AS exit_code,
          (count_if(disposition IN ('candidate', 'baseline')) = 0 AND (SELECT count(*) FROM first_events) = 0) AS nothing_new
        FROM judged""",
    "run_alerts_r5_j10": f"""
        WITH {_RUN_SQL} SELECT source, item_key, stage, title FROM first_events
        WHERE (source, item_key) NOT IN (SELECT source, item_key FROM active)""",
    "run_recoveries_j11_j12": _RECOVERED_SQL,
    "run_preview_k6": f"""
        WITH {_RUN_SQL} SELECT r.source, r.role, (SELECT count(*) FROM once o WHERE o.source = r.source) AS items,
          CASE WHEN role = 'failed' THEN 0 ELSE issues END AS issues
        FROM roles r WHERE role IN ('baseline', 'deferred')""",
    "two_runs_k1_k2_k5_k7_r6_x4": _TWO_RUNS_SQL,
    "alert_stream_r5_r7": """
        WITH k AS (SELECT event_id, user_id, event_type AS kind FROM events WHERE event_type IN ('error', 'purchase'))
        SELECT event_id, user_id FROM k
        QUALIFY kind = 'error' AND coalesce(lag(kind) OVER (PARTITION BY user_id ORDER BY event_id), 'purchase') = 'purchase'""",
    "first_seen_stream_r2": "SELECT min(doc_id) AS doc_id, sha256(text) AS marker FROM documents GROUP BY sha256(text)",
}
