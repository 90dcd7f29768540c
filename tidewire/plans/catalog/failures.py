"""Failure events and alerts, on the event stream of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators.failures import (
    active_failures,
    alert_once,
    cleared,
    distinct_failures,
    failure_stages,
    issue_events,
    item_events,
    latest_state,
    proven_recoveries,
    to_alert,
    vanished_issues,
)
from tidewire.plans.catalog.common import DOC_ITEMS_SQL, table
from tidewire.plans.catalog.gates import SOURCES_SQL, doc_issues


def alerts(spark, folder):
    """Errors of a user raise an alert once; a purchase means recovery."""
    events = table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", F.to_date("ts").alias("day")
    )
    found = alert_once(
        events, ("user_id",), "event_id", "day", "event_type = 'error'", "event_type = 'purchase'"
    )
    return found.select("event_id", "user_id")


def failing_users(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    return latest_state(events, ("user_id",), "event_id", "event_type = 'error'", "event_type = 'purchase'")


_KIND_SQL = "CASE event_type WHEN 'error' THEN 'f' WHEN 'purchase' THEN 'r' END"

#: An article key for low values of the property, a list-entry key for others.
_ITEM_KEY = (
    "concat(if(get_json_object(props, '$.k') >= '5', 'collection:', 'https://x.example.com/'),"
    " substr(get_json_object(props, '$.k'), 1, 1))"
)
_ITEM_KEY_SQL = (
    "CASE WHEN json_extract_string(props, '$.k') >= '5' THEN 'collection:' ELSE 'https://x.example.com/' END"
    " || substr(json_extract_string(props, '$.k'), 1, 1)"
)


def _keyed(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "event_id", "event_type", "value", "concat('user ', user_id) AS source", f"{_ITEM_KEY} AS item_key"
    )


def _log(spark, folder):
    """The failure log as if every event were a run of its own."""
    rows = _keyed(spark, folder)
    alerted = log_rows_with_run(rows.where("event_type = 'error'"), "alerted")
    return alerted.unionByName(log_rows_with_run(rows.where("event_type = 'purchase'"), "cleared"))


def log_rows_with_run(rows, event):
    return rows.select(
        "source", "item_key", F.lit(event).alias("event"), F.lit(0).alias("seq"), F.col("event_id").alias("run_seq")
    )


def _current(spark, folder):
    return _keyed(spark, folder).where("event_type = 'view' AND value > 30").select(
        "source", "item_key", F.lit("t").alias("title"), F.lit("parse").alias("stage"), F.col("event_id").alias("event_ord")
    )


def active_keys(spark, folder):
    return active_failures(_log(spark, folder))


def new_alerts(spark, folder):
    """Failures of now, once for each key, that are not active."""
    current = distinct_failures(_current(spark, folder))
    return to_alert(current, active_keys(spark, folder)).select("source", "item_key", "event_ord")


def recovered_entries(spark, folder):
    """Active entry failures that are gone from the sources collected now."""
    collected = _keyed(spark, folder).where("event_type = 'signup' AND value > 10").select("source").distinct()
    return vanished_issues(active_keys(spark, folder), _current(spark, folder), collected)


def recovered_articles(spark, folder):
    """Active failures whose article was clicked, unless it fails now."""
    persisted = _keyed(spark, folder).where("event_type = 'click'").select(
        "source", F.col("item_key").alias("dedupe_key")
    )
    return proven_recoveries(active_keys(spark, folder), persisted, _current(spark, folder))


def cleared_keys(spark, folder):
    """Clearing by source, by prefix, and by a table of keys."""
    active = active_keys(spark, folder)
    clicked = _keyed(spark, folder).where("event_type = 'click' AND value > 15")
    tag = lambda df, how: df.select(F.lit(how).alias("how"), "source", "item_key")
    return (
        tag(cleared(active, source="user 1"), "source")
        .unionByName(tag(cleared(active, source="user 2", prefix="collection:"), "prefix"))
        .unionByName(tag(cleared(active, keys=clicked), "keys"))
    )


_ACTIVE_SQL = f"""
keyed AS (SELECT event_id, event_type, value, 'user ' || user_id AS source, {_ITEM_KEY_SQL} AS item_key FROM events),
active AS (SELECT source, item_key FROM keyed WHERE event_type IN ('error', 'purchase')
  GROUP BY source, item_key HAVING arg_max(event_type, event_id) = 'error'),
now AS (SELECT source, item_key, min(event_id) AS event_ord FROM keyed
  WHERE event_type = 'view' AND value > 30 GROUP BY source, item_key)
"""


def first_stages(spark, folder):
    """First failed stage of each key, by stage order."""
    failed = _keyed(spark, folder).selectExpr(
        "source",
        "item_key AS dedupe_key",
        "concat('t ', item_key) AS title",
        "CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'summary' WHEN 'error' THEN 'content'"
        " WHEN 'signup' THEN 'send' ELSE 'cache' END AS stage",
    ).where("stage <> 'cache' OR source LIKE 'user 1%'")
    return failed


def distinct_events(spark, folder):
    return distinct_failures(item_events(first_stages(spark, folder))).select("source", "item_key", "title", "stage")


def stage_lists(spark, folder):
    rows = failure_stages(first_stages(spark, folder))
    return rows.select("source", "dedupe_key", F.array_join("stages", ",").alias("stages"))


_STAGE_SQL = """
staged AS (SELECT source, item_key, CASE event_type WHEN 'view' THEN 'message' WHEN 'click' THEN 'summary'
    WHEN 'error' THEN 'content' WHEN 'signup' THEN 'send' ELSE 'cache' END AS stage FROM keyed),
ranked AS (SELECT *, list_position(['cache', 'content', 'summary', 'message', 'send', 'record'], stage) AS o
  FROM staged WHERE stage <> 'cache' OR source LIKE 'user 1%')
"""


def entry_events(spark, folder):
    """Malformed entries as events; unnamed ones by their position."""
    return issue_events(doc_issues(spark, folder)).select("source", "item_key", "title", "stage")


QUERIES = {
    "alert_once_w9_r5": alerts,
    "failing_users_r5": failing_users,
    "active_failures_k4": active_keys,
    "new_alerts_j10": new_alerts,
    "recovered_articles_j11": recovered_articles,
    "vanished_entries_j12": recovered_entries,
    "cleared_failures_k4": cleared_keys,
    "first_failure_stage_a3": distinct_events,
    "failure_stages_a6": stage_lists,
    "issue_events_p17": entry_events,
}

ORACLES = {
    "alert_once_w9_r5": f"""
        WITH k AS (SELECT event_id, user_id, {_KIND_SQL} AS kind FROM events WHERE event_type IN ('error', 'purchase'))
        SELECT event_id, user_id FROM k
        QUALIFY kind = 'f' AND coalesce(lag(kind) OVER (PARTITION BY user_id ORDER BY event_id), 'r') = 'r'""",
    "failing_users_r5": f"""
        SELECT user_id, max(event_id) AS last_at FROM events WHERE event_type IN ('error', 'purchase')
        GROUP BY user_id HAVING arg_max({_KIND_SQL}, event_id) = 'f'""",
    "active_failures_k4": f"WITH {_ACTIVE_SQL} SELECT source, item_key FROM active",
    "new_alerts_j10": f"""
        WITH {_ACTIVE_SQL} SELECT source, item_key, event_ord FROM now n
        WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.source = n.source AND a.item_key = n.item_key)""",
    "recovered_articles_j11": f"""
        WITH {_ACTIVE_SQL} SELECT source, item_key FROM active a
        WHERE EXISTS (SELECT 1 FROM keyed k WHERE event_type = 'click' AND k.source = a.source AND k.item_key = a.item_key)
          AND NOT EXISTS (SELECT 1 FROM now n WHERE n.source = a.source AND n.item_key = a.item_key)""",
    "vanished_entries_j12": f"""
        WITH {_ACTIVE_SQL} SELECT source, item_key FROM active a WHERE starts_with(item_key, 'collection:')
          AND source IN (SELECT source FROM keyed WHERE event_type = 'signup' AND value > 10)
          AND NOT EXISTS (SELECT 1 FROM now n WHERE n.source = a.source AND n.item_key = a.item_key)""",
    "cleared_failures_k4": f"""
        WITH {_ACTIVE_SQL} SELECT 'source' AS how, source, item_key FROM active WHERE source = 'user 1'
        UNION ALL SELECT 'prefix', source, item_key FROM active WHERE source = 'user 2' AND starts_with(item_key, 'collection:')
        UNION ALL SELECT 'keys', source, item_key FROM active a WHERE EXISTS (SELECT 1 FROM keyed k
          WHERE event_type = 'click' AND value > 15 AND k.source = a.source AND k.item_key = a.item_key)""",
    "first_failure_stage_a3": f"""
        WITH {_ACTIVE_SQL}, {_STAGE_SQL}
        SELECT source, item_key, 't ' || item_key AS title, arg_min(stage, o) AS stage FROM ranked GROUP BY source, item_key""",
    "failure_stages_a6": f"""
        WITH {_ACTIVE_SQL}, {_STAGE_SQL}, d AS (SELECT DISTINCT source, item_key, stage, o FROM ranked)
        SELECT source, item_key AS dedupe_key, string_agg(stage, ',' ORDER BY o) AS stages FROM d GROUP BY source, item_key""",
    "issue_events_p17": f"""
        WITH {DOC_ITEMS_SQL}, {SOURCES_SQL}
        SELECT source, item_key, CASE WHEN title = '' THEN '（列表条目 ' || pos || '）' ELSE title END AS title, 'parse' AS stage
        FROM issue_rows""",
}
