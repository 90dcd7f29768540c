"""One run: what to record as history, what is news, what failed.

The whole decision is one plan over narrow identity rows of all sources; item texts
are joined only to the few rows that remain.  Counters are observed while tables are
written that are needed anyway.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.dates import date_bound
from tidewire.functions.identity import AGE_KEY, SOURCE_KEY, is_ordinary
from tidewire.operators.dedup import first_in_source, with_claims
from tidewire.operators.enrichment import (
    BULLETS,
    MAX_ARTICLE_BYTES,
    TITLE,
    Summarizer,
    ask,
    cache_lookup,
    cache_rows,
    with_article,
    with_summary,
)
from tidewire.operators.failures import (
    age_events,
    distinct_failures,
    issue_events,
    item_events,
    proven_recoveries,
    source_events,
    to_alert,
    vanished_issues,
)
from tidewire.operators.filters import is_stale, keyword_hit, source_roles
from tidewire.operators.messages import (
    DEFAULT_LIMIT,
    deliver_order,
    failure_message,
    message_title,
    with_message,
)
from tidewire.operators.seen import persisted_keys, unseen
from tidewire.plans.outbox import Outbox
from tidewire.plans.state import Attempt, StateStore, log_rows, new_baseline, new_deliveries
from tidewire.schemas import STATE
from tidewire.session import counted, written
from tidewire.sources.articles import Reader, read_articles
from tidewire.sources.landing import MAX_RESPONSE_BYTES
from tidewire.sources.registry import Collected, collect, split_entries


@dataclass(frozen=True)
class Settings:
    """What a run needs besides data."""

    run_date: datetime.date
    keywords: Sequence[str] = ()
    fields: Sequence[str] = ("title", "content")
    label: str = "tidewire"
    alert_label: str = "告警"
    max_payload_bytes: int = DEFAULT_LIMIT
    max_response_bytes: int = MAX_RESPONSE_BYTES
    max_article_bytes: int = MAX_ARTICLE_BYTES
    collectors: Sequence[str] | None = None
    model: dict = field(
        default_factory=lambda: {"model": "", "protocol": "", "base_url": "", "prompt_version": "1"}
    )
    concurrency: int = 8
    #: Articles that are summarised and kept together; a part that fails does not cost the others.
    summary_rows: int = 10_000

    @classmethod
    def now(cls, clock: Callable[[], datetime.datetime] = lambda: datetime.datetime.now(datetime.UTC), **settings) -> Settings:
        """Settings of a run of today, in Beijing; the clock is read once."""
        at = clock()
        zone = datetime.timezone(datetime.timedelta(hours=8))
        if at.tzinfo is None:
            raise ValueError("the clock must know its time zone")
        return cls(run_date=at.astimezone(zone).date(), **settings)


class State(NamedTuple):
    delivered: DataFrame
    baseline: DataFrame
    source_state: DataFrame
    active: DataFrame


class Decision(NamedTuple):
    #: One row per item of the run: identity and ``disposition``.
    dispositions: DataFrame
    #: Role of each source in this run.
    roles: DataFrame
    #: Failure events known before any article is worked on.
    events: DataFrame
    #: Active failures that have recovered.
    recovered: DataFrame
    #: Items by disposition, and repeats within sources (``repeat``).
    counts: Mapping[str, int]


#: What can become of an item.
DISPOSITIONS = ("baseline", "deferred", "outranked", "seen", "filtered", "stale", "candidate")


def decide(collected: Collected, sources: DataFrame, state: State, settings: Settings) -> Decision:
    """Dispositions: ``baseline``, ``deferred``, ``outranked``, ``seen``, ``filtered``,
    ``stale`` or ``candidate``, in this order of checks.

    Three narrow intermediates are written to the shared folder, because all later
    steps read them several times: roles, claimed items, dispositions.
    """
    items, issues, failures = collected
    roles = source_roles(sources, failures, issues, state.source_state)
    narrow = items.select(
        "source",
        "source_ord",
        "pos",
        "item_id",
        "url",
        "dedupe_key",
        F.expr(is_ordinary("dedupe_key", "url")).alias("ordinary"),
        keyword_hit(settings.keywords, settings.fields).alias("hit"),
        F.expr(date_bound("published_at")).alias("bound"),
        "title",
    )
    repeats = (
        narrow.groupBy("source")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("dedupe_key").alias("keys"))
        .select("source", (F.col("rows") - F.col("keys")).alias("repeats"))
    )
    roles, repeated = counted(
        roles.join(repeats, "source", "left").withColumn("repeats", F.coalesce("repeats", F.lit(0)).cast("long")),
        "roles", repeat=F.sum("repeats"),
    )
    once = written(
        with_claims(first_in_source(narrow)).join(
            roles.select("source", "role", "filter", "max_age_days"), "source"
        ),
        "claims",
    )
    active = once.where(F.col("role") == "active")
    ours = active.where("claimed")
    new = unseen(ours, state.delivered, state.baseline).select("order_key", F.lit(True).alias("new"))
    stale = is_stale(F.col("bound"), settings.run_date, F.col("max_age_days"))
    judged = once.join(new, "order_key", "left").withColumn(
        "disposition",
        F.when(F.col("role") != "active", F.col("role"))
        .when(~F.col("claimed"), F.lit("outranked"))
        .when(F.col("new").isNull(), F.lit("seen"))
        .when(F.col("filter") & ~F.col("hit"), F.lit("filtered"))
        .when(stale, F.lit("stale"))
        .otherwise(F.lit("candidate")),
    )
    judged, counts = counted(
        judged.select(
            "order_key", "source", "source_ord", "pos", "item_id", "url", "dedupe_key", "title", "bound",
            "max_age_days", "disposition",
        ),
        "dispositions",
        **{kind: F.count(F.when(F.col("disposition") == kind, 1)) for kind in DISPOSITIONS},
    )
    old = judged.where(F.col("disposition") == "stale")
    events = (
        source_events(failures).unionByName(issue_events(issues)).unionByName(age_events(old))
    )
    return Decision(judged, roles, events, _recovered(judged, roles, events, state), counts | repeated)


def _recovered(judged: DataFrame, roles: DataFrame, events: DataFrame, state: State) -> DataFrame:
    collected = roles.where(F.col("role") != "failed")
    outranked = judged.where(F.col("disposition") == "outranked")
    persisted = outranked.join(
        persisted_keys(outranked, state.delivered, state.baseline), "dedupe_key", "left_semi"
    )
    proven = (
        judged.where(F.col("disposition") == "seen")
        .unionByName(persisted)
        .select("source", "dedupe_key")
    )
    first_windows = judged.where(F.col("disposition") == "baseline").select(
        "source", F.col("dedupe_key").alias("item_key")
    )
    young = (
        roles.where((F.col("role") == "active") & F.col("max_age_days").isNotNull())
        .join(events.where(F.col("stage") == "age").select("source"), "source", "left_anti")
        .select("source", F.lit(AGE_KEY).alias("item_key"))
    )
    whole = collected.select("source", F.lit(SOURCE_KEY).alias("item_key"))
    named = first_windows.unionByName(young).unionByName(whole)
    return (
        state.active.join(named, ["source", "item_key"], "left_semi")
        .unionByName(vanished_issues(state.active, events, collected))
        .unionByName(proven_recoveries(state.active, proven, events))
        .distinct()
    )


class Prepared(NamedTuple):
    #: Candidates with payload, summary and ``failed_stage`` (NULL when deliverable).
    messages: DataFrame
    #: New summaries for the cache.
    answers: DataFrame


#: Parts of the summaries of a run at most; each is a commit.
_MOST_PARTS = 32


def prepare(
    decision: Decision,
    items: DataFrame,
    sources: DataFrame,
    cache: DataFrame,
    settings: Settings,
    summarizer: Callable[[], Summarizer],
    articles: DataFrame | None = None,
    keep: Callable[[DataFrame], object] = lambda rows: None,
    reader: Callable[[], Reader] | None = None,
) -> Prepared:
    """Summaries and messages of the candidates; every failure stays in its row.

    Articles are landed rows, or read now with a ``reader``.  Missing summaries are asked for in parts.  ``keep`` gets the new cache rows of a part as soon as it is done; a
    part whose job fails is left out, the others go on, and its problem is raised in the end.
    """
    chosen = decision.dispositions.where(F.col("disposition") == "candidate").select(
        "order_key", "source", "pos"
    )
    candidates = items.join(chosen, ["source", "pos"]).join(
        sources.select("source", "content_mode", "allowed_hosts"), "source"
    )
    looked_up = cache_lookup(candidates, cache, **settings.model)
    # Written once: the costly part below works on the misses only.
    looked_up, counts = counted(looked_up, "candidates", missing=F.count(F.when(F.col(TITLE).isNull(), 1)))
    parts = max(1, min(_MOST_PARTS, -(-counts["missing"] // settings.summary_rows)))
    missing = looked_up.where(F.col(TITLE).isNull()).drop(TITLE, BULLETS)
    if reader is not None:
        read = written(read_articles(missing, reader, max_bytes=settings.max_article_bytes), "articles")
        read = read.where(F.col("body").isNotNull()).drop("error")
        articles = read if articles is None else read.unionByName(articles, allowMissingColumns=True)
    misses = with_article(missing, articles, settings.max_article_bytes)
    misses = written(
        misses.withColumn("_part", F.pmod(F.xxhash64("source", "dedupe_key"), F.lit(parts)).cast("int")), "misses", ("_part",)
    )
    keys = looked_up.select("order_key", "source", "dedupe_key")
    answers, new, problems = None, None, []
    for part in range(parts):
        asked = misses.where((F.col("_part") == part) & F.col("article").isNotNull())
        try:
            one = written(ask(asked, summarizer, settings.concurrency), "answers")
        except Exception as problem:  # noqa: BLE001 - raised below, after the other parts
            problems.append(problem)
            continue
        rows = cache_rows(keys.join(one.where(F.col("error").isNull()), "order_key"), **settings.model)
        keep(rows)
        answers = one if answers is None else answers.unionByName(one)
        new = rows if new is None else new.unionByName(rows)
    if problems:
        raise problems[0]
    asked = misses.drop("article", "article_error", "_part").join(answers, "order_key", "left").withColumn(
        "failed_stage",
        F.when(F.col("error").isNotNull(), F.lit("summary")).when(F.col(TITLE).isNull(), F.lit("content")),
    )
    hits = looked_up.where(F.col(TITLE).isNotNull()).withColumn("failed_stage", F.lit(None).cast("string"))
    ready = hits.unionByName(asked.drop("error")).withColumn("original_title", F.col("title"))
    day = settings.run_date.isoformat()
    shown = with_summary(ready).withColumn("title", F.coalesce("title", "original_title"))
    messages = with_message(
        shown, message_title(day, settings.label, F.col("source")), settings.max_payload_bytes
    ).withColumn(
        "failed_stage",
        F.coalesce("failed_stage", F.when(~F.col("fits"), F.lit("message"))),
    )
    return Prepared(messages, new)


def counters(counts: Mapping[str, int], failed: int, done: int, preview: bool = False) -> dict[str, int | bool]:
    """The one summary row of a run, from what was observed while its tables were written."""
    nothing = not (counts["candidate"] or counts["baseline"] or failed)
    return {
        "sent": 0 if preview else done,
        "failed": failed,
        "baseline": counts["baseline"],
        "skipped": sum(counts[kind] for kind in ("repeat", "outranked", "seen", "filtered", "stale")),
        "previewed": done if preview else 0,
        "exit_code": int(failed > 0),
        "nothing_new": nothing,
    }


def summary_row(spark: SparkSession, run_id: str, summary: Mapping[str, int | bool]) -> DataFrame:
    return spark.createDataFrame([(run_id, *summary.values())], STATE["run_summary"])


def baseline_preview(decision: Decision) -> DataFrame:
    """Items per source whose first window would be or was recorded, or was put off."""
    counts = decision.dispositions.groupBy("source").agg(F.count(F.lit(1)).alias("items"))
    return (
        decision.roles.where(F.col("role").isin("baseline", "deferred"))
        .join(counts, "source", "left")
        .select("source", "role", F.coalesce("items", F.lit(0)).cast("long").alias("items"), "issues")
    )


Sink = Callable[[DataFrame], DataFrame]


class Result(NamedTuple):
    run_id: str
    summary: DataFrame
    messages: DataFrame
    failures: DataFrame
    alerts: DataFrame
    decision: Decision


def send_all(messages: DataFrame) -> DataFrame:
    """A sink that accepts every row: the messages are the output."""
    return messages


def execute(
    store: StateStore,
    run_id: str,
    docs: DataFrame,
    sources: DataFrame,
    settings: Settings,
    summarizer: Callable[[], Summarizer],
    *,
    articles: DataFrame | None = None,
    reader: Callable[[], Reader] | None = None,
    collected: Collected | None = None,
    send: Sink = send_all,
    send_alerts: Sink = send_all,
    preview: bool = False,
) -> Result:
    """Run once.  With ``preview`` nothing is written to the state.

    ``send`` gets the deliverable messages in order and returns the rows that were accepted
    (``order_key``); ``send_alerts`` does the same for alerts (``source``, ``item_key``).
    Messages are kept in the outbox of the store, sent, and then recorded, so a lost run is sent again:
    ``Outbox.sender`` sends only what was not acknowledged.  Runs at the same time share the store; what they
    record is made from the state as it is then.
    """
    spark = sources.sparkSession
    if collected is None:
        # A document may feed thousands of rows: extract once, then read the result.
        entries = written(
            collect(docs, sources, settings.collectors, settings.max_response_bytes), f"{run_id}-entries"
        )
        collected = split_entries(entries)
    runs = store.published()
    state = State(
        store.table("delivered", runs),
        store.table("baseline", runs),
        store.table("source_state", runs),
        # Read by several recovery rules.
        written(store.active_failures(runs), f"{run_id}-active"),
    )
    decision = decide(collected, sources, state, settings)

    def keep(rows: DataFrame) -> None:
        # Kept even if another part or the delivery fails, so a retry does not ask again.
        store.commit(f"{run_id}/summaries/{uuid.uuid4().hex}", {"summary_cache": rows})

    prepared = prepare(
        decision, collected.items, sources, store.table("summary_cache", runs), settings, summarizer, articles,
        **({} if preview else {"keep": keep}), reader=reader,
    )
    messages = written(prepared.messages, f"{run_id}-messages")
    ready = messages.where(F.col("failed_stage").isNull())
    if preview:
        sent = ready.select("order_key")
    else:
        outbox = Outbox(spark, f"{store.path}/outbox")
        ready = outbox.put(run_id, ready)
        sent = outbox.acknowledge(run_id, send(deliver_order(ready)))
    sent, done = counted(sent, f"{run_id}-sent", done=F.count(F.lit(1)))
    not_sent = ready.join(sent, "order_key", "left_anti")
    failed_items = (
        messages.where(F.col("failed_stage").isNotNull())
        .select("source", "dedupe_key", F.col("original_title").alias("title"), F.col("failed_stage").alias("stage"))
        .unionByName(
            not_sent.select("source", "dedupe_key", F.col("original_title").alias("title"), F.lit("send").alias("stage"))
        )
    )
    failures, failed = counted(
        distinct_failures(decision.events.unionByName(item_events(failed_items))), f"{run_id}-failures", failed=F.count(F.lit(1))
    )
    recovered = decision.recovered
    alerts = to_alert(failures, state.active).withColumn(
        "payload",
        failure_message(
            F.lit(f"{settings.run_date.isoformat()} · {settings.label} · {settings.alert_label}"),
            F.col("source"), F.col("title"), F.col("stage"),
        ),
    ).withColumn("fits", F.octet_length("payload") <= settings.max_payload_bytes)
    summary = summary_row(spark, run_id, counters(decision.counts, failed["failed"], done["done"], preview))
    if preview:
        return Result(run_id, summary, messages, failures, alerts, decision)
    # An alert that was not accepted is not recorded and is tried again next time.
    alerted = written(send_alerts(alerts.where("fits")).select("source", "item_key"), f"{run_id}-alerted")
    delivered = ready.join(sent, "order_key", "left_semi")
    log = (
        log_rows(recovered, "cleared", 0)
        .unionByName(log_rows(alerted, "alerted", 1))
        .unionByName(log_rows(delivered.select("source", F.col("dedupe_key").alias("item_key")), "cleared", 2))
    )

    def tables(now: list[Attempt]) -> dict[str, DataFrame]:
        base_rows, marks = new_baseline(collected.items, decision.roles, store.table("source_state", now))
        return {
            "delivered": new_deliveries(delivered, store.table("delivered", now)),
            "baseline": base_rows,
            "source_state": marks,
            "failure_log": log,
            "run_summary": summary,
        }

    store.commit(run_id, tables)
    return Result(run_id, summary, messages, failures, alerts, decision)
