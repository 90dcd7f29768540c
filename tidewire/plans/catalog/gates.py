"""Keyword, age, required-field and source gates."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tidewire.operators.failures import age_label, stale_summary
from tidewire.operators.filters import age_gate, first_missing, keyword_hit, source_roles
from tidewire.plans.catalog.common import DOC_ITEMS_SQL, RUN_DATE, doc_items, labelled, table
from tidewire.plans.catalog.scalars import BOUND_SQL, orders_mixed
from tidewire.plans.state import new_baseline
from tidewire.schemas import SOURCES

KEYWORDS = ("on the", "einer", "ÉTRE", "que", "GPT", "a.b", "anxx")
_HIT_SQL = " OR ".join(
    f"regexp_matches(text, '(^|[^A-Za-z0-9_]){k.replace('.', '[.]')}($|[^A-Za-z0-9_])', 'i')" for k in KEYWORDS
)


def keyword_hits(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.where(keyword_hit(KEYWORDS, ["source", "text"])).select("doc_id", "source")


def order_items(spark, folder):
    """Orders as dated items; priorities are the sources, each with its age limit."""
    limit = F.expr("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 30 WHEN '2' THEN 365 WHEN '3' THEN 1000 END")
    return orders_mixed(spark, folder).select(
        F.col("o_orderpriority").alias("source"),
        F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), F.repeat(F.lit("x"), 90)).alias("title"),
        "published_at",
        limit.alias("max_age_days"),
    )


_DAY = datetime.date.fromisoformat(RUN_DATE)


def aged(spark, folder):
    return age_gate(order_items(spark, folder), _DAY).select("pos", F.coalesce(F.col("bound").cast("string"), F.lit("")).alias("bound"), "stale")


def stale_labels(spark, folder):
    stale = age_gate(order_items(spark, folder), _DAY).where("stale")
    return age_label(stale_summary(stale)).select(
        "source", "stale", F.col("oldest").cast("string").alias("oldest"), "label"
    )


_AGED_SQL = f"""
aged AS (SELECT o_orderkey AS pos, o_orderpriority AS source, {BOUND_SQL} AS bound,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 30 WHEN '2' THEN 365 WHEN '3' THEN 1000 END AS days FROM orders),
judged AS (SELECT *, coalesce(bound < DATE '{RUN_DATE}' - cast(days AS INTEGER), false) AS stale FROM aged)
"""


def missing_fields(spark, folder):
    rows = table(spark, folder, "documents").selectExpr(
        "doc_id",
        "if(n_chars % 5 = 0, '\\n\\u00a0', text) AS title",
        "if(lang = 'fr', ' \\t\\n', concat('https://x/', doc_id)) AS link",
        "if(lang = 'de', NULL, '2026-01-01') AS day",
    )
    return rows.select("doc_id", first_missing(title="title", link="link", pubDate="day").alias("reason"))


def doc_sources(spark, folder):
    """One row per source of the documents."""
    return (
        table(spark, folder, "documents")
        .select("source")
        .distinct()
        .selectExpr(
            "int(substr(source, 4)) AS source_ord",
            "source",
            "concat('https://', source, '.example.com/list') AS url",
            "array('example.com') AS allowed_hosts",
            "20 AS window_size",
            "'rss' AS collector",
            "if(source > 'src3', 'inline', 'article') AS content_mode",
            "source < 'src5' AS filter",
            "if(source LIKE 'src1%', 90, NULL) AS max_age_days",
        )
        .select(*SOURCES.names)
    )


def doc_issues(spark, folder):
    return doc_issues_of(doc_items(spark, folder))


def doc_issues_of(items):
    """Short documents count as malformed entries."""
    return (
        items
        .where("length(content) < 60")
        .selectExpr(
            "run_id", "source", "source_ord", "pos", "'parse' AS stage", "if(category = 'es', '', title) AS title",
            "url", "'too short' AS message",
            "if(category = 'en', dedupe_key, concat('collection:', sha2(title, 256))) AS item_key",
        )
    )


def doc_failures(spark, folder):
    """Sources with a very long document count as not collected."""
    return (
        table(spark, folder, "documents")
        .where("n_chars > 30000")
        .select(F.lit("r1").alias("run_id"), "source", F.expr("int(substr(source, 4))").alias("source_ord"), F.lit("too big").alias("message"))
        .distinct()
    )


def known_sources(spark, folder):
    """Sources with a document labelled both good and toxic were recorded before."""
    both = table(spark, folder, "labels").where("quality = 1 AND toxic = 1")
    return (
        table(spark, folder, "documents").join(both, "doc_id", "left_semi").select("source").distinct()
    )


def roles(spark, folder):
    return source_roles(
        doc_sources(spark, folder), doc_failures(spark, folder), doc_issues(spark, folder), known_sources(spark, folder)
    )


def roles_query(spark, folder):
    return roles(spark, folder).select("source", "issues", "role")


SOURCES_SQL = """
src AS (SELECT DISTINCT source, cast(substr(source, 4) AS INTEGER) AS source_ord FROM documents),
issue_rows AS (SELECT source, pos, CASE WHEN lang = 'es' THEN '' ELSE title END AS title, dedupe_key,
    CASE WHEN lang = 'en' THEN dedupe_key ELSE 'collection:' || sha256(title) END AS item_key
  FROM doc_items WHERE length(content) < 60),
failed_src AS (SELECT DISTINCT source FROM documents WHERE n_chars > 30000),
known_src AS (SELECT DISTINCT source FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND toxic = 1),
roles AS (SELECT s.source, s.source_ord, coalesce(i.n, 0) AS issues,
    CASE WHEN s.source IN (SELECT source FROM failed_src) THEN 'failed'
         WHEN s.source IN (SELECT source FROM known_src) THEN 'active'
         WHEN coalesce(i.n, 0) > 0 THEN 'deferred' ELSE 'baseline' END AS role,
    s.source < 'src5' AS filter, CASE WHEN s.source LIKE 'src1%' THEN 90 END AS days
  FROM src s LEFT JOIN (SELECT source, count(*) AS n FROM issue_rows GROUP BY source) i ON i.source = s.source)
"""


def first_windows(spark, folder):
    """Rows of the first windows that would be recorded."""
    rows, marks = new_baseline(doc_items(spark, folder), roles(spark, folder), known_sources(spark, folder))
    return rows.select("source", "dedupe_key", "item_id").unionByName(
        marks.select("source", F.lit("").alias("dedupe_key"), F.lit("marker").alias("item_id"))
    )


def entry_counts(spark, folder):
    """Items and issues of each source."""
    items = doc_items(spark, folder).select("source", F.lit(1).alias("item"), F.lit(0).alias("issue"))
    issues = doc_issues(spark, folder).select("source", F.lit(0).alias("item"), F.lit(1).alias("issue"))
    return items.unionByName(issues).groupBy("source").agg(
        F.sum("item").alias("items"), F.sum("issue").alias("issues")
    )


def with_settings(spark, folder):
    """Settings of the source on every item."""
    items = doc_items(spark, folder).select("source", "pos")
    settings = doc_sources(spark, folder).select(
        "source", "source_ord", "filter", F.coalesce("max_age_days", F.lit(-1)).alias("max_age_days")
    )
    return items.join(settings, "source")


QUERIES = {
    "keyword_filter_f1": keyword_hits,
    "required_fields_f4": missing_fields,
    "age_gate_f5_r3": aged,
    "stale_labels_a2_p24": stale_labels,
    "source_roles_f7_f8": roles_query,
    "first_windows_k2_r4": first_windows,
    "entry_counts_a7_u1": entry_counts,
    "source_settings_j9": with_settings,
}

ORACLES = {
    "keyword_filter_f1": f"SELECT doc_id, source FROM documents WHERE {_HIT_SQL}",
    "required_fields_f4": """
        SELECT doc_id, CASE WHEN n_chars % 5 = 0 OR regexp_full_match(text, '\\s*') THEN 'missing title'
          WHEN lang = 'fr' THEN 'missing link' WHEN lang = 'de' THEN 'missing pubDate' END AS reason FROM documents""",
    "age_gate_f5_r3": f"WITH {_AGED_SQL} SELECT pos, coalesce(strftime(bound, '%Y-%m-%d'), '') AS bound, stale FROM judged",
    "stale_labels_a2_p24": f"""
        WITH {_AGED_SQL} SELECT source, count(*) AS stale, strftime(min(bound), '%Y-%m-%d') AS oldest,
          count(*) || ' 篇超过 ' || any_value(days) || ' 天的文章已跳过（最老 ' || strftime(min(bound), '%Y-%m-%d')
            || '，如：' || substr('Order ' || min(pos) || ' ' || repeat('x', 90), 1, 80) || '）' AS label
        FROM judged WHERE stale GROUP BY source""",
    "source_roles_f7_f8": f"WITH {DOC_ITEMS_SQL}, {SOURCES_SQL} SELECT source, issues, role FROM roles",
    "first_windows_k2_r4": f"""
        WITH {DOC_ITEMS_SQL}, {SOURCES_SQL}
        SELECT source, dedupe_key, arg_min(item_id, pos) AS item_id FROM doc_items
        WHERE source IN (SELECT source FROM roles WHERE role = 'baseline') GROUP BY source, dedupe_key
        UNION ALL SELECT source, '', 'marker' FROM roles WHERE role = 'baseline'""",
    "entry_counts_a7_u1": """
        SELECT source, count(*) AS items, cast(sum(CASE WHEN length(text) < 60 THEN 1 ELSE 0 END) AS BIGINT) AS issues
        FROM documents GROUP BY source""",
    "source_settings_j9": f"""
        WITH {DOC_ITEMS_SQL}, {SOURCES_SQL}
        SELECT d.source, d.pos, r.source_ord, r.filter, cast(coalesce(r.days, -1) AS INTEGER) AS max_age_days
        FROM doc_items d JOIN roles r ON r.source = d.source""",
}
