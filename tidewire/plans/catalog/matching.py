"""Windows, deduplication and comparison with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators.dedup import (
    first_by,
    first_id_in_batch,
    first_in_source,
    first_window,
    first_window_by_setting,
    priority_claims,
    with_claims,
)
from tidewire.operators.messages import deliver_order, numbered
from tidewire.operators.ordered import carry_forward, inferred_years, nearest_preceding
from tidewire.operators.seen import baseline_items, delivered_items, persisted_keys, seen_keys, unseen
from tidewire.plans.catalog.common import (
    DOC_ITEMS_SQL,
    HOST_SQL,
    canonical_sql,
    doc_items,
    labelled,
    pages,
    stored_items,
    table,
    with_ordinary,
)
from tidewire.plans.state import new_deliveries


def first_pages(spark, folder):
    """The first three pages of each host."""
    rows = pages(spark, folder).select(F.col("host").alias("source"), F.col("page_id").alias("pos"))
    return first_window(rows, 3)


def windows_by_setting(spark, folder):
    """As many entries as each source allows, up to 100."""
    rows = doc_items(spark, folder).select("source", "source_ord", "pos")
    return first_window_by_setting(
        rows.withColumn("window_size", 5 + 5 * F.col("source_ord"))
    ).select("source", "pos")


def first_of_key(spark, folder):
    return first_in_source(doc_items(spark, folder)).select("source", "pos", "dedupe_key")


def claims(spark, folder):
    return priority_claims(doc_items(spark, folder)).select("dedupe_key", "source", "pos")


def claimed_counts(spark, folder):
    rows = with_claims(first_in_source(doc_items(spark, folder).select("source", "source_ord", "pos", "dedupe_key")))
    return rows.groupBy("source").agg(
        F.count_if("claimed").alias("claimed"), F.count_if(~F.col("claimed")).alias("outranked")
    )


def first_ids(spark, folder):
    items = with_ordinary(first_in_source(doc_items(spark, folder)))
    return first_id_in_batch(items).select("source", "pos", "ordinary")


def unseen_items(spark, folder):
    """Documents against the labelled ones as state: good ones delivered, toxic ones from first windows."""
    items, delivered, baseline = stored_items(spark, folder)
    return unseen(first_in_source(items), delivered, baseline).select("source", "pos", "dedupe_key")


def persisted(spark, folder):
    return persisted_keys(*stored_items(spark, folder))


def known_items(spark, folder):
    items, delivered, baseline = stored_items(spark, folder)
    known = delivered_items(items, delivered, baseline).select("pos", F.lit("delivered").alias("kind"))
    first = baseline_items(items, baseline).select("pos", F.lit("baseline").alias("kind"))
    return known.unionByName(first)


def key_sets(spark, folder):
    """Union, intersection and difference of the keys of both state tables."""
    _, delivered, baseline = stored_items(spark, folder)
    delivered, baseline = delivered.select("dedupe_key"), baseline.select("dedupe_key")
    tag = lambda df, name: df.select(F.lit(name).alias("kind"), "dedupe_key")
    return (
        tag(seen_keys(delivered, baseline).distinct(), "union")
        .unionByName(tag(delivered.intersect(baseline), "both"))
        .unionByName(tag(delivered.subtract(baseline), "delivered only"))
    )


def ledger_rows(spark, folder):
    """What delivering every document would add to the ledger."""
    return new_deliveries(doc_items(spark, folder), labelled(spark, folder, "quality")).select("source", "dedupe_key", "url")


def candidate_index(spark, folder):
    rows = numbered(doc_items(spark, folder).select("source", "source_ord", "pos"))
    return rows.select("source", "pos", F.col("cand_index").cast("long").alias("cand_index"))


def delivery_order(spark, folder):
    items = doc_items(spark, folder).select("source", "source_ord", "pos", "title")
    return deliver_order(first_window(items, 5))


def title_hints(spark, folder):
    """Shortest text of all links to one address; the first one on equal length."""
    links = pages(spark, folder).selectExpr(
        "page_id",
        "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin",
        "posexplode(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*', 0)) AS (n, a)",
    )
    named = links.selectExpr(
        "concat(origin, regexp_extract(a, 'href=\"([^\"]*)', 1)) AS key",
        "concat(regexp_extract(a, '>(.*)$', 1), repeat('.', n % 3)) AS label",
        "page_id * 1000 + n AS place",
    )
    return named.groupBy("key").agg(F.min_by("label", F.struct(F.length("label"), "place")).alias("hint"))


def prefix_titles(spark, folder):
    """Longest part name word that begins the title of a page, in its own row."""
    from tidewire.sources.index_links import prefix_title

    title = "regexp_extract(html, '<title>([^<]*)', 1)"
    words = "regexp_extract_all(html, '<a href=\"/[^\"]*\">([^<]*)', 1)"
    halves = f"flatten(array({words}, array(substr({title}, 1, 4), lower(substr({title}, 1, 7)))))"
    return table(spark, folder, "pages").selectExpr("page_id", f"{prefix_title(title, halves)} AS title")


_PREFIX_SQL = """
WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS t,
             regexp_extract_all(html, '<a href="/[^"]*">([^<]*)', 1) AS words FROM pages),
q AS (SELECT page_id, lower(trim(regexp_replace(regexp_replace(replace(t, '&amp;', '&'), '[`*_~]', '', 'g'), '\\s+', ' ', 'g'))) AS plain,
        list_concat(words, [substr(t, 1, 4), lower(substr(t, 1, 7))]) AS words FROM p),
u AS (SELECT page_id, plain, unnest(words) AS w, generate_subscripts(words, 1) AS n FROM q)
SELECT q.page_id, coalesce(m.title, '') AS title FROM q LEFT JOIN
  (SELECT page_id, arg_min(w, struct_pack(l := -length(w), n := n)) AS title FROM u
   WHERE w <> '' AND starts_with(plain, lower(w)) GROUP BY page_id) m USING (page_id)
"""


# --------------------------------------------------------------------------
# Looking back
# --------------------------------------------------------------------------


def _customer_days(spark, folder):
    """Orders of a customer, newest first; the year is only known for closed ones."""
    day = "unix_date(date(o_orderdate))"
    return table(spark, folder, "orders").selectExpr(
        "o_custkey",
        "o_orderkey",
        f"(40000L - {day}) * 1000000000L + o_orderkey AS place",
        f"int((40000 - {day}) / 200) AS part",
        "if(o_orderstatus = 'P', year(o_orderdate), NULL) AS year",
        "month(o_orderdate) AS month",
        "1998 AS newest",
    )


def years_by_order(spark, folder):
    rows = inferred_years(_customer_days(spark, folder), ["o_custkey"], "place", "part", "year", "month", "newest")
    return rows.select("o_custkey", "o_orderkey", "inferred_year")


_YEARS_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey, (40000 - date_diff('day', DATE '1970-01-01', cast(o_orderdate AS DATE))) * 1000000000 + o_orderkey AS place,
    CASE WHEN o_orderstatus = 'P' THEN date_part('year', o_orderdate) END AS y, date_part('month', o_orderdate) AS m FROM orders),
r AS (SELECT *, CASE WHEN y IS NULL AND lag(m) OVER w <= 2 AND m >= 10 THEN 1 ELSE 0 END AS rolled FROM o
      WINDOW w AS (PARTITION BY o_custkey ORDER BY place)),
c AS (SELECT *, sum(rolled) OVER (PARTITION BY o_custkey ORDER BY place) AS passed FROM r),
a AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY place) AS ay,
        last_value(CASE WHEN y IS NOT NULL THEN passed END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY place) AS ap FROM c)
SELECT o_custkey, o_orderkey, cast(coalesce(ay - (passed - ap), 1998 - passed) AS INTEGER) AS inferred_year FROM a
"""


def years_above(spark, folder):
    rows = carry_forward(_customer_days(spark, folder), ["o_custkey"], "place", "part", {"above": F.col("year")})
    return rows.select("o_custkey", "o_orderkey", F.coalesce("above", F.lit(-1)).alias("above"))


def sections(spark, folder):
    """Conversation turns as sections: a user turn opens one, the next one ends it."""
    turns = table(spark, folder, "conversations").withColumn("part", F.floor(F.col("turn") / 4))
    opened = carry_forward(
        turns, ["conv_id"], "turn", "part", {"start": F.when(F.col("role") == "user", F.col("turn"))}, include_row=True
    )
    parts = opened.where(F.col("start").isNotNull()).groupBy("conv_id", "start").agg(
        F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("turns")
    )
    # The end of a section is the start of the next one.
    lead = parts.withColumn("part", F.floor(F.col("start") / 64))
    ahead = carry_forward(
        lead.withColumn("back", -F.col("start")).withColumn("part", -F.col("part")),
        ["conv_id"], "back", "part", {"next_start": F.col("start")},
    )
    return ahead.select(
        "conv_id", "start", F.coalesce("next_start", F.lit(-1)).alias("next_start"), "last_turn", "chars", "turns"
    )


def clicks_before_purchase(spark, folder):
    """For each purchase the nearest earlier click of the same user."""
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    found = nearest_preceding(
        events, ["user_id"], "event_id", "day", F.col("event_type") == "click",
        {"click_id": F.col("event_id"), "click_value": F.col("value")},
    )
    return found.where(F.col("event_type") == "purchase").select(
        "event_id", "user_id", F.coalesce("click_id", F.lit(-1)).alias("click_id"),
        F.coalesce("click_value", F.lit(-1.0)).alias("click_value"),
    )


def distinct_entries(spark, folder):
    """First place of each distinct text."""
    rows = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("marker"))
    return first_by(rows, ["marker"], ["doc_id"])


QUERIES = {
    "first_window_w1_t2": first_pages,
    "first_window_by_setting_w1": windows_by_setting,
    "first_in_source_w2": first_of_key,
    "priority_claims_w3": claims,
    "claimed_counts_w3": claimed_counts,
    "first_ids_w4_f6": first_ids,
    "unseen_j1_j2_j3_w4": unseen_items,
    "persisted_keys_j4_u3": persisted,
    "known_items_j13": known_items,
    "key_sets_u2_u3_u4": key_sets,
    "ledger_rows_k1": ledger_rows,
    "candidate_index_w8": candidate_index,
    "delivery_order_t1": delivery_order,
    "title_hints_j5_t4": title_hints,
    "prefix_titles_j6_t4": prefix_titles,
    "inferred_years_w5": years_by_order,
    "carried_years_w6": years_above,
    "section_ends_w7": sections,
    "nearest_preceding_j7": clicks_before_purchase,
    "distinct_entries_a4": distinct_entries,
}

_FIRST_SQL = "first_rows AS (SELECT * FROM doc_items QUALIFY row_number() OVER (PARTITION BY source, dedupe_key ORDER BY pos) = 1)"

ORACLES = {
    "first_window_w1_t2": f"""
        SELECT {HOST_SQL} AS source, page_id AS pos FROM pages
        QUALIFY row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY page_id) <= 3""",
    "first_window_by_setting_w1": """
        SELECT source, doc_id AS pos FROM documents
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5 + 5 * cast(substr(source, 4) AS INTEGER)""",
    "first_in_source_w2": f"WITH {DOC_ITEMS_SQL}, {_FIRST_SQL} SELECT source, pos, dedupe_key FROM first_rows",
    "priority_claims_w3": f"""
        WITH {DOC_ITEMS_SQL} SELECT dedupe_key, source, pos FROM doc_items
        QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY source_ord, pos) = 1""",
    "claimed_counts_w3": f"""
        WITH {DOC_ITEMS_SQL}, {_FIRST_SQL},
        r AS (SELECT source, row_number() OVER (PARTITION BY dedupe_key ORDER BY source_ord, pos) AS n FROM first_rows)
        SELECT source, count_if(n = 1)::BIGINT AS claimed, count_if(n > 1)::BIGINT AS outranked FROM r GROUP BY source""",
    "first_ids_w4_f6": f"""
        WITH {DOC_ITEMS_SQL}, {_FIRST_SQL} SELECT source, pos, ordinary FROM first_rows
        QUALIFY NOT ordinary OR row_number() OVER (PARTITION BY source, item_id ORDER BY pos) = 1""",
    "unseen_j1_j2_j3_w4": f"""
        WITH {DOC_ITEMS_SQL}, {_FIRST_SQL},
        state AS (SELECT source, item_id, url, dedupe_key FROM delivered UNION ALL
                  SELECT source, item_id, url, dedupe_key FROM baseline),
        fresh AS (SELECT * FROM first_rows f
          WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.dedupe_key = f.dedupe_key)
            AND NOT (ordinary AND EXISTS (SELECT 1 FROM state s WHERE s.source = f.source AND s.item_id = f.item_id))
            AND NOT (ordinary AND EXISTS (SELECT 1 FROM state s WHERE s.source = f.source AND s.url = f.url)))
        SELECT source, pos, dedupe_key FROM fresh
        QUALIFY NOT ordinary OR row_number() OVER (PARTITION BY source, item_id ORDER BY pos) = 1""",
    "persisted_keys_j4_u3": f"""
        WITH {DOC_ITEMS_SQL} SELECT dedupe_key FROM doc_items
        INTERSECT (SELECT dedupe_key FROM delivered UNION ALL SELECT dedupe_key FROM baseline)""",
    "known_items_j13": f"""
        WITH {DOC_ITEMS_SQL},
        pairs AS (SELECT source, item_id, url FROM delivered UNION ALL SELECT source, item_id, url FROM baseline)
        SELECT pos, 'delivered' AS kind FROM doc_items d
        WHERE dedupe_key IN (SELECT dedupe_key FROM delivered)
           OR (ordinary AND (EXISTS (SELECT 1 FROM pairs p WHERE p.source = d.source AND p.item_id = d.item_id)
                          OR EXISTS (SELECT 1 FROM pairs p WHERE p.source = d.source AND p.url = d.url)))
        UNION ALL SELECT pos, 'baseline' FROM doc_items WHERE dedupe_key IN (SELECT dedupe_key FROM baseline)""",
    "key_sets_u2_u3_u4": f"""
        WITH {DOC_ITEMS_SQL}
        SELECT 'union' AS kind, dedupe_key FROM (SELECT dedupe_key FROM delivered UNION SELECT dedupe_key FROM baseline)
        UNION ALL SELECT 'both', dedupe_key FROM (SELECT dedupe_key FROM delivered INTERSECT SELECT dedupe_key FROM baseline)
        UNION ALL SELECT 'delivered only', dedupe_key FROM (SELECT dedupe_key FROM delivered EXCEPT SELECT dedupe_key FROM baseline)""",
    "ledger_rows_k1": f"""
        WITH {DOC_ITEMS_SQL} SELECT source, dedupe_key, url FROM doc_items
        WHERE dedupe_key NOT IN (SELECT dedupe_key FROM delivered)
        QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY source_ord, pos) = 1""",
    "candidate_index_w8": """
        SELECT source, doc_id AS pos,
          row_number() OVER (ORDER BY cast(substr(source, 4) AS INTEGER), doc_id) - 1 AS cand_index FROM documents""",
    "delivery_order_t1": """
        SELECT source, cast(substr(source, 4) AS INTEGER) AS source_ord, doc_id AS pos, substr(text, 1, 60) AS title
        FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5""",
    "title_hints_j5_t4": """
        WITH l AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin,
            unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*')) AS a,
            generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*'), 1) - 1 AS n FROM pages),
        t AS (SELECT origin || regexp_extract(a, 'href="([^"]*)', 1) AS key,
            regexp_extract(a, '>(.*)$', 1) || repeat('.', n % 3) AS label, page_id * 1000 + n AS place FROM l)
        SELECT key, arg_min(label, struct_pack(l := length(label), p := place)) AS hint FROM t GROUP BY key""",
    "prefix_titles_j6_t4": _PREFIX_SQL,
    "inferred_years_w5": _YEARS_SQL,
    "carried_years_w6": """
        SELECT o_custkey, o_orderkey, cast(coalesce(last_value(CASE WHEN o_orderstatus = 'P' THEN date_part('year', o_orderdate) END IGNORE NULLS)
          OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS INTEGER) AS above FROM orders""",
    "section_ends_w7": """
        WITH t AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
                     OVER (PARTITION BY conv_id ORDER BY turn) AS start FROM conversations),
        s AS (SELECT conv_id, start, max(turn) AS last_turn, cast(sum(length(text)) AS BIGINT) AS chars, count(*) AS turns
              FROM t WHERE start IS NOT NULL GROUP BY conv_id, start)
        SELECT conv_id, start, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY start), -1) AS next_start, last_turn, chars, turns FROM s""",
    "nearest_preceding_j7": """
        SELECT p.event_id, p.user_id, coalesce(c.event_id, -1) AS click_id, coalesce(c.value, -1.0) AS click_value
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
          ON p.user_id = c.user_id AND p.event_id > c.event_id""",
    "distinct_entries_a4": "SELECT min(doc_id) AS doc_id, sha256(text) AS marker FROM documents GROUP BY sha256(text)",
}
