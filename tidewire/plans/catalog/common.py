"""Input frames and SQL pieces shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.identity import dedupe_key, is_ordinary
from tidewire.functions.urls import canonical_url, host_of
from tidewire.session import written

RUN_DATE = "1998-01-15"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def canonical_sql(u: str) -> str:
    """Canonical URL in DuckDB for URLs without percent-escapes in the query."""
    place = r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)"
    query = f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
    scheme = f"lower(regexp_extract({u}, '^([A-Za-z]+)://', 1))"
    port = f"regexp_extract({u}, '^[A-Za-z]+://[^/?#]*?:([0-9]+)(?:[/?#]|$)', 1)"
    path = f"regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
    trackers = (
        "'_ga','_gl','_hsenc','_hsmi','dclid','fbclid','gclid','mc_cid','mc_eid','mkt_tok','msclkid',"
        "'vero_conv','vero_id'"
    )
    kept = (
        f"list_filter(string_split({query}, '&'), lambda p: p <> ''"
        f" AND NOT starts_with(lower(p), 'utm_') AND lower(string_split(p, '=')[1]) NOT IN ({trackers}))"
    )
    pairs = f"list_transform({kept}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)"
    return (
        f"({scheme} || '://' || rtrim(lower(regexp_extract({u}, '{place}', 1)), '.')"
        f" || CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443')"
        f" THEN '' ELSE ':' || {port} END"
        f" || CASE WHEN {path} = '' THEN '/' ELSE {path} END"
        f" || CASE WHEN len({pairs}) = 0 THEN '' ELSE '?' || array_to_string(list_sort({pairs}), '&') END)"
    )


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of texts; Spark splits its files by ``spark.sql.files.maxPartitionBytes``."""
    return table(spark, folder, name)


HOST_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with their host as the source."""
    return text_table(spark, folder, "pages").withColumn("host", F.expr(host_of("url")))


# --------------------------------------------------------------------------
# Documents as items
# --------------------------------------------------------------------------

#: German documents stand for dated sections, which are not named by their URL.
_RAW_URL = "concat('HTTPS://Docs.Example.com/', lang, '/', md5(text), '?utm_source=', source, '#', doc_id)"
_EXPLICIT = "if(lang = 'de', concat('changelog:', sha2(text, 256)), '')"
#: Dates of all precisions, spread over about a year.
_PUBLISHED = (
    "CASE lang WHEN 'en' THEN date_format({day}, 'yyyy-MM-dd') WHEN 'fr' THEN date_format({day}, 'yyyy-MM')"
    " WHEN 'es' THEN concat(date_format({day}, 'yyyy-MM-dd'), 'T20:30:00+00:00') ELSE '' END"
)


def doc_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as an item of its source, in order of ids."""
    docs = text_table(spark, folder, "documents")
    day = "date_sub(DATE'1998-01-15', int(n_chars % 365))"
    return docs.selectExpr(
        "'r1' AS run_id",
        "source",
        "int(substr(source, 4)) AS source_ord",
        "doc_id AS pos",
        "concat(lang, '-', n_chars) AS item_id",
        "substr(text, 1, 60) AS title",
        "text AS content",
        f"{_RAW_URL} AS url",
        f"{_PUBLISHED.format(day=day)} AS published_at",
        "'' AS author",
        "lang AS category",
        "'' AS guid",
        f"{_EXPLICIT} AS explicit",
    ).withColumn("dedupe_key", F.expr(dedupe_key("explicit", "url"))).drop("explicit")


def with_ordinary(items: DataFrame) -> DataFrame:
    return items.withColumn("ordinary", F.expr(is_ordinary("dedupe_key", "url")))


def labelled(spark: SparkSession, folder: str, column: str, items: DataFrame | None = None) -> DataFrame:
    """Items of documents with a label (0/1) set."""
    ids = table(spark, folder, "labels").where(F.col(column) == 1).select(F.col("doc_id").alias("pos"))
    return (doc_items(spark, folder) if items is None else items).join(ids, "pos", "left_semi")


def stored_items(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Identities of all items as a written table, with the delivered and the first-window ones."""
    items = with_ordinary(doc_items(spark, folder)).select(
        "source", "source_ord", "pos", "item_id", "url", "dedupe_key", "ordinary"
    )
    items = written(items, "items")
    return items, labelled(spark, folder, "quality", items), labelled(spark, folder, "toxic", items)


#: The same items in DuckDB.
DOC_ITEMS_SQL = """
doc_items AS (
  SELECT source, cast(substr(source, 4) AS INTEGER) AS source_ord, doc_id AS pos,
         lang || '-' || n_chars AS item_id, substr(text, 1, 60) AS title, text AS content,
         'HTTPS://Docs.Example.com/' || lang || '/' || md5(text) || '?utm_source=' || source || '#' || doc_id AS url,
         DATE '1998-01-15' - cast(n_chars % 365 AS INTEGER) AS day, lang,
         CASE WHEN lang = 'de' THEN 'changelog:' || sha256(text)
              ELSE 'https://docs.example.com/' || lang || '/' || md5(text) END AS dedupe_key,
         lang <> 'de' AS ordinary
  FROM documents),
delivered AS (SELECT d.* FROM doc_items d JOIN labels l ON l.doc_id = d.pos WHERE l.quality = 1),
baseline AS (SELECT d.* FROM doc_items d JOIN labels l ON l.doc_id = d.pos WHERE l.toxic = 1)
"""


def pages_key(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).withColumn("dedupe_key", F.expr(canonical_url("url")))
