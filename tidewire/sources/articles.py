"""Reading articles with a user's client.

Links are dealt by host, so one task asks a host one thing after the other and keeps its pace; a host with very many
links is dealt to a fixed number of clients.  What cannot be read is a row with its reason.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.urls import article_link, canonical_url, host_of
from tidewire.operators.enrichment import MAX_ARTICLE_BYTES, TOO_LARGE

#: Reads the page of a URL; an exception says why it cannot be read.
Reader = Callable[[str], bytes]

NOT_ALLOWED = "article link is not allowed"
_PAGE = "article_url string, fetched_at timestamp, body binary, error string"


def read_articles(
    items: DataFrame, factory: Callable[[], Reader], *, clients_per_host: int = 4, pause: float = 0.0,
    max_bytes: int = MAX_ARTICLE_BYTES,
) -> DataFrame:
    """Read the articles of ``items`` (url, allowed_hosts, content_mode), each address once.

    The result has the columns of landed articles, and ``error`` with a NULL body where there is none.
    ``factory`` builds one reader per task; ``pause`` are the seconds between two requests of a client to a host.
    """
    asked = items.where(F.col("content_mode") == "article").select(
        "url", F.expr(article_link("url", "allowed_hosts")).alias("article_url")
    )
    refused = asked.where(F.col("article_url").isNull()).select(
        F.col("url").alias("article_url"), F.lit(None).cast("timestamp").alias("fetched_at"),
        F.lit(None).cast("binary").alias("body"), F.lit(NOT_ALLOWED).alias("error"),
    ).distinct()
    # Addresses that differ only in their shape are one article.
    links = (
        asked.where(F.col("article_url").isNotNull())
        .groupBy(F.expr(canonical_url("article_url")).alias("_key"))
        .agg(F.min("article_url").alias("article_url"))
        .select("article_url", F.expr(host_of("article_url")).alias("_host"))
        .withColumn("_client", F.pmod(F.xxhash64("article_url"), F.lit(clients_per_host)))
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, last = None, {}
        try:
            for batch in batches:
                rows = []
                for link, host in zip(batch["article_url"], batch["_host"], strict=True):
                    time.sleep(max(0.0, last.get(host, 0.0) + pause - time.monotonic()))
                    body = problem = None
                    try:
                        reader = reader or factory()
                        body = bytes(reader(link))
                        if len(body) > max_bytes:
                            body, problem = None, TOO_LARGE
                    except Exception as failure:  # noqa: BLE001 - one article must not stop the others
                        problem = f"{type(failure).__name__}: {failure}"
                    last = {host: time.monotonic()}
                    rows.append((link, pd.Timestamp.now(tz="UTC"), body, problem))
                yield pd.DataFrame(rows, columns=["article_url", "fetched_at", "body", "error"])
        finally:
            close = getattr(reader, "close", None)
            if callable(close):
                close()

    dealt = links.repartition("_host", "_client").sortWithinPartitions("_host", "_client")
    return dealt.mapInPandas(read, _PAGE).unionByName(refused)
