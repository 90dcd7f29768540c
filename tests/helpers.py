"""Small documents and tables for the tests."""

import itertools
import re
from pathlib import Path

import pyarrow as pa

from tidewire import schemas


def source(name, url, collector, hosts=("example.com",), window=20, ordinal=0, **more):
    return {
        "source_ord": ordinal, "source": name, "url": url, "allowed_hosts": list(hosts),
        "window_size": window, "collector": collector,
        "content_mode": more.get("content_mode", "inline"),
        "filter": more.get("filter", False), "max_age_days": more.get("max_age_days"),
    }


def source_table(spark, *rows):
    return schemas.source_table(spark, rows)


def raw_docs(spark, *pairs, run="r1", times=()):
    """Pages as (source, body); ``times`` are their fetch times, None for the rest."""
    rows = [
        (run, name, None, at, body if isinstance(body, (bytes, bytearray)) else body.encode())
        for (name, body), at in itertools.zip_longest(pairs, times)
    ]
    return spark.createDataFrame(rows, schemas.RAW_DOCS)


def entry_list(spark, settings, body, max_bytes=5 * 1024 * 1024):
    """Entry rows of one document, in page order."""
    from tidewire.sources.registry import entries

    rows = entries(
        raw_docs(spark, (settings["source"], body)), source_table(spark, settings),
        settings["collector"], max_bytes,
    ).collect()
    return sorted(rows, key=lambda r: r["pos"] or 0)


def picked(rows, kind, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rows if r["kind"] == kind]


def kept_by_arrow():
    """MB that Arrow holds of this process though nothing uses them."""
    own = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    before = own()
    pa.default_memory_pool().release_unused()
    return before - own()
