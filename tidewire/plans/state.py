"""Persisted state as append-only Parquet logs that several writers may share.

Every attempt of a run writes its rows to folders of its own, ``<table>/attempt=<unique>``, and is published by
one small manifest, ``_runs/<number>``, that names the run, the attempt and its tables.  A manifest is written aside and
renamed only if its number is free, so of two writers one takes the number and the other one looks at the state
again and takes the next.  Rows that depend on the state are then made anew from what is published by now.  A run so
appears as a whole or not at all, and files of a crashed attempt are never read.

After ``COMPACT_AFTER`` runs the state is rewritten as one.  Such a base says up to which number it covers the
state; a run that another writer published meanwhile has a higher number and is still read.  ``vacuum`` removes
what no reader needs any more.

The rename is as atomic as that of the file system: HDFS and local folders refuse an existing target.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.dedup import first_by
from tidewire.operators.failures import active_failures
from tidewire.schemas import STATE

#: Published runs that are read one by one before they are rewritten as one.
COMPACT_AFTER = 64
#: Seconds after which files that nothing refers to are removed; an attempt must not take longer.
VACUUM_AFTER = 7 * 24 * 3600

_RUN_ROW = "run_seq long, run_id string, covers long, attempt string, tables array<string>"


class Attempt(NamedTuple):
    """A published attempt: its number, run and folder, the tables it wrote, and for a base the last number it covers."""

    number: int
    run_id: str
    name: str
    tables: frozenset[str]
    covers: int | None = None

    @property
    def order(self) -> int:
        """Place of its rows among those of other runs."""
        return self.number if self.covers is None else self.covers


Tables = Mapping[str, DataFrame]


class StateStore:
    """State tables below one folder that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    # -- files ------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("_runs").getFileSystem(self._conf)

    def _listed(self, name: str) -> list[tuple[str, int]]:
        """Names and times of change (milliseconds) in a folder."""
        if not self._fs().exists(self._path(name)):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs().listStatus(self._path(name))]

    def _read(self, name: str) -> dict:
        stream = self._fs().open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _create(self, name: str, content: dict) -> bool:
        """Write a file unless it exists; False if it does."""
        aside = self._path(f"_aside/{uuid.uuid4().hex}")
        stream = self._fs().create(aside, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        files = self._jvm.org.apache.hadoop.fs
        rename = getattr(files, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        self._fs().mkdirs(self._path(name).getParent())
        try:
            files.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, self._path(name), how)
        except Py4JJavaError as problem:
            self._fs().delete(aside, False)
            if self._fs().exists(self._path(name)):
                return False
            raise problem
        return True

    # -- reading ----------------------------------------------------------

    def _numbers(self) -> list[int]:
        return sorted((int(name) for name, _ in self._listed("_runs") if name.isdigit()), reverse=True)

    def _manifest(self, number: int) -> Attempt:
        row = self._read(f"_runs/{number:012d}")
        return Attempt(number, row["run_id"], row["attempt"], frozenset(row["tables"]), row["covers"])

    def published(self) -> list[Attempt]:
        """Attempts to read, by number: the newest base and the runs it does not cover, of which there are few."""
        found: list[Attempt] = []
        base: Attempt | None = None
        for number in self._numbers():
            if base is not None and number <= base.covers:
                break
            attempt = self._manifest(number)
            if attempt.covers is None:
                found.append(attempt)
            elif base is None:
                base = attempt
        return sorted([*found, *([base] if base else [])])

    def runs(self) -> DataFrame:
        """The attempts that are read, as rows."""
        rows = [(a.number, a.run_id, a.covers, a.name, sorted(a.tables)) for a in self.published()]
        return self.spark.createDataFrame(rows, _RUN_ROW)

    def table(self, name: str, published: list[Attempt] | None = None) -> DataFrame:
        """All published rows with ``run_seq``; empty when nothing was written yet."""
        wanted = [a for a in (self.published() if published is None else published) if name in a.tables]
        if not wanted:
            return self.spark.createDataFrame([], T.StructType([*STATE[name].fields, T.StructField("run_seq", T.LongType())]))
        schema = T.StructType([*STATE[name].fields, T.StructField("attempt", T.StringType())])
        folders = [f"{self.path}/{name}/attempt={a.name}" for a in wanted]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*folders)
        # At most one entry for each attempt that is read.
        order = F.create_map(*(F.lit(v) for a in wanted for v in (a.name, a.order)))
        return rows.withColumn("run_seq", order[F.col("attempt")].cast("long")).drop("attempt")

    def active_failures(self, published: list[Attempt] | None = None) -> DataFrame:
        return active_failures(self.table("failure_log", published))

    def _mark(self, run_id: str) -> str:
        return f"_ids/{hashlib.sha256(run_id.encode()).hexdigest()}"

    def sequence_of(self, run_id: str, published: list[Attempt] | None = None) -> int | None:
        """Number of a published run, None when it is not published."""
        for attempt in self.published() if published is None else published:
            if attempt.run_id == run_id:
                return attempt.number
        # Runs that a base covers have left a mark.
        return self._read(self._mark(run_id))["number"] if self._fs().exists(self._path(self._mark(run_id))) else None

    # -- writing ----------------------------------------------------------

    def _written(self, tables: Tables) -> tuple[str, list[str]]:
        # Unique, so that nothing of an attempt that crashed, or of another writer, can be taken for this one.
        attempt = uuid.uuid4().hex
        for name, rows in tables.items():
            rows.select(*STATE[name].names).write.parquet(f"{self.path}/{name}/attempt={attempt}")
        return attempt, sorted(tables)

    def commit(self, run_id: str, tables: Tables | Callable[[list[Attempt]], Tables], covers: int | None = None) -> int:
        """Write all tables of a run, then publish it.  A published run is left as it is.

        ``tables`` that depend on the state are a function of the published attempts; it is called again if
        another run was published while they were written.
        """
        written: tuple[str, list[str]] | None = None
        seen: list[Attempt] | None = None
        while True:
            number = max([0, *self._numbers()]) + 1
            # Read after the number was chosen: a run that is published from now on takes that number.
            published = self.published()
            done = self.sequence_of(run_id, published)
            if done is not None:
                return done
            if written is None or (callable(tables) and published != seen):
                written = self._written(tables(published) if callable(tables) else tables)
                seen = published
            content = {"run_id": run_id, "attempt": written[0], "tables": written[1], "covers": covers}
            if self._create(f"_runs/{number:012d}", content):
                break
        if covers is None and len(self.published()) > COMPACT_AFTER:
            self.compact()
        return number

    def compact(self, run_id: str | None = None) -> int:
        """Rewrite the current state as one base; the runs it covers are no longer read."""
        published = self.published()
        if not published:
            return 0
        cache = self.table("summary_cache", published)
        key = [c for c in STATE["summary_cache"].names if c not in ("title_zh", "bullets_zh")]
        active = self.active_failures(published).select(
            "source", "item_key", F.lit("alerted").alias("event"), F.lit(0).alias("seq")
        )
        for attempt in published:
            self._create(self._mark(attempt.run_id), {"number": attempt.number})
        return self.commit(
            run_id or f"compacted-{uuid.uuid4().hex}",
            {
                "delivered": self.table("delivered", published),
                "baseline": self.table("baseline", published),
                "source_state": self.table("source_state", published).select("source").distinct(),
                "summary_cache": first_by(cache, key, [F.col("run_seq").desc()]),
                "failure_log": active,
                "run_summary": self.table("run_summary", published),
            },
            covers=max(a.number for a in published),
        )

    def vacuum(self, older_than: float = VACUUM_AFTER) -> int:
        """Remove attempts, manifests and files aside that no reader needs and that are old enough; their number."""
        before = (time.time() - older_than) * 1000
        published = self.published()
        used = {a.name for a in published}
        covered = max((a.covers for a in published if a.covers is not None), default=0)
        old = [
            f"{name}/{folder}"
            for name in STATE
            for folder, changed in self._listed(name)
            if folder.startswith("attempt=") and folder.removeprefix("attempt=") not in used and changed < before
        ]
        old += [
            f"_runs/{name}"
            for name, changed in self._listed("_runs")
            if name.isdigit() and int(name) <= covered and changed < before
        ]
        old += [f"_aside/{name}" for name, changed in self._listed("_aside") if changed < before]
        for name in old:
            self._fs().delete(self._path(name), True)
        return len(old)


# --------------------------------------------------------------------------
# Rows to write
# --------------------------------------------------------------------------


def new_deliveries(items: DataFrame, delivered: DataFrame) -> DataFrame:
    """Delivered items whose key is in the ledger neither before nor twice now."""
    once = first_by(items, ["dedupe_key"], ["source_ord", "pos"])
    return once.join(delivered.select("dedupe_key"), "dedupe_key", "left_anti").select(*STATE["delivered"].names)


def new_baseline(items: DataFrame, roles: DataFrame, source_state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of first windows and the marks of their sources.

    Every item of the window counts, filtered or not; a source without items is
    marked as well.  Sources that are marked already are left alone.
    """
    fresh = roles.where(F.col("role") == "baseline").join(
        source_state.select("source"), "source", "left_anti"
    ).select("source")
    rows = first_by(items.join(fresh, "source", "left_semi"), ["source", "dedupe_key"], ["pos"])
    return rows.select(*STATE["baseline"].names), fresh


def log_rows(keys: DataFrame, event: str, seq: int) -> DataFrame:
    return keys.select("source", "item_key", F.lit(event).alias("event"), F.lit(seq).alias("seq"))
