"""Runs driven by landed files."""

import datetime
import json

from tests.helpers import raw_docs, source, source_table
from tidewire.plans.run import Settings
from tidewire.plans.state import StateStore
from tidewire.streaming.runs import landed, run_landed

PAGE = "# Log\n\n## June 2026\n\n{}\n\n## May 2026\n\nOld text.\n"


def summarizer():
    return lambda item, article: json.dumps({"title_zh": "标题", "bullets_zh": ["一", "二", article + " 三"]})


def test_each_micro_batch_is_one_run(spark, tmp_path):
    sources = source_table(spark, source("API", "https://example.com/log", "markdown_changelog"))
    settings = Settings(run_date=datetime.date(2026, 6, 20), collectors=("markdown_changelog",))
    folder, sent = str(tmp_path / "in"), []

    def work():
        run_landed(
            landed(spark, folder, files_per_run=1), str(tmp_path / "state"), sources, settings, summarizer,
            checkpoint=str(tmp_path / "checkpoint"),
            after=lambda result: sent.append([r["dedupe_key"] for r in result.messages.collect()]),
        )

    raw_docs(spark, ("API", PAGE.format("First."))).coalesce(1).write.mode("append").parquet(folder)
    work()
    raw_docs(spark, ("API", PAGE.format("Second."))).coalesce(1).write.mode("append").parquet(folder)
    work()
    work()  # nothing new landed
    assert [len(s) for s in sent] == [0, 1] and sent[1][0].startswith("changelog:")
    store = StateStore(spark, str(tmp_path / "state"))
    assert store.table("baseline").count() == 2 and store.table("delivered").count() == 1
    assert store.sequence_of("batch-1") is not None and store.sequence_of("batch-2") is None
