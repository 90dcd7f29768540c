"""The pipeline stage by stage, and registration."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
import corpus_pipeline
from tests.llm.test_packing_mixing import plain_targets
from tests.llm.test_scans_rules import base_spans
from tests.llm.test_search_join import shingles
from tidewire.llm import quality_classifier
from tidewire.llm.tables import read
from tidewire.session import written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = read(spark, FOLDER, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], FOLDER), name))
    return out


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def test_rejected_documents_go(spark, stages):
    scored = quality_classifier.scored(stages[0], read(spark, FOLDER, "labels")).collect()
    assert sorted(r.doc_id for r in scored if r.predicted) == sorted(r.doc_id for r in stages[1].collect())


def test_one_document_of_each_group(stages):
    before, after = stages[1].collect(), {r.doc_id for r in stages[2].collect()}
    sets = {r.doc_id: shingles(r.text) for r in before}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if b < a and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert after == {r for d, r in root.items() if sets[d]} | {d for d in sets if not sets[d]}


def test_secrets_are_masked(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    assert any(base_spans(r.text) for r in before.values())
    for doc, row in after.items():
        assert not base_spans(row.text) and row.n_chars == len(row.text)
        if "[REDACTED]" not in row.text:
            assert row.text == before[doc].text


def test_mix_comes_near_targets(stages):
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in stages[3].collect():
        n = len(r.text.split())
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    for r in stages[4].collect():
        taken[r.source] += len(r.text.split())
    goal = plain_targets(sizes)
    assert all(abs(taken[s] - float(goal[s])) <= largest[s] for s in sizes)
    assert max(Counter(r.doc_id for r in stages[4].collect()).values()) <= 3


def test_packed_pieces(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for r in stages[4].collect():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], dtype="<u4")
        expected.update((r.doc_id, k, zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    rows = stages[5].collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in rows) == expected
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    # Best-fit decreasing need not reach the bound by volume: these few documents leave 30 tokens too much.
    least = -(-sum(fill.values()) // 4096)
    assert max(fill.values()) <= 4096 and least <= len(fill) <= least + 1


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "ids_crc32").collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, stages[5].select("doc_id", "piece", "ids_crc32").collect()))


def test_registered():
    names = [n for n in entry_point.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted([*(f"op{i}" for i in range(1, 11)), "pipeline"])
