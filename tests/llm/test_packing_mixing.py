"""Packing and mixing against plain Python."""

import itertools
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.helpers import kept_by_arrow
from tidewire.llm import mixing, packing
from tidewire.session import written

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, size string, length string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture
def docs(spark):
    rows = [
        (1, "one two three", "b", "x", "y"),
        (1, "one two three", "b", "x", "y"),
        (2, None, "a", None, None),
        (3, "", None, "", ""),
        (None, "word " * 9000, "b", "s", "l"),
        (5, "it's DON'T \n\tstop!!! ß İx 12 <|endoftext|> 中文", "a", "s", "l"),
        (6, "x" * 5000, None, "s", "l"),
        *((100 + i, f"some text number {i} " * (i % 7 + 1), "ab"[i % 2], "s", "l") for i in range(40)),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_pieces_are_those_of_the_tokenizer(docs, tokenizer):
    got = Counter(
        (r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.token_pieces(docs, PATH).collect()
    )
    expected = Counter()
    for row in docs.collect():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], dtype="<u4")
            expected[row.doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert got == expected


def test_pieces_fill_sequences_without_gaps(docs):
    rows = packing.pack_documents(docs, PATH).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) == rows[0].bound  # certified here


def test_exchange_between_groups(spark):
    sizes = [int(x) for x in np.random.default_rng(5).integers(1, 60, 3000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0, i) for i, n in enumerate(sizes)], packing.PIECES)
    rows = packing.pack(written(pieces, "pieces"), 100, group_rows=200).collect()
    assert sorted(r.length for r in rows) == sorted(sizes)
    fills = Counter()
    for r in rows:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 100
    assert rows[0].bound <= len(fills) <= rows[0].bound + 1


def test_every_piece_comes_back_when_rounds_run_out(spark):
    # No bin is certain to fill and the total falls in every round, so no other end of the exchange is met.
    sizes = [int(x) for x in np.random.default_rng(1).integers(78, 134, 40_000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0, i) for i, n in enumerate(sizes)], packing.PIECES)
    rows = packing.pack(written(pieces, "pieces"), 400, group_rows=400).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(sizes))
    fills = Counter()
    for r in rows:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 400


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_bound_is_a_bound(sizes):
    def fits(bins):
        def put(i, room):
            if i == len(sizes):
                return True
            tried = set()
            for k, r in enumerate(room):
                if r >= sizes[i] and r not in tried:
                    tried.add(r)
                    if put(i + 1, [*room[:k], r - sizes[i], *room[k + 1 :]]):
                        return True
            return False

        return put(0, [12] * bins)

    least = next(n for n in range(1, 8) if fits(n))
    assert packing.lower_bound(np.bincount(sizes, minlength=13), 12) <= least
    bins, _, fill = packing.best_fit(np.array(sizes), 12)
    assert len(fill) >= least and fill.max() <= 12 and fill.sum() == sum(sizes) and bins.max() == len(fill) - 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack_documents(empty, PATH).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.emitted(empty).columns == empty.columns


def plain_targets(sizes):
    """Targets by sharing the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weights = dict(zip(names, itertools.cycle((1, 2, 3))))
    total, open_, out = Fraction(sum(sizes.values())), set(names), {}
    while open_:
        share = total / sum(weights[s] for s in open_)
        above = {s for s in open_ if share * weights[s] > 3 * sizes[s]}
        if not above:
            out |= {s: share * weights[s] for s in open_}
            break
        for s in above:
            out[s] = Fraction(3 * sizes[s])
            total -= out[s]
        open_ -= above
    return out


def test_targets_and_copies(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken = Counter({r.source: 0 for r in rows}), Counter()
    for r in rows:
        assert r.size == len([w for w in (r.text or "").replace("\n", " ").replace("\t", " ").split(" ") if w])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    goal = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - float(goal[r.source])) < 1e-6
    largest = Counter()
    for r in rows:
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - float(goal[s])) <= largest[s] for s in sizes)


def test_positions_are_whole_divisions(spark):
    cases = [(1, 10**12 - 1, 0), (1, 10**12, 0), (3, 999_999_999_999, 2), (10**17 + 7, 2_999_999_999_999, 5), (10**17 + 1, 3 * 10**12 - 1, 10**12 - 1)]
    rows = spark.createDataFrame(cases, "rank long, _rate long, _offset long")
    got = [r[0] for r in rows.select(mixing._crossed(F.col("rank"))).collect()]
    assert got == [(rank * rate + offset) // mixing.UNIT for rank, rate, offset in cases]


def test_small_source_stops_at_its_limit(spark):
    rows = [(i, "w " * 10, "big") for i in range(30)] + [(100, "w", "c"), (101, "w w", "c")]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.taken for r in mixed if r.source == "c"} == {3, 6}
    assert sum(r.taken for r in mixed if r.source == "big") in range(280, 310)


def test_emitted_rows_keep_their_columns(docs):
    out = mixing.emitted(docs)
    assert out.schema.names == docs.schema.names
    assert out.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert {r["size"] for r in out.select("size").collect()} <= {"x", "s", None, ""}


def test_reruns_agree(docs):
    def run(parts):
        return Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(docs.repartition(parts)).collect())

    assert run(2) == run(7)


def test_equal_ids_stand_in_the_order_of_their_texts(spark):
    rows = [(1, f"w{i} x y", "a") for i in range(9)] + [(i, "w " * 20, "b") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def run(parts):
        return Counter(tuple(r) for r in mixing.emitted(docs.repartition(parts)).collect())

    assert run(1) == run(3) == run(8)


def test_one_offset_per_source(spark):
    """The chance of a document is its rate: over many sources each is taken as often as expected."""
    rows = [(10 * s + i, "w " * (i + 1), f"s{s:03}") for s in range(120) for i in range(6)] + [(9999, "w " * 4000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    over = Counter()
    for r in mixing.mix(docs).where(F.col("source") != "t").collect():
        over[r.size] += r.copies - r.target / r.source_size
    assert all(abs(over[size] / 120) < 0.2 for size in range(1, 7))


def test_words_learnt_in_shares(monkeypatch):
    """Ids of words are the tokenizer's, however few words and lines it gets at once and words are kept."""
    monkeypatch.setattr(packing, "_NEW_WORDS", 700)
    monkeypatch.setattr(packing, "_LINES", 1)
    pick = random.Random(5)
    letters = "abcdefghijXYZéñßİ中"
    ends = ["", "", ".", ",", "!", "?!", "'s", "'", ":", "7", "́", "ª,"]
    words = ["".join(pick.choices(letters, k=pick.randint(1, 9))) + pick.choice(ends) for _ in range(4000)]
    texts = [" ".join(pick.choices([*words, ".", "don't", "<|endoftext|>", "x" * 300 + ","], k=120)) for _ in range(150)]
    known = packing.WordIds(PATH)
    lines = []

    class Counting:
        def __init__(self, tokenizer):
            self.encode, self._batch = tokenizer.encode, tokenizer.encode_batch_fast

        def encode_batch_fast(self, batch, **options):
            lines.append(len(batch))
            return self._batch(batch, **options)

    plain, known._tokenizer = known._tokenizer, Counting(known._tokenizer)
    expected = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    array = pa.array([t.encode() for t in [*texts, ""]] + [None], pa.binary())
    assert list(known.ids(array)) == [*expected, b"", b""]
    assert max(lines) == 1 and len(lines) > 3
    monkeypatch.setattr(packing, "CACHED_WORDS", 100)
    assert list(known.ids(array)) == [*expected, b"", b""]
    assert list(packing.WordIds(PATH).ids(array)) == [*expected, b"", b""]


def test_workers_give_memory_back():
    """A worker does other tasks after a packing one: what its slices took does not stay in it, and its caches are bounded."""
    texts = pa.array([b"some text number %d of many, " % (i % 50) * 100 for i in range(16_000)], pa.binary())
    known = packing.WordIds(PATH)
    pa.default_memory_pool().release_unused()
    assert sum(map(len, known.ids(texts))) > 40_000_000
    assert kept_by_arrow() < 20
    assert packing.CACHED_WORDS <= 2_000_000 and packing.CACHED_RUNS <= 600_000
