"""Neighbour search and n-gram join against brute force."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.llm import ann, ngram_join
from tidewire.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, score string"


def nearest(rows, query, k=5):
    def usable(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    q = np.array(query[1], dtype=np.float64)
    scored = []
    for i, v, *_ in rows:
        if i is not None and i != query[0] and usable(v) and len(v) == len(q):
            w = np.array(v, dtype=np.float64)
            scored.append((-(q * w).sum() / (np.sqrt((q * q).sum()) * np.sqrt((w * w).sum())), i))
    return sorted(scored)[:k]


@pytest.fixture(scope="module")
def vectors():
    random_ = np.random.default_rng(3)
    centres = random_.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * random_.normal(size=16)).astype("f4").tolist(), "s") for i in range(600)]
    rows += [(1000 + i, [1.0] * 16, "s") for i in range(60)]  # a very common vector
    rows += [(2000, None, "s"), (2050, [0.0] * 16, "s"), (2100, [float("nan")] * 16, "s"), (2150, [1.0, None], "s"), (None, [1.0] * 16, "s")]
    rows += [(2200, [1.0, 2.0], "s"), (2201, [2.0, 4.0], "s"), (2250, [], "s")]
    return rows


def test_neighbours(spark, vectors):
    found = defaultdict(list)
    for r in ann.neighbours(spark.createDataFrame(vectors, SCHEMA), F.col("vec_id") % 50 == 0).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    by_id = {r[0]: r for r in vectors}
    hit = total = 0
    asked = [i for i in by_id if i is not None and i % 50 == 0 and i not in (2000, 2050, 2100, 2150, 2250)]
    for i in asked:
        best = nearest(vectors, by_id[i])
        got = sorted(found.pop(i))
        assert [rank for rank, *_ in got] == list(range(1, len(best) + 1))
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        exact = {v: -s for s, v in nearest(vectors, by_id[i], 10**6)}
        assert all(s == pytest.approx(exact[v], abs=1e-12) for _, v, s in got)
        hit += len({v for _, v in best} & {v for _, v, _ in got})
        total += len(best)
    assert not found
    assert hit >= 0.9 * total


def test_ties_go_to_smaller_ids(spark, vectors):
    found = ann.neighbours(spark.createDataFrame(vectors, SCHEMA), F.col("vec_id") == 1050).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [1000, 1001, 1002, 1003, 1004]


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1e-310])
def test_huge_and_tiny_numbers(spark, vectors, scale):
    rows = [(i, v) for i, v, _ in vectors if i is not None and i < 600]
    scaled = [(i, [x * scale for x in v]) for i, v in rows]
    schema = "vec_id long, embedding array<double>"

    def run(table):
        found = ann.neighbours(spark.createDataFrame(table, schema), F.col("vec_id") % 50 == 0).collect()
        return {(r.query_id, r["rank"]): (r.vec_id, pytest.approx(r.score, abs=1e-2 if scale == 1e-310 else 1e-12)) for r in found}

    expected, got = run(rows), run(scaled)
    assert len(got) == 60 and got.keys() == expected.keys()
    if scale != 1e-310:  # components there have a few digits only
        assert [got[k][0] for k in got] == [expected[k][0] for k in got]


def test_many_lengths_and_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 40)
    monkeypatch.setattr(ann, "ASKED", 7)
    rows = [(10_000 + 10 * d + i, [float((i * j) % 7 + 1) for j in range(d)]) for d in range(1, 81) for i in range(7)]
    rows += [(i, v) for i, v, _ in vectors if i is not None and v and len(v) == 16]
    rows += [(20_000 + i, [2.0, 1.0] * 8) for i in range(400)]  # queries that are one vector
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = (F.col("vec_id") % 50 == 0) | (F.col("vec_id") >= 20_000)
    found = defaultdict(list)
    for r in ann.neighbours(table, asked).collect():
        found[r.query_id].append((r["rank"], r.vec_id))
    for i in range(400):
        least = [20_000 + j for j in range(6) if j != i][:5]
        assert [v for _, v in sorted(found[20_000 + i])] == least
    by_id = dict(rows)
    for q in (10_050, 10_100, 10_800):
        assert [n for n, _ in sorted(found[q])] == list(range(1, 1 + len(nearest(rows, (q, by_id[q])))))


def test_no_vectors(spark):
    assert ann.neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    words = ["".join(c.lower() if c < "\x80" else c for c in w) for w in words]
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def plain_join(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((repr(d), len(s), repr(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, n=150):
    pick = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    bases = [[f"w{pick.randrange(4000)}" for _ in range(pick.choice((3, 20, 60, 200)))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(pick.choice(bases))
        for _ in range(pick.choice((0, 0, 1, 2, 3))):
            words[pick.randrange(len(words))] = f"n{pick.randrange(10**6)}"
        if pick.random() < 0.3:
            words += passage
        if pick.random() < 0.2:
            words = words[: pick.randrange(1, len(words) + 1)]
        rows.append((i, pick.choice((" ", "\n", "  ")).join(words).upper() if pick.random() < 0.2 else " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n"), (3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, "q r s t u v"), (903, "é É")]


@pytest.mark.parametrize("seed, block, sets", [(1, 10**6, 2000), (2, 300, 4), (3, 800, 2)])
def test_join(spark, monkeypatch, seed, block, sets):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", sets)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, n int, sig int, label int")
    found = ngram_join.near_duplicates(docs).collect()
    assert Counter((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in found) == plain_join(rows)


def test_one_document_of_each(spark):
    rows = corpus(4, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = plain_join(rows)
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    full = [r for r in kept.collect() if shingles(r.text)]
    alone = 1  # the component of "q r s t u v" has no id
    assert len(full) == len({c for _, n, c in groups if n and c != "None"}) + alone
    assert kept.count() - len(full) == 3


def test_tree_join_keeps_known_labels():
    sets = [np.arange(10), np.arange(1, 11), np.arange(50, 60)]
    assert ngram_join.tree_join(sets, np.array([5, 6, 7])).tolist() == [5, 5, 7]


def test_join_of_nothing(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    pick = random.Random(9)
    edges = [(pick.randrange(80), pick.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert all(found.get(x, x) == c for x, c in low.items())


def test_few_texts_are_fetched(spark, monkeypatch):
    """Rows that are wanted are all found, null ids too, before any text is shuffled; others hardly ever."""
    docs = spark.range(20_000).selectExpr("if(id = 7, NULL, id) AS doc_id", "xxhash64(id % 9000) AS hash", "string(id) AS text")
    wanted = docs.where("doc_id % 50 = 3 OR doc_id IS NULL").select("doc_id", "hash")
    asked = {tuple(r) for r in wanted.collect()}
    for bits, most in ((26, 1000), (10, 20_000)):
        monkeypatch.setattr(ngram_join, "FILTER_BITS", bits)
        found = [tuple(r) for r in ngram_join._may_be_in(docs, wanted).select("doc_id", "hash").collect()]
        assert asked <= set(found) and len(found) == len(set(found)) and 401 <= len(found) <= most
    assert ngram_join._may_be_in(docs, wanted.limit(0)).count() == 0


class _Task:
    """Stands for a table of one batch; runs a step's task on it and keeps the most memory it takes."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *names):
        return _Task(self.batch.select(names))

    def mapInPandas(self, run, schema):  # noqa: N802
        return self._run(run, self.batch.to_pandas())

    def mapInArrow(self, run, schema):  # noqa: N802
        return self._run(run, self.batch)

    @staticmethod
    def _run(run, batch):
        tracemalloc.start()
        try:
            rows = sum(len(x) for x in run(iter([batch])))
            return rows, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()


def test_tasks_hold_few_sets_at_once(monkeypatch):
    """The sets of a batch of texts are not held together, nor the words of many texts."""
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 1 << 16, raising=False)
    texts = [" ".join(f"w{i * 80 + j}" for j in range(300)) for i in range(2000)]
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": [str(i) for i in range(2000)], "text": texts, "hash": list(range(2000))}
    )
    rows, most = ngram_join._all_items(_Task(batch))
    assert rows == 2000 and most < 2_000_000
    rows, most = ngram_join._signatures(_Task(batch))
    counters = 1 << ngram_join.SKETCH_BITS
    assert rows == 2000 + ngram_join._PARTS and most < 2_000_000 + 3 * counters


def test_sets_do_not_depend_on_slices(monkeypatch):
    texts = [t for _, t in corpus(6)] + ["É é\x0bÀ\x85b C\x1fd", "A b c D", "a b c d", "a b c d e", "x" * 300]
    found = {}
    for size in (1, 100, 1 << 21):
        monkeypatch.setattr(ngram_join, "SLICE_BYTES", size)
        found[size] = [s.tolist() for part in ngram_join.shingle_sets(pa.array(texts)) for s in part]
    assert found[1] == found[100] == found[1 << 21]
    assert [len(s) for s in found[1]] == [len(shingles(t)) for t in texts]
    assert found[1][-4] == found[1][-3]


def test_driver_holds_a_byte_of_each_counter(spark):
    """The classes of the sketch's counters are made by tasks; the driver never holds the counts or numbers made of them."""
    random_ = np.random.default_rng(5)
    width = (1 << ngram_join.SKETCH_BITS) // ngram_join._PARTS
    tasks = random_.integers(0, 4, (2, ngram_join._PARTS, width), dtype=np.uint8)
    tasks[:, 3, :50] = 255
    rows = [(p, tasks[t, p].tobytes(), t) for t in range(2) for p in range(ngram_join._PARTS)]
    sketches = spark.createDataFrame(rows, "part int, counts binary, _task int").repartition(4)
    sums = tasks.astype(np.float64).sum(axis=0).ravel()
    expected = np.floor(np.log2(np.maximum(sums / (2 * sums.mean() + 8), 0.5)) + 1).astype(np.uint8)
    tracemalloc.start()
    try:
        found = ngram_join._ranks(sketches)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.dtype == np.uint8 and (found == expected).all() and expected.max() > 0
    assert most < 24 << 20
    assert not ngram_join._ranks(sketches.limit(0)).any()


def test_places_of_a_block_are_small():
    """Places in the order of a block take four bytes: blocks hold many."""
    sets = ngram_join._in_order([np.array([1, 5, 9], np.uint64), np.array([5], np.uint64)], np.zeros(1 << 22, np.uint8))
    assert [s.tolist() for s in sets] == [[0, 1, 2], [1]] and {s.dtype.itemsize for s in sets} == {4}


def test_items_that_no_other_row_holds(spark):
    """Equal items of any two rows meet, over tasks, batches of rows and shares."""
    random_ = np.random.default_rng(8)
    sizes = [int(x) for x in random_.integers(0, 220, 2 * ngram_join.BATCH_ROWS)]
    items = [np.unique(random_.integers(-(2**62), 2**62, n)).tolist() for n in sizes]
    for i in range(0, len(items), 3):
        items[i] += items[i - 40][: i % 7]
    rows = [(i % 3 << 33 | i, x) for i, x in enumerate(items)]
    held = Counter(item for x in items for item in x)
    expected = {row: n for row, x in rows if (n := sum(held[item] == 1 for item in x))}
    sets = spark.createDataFrame(rows, "row long, items array<long>").repartitionByRange(3, "row").sortWithinPartitions("row")
    found = {r.row: r.alone for r in ngram_join._alone(sets).collect()}
    # Of unlike items a few may be taken for equal, never the other way.
    assert all(n <= expected[row] for row, n in found.items())
    assert sum(expected.values()) - 20 <= sum(found.values())


def test_sets_are_settled_among_many_that_repeat(spark, monkeypatch):
    """What is known of repeated items does not blur as they become many: only sets that may link are read again."""
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 14)
    monkeypatch.setattr(ngram_join, "_FILTER_SHIFT", np.uint64(64 - 14), raising=False)
    kept, plain = {}, ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name, *a: kept.setdefault(name, plain(df, name, *a)))
    pick = random.Random(12)
    texts = [" ".join(f"w{pick.randrange(10**6)}" for _ in range(200)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:300])), "doc_id long, text string")
    assert ngram_join.near_duplicates(docs).select("component_id").distinct().count() == 600
    assert 300 <= kept["suspects"].count() <= 315


def _shuffled(plan):
    """Bytes that the exchanges of a plan that has run have sent."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    own = plan.metrics().apply("dataSize").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_texts_that_stay_are_not_shuffled(spark):
    """One of each group: only texts that go, or come again, are looked up."""
    pick = random.Random(13)
    texts = [" ".join(f"w{pick.randrange(10**6)}" for _ in range(200)) for _ in range(400)]
    rows = [*enumerate(texts), (1000, texts[5]), (1001, texts[6] + " more"), (7, texts[7]), (None, texts[8]), (1002, ""), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.deduplicated(docs)
        found = Counter(tuple(r) for r in kept.collect())
        sent = _shuffled(kept._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == Counter([*enumerate(texts), (1002, ""), (1002, "")])
    assert sent < 0.2 * sum(map(len, texts))
