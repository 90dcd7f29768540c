"""Collocations, benchmark passages and whitening against brute force."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import collocations, decontamination, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, count string, block string, word string, spans string"


def docs(spark, rows):
    """Documents (id, text, lang) with columns whose names clash with those the operators use."""
    return spark.createDataFrame([(*r, "c", "b", "w", "s") for r in rows], DOCS)


# Collocations.


def phrases(rows, min_count, max_words, top, percent=50):
    found, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for size in range(1, max_words + 1):
                found[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in found.items():
        candidates = {p for p, a in f.items() if len(p) > 1 and a >= min_count}
        rows_ = []
        for p in candidates:
            inside = any(
                len(q) > len(p) and 100 * f[q] >= percent * f[p] and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q in candidates
            )
            if not inside:
                score, k = min((1000000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def mined(spark, rows, **settings):
    found = collocations.collocations(docs(spark, rows), **settings).collect()
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found)


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(11)
    names = ["New York", "new york City", "ha ha ha", "émile Zola", "a b c", "x\x00y z", "of the", "in the end"]
    rows = []
    for i in range(150):
        parts = [draw.choice([*names, *"abcdefgh"]) + draw.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!"]) for _ in range(60)]
        rows.append((i, "".join(parts), draw.choice(["en", "en", "fr", None, "und"])))
    return [*rows, (200, None, "en"), (201, "", "xx"), (202, " .,;\t", None), *[(7, "Same Text here again", "de")] * 12]


@pytest.mark.parametrize("length,block_words,merge_entries", [(2, 100, 400), (3, 1000, 10**6), (4, 10**6, 10**6)])
def test_collocations(spark, prose, length, block_words, merge_entries):
    found = mined(spark, prose, min_count=5, max_words=length, top=40, block_words=block_words, merge_entries=merge_entries)
    assert found == phrases(prose, 5, length, 40)
    assert {r[0] for r in found} >= {"en", "fr", "und", "de"}


def test_all_collocations(spark, prose):
    found = mined(spark, prose, min_count=5, top=None)
    assert found == phrases(prose, 5, 3, None)


def test_no_collocations(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, None, None), (2, "", "en"), (3, "once only", "en")]) == []


def test_dense_and_sparse_tiles(monkeypatch):
    draw = np.random.default_rng(5)
    wide = 10**11  # ranks beyond 32 bits
    left = np.concatenate([draw.integers(0, 40, 5000), draw.integers(0, wide, 300), draw.integers(0, 5000, 300), [wide, wide, 3, 3]])
    right = np.concatenate([draw.integers(0, 40, 5000), draw.integers(0, wide, 300), draw.integers(0, 5000, 300), [7, 7, wide, wide]])
    weights = draw.integers(1, 9, len(left))
    for counts in (None, weights):
        expected = Counter()
        for pair, n in zip(zip(left.tolist(), right.tolist(), strict=True), weights if counts is not None else [1] * len(left), strict=True):
            expected[pair] += int(n)
        for share in (300, 10**6):
            monkeypatch.setattr(collocations, "_DENSE_CELLS", 1 << 20 if share == 300 else 16)
            found, tiles = Counter(), []
            for tile, a, b, n in collocations.tiled(left, right, counts, 3):
                assert (collocations.tile_of(a, b, 3) == tile).all()
                found.update(dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)))
                assert (np.diff(a) >= 0).all() and ((np.diff(a) > 0) | (np.diff(b) > 0)).all()
                tiles.append(tile)
            assert found == expected and len(set(tiles)) == len(tiles)


def test_packing_of_numbers():
    for arrays in ([], [np.zeros(0, np.int64)], [np.arange(300), np.array([0, 1 << 40]), np.array([255, 0, 7])]):
        back = collocations.unpack(collocations.pack(*arrays))
        assert [a.tolist() for a in back] == [a.tolist() for a in arrays]


def test_lookup_of_pairs():
    known = (np.array([5, 1, 5, 1 << 40]), np.array([2, 9, 3, 1 << 41]), np.array([7, 8, 9, 10]))
    left, right = np.array([5, 5, 5, 1, -1, 1 << 40, 9]), np.array([2, 3, 9, 9, 2, 1 << 41, 9])
    assert collocations.found_at(left, right, known).tolist() == [7, 9, -1, 8, -1, 10, -1]
    assert collocations.found_at(left, right, (np.zeros(0, int),) * 3).tolist() == [-1] * 7


# Benchmark passages.


def test_tasks_hold_few_arrays_of_pairs():
    """Neither a block nor a merge holds many arrays of the length of its pairs at once; bytes are for each pair of a block."""

    def peak(make):
        tracemalloc.start()
        try:
            pairs = sum(int(counts.sum()) for _, _, _, counts in make())
            return tracemalloc.get_traced_memory()[1], pairs
        finally:
            tracemalloc.stop()

    random_ = np.random.default_rng(8)
    n = 600_000
    for ranks, of_block, of_merge in ((1 << 10, 95, 250), (1 << 20, 75, 250)):
        left, right = random_.integers(0, ranks, n), random_.integers(0, ranks, n)
        packed = [collocations._part("en", 1, 0, *collocations.summed(left, right))["packed"]] * 4
        packed = pa.chunked_array([packed], pa.binary())
        block, pairs = peak(lambda: collocations.tiled(left.copy(), right.copy(), None, 4))  # noqa: B023
        assert pairs == n and block < of_block * n
        merge, pairs = peak(lambda: collocations.tiled(*collocations._opened(packed), 4))  # noqa: B023
        assert pairs == 4 * n and merge < of_merge * n


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def hits(rows, items, window):
    tests = defaultdict(set)
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            tests[tuple(w[i : i + size])].add(name)
    out = []
    for doc, text, _ in rows:
        w, hit, named = words(text), set(), set()
        for size in {len(t) for t in tests}:
            for i in range(len(w) - size + 1):
                if (t := tuple(w[i : i + size])) in tests:
                    hit.update(range(i, i + size))
                    named |= tests[t]
        out.append((doc, len(w), sorted(hit), sorted(str(n) for n in named if n is not None)))
    return sorted(out, key=repr)


def searched(spark, rows, items, **settings):
    bench = spark.createDataFrame([(*i, "n") for i in items], "item_id long, text string, n_words string")
    found = decontamination.find(docs(spark, rows), bench, **settings).collect()
    for r in found:
        ends = [(s["start"], s["end"]) for s in r["spans"]]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False)) and all(a < b for a, b in ends)
    out = [(r["doc_id"], r["n_words"], [p for s in r["spans"] for p in range(s["start"], s["end"])], r["items"]) for r in found]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages():
    draw = random.Random(12)
    vocabulary = [*"abcdefghijkl", "the", "The", "été", "über", "x1", "日本"]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([1, 2, 3, 9, 10, 11, 30, 60])))) for i in range(10, 60)]
    items = [i for i in items if len(words(i[1])) > 1] + [(7, "UNIQUEWORD"), (8, None), (9, "..."), (None, " ".join("qwertyuiopas")), items[0], (99, items[0][1])]
    rows = []
    for i in range(120):
        text = draw.choices(vocabulary, k=draw.choice([0, 1, 5, 20, 200, 700]))
        for _ in range(draw.choice([0, 0, 1, 3])):
            part = words(draw.choice(items)[1])
            begin = draw.randrange(len(part) + 1)
            text += part[begin:]
        rows.append((i, draw.choice([" ", " - ", ".\n"]).join(text), "en"))
    rows += [(500, None, "en"), (501, "", None), (502, "uniqueword", "en"), (502, "uniqueword", "en"), (None, "q w e r t y u i o p a s", "en")]
    rows += [(503, "UNIQUE", "en"), (504, "WORD", "en"), (505, "a" * 70000 + " " + "uniqueword " * 3000, "en")]
    return rows, items


@pytest.mark.parametrize("settings", [{}, {"window": 3}, {"block_chars": 600}])
def test_passages(spark, passages, settings):
    rows, items = passages
    found = searched(spark, rows, items, **settings)
    assert found == hits(rows, items, settings.get("window", 10))
    assert sum(bool(r[2]) for r in found) > 20


def test_passages_of_nothing(spark):
    rows = [(1, "a b c", "en"), (2, None, "en")]
    assert searched(spark, rows, []) == [(1, 3, [], []), (2, 0, [], [])]
    assert searched(spark, rows, [(1, None), (2, "!")]) == [(1, 3, [], []), (2, 0, [], [])]
    assert searched(spark, [], [(1, "a b c")]) == []


# Whitening.

VECTORS = "vec_id long, embedding array<float>, component string, n string"


def whiten(spark, rows, **settings):
    return whitening.whitened(spark.createDataFrame([(*r, "c", "n") for r in rows], VECTORS), **settings).collect()


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def check_whitened(found, rows, components):
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if usable(v)]
    x = np.floor(64 * np.array([v for _, v in kept])).astype(np.int64) + 1000000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(components, int((values > 1e-12 * values[0]).sum()))
    by_id = defaultdict(dict)
    for r in found:
        by_id[r["vec_id"]][r["component"]] = r
    assert by_id.keys() == {i for i, _ in kept}
    expected = centred @ axes[:, :count] / np.sqrt(values[:count])
    signs = None
    for k, (i, _) in enumerate(kept):
        assert sorted(by_id[i]) == list(range(1, count + 1))
        got = np.array([by_id[i][c]["whitened"] for c in range(1, count + 1)])
        signs = np.sign(got * expected[k]) if signs is None else signs
        assert np.allclose(got * signs, expected[k], rtol=0, atol=1e-8)
        first = by_id[i][1]
        assert first["n"] == n and first["deviation"] == sum(int(d) ** 2 for d in n * x[k].astype(object) - sums)
        shares = [by_id[i][c]["explained"] for c in range(1, count + 1)]
        assert np.allclose(shares, values[:count] / values.sum(), rtol=1e-10)
        assert first["identity_error"] < 1e-9


def test_whitening(spark):
    draw = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(400, 40)) * np.linspace(0.1, 3, 40))]
    rows += [(1000, None), (1001, [float("nan")] * 40), (1002, [None] * 40), (1003, [float("inf")] + [0.0] * 39), (1004, [])]
    check_whitened(whiten(spark, rows), rows, 32)


def test_whitening_of_few_dimensions_and_large_numbers(spark):
    rows = [(i, [float(i % 7), float(i % 3) * 1e6]) for i in range(50)]
    check_whitened(whiten(spark, rows), rows, 32)
    # A column that is a sum of others has no component of its own.
    rows = [(i, [float(i % 7), float(i % 5), float(i % 7 + i % 5)]) for i in range(70)]
    found = whiten(spark, rows)
    assert max(r["component"] for r in found) == 2 and len(found) == 140
    assert all(r["identity_error"] < 1e-9 for r in found)


def test_whitening_without_variance_or_rows(spark):
    assert whiten(spark, []) == []
    assert whiten(spark, [(1, None), (2, [])]) == []
    assert whiten(spark, [(1, [1.0, 2.0])] * 5) == []


def test_whitening_by_length_and_beyond_64_bits(spark):
    rows = [(i, [float(i), float(i * i % 11)]) for i in range(20)] + [(100 + i, [float(i % 4) * 1e15]) for i in range(9)]
    found = whiten(spark, rows)
    check_whitened([r for r in found if r["vec_id"] < 100], rows[:20], 32)
    check_whitened([r for r in found if r["vec_id"] >= 100], rows[20:], 32)
    assert whiten(spark, [(1, [3e38]), (2, [1.0]), (3, [2.0])])[0]["n"] == 2


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1.0, 41), np.r_[np.ones(20), np.full(20, 2.0)], 1 + 1e-9 * np.arange(40), 1 + 1e-13 * np.arange(40),
        10.0 ** -np.arange(0, 10, 0.25), np.r_[1e9, 1e9 + 1, np.arange(38.0)], np.r_[np.ones(39) * 1e-30, 3e-30],
    ],
)
def test_eigenvectors(values):
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(40, 40)))[0]
    matrix = q @ np.diag(values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, axes = whitening.eigen(matrix)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-13 * values.max()
    assert np.abs(axes.T @ axes - np.eye(40)).max() < 1e-13
    assert np.abs(matrix @ axes - axes * found).max() < 1e-13 * values.max()
