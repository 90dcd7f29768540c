"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a sequence of tokens: its words (ASCII letters lower-cased) and one end.  A token is coded by binary
decisions: first, where an earlier token of the text followed the same token, whether it comes again; if not, the
``CODE_BITS`` bits of a hash of the token, its cell; last, which token of the cell it is, by the exact counts of
training tokens in the cell (an unknown token shares one more count).  Each bit has several predictors:
counts over all training tokens, counts after the token before and after the two tokens before, and
counts of the text itself so far.  Their logits are mixed by weights chosen by a gate (the place of the bit
and how often the longest context was seen), and the mix is refined by a map from mixed to observed probability.
Weights, map and text counts adapt as the text goes on, after every ``CHUNK`` tokens, and start again for each
text, so a score does not depend on other texts scored with it.

Learning is counting and is spread over the cluster.  Exact counts of tokens are grouped by token and sent back
only to the blocks of documents that use them.  Counts of (context, cell) are grouped by ranges of the context's hash:
each block sends the pairs it has, sorted and packed, and gets back the totals of these pairs and of the
prefixes of their cells.  The hash has as many bits as the number of tokens asks for, so the counts grow with the
corpus and contexts hardly share any; a range is held by one task and has about ``RANGE_PAIRS`` pairs, of a
very common context at most one pair per cell and block.  Totals from 16 on go back rounded to quarters of a power
of two, one byte each.  Words take the same way, by 96 bits of their hash.

``score`` uses the counts of all training documents, a training document's own included.  ``bits_per_byte`` is told
by the same mixer with each event of a training document left out of the counts of its contexts and of its word, so texts
that were learnt from and texts that were not can be compared: low values are texts that the rest of the corpus holds, too.
The mixer learns from the errors of the second, which are those of a new text.

Defined results: null and empty texts are one end; null ids count as training; repeated rows are counted and
scored one by one; without training tokens all counts are zero and scores are still defined; an empty table gives an
empty table; texts of any length are scored whole; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import written

CODE_BITS = 6
CELLS = 1 << CODE_BITS
#: The token before, and the two tokens before.
CONTEXTS = 2
BLOCK_TOKENS, STEP_TOKENS, CHUNK = 2_000_000, 100_000, 64
#: Pairs of a context and a cell in a range, about; bits of a context's hash beyond those of the number of tokens.
RANGE_PAIRS, SPARE_BITS = 2_000_000, 6
#: Most partitions that blocks are dealt to; a partition holds one block after the other.
MOST_PARTITIONS = 10_000
#: Confidence classes of the longest context, inputs of the mixer, buckets of the map, classes of matches.
CLASSES, INPUTS, BUCKETS, MATCHES = 4, 4, 16, 3
GATES = CODE_BITS * CLASSES
RATE, MAP_RATE = 0.004, 0.02
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_OLDER = np.uint64(0xC2B2AE3D27D4EB4F)
_TEXT = np.uint64(0xD6E8FEB86659FD93)
#: Weights of the logits before a text begins: all tokens, one token before, two before, the text; a row per class.
START = ((0.1, 0.8, 0.0, 0.3), (0.0, 0.2, 0.8, 0.2), (0.0, 0.1, 0.9, 0.2), (0.0, 0.0, 1.0, 0.2))
#: Rates of matches before a text begins: first chance, after a miss, after a match.
MATCH_RATES = (0.2, 0.1, 0.6)


class _Vocabulary(dict):
    """Word -> number in order of appearance; the end of a text is the empty word, number 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


# --------------------------------------------------------------------------
# Blocks of coded documents
# --------------------------------------------------------------------------

_CODED = "block long, docs array<string>, held array<int>, lengths array<int>, bytes array<int>, tokens binary, h1 array<long>"
_BLOCK = f"{_CODED}, h2 array<int>, n array<long>"


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on as planes of bytes, as many as the largest needs; high planes hold little and compress well."""
    wide = np.ascontiguousarray(numbers, dtype="<u8")
    width = max(1, (int(wide.max(initial=0)).bit_length() + 7) // 8)
    planes = wide.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def _unpacked(raw: bytes, dtype=np.int64) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw[1:]), dtype=np.uint8).reshape(raw[0], -1)
    out = planes[0].astype(dtype)
    for i in range(1, raw[0]):
        out += planes[i].astype(dtype) * dtype(1 << 8 * i)
    return out


#: Totals as they are sent: exact below 16, then four steps to each power of two.
_STEPS = np.concatenate([np.arange(16), 16 * 2 ** (np.arange(240) / 4)]).astype(np.float32)


def _rounded(totals: np.ndarray) -> np.ndarray:
    """Places of totals in ``_STEPS``."""
    steps = 16 + np.rint(4 * (np.log2(np.maximum(totals, 16).astype(np.float32)) - 4))
    return np.where(totals < 16, totals, steps).astype(np.uint8)


def _coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per block of documents: their tokens as numbers, and hash and training count of each word."""
    block = TaskContext.get().partitionId() << 32
    words = _Vocabulary()
    words[b""]
    docs: list[tuple] = []
    ids: list[np.ndarray] = []
    held = 0

    def flushed() -> pd.DataFrame:
        tokens = np.concatenate(ids)
        lengths = np.array([len(x) for x in ids])
        train = np.repeat([not d[1] for d in docs], lengths)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype="V16")
        halves = digests.view([("h1", "<i8"), ("h2", "<i4"), ("", "V4")])
        # Frequent words get small numbers.
        order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        number = np.empty(len(words), dtype=np.int64)
        number[order] = np.arange(len(words))
        tokens = number[tokens]
        row = {
            "block": block,
            "docs": [d[0] for d in docs],
            "held": [int(d[1]) for d in docs],
            "lengths": lengths.tolist(),
            "bytes": [d[2] for d in docs],
            "tokens": _packed(tokens),
            "h1": halves["h1"][order],
            "h2": halves["h2"][order],
            "n": np.bincount(tokens[train], minlength=len(words)),
        }
        return pd.DataFrame([row])

    for batch in batches:
        for doc, out, text in zip(batch["doc_id"], batch["held"], batch["text"], strict=True):
            raw = (text or "").encode()
            split = raw.lower().split()
            split.append(b"")
            ids.append(np.fromiter(map(words.__getitem__, split), dtype=np.int32, count=len(split)))
            docs.append((doc if isinstance(doc, str) else None, bool(out), len(raw)))
            held += len(split)
            if held >= BLOCK_TOKENS:
                yield flushed()
                block, docs, ids, held = block + 1, [], [], 0
                words = _Vocabulary()
                words[b""]
    if docs:
        yield flushed()


# --------------------------------------------------------------------------
# Decisions
# --------------------------------------------------------------------------


class _Block:
    """Tokens of a block: what each text expects at each place, and the (context, cell) pairs of unexpected tokens."""

    def __init__(self, row, bits: int):
        self.held = np.asarray(row.held, dtype=bool)
        self.lengths = np.asarray(row.lengths, dtype=np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.lengths)])
        self.tokens = _unpacked(row.tokens, np.int32)
        hashes = np.asarray(row.h1, dtype=np.int64).view(np.uint64)
        self.cells = (hashes >> np.uint64(64 - CODE_BITS)).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        starts = self.ends[:-1]
        before = np.ones(len(self.tokens), dtype=np.uint64)
        before[1:] = hashes[self.tokens[:-1]]
        before[starts] = 1
        self._expect(before)
        self.cell = self.cells.astype(np.int8)[self.tokens]
        self.coded = np.flatnonzero(~self.matched).astype(np.int32)
        near = (before[self.coded] + np.uint64(CONTEXTS)) * _FACTOR
        # Two tokens before: what was before the token before.
        before[1:] = before[:-1]
        before[starts] = 2
        far = ((before[self.coded] * _OLDER) ^ near) * _FACTOR
        del before
        cell = self.cell[self.coded]
        self.pairs = [((c >> np.uint64(64 - bits)).astype(np.int64) << CODE_BITS) | cell for c in (near, far)]

    def _expect(self, before: np.ndarray) -> None:
        """What followed the same token last time in the text, whether it came, and how well that worked before."""
        key = before * _FACTOR + self.doc.astype(np.uint64) * _TEXT
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        later, earlier = order[1:][same], order[:-1][same]
        self.expected = np.zeros(len(key), dtype=bool)
        self.expected[later] = True
        self.matched = np.zeros(len(key), dtype=bool)
        self.matched[later] = self.tokens[later] == self.tokens[earlier]
        self.trust = np.zeros(len(key), dtype=np.int8)
        self.trust[later] = np.where(self.expected[earlier], 1 + self.matched[earlier], 0)

    def match_scores(self) -> np.ndarray:
        """Log10 probability of the match decisions of each text, by its own counts so far and a rate per class."""
        score = np.zeros(len(self.lengths))
        for trust, rate in enumerate(MATCH_RATES):
            at = np.flatnonzero(self.expected & (self.trust == trust))
            doc, hit = self.doc[at], self.matched[at]
            first = np.searchsorted(doc, doc)
            sums = np.concatenate([[0], np.cumsum(hit)])
            hits, times = sums[:-1] - sums[first], np.arange(len(at)) - first
            p = (hits + 4 * rate) / (times + 4)
            score += np.bincount(doc, np.log10(np.where(hit, p, 1 - p)), len(score))
        return score


def _steps(lengths: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``size`` tokens; documents are never cut."""
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths):
        yield start, len(lengths)


def _paths() -> tuple[np.ndarray, np.ndarray]:
    """Node before each bit of every cell, and the bit."""
    cell, place = np.arange(CELLS)[:, None], np.arange(CODE_BITS)
    return (1 << place) | cell >> (CODE_BITS - place), cell >> (CODE_BITS - 1 - place) & 1


_NODES, _BITS = _paths()
_SPOTS = (2 * _NODES + _BITS).astype(np.int32)
_ONES = _BITS.astype(bool)


def prefix_totals(counts: np.ndarray) -> np.ndarray:
    """Counts of all cells that share the first 0, 1, .. bits with each cell, in one row per cell."""
    cell = np.arange(CELLS)
    columns = []
    for place in range(CODE_BITS + 1):
        prefix = cell >> (CODE_BITS - place)
        columns.append(np.bincount(prefix, counts)[prefix])
    return np.stack(columns, axis=1).astype(np.float32)


# --------------------------------------------------------------------------
# Counts of contexts
# --------------------------------------------------------------------------

_PAIRS = "block long, kind int, part int, pairs binary, more binary, n binary"
_TOTALS = "block long, kind int, part int, totals array<binary>, sums array<long>"
_WORDS = CONTEXTS


def _ranges(block: int, kind: int, part: np.ndarray, pairs: np.ndarray, more: np.ndarray | None, n: np.ndarray) -> pd.DataFrame:
    """Rows of a block, in the order of their pairs, cut by range."""
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    slices = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pd.DataFrame(
        {
            "block": block,
            "kind": kind,
            "part": part[cuts[:-1]].astype(np.int64),
            "pairs": [_packed(np.diff(pairs[x], prepend=pairs.dtype.type(0))) for x in slices],
            "more": [None if more is None else _packed(more[x]) for x in slices],
            "n": [_packed(n[x]) for x in slices],
        }
    )


def _sent(batches: Iterator[pd.DataFrame], bits: int, part_bits: int) -> Iterator[pd.DataFrame]:
    """The distinct (context, cell) pairs of a block, and how often training documents have them, by ranges."""
    shift = bits + CODE_BITS - part_bits
    for batch in batches:
        for row in batch.itertuples():
            block = _Block(row, bits)
            train = (~block.held[block.doc[block.coded]]).astype(np.int64)
            for kind, pairs in enumerate(block.pairs):
                both = np.sort(pairs << 1 | train)
                pair = both >> 1
                first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
                n = np.add.reduceat(both & 1, first)
                pair = pair[first]
                yield _ranges(row.block, kind, pair >> shift, pair, None, n)


def _sent_words(batches: Iterator[pd.DataFrame], part_bits: int) -> Iterator[pd.DataFrame]:
    """The words of a block by their hashes, and how often training documents have them, by ranges."""
    for batch in batches:
        for row in batch.itertuples():
            hashes = np.asarray(row.h1, dtype=np.int64).view(np.uint64)
            order = np.argsort(hashes, kind="stable")
            more = np.asarray(row.h2, dtype=np.int32).view(np.uint32)[order]
            hashes, n = hashes[order], np.asarray(row.n, dtype=np.int64)[order]
            yield _ranges(row.block, _WORDS, hashes >> np.uint64(64 - part_bits), hashes, more, n)


def _word_totals(rows: pd.DataFrame) -> pd.DataFrame:
    """For each word sent, its count in all training documents; in the first row, tokens and types by cell."""
    hashes = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in rows["pairs"]]
    ends = np.cumsum([len(x) for x in hashes])
    all_, more = np.concatenate(hashes), np.concatenate([_unpacked(x) for x in rows["more"]])
    n = np.concatenate([_unpacked(x) for x in rows["n"]])
    order = np.lexsort((more, all_))
    all_, more = all_[order], more[order]
    first = np.concatenate([[True], (all_[1:] != all_[:-1]) | (more[1:] != more[:-1])])
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(first) - 1
    total = np.add.reduceat(n[order], np.flatnonzero(first))
    cell = (all_[first] >> np.uint64(64 - CODE_BITS)).astype(np.int64)
    tokens, types = np.zeros(CELLS, dtype=np.int64), np.bincount(cell[total > 0], minlength=CELLS)
    np.add.at(tokens, cell, total)
    sums = [np.concatenate([tokens, types])] + [None] * (len(rows) - 1)
    totals = [[_packed(x)] for x in np.split(total[place], ends[:-1])]
    return rows[["block", "kind", "part"]].assign(totals=totals, sums=sums)


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    """For each pair sent, its total, then at each bit, from the last one, the total of cells that part there."""
    pairs = [np.cumsum(_unpacked(x)) for x in rows["pairs"]]
    ends = np.cumsum([len(x) for x in pairs])
    pair, n = np.concatenate(pairs), np.concatenate([_unpacked(x) for x in rows["n"]])
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.concatenate([[True], pair[1:] != pair[:-1]])
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(first) - 1
    pair, total = pair[first], np.add.reduceat(n[order], np.flatnonzero(first))
    columns, held = [total], total
    for bit in range(1, CODE_BITS + 1):
        prefix = pair >> bit
        starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        sums = np.repeat(np.add.reduceat(total, starts), np.diff(starts, append=len(prefix)))
        columns.append(sums - held)
        held = sums
    split = [np.split(_rounded(c)[place], ends[:-1]) for c in columns]
    return rows[["block", "kind", "part"]].assign(totals=[[zlib.compress(c[i].tobytes(), 1) for c in split] for i in range(len(rows))], sums=None)


# --------------------------------------------------------------------------
# Mixing
# --------------------------------------------------------------------------


_LOW, _HIGH = np.float32(1e-6), np.float32(1 - 1e-6)


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


_DECAY = ((1 - MAP_RATE) ** np.arange(4096)).astype(np.float32)


def _map() -> np.ndarray:
    """The map before a text begins, the identity: the favoured value's probability by place and bucket."""
    return np.tile((1 / (1 + np.exp(-(np.arange(BUCKETS) + 0.5) / 1.5))).astype(np.float32), CODE_BITS)


def mixed(cell, lane, chunk, totals, root, own):
    """Log10 probability of the cells of each lane, with all counts and with ``own`` taken from those of the contexts.

    Rows are tokens; lanes are texts, each with a row at least.  ``totals`` has, per context, rows of counts that share
    0, 1, .. bits with the token's cell.  All inputs change sign with the bit, so everything is written for the
    bit that came.
    """
    lanes = int(lane.max(initial=-1)) + 1
    order = np.argsort(chunk * lanes + lane, kind="stable")
    cell, lane, chunk = cell[order], lane[order], chunk[order]
    less = own[order].astype(np.float32)[:, None]
    share = root[cell]
    base = (share[:, 1:] + np.float32(0.4)) / (share[:, :-1] + np.float32(0.8))
    inputs, more = [_logit(base)], []
    p, full = base, base
    for context in totals:
        counts = context[order]
        # Few counts lean on the shorter context.
        full = np.clip((counts[:, 1:] + 2 * full) / (counts[:, :-1] + 2), _LOW, _HIGH)
        counts -= less
        p = np.clip((counts[:, 1:] + 2 * p) / (counts[:, :-1] + 2), _LOW, _HIGH)
        inputs.append(_logit(p))
        more.append(_logit(full) - inputs[-1])
    seen = counts[:, :-1]
    gate = np.arange(CODE_BITS) * CLASSES + (seen > 0) + (seen > 2) + (seen > 15)
    weight = [np.tile(np.tile(np.array([x[i] for x in START], dtype=np.float32), CODE_BITS), lanes) for i in range(INPUTS)]
    map_ = np.tile(_map(), lanes)
    text = np.zeros(lanes * 2 * CELLS, dtype=np.float32)
    score, left = np.zeros(lanes), np.zeros(lanes)
    bounds = np.searchsorted(chunk, np.arange(int(chunk.max(initial=-1)) + 2))
    row_of = lane[:, None] * GATES + gate
    map_of = (lane[:, None] * CODE_BITS + np.arange(CODE_BITS)) * BUCKETS
    text_of = lane[:, None] * (2 * CELLS) + _SPOTS[cell]
    lean, ones, owned = 4 * base, _ONES[cell], own.any()

    def refined(logit: np.ndarray, now: slice) -> tuple[np.ndarray, ...]:
        q = 1 / (1 + np.exp(-logit))
        spot = map_of[now] + np.minimum((np.abs(logit) * np.float32(1.5)).astype(np.int64), BUCKETS - 1)
        favoured = (logit > 0) | (logit == 0) & ones[now]
        value = map_.take(spot)
        final = np.clip((q + np.where(favoured, value, 1 - value)) / 2, _LOW, _HIGH)
        return q, spot, favoured, np.log10(final).sum(axis=1)

    for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
        if start == stop:
            continue
        now = slice(start, stop)
        active = int(lane[now].max()) + 1
        at, row = text_of[now], row_of[now]
        hits = text.take(at)
        local = (hits + lean[now]) / (hits + text.take(at ^ 1) + 4)
        x = [*(i[now] for i in inputs), _logit(np.clip(local, _LOW, _HIGH))]
        w = [i.take(row) for i in weight]
        logit = w[0] * x[0] + w[1] * x[1] + w[2] * x[2] + w[3] * x[3]
        q, spot, favoured, found = refined(np.clip(logit, -12, 12), now)
        left[:active] += np.bincount(lane[now], found, active)
        if owned:
            found = refined(np.clip(logit + w[1] * more[0][now] + w[2] * more[1][now], -12, 12), now)[3]
        score[:active] += np.bincount(lane[now], found, active)
        # Learn from the chunk: weights by the gradient, the map and the text's counts by what came.
        miss = 1 - q
        flat, size = row.ravel(), active * GATES
        for i in range(INPUTS):
            weight[i][:size] += np.clip(RATE * np.bincount(flat, (miss * x[i]).ravel(), size), -0.2, 0.2)
        size = active * CODE_BITS * BUCKETS
        missed, hit = np.bincount((2 * spot + favoured).ravel(), minlength=2 * size).reshape(-1, 2).T
        times = missed + hit
        came = np.flatnonzero(times)
        times, hit = times[came], hit[came]
        map_[came] += (1 - _DECAY[np.minimum(times, len(_DECAY) - 1)]) * (hit / times - map_[came])
        text[: active * 2 * CELLS] += np.bincount(at.ravel(), minlength=active * 2 * CELLS)
    return score, left


def _scores(block: _Block, near: list[bytes], far: list[bytes], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log10 probability of the cells of each text, with all counts and with own events left out."""
    columns, index = [], []
    for kind, packed in enumerate((near, far)):
        # Rows of totals that share 0, 1, .. bits, per distinct pair of the block.
        parts = [b"".join(map(zlib.decompress, packed[i :: CODE_BITS + 1])) for i in range(CODE_BITS + 1)]
        rows = np.empty((len(parts[0]), CODE_BITS + 1), dtype=np.float32)
        total = np.zeros(len(parts[0]), dtype=np.float32)
        for i, part in enumerate(parts):
            total += _STEPS[np.frombuffer(part, dtype=np.uint8)]
            rows[:, CODE_BITS - i] = total
        columns.append(rows)
        order = np.argsort(block.pairs[kind])
        pair = block.pairs[kind][order]
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.cumsum(np.concatenate([[False], pair[1:] != pair[:-1]]))
        index.append(place)
    score, left = np.zeros(len(block.lengths)), np.zeros(len(block.lengths))
    by_length = np.argsort(-block.lengths, kind="stable")
    # Coded tokens of each document are a range.
    cuts = np.searchsorted(block.coded, block.ends)
    for start, stop in _steps(block.lengths[by_length], STEP_TOKENS):
        docs = by_length[start:stop]
        many = cuts[docs + 1] - cuts[docs]
        lane = np.repeat(np.arange(len(docs)), many)
        at = np.arange(len(lane)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(cuts[docs], many)
        token = block.coded[at]
        chunk = (token - block.ends[docs][lane]) // CHUNK
        totals = [c[i[at]] for c, i in zip(columns, index, strict=True)]
        # Every text has a coded token, its end.
        score[docs], left[docs] = mixed(block.cell[token].astype(np.int64), lane, chunk, totals, root, ~block.held[docs][lane])
    return score, left


# --------------------------------------------------------------------------
# Scores
# --------------------------------------------------------------------------


def held_out(id_column: str | Column) -> Column:
    """Documents that are not learnt from: one in seven by id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


_SCORES = (
    "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double, left double, n_bytes long"
)


def _scored(blocks: pd.DataFrame, extra: pd.DataFrame, bits: int, held_cells: np.ndarray, types_of: np.ndarray) -> pd.DataFrame:
    """Scores of a block, given the counts of its words and the totals of its pairs."""
    if blocks.empty:
        return pd.DataFrame({x.split()[0]: [] for x in _SCORES.split(", ")})
    (row,) = blocks.itertuples()
    block = _Block(row, bits)
    extra = extra.sort_values("part")
    words, near, far = ([x for row in extra["totals"][extra["kind"] == kind] for x in row] for kind in (_WORDS, 0, 1))
    count = np.empty(len(block.cells), dtype=np.int64)
    count[np.argsort(np.asarray(row.h1, dtype=np.int64).view(np.uint64), kind="stable")] = np.concatenate([_unpacked(x) for x in words])
    n = len(block.lengths)
    cells = held_cells + types_of + 1
    base = np.log10((count + 1) / (held_cells.sum() + types_of.sum() + 1))
    rest = np.log10((count + 1) / cells[block.cells])
    score, left = _scores(block, near, far, prefix_totals(held_cells))
    token, doc = block.tokens[block.coded], block.doc[block.coded]
    own = ~block.held[doc]
    # Without its own event a word may be unknown.
    apart = np.log10((count[token] - own + 1) / (cells[block.cells[token]] - own))
    match = block.match_scores()
    return pd.DataFrame(
        {
            "doc_id": row.docs,
            "held_out": block.held,
            "n_tokens": block.lengths,
            "n_known": np.bincount(block.doc, count[block.tokens] > 0, n).astype(np.int64),
            "base_score": np.bincount(block.doc, base[block.tokens], n),
            "score": score + match + np.bincount(doc, rest[token], n),
            "left": left + match + np.bincount(doc, apart, n),
            "n_bytes": np.asarray(row.bytes, dtype=np.int64),
        }
    )


def scored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every document."""
    named = docs.select(
        F.col(id_column).cast("string").alias("doc_id"), held_out(id_column).alias("held"), F.col(text_column).alias("text")
    )
    blocks = written(named.mapInPandas(_coded, _BLOCK), "blocks")
    coded = blocks.drop("h2", "n")
    tokens = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    size = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")).first()
    bits = min(50, int(size["tokens"]).bit_length() + SPARE_BITS)
    part_bits = max(4, int(size["tokens"] // RANGE_PAIRS).bit_length())

    words = blocks.select("block", "h1", "h2", "n").mapInPandas(lambda batches: _sent_words(batches, part_bits), _PAIRS)
    words = written(words.groupBy("part").applyInPandas(_word_totals, _TOTALS), "words")
    cells = words.select(F.posexplode("sums").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n"))
    sums = np.zeros(2 * CELLS, dtype=np.int64)
    for row in cells.collect():  # training tokens, and types, of each cell
        sums[row["place"]] = row["n"]
    held_cells, types_of = np.split(sums, 2)

    sent = coded.mapInPandas(lambda batches: _sent(batches, bits, part_bits), _PAIRS)
    totals = sent.groupBy("kind", "part").applyInPandas(_totals, _TOTALS)
    extra = words.unionByName(totals).drop("sums")
    partitions = max(1, min(2 * size["blocks"], MOST_PARTITIONS))
    found = (
        coded.repartition(partitions, "block")
        .groupBy("block")
        .cogroup(extra.repartition(partitions, "block").groupBy("block"))
        .applyInPandas(lambda a, b: _scored(a, b, bits, held_cells, types_of), _SCORES)
    )
    bits_per_byte = F.when(F.col("n_bytes") > 0, -F.col("left") / F.lit(float(np.log10(2))) / F.col("n_bytes"))
    return found.select(
        F.col("doc_id").cast(docs.schema[id_column].dataType).alias("doc_id"),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(held_cells.sum())).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        bits_per_byte.alias("bits_per_byte"),
    )
