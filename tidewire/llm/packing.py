"""Best-fit packing of token sequences with certified bin counts.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt to groups of bounded
size; every group packs its pieces by best-fit decreasing and computes a lower bound on its
number of bins from dual-feasible functions.  Groups keep their filled bins.  Groups with a gap
release the documents of their unfilled bins, which are exchanged: dealt to new groups, packed
and bounded again.  Rounds end when the total meets the lower bound of the whole input (taken
from its histogram of lengths, which has ``capacity`` rows at most), when one group held all that
was released, when a round saved nothing (then the round before it stands), or after ``ROUNDS``.
The last round that stands keeps its unfilled bins too, so every piece is placed.

Defined results: a null text is the empty text; an empty text is one piece that holds only the
end id; repeated rows are packed once each; a null id is carried through; an empty table gives
no pieces; texts of any length are cut into pieces of ``capacity`` ids, the last one shorter.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, compress
from operator import not_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import byte_words
from tidewire.session import written

CAPACITY = 4096
END_ID = 1
#: Pieces that one group packs, on average.
GROUP_ROWS = 4096
#: Rounds of exchange at most; later ones would only save bins.
ROUNDS = 16
#: Words and runs whose ids a worker keeps at hand.
CACHED_WORDS, CACHED_RUNS = 2_000_000, 600_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _row long"
_PLACED = f"{PIECES.replace('doc_id long', 'doc_id string')}, _bin long, _fill long, _offset long, _bins long, _bound long"


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit bytes, from ids of words kept at hand.

    The tokenizer treats white space only as a boundary and lower-cases character by character, so
    the ids of a text are those of its words in turn, and those of a Latin word are those of its
    letter, digit and symbol runs.  Other words go to the tokenizer whole.  New runs go to the
    tokenizer many at a time; the last id of each run is one that ends a word.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self._of_run: dict[str, bytes] = {}
        # Known words and their ids.
        self._words = self._ids = pa.array([], pa.large_binary())

    def _encoded(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_runs(self, runs: list[str]) -> None:
        at = 0
        # What the tokenizer tells of a token takes far more memory than its id, so it gets some lines at a time.
        for begin in range(0, len(runs), 500 * _LINES):
            end = min(len(runs), begin + 500 * _LINES)
            lines = [" ".join(runs[i : i + 500]) for i in range(begin, end, 500)]
            for line in self._tokenizer.encode_batch_fast(lines, add_special_tokens=False):
                ids = np.array(line.ids, dtype="<u4")
                stops = ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()
                raw = ids.tobytes()
                self._of_run.update(zip(runs[at : at + 500], map(raw.__getitem__, map(slice, [0, *stops], stops)), strict=False))
                at += 500

    def _learnt(self, words: list[str]) -> list[bytes]:
        """Ids of new words."""
        of_word: dict[str, bytes] = {}
        whole = [w for w in words if len(w) > 256 or not (w.isascii() or max(w) < "\u0250") or "<|" in w]
        for word in whole:
            of_word[word] = self._encoded(word)
        latin = [w for w in words if w not in of_word] if whole else words
        low = list(map(str.lower, latin))
        plain = list(map(str.isalpha, low))
        other = list(map(not_, plain))
        single = list(compress(low, plain))
        split = self._split
        # Most of them are letters and one mark.
        parts = [(w[:-1], w[-1]) if w[-1] in _MARKS and w[:-1].isalpha() else split(w) for w in compress(low, other)]
        runs = set(single)
        runs.update(chain.from_iterable(parts))
        fresh = list(runs.difference(self._of_run))
        if len(self._of_run) + len(fresh) > CACHED_RUNS:
            self._of_run.clear()
            fresh = list(runs)
        self._learn_runs(fresh)
        known = self._of_run.__getitem__
        of_word.update(zip(compress(latin, plain), map(known, single), strict=True))
        joined = (known(x[0]) + known(x[1]) if len(x) == 2 else b"".join(map(known, x)) for x in parts)
        of_word.update(zip(compress(latin, other), joined, strict=True))
        return list(map(of_word.__getitem__, words))

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words; new words become known."""
        places = pc.index_in(words, value_set=self._words)
        missing = places.is_null()
        new = words.filter(missing)
        if not len(new):
            return self._ids.take(places)
        if len(self._words) + len(new) > CACHED_WORDS and len(self._words):
            self._words, self._ids = self._words[:0], self._ids[:0]
            return self._ids_of(words)
        shares = (new[i : i + _NEW_WORDS] for i in range(0, len(new), _NEW_WORDS))
        found = [pa.array(self._learnt(x.cast(pa.large_string()).to_pylist()), pa.large_binary()) for x in shares]
        out = places.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out[missing.to_numpy(zero_copy_only=False)] = len(self._words) + np.arange(len(new))
        self._ids = pa.concat_arrays([self._ids, *found])
        self._words = pa.concat_arrays([self._words, new])
        return self._ids.take(pa.array(out))

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text; each distinct word of a slice of texts is looked up once."""
        for begin, end, data, bounds in byte_words.slices(texts, _SLICE_BYTES):
            found = byte_words.words(data, bounds, _WORD_BYTES, lower_case=False)
            coded = found.array.dictionary_encode()
            at = np.searchsorted(found.row, np.arange(end - begin + 1))
            del found
            # The ids of all words, one after the other.
            raw = self._ids_of(coded.dictionary).take(coded.indices)
            del coded
            _, after, ids = raw.buffers()
            bounds = np.frombuffer(after, np.int64, len(raw) + 1, raw.offset * 8)[at].tolist()
            ids = memoryview(ids) if ids is not None else b""
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                yield bytes(ids[start:stop])
            del raw, after, ids
            byte_words.freed()


#: New words that are learnt together, and lines of runs that the tokenizer gets together.
_NEW_WORDS, _LINES = 50_000, 40
#: Marks that are runs of their own behind letters.
_MARKS = frozenset(".,;:!?")
#: Texts whose words are looked up together.
_SLICE_BYTES = 6 << 20
#: Words end at these bytes; other white space stays in them and is left to the tokenizer.
_WORD_BYTES = ~byte_words.byte_class((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x20))
#: Tokenizer file -> what this worker has learnt; workers are used for many tasks.
_LEARNT: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _LEARNT:
        _LEARNT[path] = WordIds(path)
    return _LEARNT[path]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of every document: place, length and checksum, with ``ids`` if ``keep_ids``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_ids(tokenizer)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), known.ids(batch.column(1)), strict=True):
                ids = raw + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    values = (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), row)
                    rows.append((*values, np.frombuffer(part, "<u4").astype("i4")) if keep_ids else values)
                    row += 1
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.int32())] * keep_ids]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _names(keep_ids))

    chosen = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    cut_up = chosen.mapInArrow(cut, PIECES.replace("doc_id long", "doc_id string") + (", ids array<int>" if keep_ids else ""))
    return cut_up.withColumn("doc_id", F.col("doc_id").cast("long"))


def _names(keep_ids: bool) -> list[str]:
    return [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins needed at least for ``counts[x]`` items of each size x, from two families of dual-feasible functions."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    number, volume = np.cumsum(counts), np.cumsum(counts * sizes)
    # Items above capacity - t count whole, items below t not at all, for every t up to half.
    t = np.arange(0, capacity // 2 + 1)
    whole = number[-1] - number[capacity - t]
    below = np.where(t > 0, volume[np.maximum(t - 1, 0)], 0)
    best = int(((whole * capacity + volume[capacity - t] - below + capacity - 1) // capacity).max())
    # (k + 1) x / capacity rounded down, unless it is whole already.
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        value = np.where(exact, k * sizes, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, int(-(-(counts * value).sum() // (k * capacity))))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each item its bin and place in it; for each bin its fill."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), dtype=np.int64)
    offsets = np.empty(len(sizes), dtype=np.int64)
    fill: list[int] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, len(fill)
            fill.append(0)
        bins[item], offsets[item] = chosen, fill[chosen]
        fill[chosen] += size
        if room > size:
            open_by_room[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fill, dtype=np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Place pieces into sequences: adds ``sequence_id``, ``offset``, and ``bound``, the least number of sequences.

    ``pieces`` must be a written table (it is read once for its histogram and once per round-0 group).
    """
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # capacity rows at most
        histogram[length] = n
    bound = lower_bound(histogram, capacity)
    extra = [c for c in pieces.columns if c not in _names(False)]
    fields = _PLACED + "".join(f", {c} {pieces.schema[c].dataType.simpleString()}" for c in extra)

    def place(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["length"].to_numpy()
        bins, offsets, fill = best_fit(sizes, capacity)
        least = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        return group.assign(_bin=bins, _fill=fill[bins], _offset=offsets, _bins=len(fill), _bound=least)[
            [x.split()[0] for x in fields.split(", ")]
        ]

    # Filled bins of the rounds before the one that stands, which is ``last``.
    kept, done, last, total_before = [], 0, None, None
    pending, rows = pieces, int(histogram.sum())
    for turn in range(ROUNDS):
        groups = max(1, -(-rows // group_rows))
        dealt = pending.withColumn("_group", F.expr(f"pmod(xxhash64(_row, {turn}), {groups})"))
        dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
        placed = dealt.groupBy("_group").applyInPandas(
            lambda key, group: place(group).assign(_group=key[0]), f"{fields}, _group long"
        )
        placed = written(placed, f"packed{turn}").withColumns(
            {
                "doc_id": F.col("doc_id").cast("long"),
                "sequence_id": F.expr(f"shiftleft({turn}L, 56) + shiftleft(_group, 16) + _bin"),
            }
        )
        filled = F.col("_fill") == capacity
        seen = placed.agg(
            F.sum(F.when(filled & (F.col("_offset") == 0), 1).otherwise(0)).alias("full"),
            F.sum(F.when(~filled & (F.col("_offset") == 0), 1).otherwise(0)).alias("open"),
            F.sum(F.when(~filled, 1).otherwise(0)).alias("released"),
        ).first()
        full, total = seen["full"] or 0, done + (seen["full"] or 0) + (seen["open"] or 0)
        if total_before is not None and total >= total_before:
            break
        if last is not None:
            kept.append(last.where(filled))
        last, total_before = placed, total
        if total == bound or groups == 1:
            break
        done, pending, rows = done + full, placed.where(~filled).select(pieces.columns), seen["released"]
    columns = [c for c in pieces.columns if c != "_row"]
    parts = [df.select(*columns, "sequence_id", F.col("_offset").alias("offset")) for df in [*kept, last]]
    return reduce(DataFrame.unionAll, parts).withColumn("bound", F.lit(bound).cast("long"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenize and pack: the pieces of all documents with their sequence and place."""
    return pack(written(token_pieces(docs, tokenizer, capacity=capacity, keep_ids=keep_ids), "pieces"), capacity)
