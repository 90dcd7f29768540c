"""Benchmark passages in documents by multi-pattern search after Wu and Manber.

The test strings are windows of consecutive words of benchmark items.  All of one length share a table of shifts: for
each block of two words, how far the end of a test string is away at least.  A text is read from window end to
window end; a block that is in no test string skips nearly a whole window, and only where the shift is
zero a bucket of test strings with that last block is looked up and compared word by word.  Words are numbered by the
words of the benchmark, so equal numbers are equal words and a comparison is exact.  A slice of documents is
searched in lanes of bounded length that advance together.

Tables are built from items of at most about ``BLOCK_CHARS`` characters at a time and broadcast; a larger benchmark is
searched in as many passes, so what a worker holds does not grow with it.  Documents are not shuffled.

Defined results: null and empty texts have no words and no hits; items without words have no windows, an item shorter
than a window is one window; repeated items and texts count like any other, with ``items`` distinct; words of an item
without an id are hit but named in no list; an empty table of items leaves all documents clean, an empty table of
documents gives an empty table; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import byte_words
from tidewire.session import written

#: Words in a window; characters of items searched in one pass.
WINDOW, BLOCK_CHARS = 10, 4_000_000
#: Window ends in a lane.
_LANE = 512
#: Digits, lower-case letters, and everything beyond ASCII.
WORD_BYTES = byte_words.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _blocks(symbols: np.ndarray, ends: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Table place of the block of ``size`` words that ends at each of ``ends``."""
    key = symbols[ends].astype(np.uint64)
    for back in range(1, size):
        key = key * _MIX + symbols[ends - back].astype(np.uint64)
    return ((key * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


class _Patterns:
    """Test strings of one length with their shifts, buckets and items."""

    def __init__(self, windows: np.ndarray, owners: np.ndarray) -> None:
        self.strings, which = np.unique(windows, axis=0, return_inverse=True)
        count, self.length = self.strings.shape
        self.block = min(2, self.length)
        self.bits = max(12, int(4 * count * (self.length - self.block + 1)).bit_length())
        flat = self.strings.reshape(-1)
        first = np.arange(count, dtype=np.int64) * self.length
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.uint8 if self.length < 256 else np.int64)
        for place in range(self.block - 1, self.length):
            np.minimum.at(self.shift, _blocks(flat, first + place, self.block, self.bits), self.length - 1 - place)
        keys = self._keys(flat, first + self.length - 1)
        order = np.argsort(keys, kind="stable")
        self.strings, self.keys = self.strings[order], keys[order]
        placed = np.empty(count, np.int64)
        placed[order] = np.arange(count)
        pairs = np.unique(np.stack([placed[which.reshape(-1)], owners]), axis=1)
        pairs = pairs[:, pairs[1] >= 0]
        self.owners = pairs[1]
        self.bounds = np.searchsorted(pairs[0], np.arange(count + 1))

    def _keys(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bucket of the last block, then a number made of all words, by which a bucket is ordered."""
        whole = np.zeros(len(ends), np.uint64)
        for back in range(self.length):
            whole = (whole ^ symbols[ends - back].astype(np.uint64)) * _MIX
        bucket = _blocks(symbols, ends, self.block, self.bits).astype(np.uint64)
        return (bucket << np.uint64(64 - self.bits)) | (whole >> np.uint64(self.bits))

    def occurrences(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the occurrences, and the test string of each; ``bounds`` are those of texts in words."""
        lanes = np.maximum(0, -(-(np.diff(bounds) - self.length + 1) // _LANE))
        text = np.repeat(np.arange(len(lanes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = bounds[:-1][text] + self.length - 1 + nth * _LANE
        stop = np.minimum(at + _LANE, bounds[1:][text])
        found = []
        while len(at):
            shift = self.shift[_blocks(symbols, at, self.block, self.bits)]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            more = at < stop
            at, stop = at[more], stop[more]
        ends = np.concatenate(found) if found else np.zeros(0, np.int64)
        keys = self._keys(symbols, ends)
        low, high = (np.searchsorted(self.keys, keys, side) for side in ("left", "right"))
        tried = np.repeat(np.arange(len(ends)), high - low)
        string = np.arange(len(tried)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[tried]
        begin = ends[tried] - self.length + 1
        same = np.ones(len(tried), bool)
        for place in range(self.length):
            same &= symbols[begin + place] == self.strings[string, place]
        return begin[same], string[same]


class Searcher:
    """Tables for a block of items: rows of (id or None, text)."""

    def __init__(self, items: pa.Table, window: int) -> None:
        names = items.column(0).combine_chunks()
        texts = items.column(1).combine_chunks()
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        coded = [(begin, byte_words.words(data, bounds, WORD_BYTES)) for begin, _, data, bounds in byte_words.slices(texts)]
        self.vocabulary = pa.chunked_array([w.array for _, w in coded], pa.large_binary()).unique()
        self.names = names.unique().drop_null()
        owner = pc.index_in(names, self.names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        for begin, w in coded:
            symbols = self.symbols(w.array)
            rows, first, sizes = np.unique(w.row, return_index=True, return_counts=True)
            for length in np.unique(np.minimum(sizes, window)):
                chosen = np.minimum(sizes, window) == length
                repeat = sizes[chosen] - length + 1
                base = np.repeat(first[chosen] - (np.cumsum(repeat) - repeat), repeat) + np.arange(repeat.sum())
                windows = symbols[base[:, None] + np.arange(length)]
                parts.setdefault(int(length), []).append((windows, np.repeat(owner[begin + rows[chosen]], repeat)))
        self.patterns = [
            _Patterns(np.concatenate([w for w, _ in found]), np.concatenate([o for _, o in found])) for found in parts.values()
        ]

    def symbols(self, array: pa.Array) -> np.ndarray:
        """Number of each word in the vocabulary of the items, -1 for other words."""
        coded = array.dictionary_encode()
        numbers = pc.index_in(coded.dictionary, self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.append(numbers, -1)[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64)

    def search(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, list, list]]:
        """By slice of texts: numbers of words, hit spans of words, and names of items by row."""
        names = np.array(self.names.to_pylist(), object)
        for begin, end, data, bounds in byte_words.slices(texts):
            w = byte_words.words(data, bounds, WORD_BYTES)
            starts = np.searchsorted(w.row, np.arange(end - begin + 1))
            symbols = self.symbols(w.array)
            edge = np.zeros(len(symbols) + 1, np.int64)
            spans: list[list] = [[] for _ in range(end - begin)]
            items: list[set] = [set() for _ in range(end - begin)]
            for patterns in self.patterns:
                first, string = patterns.occurrences(symbols, starts)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + patterns.length, -1)
                for row, which in np.unique(np.stack([w.row[first], string]), axis=1).T:
                    items[row].update(patterns.owners[patterns.bounds[which] : patterns.bounds[which + 1]])
            # Spans end at the end of their text: neighbours in the slice are other texts.
            hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
            text = np.concatenate([[-1], w.row, [-1]])
            changed = (hit[1:] != hit[:-1]) | (text[1:] != text[:-1])
            opens, closes = np.flatnonzero(changed & hit[1:]), np.flatnonzero(changed & hit[:-1])
            for a, b, row in zip(opens.tolist(), closes.tolist(), w.row[opens].tolist(), strict=True):
                base = int(starts[row])
                spans[row].append({"start": a - base, "end": b - base})
            yield np.diff(starts), spans, [sorted(names[list(found)]) if found else [] for found in items]


_FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _pass(docs: DataFrame, keys: list[str], items: DataFrame, window: int) -> DataFrame:
    """Keys, number of words, spans and items of all documents, for the items of one block."""
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(Searcher(items.toArrow(), window))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for counts, spans, named in tables.value.search(batch.column(batch.num_columns - 1)):
                rows = batch.slice(begin, len(counts))
                begin += len(counts)
                found = [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(named, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-1], *found], [*batch.schema.names[:-1], "n_words", "spans", "items"]
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema.fields)
    return docs.select(*keys, F.col("_text").cast("binary").alias("_text")).mapInArrow(search, f"{kinds}, {_FOUND}")


def find(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document: ``key``, n_words, ``spans`` of hit words (start, end exclusive, joined where they touch or
    overlap) and ``items`` (distinct ids as strings, in order) with a window in the text."""
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    items = benchmark.select(F.col(item).cast("string").alias("_item"), F.col(item_text).alias("_text"))
    chars = items.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = 1 + chars // block_chars
    if blocks == 1:
        return _pass(docs, ["_key"], items, window).withColumnRenamed("_key", key)
    docs = written(docs.withColumn("_row", F.monotonically_increasing_id()), "contamination-docs")
    items = written(items.withColumn("_block", F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks))), "contamination-items")
    found = None
    for block in range(blocks):
        one = _pass(docs, ["_row"], items.where(F.col("_block") == block).drop("_block"), window)
        one = written(one.where(F.size("spans") > 0).drop("n_words"), "contamination-found")
        found = one if found is None else found.unionByName(one)
    merged = _joined(found).join(
        found.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items")), "_row"
    )
    clean = _pass(docs, ["_key", "_row"], items.where("false").drop("_block"), window)
    return clean.join(merged, "_row", "left").select(
        F.col("_key").alias(key), "n_words", F.coalesce("_spans", "spans").alias("spans"), F.coalesce("_items", "items").alias("items")
    )


def _joined(found: DataFrame) -> DataFrame:
    """Spans of each row in order, with those that touch or overlap made one."""
    by_start = Window.partitionBy("_row").orderBy("start", "end")
    so_far = by_start.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("start") > F.coalesce(F.max("end").over(so_far), F.lit(-1))
    spans = found.select("_row", F.inline("spans")).withColumn("_opens", opens.cast("long"))
    spans = spans.withColumn("_island", F.sum("_opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    whole = spans.groupBy("_row", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
