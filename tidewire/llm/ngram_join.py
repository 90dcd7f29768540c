"""N-gram Jaccard join with prefix trees: documents that share most of their word shingles.

The set of a document holds the distinct five-word shingles of its words (ASCII letters lower-cased), as
64-bit hashes; a document with fewer words has its whole sequence as one shingle.  Documents link at a
similarity of ``SIMILARITY`` percent or more, and components of links are returned.

1. Signatures (128 bits of the whole set) collapse documents with equal sets.  Shingles whose hash is in the lowest
   ``SAMPLED`` part are counted exactly: equal ones meet in one of up to ``SHARES`` shares of their hashes, to which a task
   sends four bytes of each and its document's place.  Shingles known not to repeat come first in the global order.
2. Two sets that link share one of their first ``n - least overlap + 1`` shingles in that order.  A set whose first
   shingles are all known not to repeat is alone, which settles most sets without reading them again.  Among the
   other sets all shingles are counted, in the same way, and ordered by how many of these sets hold them, rare ones
   first, then by hash; so a set is settled too unless most of it repeats.  What
   remains is grouped by first shingles: each batch of sets sends one representative per shingle, and sets that
   share a shingle are joined to the least of them.  The components of these joins hold all links.
3. The sets of a component are joined in blocks of bounded size, by a prefix tree: sets are paths of shingles
   in the order of a sketch of fixed size that counts shingles over all documents; walking a path keeps the partial overlaps with all sets met so far, paths with a common
   start share them, and a set is dropped as soon as what remains of both cannot reach the overlap needed.
   Overlaps that survive the prefix are counted in full.
4. A component of many sets is dealt to several blocks by length.  Blocks are joined first within
   themselves; then one set of each result; then the sets outside of the largest result with all blocks of fitting
   length.  So a large group of near copies costs one pass, not all pairs.

No link is lost: the filters are exact, and there is no cap.  Shingle hashes can only add a link by a
collision of 64 bits within a pair.

Defined results: null and empty texts and texts without words have an empty set and their own id as component;
equal ids are documents of their own; null ids are ignored by the least id of a component (null if there is no
other); repeated rows link; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.byte_words import byte_class, slices, words
from tidewire.llm.components import components
from tidewire.llm.tables import BLANKS
from tidewire.session import written

WORDS = 5
SIMILARITY = 80
#: Counters of the sketch (one byte each): its size does not depend on the input.
SKETCH_BITS = 22
#: Part of all hashes whose shingles are counted exactly, and most bits of the bitmap of wanted texts.
SAMPLED, FILTER_BITS = 0.3, 26
#: Most shares of all hashes in which equal shingles meet, and rows whose shingles a share hands back together.
SHARES, BATCH_ROWS = 1 << 12, 1 << 12
#: Shingles that one block holds, about.
BLOCK_SHINGLES = 1_500_000
#: Sets that meet at once when results of blocks are compared.
BLOCK_SETS = 2000
#: Bytes of text whose sets a task holds at once; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Items that a task gathers before it sends them.
SENT_ITEMS = 500_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words: all but ASCII white space.
_INSIDE = ~byte_class((9, 13), (32, 32))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, from the hashes of the words."""
    n = max(0, len(h) - width + 1) if width else 0
    out = h[:n] + np.uint64(width)
    for k in range(1, width):
        out = out * _FACTOR + h[k : n + k]
    return _mixed(out)


def shingle_sets(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, in order, by slices of ``SLICE_BYTES``."""
    for begin, end, data, bounds in slices(texts, SLICE_BYTES):
        found = words(data, bounds, _INSIDE)
        coded = found.array.dictionary_encode()
        digests = map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist())
        h = np.fromiter(digests, np.uint64, len(coded.dictionary))[coded.indices.to_numpy()]
        rows = np.searchsorted(found.row, np.arange(end - begin + 1)).tolist()
        full = _hashes(h, WORDS)
        yield [
            np.unique(full[a : b - WORDS + 1]) if b - a >= WORDS else _hashes(h[a:b], b - a) for a, b in pairwise(rows)
        ]


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(sets).view(np.int64))


def _signature(items: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(items.tobytes())
    low, high = digest & (1 << 64) - 1, digest >> 64
    return low - (low >> 63 << 64), high - (high >> 63 << 64)


def _needed(total: int | np.ndarray) -> int | np.ndarray:
    """Least overlap of two sets that link, from the sum of their sizes: 100 o >= s (total - o)."""
    return -(-SIMILARITY * total // (100 + SIMILARITY))


def _prefix(n: int) -> int:
    """Length of the prefix in which a set of n items shares an item with every set that links with it."""
    return n - (-(-SIMILARITY * n // 100)) + 1 if n else 0


# --------------------------------------------------------------------------
# Signatures and the global order
# --------------------------------------------------------------------------

_ROW = "doc_id string, hash long, n long, sig long, sig2 long, items array<long>, part int, counts binary"
_PARTS = 32
_LOW = np.uint64(SAMPLED * 2**64)

def _signatures(docs: DataFrame) -> DataFrame:
    """One row per document with size and signature, and ``_PARTS`` rows per task with its sketch."""

    names = [x.split()[0] for x in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
        for batch in batches:
            ids, hashes, done = batch.column("doc_id"), batch.column("hash"), 0
            for sets in shingle_sets(batch.column("text")):
                rows, low = [], []
                for items in sets:
                    slots = (items >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    counts[slots] += counts[slots] < 255
                    low.append(items[: np.searchsorted(items, _LOW)])
                    rows.append((len(items), *_signature(items)))
                size = len(sets)
                numbers = map(pa.array, np.array(rows, dtype=np.int64).T)
                parts = [pa.array(np.full(size, -1, dtype=np.int32)), pa.nulls(size, pa.binary())]
                columns = [ids.slice(done, size), hashes.slice(done, size), *numbers, _lists(low), *parts]
                yield pa.RecordBatch.from_arrays(columns, names)
                done += size
        pieces = [piece.tobytes() for piece in np.split(counts, _PARTS)]
        zeros = pa.array(np.zeros(_PARTS, dtype=np.int64))
        columns = [pa.nulls(_PARTS, pa.string()), *[zeros] * 4, pa.nulls(_PARTS, pa.list_(pa.int64()))]
        columns += [pa.array(np.arange(_PARTS, dtype=np.int32)), pa.array(pieces, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, _ROW)


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the counters of each part, saturating at the largest 32-bit number."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch["part"], batch["counts"], strict=True):
            kind = np.uint8 if len(raw) == (1 << SKETCH_BITS) // _PARTS else np.uint32
            values = np.frombuffer(raw, kind).astype(np.int64)
            sums[part] = sums[part] + values if part in sums else values
    for part, values in sums.items():
        yield pd.DataFrame({"part": [part], "counts": [np.minimum(values, 2**32 - 1).astype("<u4").tobytes()]})


def _class(counts: np.ndarray, usual: float) -> np.ndarray:
    """Class of each counter: 0 for the usual fill, then by powers of two above it.  One byte per counter."""
    return np.floor(np.log2(np.maximum(counts.astype(np.float64) / usual, 0.5)) + 1).astype(np.uint8)


def _ranks(sketches: DataFrame) -> np.ndarray:
    """Classes of all counters.  They are made where the counters are: the driver gets a byte of each, and no counts."""
    salted = sketches.select("part", "counts", (F.col("_task") % 64).alias("_salt"))
    near = salted.repartition(F.col("part"), F.col("_salt")).mapInPandas(
        lambda batches: _summed(batches), "part int, counts binary"
    )

    def with_fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _summed(batches):
            yield batch.assign(fill=[int(np.frombuffer(raw, "<u4").sum(dtype=np.int64)) for raw in batch["counts"]])

    total = near.repartition(F.col("part")).mapInPandas(with_fill, "part int, counts binary, fill long")
    total = written(total, "sketch")  # fixed size
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    fill = total.agg(F.sum("fill")).first()[0]
    if fill is None:
        return out
    usual = 2 * (fill / len(out)) + 8

    def classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, raw in zip(batch["part"], batch["counts"], strict=True):
                yield pd.DataFrame({"part": [part], "ranks": [_class(np.frombuffer(raw, "<u4"), usual).tobytes()]})

    parts = out.reshape(_PARTS, -1)
    for row in total.select("part", "counts").mapInPandas(classes, "part int, ranks binary").collect():  # fixed size
        parts[row["part"]] = np.frombuffer(row["ranks"], np.uint8)
    return out


# --------------------------------------------------------------------------
# Equal items meet in shares of their hashes
# --------------------------------------------------------------------------

_SENT = "share int, number long, keys binary, places binary"
_KEY_BITS = 32
_SHARE_BITS = SHARES.bit_length() - 1


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive ``values``, so many in a row."""
    bounds = (np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(values))])


def _values(parts: list[pa.RecordBatch], name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many there are in each row."""
    values, sizes = [np.empty(0, kind)], [np.empty(0, np.int64)]
    for part in parts:
        array = part.column(name).cast(pa.large_binary())
        _, bounds, data = array.buffers()
        bounds = np.frombuffer(bounds, np.int64, len(array) + 1, array.offset * 8)
        if data is not None:
            values.append(np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view(kind))
        sizes.append(np.diff(bounds) // np.dtype(kind).itemsize)
    return np.concatenate(values), np.concatenate(sizes)


def _runs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Values of a sorted column, with their rows."""
    held, own = [], None
    for batch in batches:
        column = batch.column(name).to_numpy()
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)]):
            if a < b:
                if held and column[a] != own:
                    yield own, held
                    held = []
                own = int(column[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield own, held


def _share_bits(spark: SparkSession) -> int:
    """As many shares as Spark's shuffles have partitions, or up to twice as many, but not very few."""
    return min(_SHARE_BITS, max(6, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def _dealt(bits: int, rows: np.ndarray, sizes: np.ndarray, items: np.ndarray) -> pa.RecordBatch:
    """One row for each share: keys of the items and places of their rows.  The sizes of the rows are a share of their own.

    A key and its share are up to 44 bits of a hash.  Unlike items with equal ones count as one item, which only makes
    it repeat; every step takes them so.
    """
    share = (items & np.uint64((1 << bits) - 1)).astype(np.uint16)
    order = np.argsort(share, kind="stable")
    place = (rows - rows[0]).astype(np.uint16)
    keys = np.concatenate([(items >> np.uint64(bits)).astype(np.uint32)[order], sizes.astype(np.uint32)])
    places = np.concatenate([np.repeat(place, sizes)[order], place])
    counts = np.bincount(share, minlength=1 << bits)
    shares = np.flatnonzero(counts)
    counts = np.append(counts[shares], len(rows))
    shares = np.append(shares, SHARES).astype(np.int32)
    columns = [pa.array(shares), pa.array(np.full(len(shares), rows[0])), _binary(keys, counts), _binary(places, counts)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SENT.split(", ")])


def _sent(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """What tasks send of their rows (row, items) to ``2 ** bits`` shares."""
    held: list[tuple[np.ndarray, ...]] = []
    first, size = 0, 0
    for batch in batches:
        rows, lists = batch.column("row").to_numpy(), batch.column("items")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        items = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends, a = np.concatenate([[0], np.cumsum(sizes)]), 0
        while a < len(rows):
            if held and (size >= SENT_ITEMS or not first <= rows[a] < first + BATCH_ROWS):
                yield _dealt(bits, *map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
            first = first if held else rows[a]
            far = np.flatnonzero((rows[a:] < first) | (rows[a:] >= first + BATCH_ROWS))
            b = min(a + int(far[0]) if len(far) else len(rows), int(np.searchsorted(ends, ends[a] + SENT_ITEMS - size)))
            b = max(a + 1, b)
            held.append((rows[a:b].copy(), sizes[a:b], items[ends[a] : ends[b]].copy()))
            size += int(ends[b] - ends[a])
            a = b
    if held:
        yield _dealt(bits, *map(np.concatenate, zip(*held, strict=True)))


def _times(keys: np.ndarray) -> np.ndarray:
    """How often each key is there, 255 at most."""
    packed = keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    key = packed >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    run = np.diff(np.append(first, len(key)))
    out = np.empty(len(keys), np.uint8)
    out[packed & np.uint64(2**32 - 1)] = np.repeat(np.minimum(run, 255), run)
    return out


def _at_shares(sent: DataFrame, run, fields: str) -> DataFrame:
    return sent.repartition(F.col("share")).sortWithinPartitions("share").mapInArrow(run, fields)


def _at_rows(met: DataFrame, run, fields: str) -> DataFrame:
    return met.repartition(F.col("number")).sortWithinPartitions("number").mapInArrow(run, fields)


def _alone(sets: DataFrame) -> DataFrame:
    """(row, alone): how many items of each row (row, items) no other row holds; rows without any are left out."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, parts in _runs(batches, "share"):
            if share < SHARES:
                numbers = np.concatenate([part.column("number").to_numpy() for part in parts])
                keys, sizes = _values(parts, "keys", np.uint32)
                once = _times(keys) == 1
                counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[once], minlength=len(sizes))
                places = _values(parts, "places", np.uint16)[0][once]
                some = counts > 0
                yield pa.RecordBatch.from_arrays([pa.array(numbers[some]), _binary(places, counts[some])], ["number", "places"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in _runs(batches, "number"):
            counts = np.bincount(_values(parts, "places", np.uint16)[0])
            place = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(number + place), pa.array(counts[place])], ["row", "alone"])

    bits = _share_bits(sets.sparkSession)
    sent = sets.select("row", "items").mapInArrow(lambda batches: _sent(batches, bits), _SENT)
    met = _at_shares(sent, meet, "number long, places binary")
    return _at_rows(met, gather, "row long, alone long")


# --------------------------------------------------------------------------
# Candidate components
# --------------------------------------------------------------------------


def _all_items(texts: DataFrame, *names: str, into=None, fields: str = "items array<long>") -> DataFrame:
    """``items`` of every text with the columns of ``names``, or what ``into`` makes of them."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for sets in shingle_sets(batch.column("text")):
                more = [batch.column(name).slice(done, len(sets)) for name in names]
                yield pa.RecordBatch.from_arrays([_lists(sets), *more], ["items", *names])
                done += len(sets)

    return texts.select("text", *names).mapInArrow(lambda batches: into(made(batches)) if into else made(batches), fields)


def _shared(item: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """(item, node): for each item one node; other nodes that share it meet that one under a key of their own."""
    order = np.lexsort((node, item))
    item, node = item[order], node[order]
    first = np.ones(len(item), dtype=bool)
    first[1:] = item[1:] != item[:-1]
    lead = node[np.flatnonzero(first)[np.cumsum(first) - 1]]
    other = node != lead
    pairs = np.unique(np.stack([lead[other], node[other]]), axis=1)
    # Keys of items have 44 bits at most.
    own = _mixed(pairs[0].view(np.uint64) ^ _FACTOR).view(np.int64) | np.int64(-(2**63))
    keys = np.concatenate([item[first], own, own])
    ends = np.concatenate([node[first], pairs[0], pairs[1]])
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ends)], ["item", "node"])


def _shared_prefixes(texts: DataFrame) -> DataFrame:
    """(item, node): for each prefix item one row of ``texts`` (row, text) per batch; rows that share an item within a batch meet under a key of their own."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, parts in _runs(batches, "share"):
            numbers = np.concatenate([part.column("number").to_numpy() for part in parts])
            keys, sizes = _values(parts, "keys", np.uint32)
            places = _values(parts, "places", np.uint16)[0]
            times = _times(keys) if share < SHARES else np.full(len(keys), 2, np.uint8)
            again = times > 1
            counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[again], minlength=len(sizes))
            some = counts > 0
            values = [_binary(x[again], counts[some]) for x in (keys, places, times)]
            columns = [pa.array(np.full(some.sum(), share, np.int32)), pa.array(numbers[some]), *values]
            yield pa.RecordBatch.from_arrays(columns, names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in _runs(batches, "number"):
            keys, sizes = _values(parts, "keys", np.uint32)
            places, times = (_values(parts, name, kind)[0] for name, kind in (("places", np.uint16), ("times", np.uint8)))
            share = np.repeat(np.concatenate([part.column("share").to_numpy() for part in parts]), sizes)
            own = share == SHARES
            n = np.zeros(BATCH_ROWS, np.int64)
            n[places[own]] = keys[own]
            # By place, then in the global order: rare ones first, then by hash.
            packed = places[~own].astype(np.uint64) << np.uint64(_KEY_BITS + _SHARE_BITS + 8)
            packed |= times[~own].astype(np.uint64) << np.uint64(_KEY_BITS + _SHARE_BITS)
            packed |= keys[~own].astype(np.uint64) << np.uint64(bits) | share[~own].astype(np.uint64)
            packed.sort()
            place = (packed >> np.uint64(_KEY_BITS + _SHARE_BITS + 8)).astype(np.int64)
            rest = np.bincount(place, minlength=BATCH_ROWS)
            # Items that do not repeat come before.
            most = n - -(-SIMILARITY * n // 100) + 1 - (n - rest)
            kept = np.arange(len(place)) - (np.cumsum(rest) - rest)[place] < most[place]
            item = (packed[kept] & np.uint64(2 ** (_KEY_BITS + _SHARE_BITS) - 1)).astype(np.int64)
            if len(item):
                yield _shared(item, number + place[kept])

    names = ["share", "number", "keys", "places", "times"]
    bits = _share_bits(texts.sparkSession)
    sent = _all_items(texts, "row", into=lambda batches: _sent(batches, bits), fields=_SENT)
    met = _at_shares(sent, meet, f"{_SENT}, times binary")
    return _at_rows(met, gather, "item long, node long")


def _marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` with ``_held``: whether ``doc_id`` and ``hash`` may be in ``wanted``.  It is set for all that are, and few others.

    ``wanted``, a written table, becomes a bitmap with 16 bits or more for each of its rows, of at most
    ``2 ** FILTER_BITS`` bits, in rows of 32,768 bits each, so that only few texts are shuffled.
    """
    bits = min(FILTER_BITS, max(15, (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(1 << bits)) + 1
    bits = wanted.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))
    bits = bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.bitmap_bit_position(place) / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    held = F.getbit(byte, (F.bitmap_bit_position(place) % 8).cast("int")) == 1
    near = docs.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("_bucket"), "left")
    return near.withColumn("_held", F.coalesce(held, F.lit(False))).select(*docs.columns, "_held")


def _may_be_in(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` and ``hash`` may be in ``wanted``: all that are, and few others."""
    return _marked(docs, wanted).where("_held").drop("_held")


def _suspects(rows: DataFrame, alone: DataFrame) -> DataFrame:
    """One document (doc_id, hash) for every set whose first items are not all known to be its own."""
    prefix = F.expr(f"n - ({SIMILARITY} * n + 99) div 100 + 1")
    found = rows.join(alone.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    found = found.where(F.coalesce("alone", F.lit(0)) < prefix)
    return found.groupBy("sig", "sig2", "n").agg(F.min(F.struct("doc_id", "hash")).alias("_one"))


def _candidate_edges(texts: DataFrame) -> DataFrame:
    shared = Window.partitionBy("item")
    met = _shared_prefixes(texts).withColumns({"lead": F.min("node").over(shared), "last": F.max("node").over(shared)})
    return met.where("lead <> last AND node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))


# --------------------------------------------------------------------------
# The join of one block
# --------------------------------------------------------------------------


def _in_order(sets: list[np.ndarray], ranks: np.ndarray) -> list[np.ndarray]:
    """Sets as ascending places of their items in the global order, among the items of the block."""
    known, place = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ranks[(known >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    renamed = np.empty(len(known), dtype=np.int32)
    renamed[order] = np.arange(len(known), dtype=np.int32)
    ends = np.cumsum([len(x) for x in sets])[:-1]
    return [np.sort(x) for x in np.split(renamed[place], ends)]


def tree_join(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Labels of ``sets`` (ascending places) after joining all that link; ``labels`` are components known before.

    Paths are walked in lexicographic order, so the tree is the stack of depths at which paths part.  An entry
    holds the earlier paths met so far and their overlaps with the path down to that depth; the next path
    below it starts from there.  Paths that came since the entry was made share all of it.
    """
    sizes = np.array([len(x) for x in sets])
    order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes()))
    paths, sizes, label = [sets[i] for i in order], sizes[order], labels[order]
    common = np.zeros(len(paths) + 1, dtype=np.int64)  # depth shared with the path before
    for k in range(1, len(paths)):
        a, b = paths[k - 1], paths[k]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        common[k] = differ[0] if len(differ) else m
    # Postings: the paths of each item, ascending.
    items = np.concatenate(paths)
    holder = np.repeat(np.arange(len(paths)), sizes)
    by_item = np.argsort(items, kind="stable")
    holder = holder[by_item]
    starts = np.searchsorted(items[by_item], np.arange(items.max() + 2))
    stack: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # depth, path that made the entry, met, overlaps
    for k, path in enumerate(paths):
        n, prefix = len(path), _prefix(len(path))
        while stack and stack[-1][0] > common[k]:
            stack.pop()
        if stack:
            depth, maker, met, overlap = stack[-1]
            met = np.concatenate([met, np.arange(maker, k)])
            overlap = np.concatenate([overlap, np.full(k - maker, depth)])
        else:
            depth, met, overlap = 0, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        parting = min(int(common[k + 1]), prefix)
        for stop in sorted({parting, prefix}):
            if stop > depth:
                found = [holder[starts[i] : starts[i + 1]] for i in path[depth:stop].tolist()]
                fresh = np.concatenate([x[: np.searchsorted(x, k)] for x in found])
                if len(fresh):
                    ids, times = np.unique(np.concatenate([met, fresh]), return_counts=True)
                    times[np.searchsorted(ids, met)] += overlap - 1
                    met, overlap = ids, times
                depth = stop
            if stop == parting and depth == parting and parting > (stack[-1][0] if stack else 0):
                stack.append((depth, k, met, overlap))
        if not len(met):
            continue
        # Drop sets of which too little remains; sets of the same component need no test.
        other = sizes[met]
        most = overlap + np.minimum(n - depth, other - overlap)
        for p in met[(most >= _needed(n + other)) & (label[met] != label[k])].tolist():
            if label[p] != label[k]:
                both = len(np.intersect1d(path, paths[p], assume_unique=True))
                if 100 * both >= SIMILARITY * (n + sizes[p] - both):
                    low, high = sorted((label[p], label[k]))
                    label[label == high] = low
    out = np.empty_like(labels)
    out[order] = label
    return out


# --------------------------------------------------------------------------
# Blocks
# --------------------------------------------------------------------------

_MEMBER = "coarse long, block long, sig long, sig2 long, label long"


def _joined(members: DataFrame, keys: list[str], ranks) -> DataFrame:
    """Join each group of ``members`` (with ``text``) by ``keys``; (coarse, block, sig, sig2, label), label a row's ``label`` or less."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = ranks.value
        group = group.drop_duplicates(["sig", "sig2", "block"])
        sets = list(chain.from_iterable(shingle_sets(pa.array(group["text"], pa.large_string()))))
        right = np.array([_signature(x) for x in sets]) == group[["sig", "sig2"]].to_numpy()
        keep = right.all(axis=1)
        group, sets = group[keep], [x for x, k in zip(sets, keep, strict=True) if k]
        if len(group) > 1:
            group = group.assign(label=tree_join(_in_order(sets, order), group["label"].to_numpy()))
        return group[[x.split()[0] for x in _MEMBER.split(", ")]]

    return members.groupBy(*keys).applyInPandas(run, _MEMBER)


def _blocks(members: DataFrame) -> DataFrame:
    """Deal the sets of each candidate component to blocks: one, or several by class of length and hash.

    Sets that link are in the same or in neighbouring classes.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / SIMILARITY))).cast("long")
    classed = members.withColumn("_class", size)
    of_class = classed.groupBy("coarse", "_class").agg(F.sum("n").alias("_sum"))
    of_coarse = of_class.groupBy("coarse").agg(F.sum("_sum").alias("_all"))
    plan = of_class.join(of_coarse, "coarse").select(
        F.col("coarse").alias("_coarse"),
        F.col("_class").alias("_of"),
        (F.col("_all") > BLOCK_SHINGLES).alias("large"),
        F.ceil(F.col("_sum") / BLOCK_SHINGLES).cast("long").alias("_parts"),
    )
    joined = classed.join(plan, (F.col("coarse") == F.col("_coarse")) & (F.col("_class") == F.col("_of")))
    part = F.pmod(F.xxhash64("sig", "sig2"), F.col("_parts"))
    block = F.when(F.col("large"), F.col("_class") * (1 << 32) + part).otherwise(-1)
    return joined.withColumn("block", block).drop("_coarse", "_of", "_parts")


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (.., label) with labels replaced by their component under the pairs ``found`` (a, b)."""
    into = components(found).select(F.col("node").alias("_node"), "component")
    return (
        labels.join(into, F.col("label") == F.col("_node"), "left")
        .withColumn("label", F.coalesce("component", "label"))
        .drop("_node", "component")
    )


def _leaders_met(first: DataFrame, texts: DataFrame, ranks) -> DataFrame:
    """Labels of blocks, merged where the largest results of blocks link: one set of each meets those of other blocks.

    At most about ``BLOCK_SETS`` of them meet at once; the rounds end when they merge no more.
    """
    key = ["sig", "sig2"]
    results = first.groupBy("coarse", "block", "label").agg(F.count("*").alias("n"), F.min(F.struct(*key)).alias("s"))
    best = results.groupBy("coarse", "block").agg(F.max(F.struct("n", "s", "label")).alias("m"))
    leaders = best.select("coarse", F.lit(0).cast("long").alias("block"), "m.s.sig", "m.s.sig2", "m.label")
    labels, before = first, None
    for turn in range(8):
        leaders = written(leaders.groupBy("coarse", "block", "label").agg(F.min(F.struct(*key)).alias("s")).select(
            "coarse", "block", "s.sig", "s.sig2", "label"
        ), "leaders")
        n = leaders.count()
        if n == before:
            break
        before = n
        deals = leaders.groupBy("coarse").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("long").alias("_deals"))
        dealt = leaders.join(deals, "coarse").withColumn("_deal", F.expr(f"pmod(xxhash64(label, {turn}), _deals)"))
        met = _joined(dealt.join(texts, key), ["coarse", "_deal"], ranks).select(*key, F.col("label").alias("b"))
        found = written(leaders.join(met, key).select(F.col("label").alias("a"), "b").distinct(), "met")
        labels = written(_merged(labels, found), "merged")
        leaders = _merged(leaders, found)
    return labels


def _large(members: DataFrame, texts: DataFrame, ranks) -> DataFrame:
    """Join the candidate components that take several blocks; (sig, sig2, label)."""
    key = ["sig", "sig2"]
    first = written(_joined(members.join(texts, key), ["coarse", "block"], ranks), "blocks")
    labels = _leaders_met(first, texts, ranks)
    # Sets outside of the largest result of their candidate component meet all blocks of fitting length.
    counts = labels.groupBy("coarse", "label").count()
    largest = counts.groupBy("coarse").agg(F.max(F.struct("count", "label")).alias("_m"))
    rest = labels.join(largest, "coarse").where(F.col("label") != F.col("_m.label")).drop("_m")
    deals = rest.groupBy("coarse").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("long").alias("_deals"))
    rest = rest.join(deals, "coarse")
    near = F.explode(F.array(*(F.floor(F.col("block") / (1 << 32)) + d for d in (-1, 0, 1)))).alias("_near")
    rest = rest.withColumn("_deal", F.pmod(F.xxhash64("sig", "sig2"), F.col("_deals"))).select("*", near)
    rest = rest.select(F.col("coarse").alias("_c"), "_near", "_deal", *key, "label", F.col("block").alias("_own"))
    targets = labels.select("coarse", F.col("block").alias("_target")).distinct()
    pairs = rest.join(
        targets, (F.col("_c") == F.col("coarse")) & (F.col("_near") == F.floor(F.col("_target") / (1 << 32)))
    )
    probes = pairs.select("coarse", "_target", "_deal", F.col("_own").alias("block"), *key, "label")
    asked = probes.select(F.col("coarse").alias("_c"), F.col("_target").alias("_t"), "_deal").distinct()
    filled = labels.join(asked, (F.col("_c") == F.col("coarse")) & (F.col("_t") == F.col("block")))
    filled = filled.select("coarse", F.col("_t").alias("_target"), "_deal", "block", *key, "label")
    both = probes.unionAll(filled).join(texts, key)
    last = _joined(both, ["coarse", "_target", "_deal"], ranks)
    again = last.join(labels.select(*key, F.col("label").alias("a")), key).select("a", F.col("label").alias("b"))
    return _merged(labels.select("sig", "sig2", "label"), again.distinct())


def linked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, hash, n_shingles, root, component_id) for every document: ``hash`` of its text, ``root`` of its component."""
    spark = docs.sparkSession
    chosen = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
        F.xxhash64(F.col(text_column)).alias("hash"),
    )
    # Ids pass through Python as text: as numbers, nulls would turn them into floats.
    named = chosen.withColumn("doc_id", F.col("doc_id").cast("string"))
    numbered = {"_task": F.spark_partition_id(), "row": F.monotonically_increasing_id()}
    signed = written(_signatures(named).withColumns(numbered), "signatures")
    sets = signed.where("part < 0 AND n > 0")
    ranks = spark.sparkContext.broadcast(_ranks(signed.where("part >= 0")))  # fixed size
    rows = signed.where("part < 0").select(F.col("doc_id").cast("long").alias("doc_id"), "hash", "n", "sig", "sig2", "row")
    # The texts of sets that may link, one document for each.
    suspects = written(_suspects(rows.where("n > 0"), _alone(sets)), "suspects")
    rows = rows.drop("row")
    one = suspects.select("sig", "sig2", "n", F.col("_one.doc_id").alias("_id"), F.col("_one.hash").alias("_hash"))
    near = _may_be_in(chosen, one.select(F.col("_id").alias("doc_id"), F.col("_hash").alias("hash")))
    # Joined by plain columns, so that texts are not shuffled again for repeated rows.
    key = ["_at", "_none", "hash"]
    near = near.withColumns({"_at": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull()})
    one = one.select("sig", "sig2", "n", F.coalesce("_id", F.lit(0)).alias("_at"), F.col("_id").isNull().alias("_none"), F.col("_hash").alias("hash"))
    texts = near.join(one.hint("shuffle_hash"), key).dropDuplicates([*key, "sig", "sig2"]).select("sig", "sig2", "n", "text")
    texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    # Among these texts, all items are counted.
    coarse = components(_candidate_edges(texts))
    members = texts.select("sig", "sig2", "n", "row").join(coarse, F.col("row") == F.col("node"))
    members = members.select(F.col("component").alias("coarse"), "sig", "sig2", "n", F.col("row").alias("label"))
    members = written(_blocks(members), "members")
    texts = texts.drop("n", "row")
    columns = ["coarse", "block", "sig", "sig2", "label"]
    small = _joined(members.where("NOT large").select(columns).join(texts, ["sig", "sig2"]), ["coarse"], ranks)
    labels = small.select("sig", "sig2", "label")
    large = members.where("large").select(columns)
    if not large.isEmpty():
        labels = labels.unionAll(_large(large, texts, ranks))
    labels = written(labels.withColumnsRenamed({"sig": "_sig", "sig2": "_sig2"}), "labels")
    # The least id of each component, by set and then by label.
    known = rows.where("n > 0").groupBy("sig", "sig2").agg(F.min("doc_id").alias("_least"))
    equal = (F.col("sig") == F.col("_sig")) & (F.col("sig2") == F.col("_sig2"))
    known = known.join(labels, equal, "left").drop("_sig", "_sig2")
    together = known.where("label IS NOT NULL").groupBy(F.col("label").alias("_label")).agg(F.min("_least").alias("_all"))
    known = known.join(together, F.col("label") == F.col("_label"), "left").select(
        F.col("sig").alias("_sig"),
        F.col("sig2").alias("_sig2"),
        F.coalesce(F.col("label").cast("string"), F.concat_ws(":", "sig", "sig2")).alias("root"),
        F.coalesce("_all", "_least").alias("component_id"),
    )
    found = rows.join(known, equal & (F.col("n") > 0), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "hash", F.col("n").alias("n_shingles"), "root", own.alias("component_id"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    return linked(docs, id_column, text_column).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the least id; documents with an empty set all stay."""
    found = written(linked(docs, id_column, text_column), "linked")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    full = found.where("n_shingles > 0")
    one = full.groupBy("root").agg(F.min(place).alias("_one"))
    one = one.select(F.col("_one.doc_id").alias("_id"), F.col("_one.hash").alias("_hash"))
    rows = full.groupBy("doc_id", "hash").agg(F.count("*").alias("_copies"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_hash").eqNullSafe(F.col("hash"))
    # Rows that go, and repeated rows of which one stays, are few: only they are looked up and shuffled with their texts.
    rows = rows.join(one, same, "left").withColumn("_stays", F.col("_hash").isNotNull())
    odd = written(rows.where("NOT _stays OR _copies > 1").select("doc_id", "hash", "_stays"), "odd")
    text = F.col(text_column)
    keys = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"),
                       (F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)) == "").alias("_empty"))
    marked = _marked(keys, odd.select("doc_id", "hash"))
    key = ["_at", "_none", "hash"]
    at = {"_at": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull()}
    near = marked.where("_held AND NOT _empty").withColumns(at).drop("doc_id")
    near = near.join(odd.withColumns(at).drop("doc_id").hint("shuffle_hash"), key, "left")
    usual = near.where("_stays IS NULL").select("_row.*")
    repeated = near.where("_stays").dropDuplicates(key).select("_row.*")
    return marked.where("NOT _held OR _empty").select("_row.*").unionAll(usual).unionAll(repeated)
