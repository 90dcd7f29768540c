"""Phrases whose words occur together, counted in direct-address tiles.

Texts become blocks of word numbers, one row per task, block and language.  Spark counts the words and ranks the
frequent ones by frequency; a block then holds ranks.  Pairs of neighbours fall into square tiles of ranks.  Each of the
tiles of the most frequent words is a key of its own, the others are dealt to buckets.  A tile that holds many pairs is
counted in a dense array with a cell for each pair (``bincount``), all others as sorted coordinates with counts.
The parts that blocks have of a tile are packed, shuffled by tile and merged in the same two ways; a tile with
more than ``MERGE_ENTRIES`` entries is merged in shares first, and a bucket of many tiles is split on the way.  Pairs that are
frequent are ranked in turn, and become the left symbols of the next level, whose pairs are phrases of one more word.
A phrase is only counted if both phrases of one word less in it are frequent, which loses none.

A block is bounded by ``BLOCK_WORDS`` (or one slice of text) and a merge by ``MERGE_ENTRIES`` (or one block's part), so
no task holds more of a language than that.  Counts are exact, scores are computed in decimals.

Defined results: a null text has no words, a null language is ``und``; empty texts and pieces without words have none;
repeated rows count as often as they occur; ties are ordered by phrase; an empty table gives an empty table; other
columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm import byte_words
from tidewire.session import written

#: Occurrences and words of a phrase; share of its occurrences in a longer one that drops it; phrases per language.
MIN_COUNT, MAX_WORDS, INSIDE_PERCENT, TOP = 10, 3, 50, 2000
#: Words in a block; pairs with their counts in a merge.
BLOCK_WORDS, MERGE_ENTRIES = 2_000_000, 2_000_000
#: Ranks on a side of a tile, and on the sides of the square of tiles that are keys of their own.
TILE_BITS, HEAD_BITS = 10, 13
#: A tile is dense if it holds a pair for so many of its cells.
_DENSE_CELLS = 16
#: Pairs whose tiles, and whose cells in a tile, are worked out at once.
_AT_ONCE, _CELLS_AT_ONCE = 1 << 17, 1 << 19
#: Bits of the bucket of a tile: at first at most, and more with each round of merges.
_FIRST_BITS, _MORE_BITS, _MOST_BITS = 12, 4, 40
_PIECE_ENDS = byte_words.byte_class((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
_WORD_BYTES = ~(_PIECE_ENDS | byte_words.byte_class((0x20, 0x20), (0x09, 0x09)))

_BLOCK = "block long, lang string, code int, word string, count long, symbols binary"
_BLOCK_NAMES = [field.split()[0] for field in _BLOCK.split(", ")]
#: A part of a tile (tile, entries, packed), or the symbols of a block (words, phrases).
_LEVEL = "block long, lang string, tile long, entries long, packed binary, words binary, phrases binary"
_LEVEL_SCHEMA = pa.schema(
    [("block", pa.int64()), ("lang", pa.string()), ("tile", pa.int64()), ("entries", pa.int64()), ("packed", pa.binary()),
     ("words", pa.binary()), ("phrases", pa.binary())]
)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, byte by byte of their values and compressed."""
    kinds = [np.min_scalar_type(int(a.max(initial=0))) for a in arrays]
    planes = [a.astype(k).view(np.uint8).reshape(-1, k.itemsize).T.tobytes() for a, k in zip(arrays, kinds, strict=True)]
    sizes = np.array([len(arrays), *(n for a, k in zip(arrays, kinds, strict=True) for n in (len(a), k.itemsize))], np.int64)
    body = b"".join(planes)
    return sizes.tobytes() + (pa.compress(body, "zstd", asbytes=True) if body else b"")


def unpack(packed: bytes) -> list[np.ndarray]:
    """The arrays, as 64-bit numbers."""
    count = int(np.frombuffer(packed, np.int64, 1)[0])
    sizes = np.frombuffer(packed, np.int64, 2 * count, 8).reshape(-1, 2)
    total = int(sizes.prod(axis=1).sum())
    body = pa.decompress(packed[8 + 16 * count :], total, "zstd", asbytes=True) if total else b""
    out, at = [], 0
    for size, width in sizes.tolist():
        planes = np.frombuffer(body, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"u{width}").reshape(-1).astype(np.int64))
        at += size * width
    return out


def _barred(codes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Codes with a -1 before each that begins a piece."""
    out = np.full(len(codes) + int(fresh.sum()), -1, np.int32)
    out[np.arange(len(codes)) + np.cumsum(fresh)] = codes
    return out


class _Gatherer:
    """Words of a block by language: arrays of words and flags of those that begin a piece."""

    def __init__(self) -> None:
        self.found: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        self.words = 0

    def add(self, langs: np.ndarray, texts: pa.Array) -> None:
        """Words of some rows, whose languages are given."""
        for begin, end, data, bounds in byte_words.slices(texts):
            w = byte_words.words(data, bounds, _WORD_BYTES)
            passed = np.cumsum(_PIECE_ENDS[w.data], dtype=np.int32)[w.start] if len(w.start) else w.start
            fresh = np.ones(len(w.start), bool)
            fresh[1:] = (passed[1:] != passed[:-1]) | (w.row[1:] != w.row[:-1])
            of_rows = langs[begin:end]
            for lang in np.unique(of_rows):
                mine = (of_rows == lang)[w.row]
                array = w.array.filter(pa.array(mine)) if not mine.all() else w.array
                self.found.setdefault(lang, []).append((array, fresh[mine]))
            self.words += len(w.start)

    def rows(self, first: int) -> Iterator[pa.RecordBatch]:
        """Rows of distinct words, and one of symbols, for each language; blocks are numbered from ``first`` on."""
        for block, (lang, parts) in enumerate(self.found.items(), first):
            coded = pa.concat_arrays([a for a, _ in parts]).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            size = len(coded.dictionary)
            if not size:
                continue
            symbols = _barred(codes, np.concatenate([f for _, f in parts]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * size), pa.array([lang] * size), pa.array(np.arange(size, dtype=np.int32)),
                    coded.dictionary.cast(pa.binary()).cast(pa.string()), pa.array(np.bincount(codes, minlength=size)),
                    pa.nulls(size, pa.binary()),
                ],
                _BLOCK_NAMES,
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block]), pa.array([lang]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()),
                    pa.nulls(1, pa.int64()), pa.array([pack(symbols + 1)], pa.binary()),
                ],
                _BLOCK_NAMES,
            )


def _blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """Rows of ``_BLOCK``: distinct words with their counts, and the symbols of the block."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = _Gatherer(), TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            # Few rows at a time, so that a block ends near its size.
            for begin in range(0, batch.num_rows, 512):
                held.add(langs[begin : begin + 512], batch.column(1).slice(begin, 512))
                if held.words >= block_words:
                    yield from held.rows(block)
                    held, block = _Gatherer(), block + len(held.found)
        yield from held.rows(block)

    texts = docs.select(F.coalesce(F.col("_lang").cast("string"), F.lit("und")).alias("_lang"), F.col("_text").cast("binary"))
    return texts.mapInArrow(gather, _BLOCK)


def tile_of(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Key of the tile of each pair: below 0 a tile of the head, from 0 on a bucket of 2^``bits`` of other tiles."""
    out = np.empty(len(left), np.int64)
    for at in range(0, len(left), _AT_ONCE):
        some = slice(at, at + _AT_ONCE)
        out[some] = _tile_of(left[some], right[some], bits)
    return out


def _tile_of(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    across = HEAD_BITS - TILE_BITS
    rows, columns = left >> TILE_BITS, right >> TILE_BITS
    mixed = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ columns.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    bucket = ((mixed >> np.uint64(64 - _MOST_BITS)) >> np.uint64(_MOST_BITS - bits)).astype(np.int64)
    return np.where((rows < 1 << across) & (columns < 1 << across), ~((rows << across) | columns), bucket)


def summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct pairs in order, with the sums of their counts, from sorted coordinates."""
    if not len(left):
        return left, right, left
    wide = int(right.max()).bit_length()
    fits = int(left.max()).bit_length() + wide < 63
    if fits:
        keys = left << wide
        keys |= right
    else:
        lefts, keys = np.unique(left, return_inverse=True)
        ranks, place = np.unique(right, return_inverse=True)
        keys = keys * len(ranks) + place
        del place
    # The keys have all of the pairs: nothing else of their length is held longer than needed.
    del left, right
    if counts is None:
        # Sorting alone is faster than sorting places.
        keys.sort()
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        del order
    fresh = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
    first = np.flatnonzero(fresh)
    found = keys[first]
    times = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)
    if fits:
        return found >> wide, found & ((1 << wide) - 1), times
    return lefts[found // len(ranks)], ranks[found % len(ranks)], times


def dense(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The same for pairs of one tile, from a cell for each pair."""
    inside = (1 << TILE_BITS) - 1
    cells = np.zeros(1 << 2 * TILE_BITS, np.int64 if counts is None else np.float64)
    for at in range(0, len(left), _CELLS_AT_ONCE):
        some = slice(at, at + _CELLS_AT_ONCE)
        cell = ((left[some] & inside) << TILE_BITS) | (right[some] & inside)
        cells += np.bincount(cell, None if counts is None else counts[some], len(cells))
    used = np.flatnonzero(cells)
    return (left[0] & ~inside) | (used >> TILE_BITS), (right[0] & ~inside) | (used & inside), cells[used].astype(np.int64)


def tiled(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, bits: int) -> Iterator[tuple[int, np.ndarray, ...]]:
    """Tile, distinct pairs and the sums of their counts."""
    across = HEAD_BITS - TILE_BITS
    near = (left < 1 << HEAD_BITS) & (right < 1 << HEAD_BITS)
    kind = np.min_scalar_type(1 << 2 * across)
    # Tiles of the head, from 1 on, and 0 for all other pairs.
    tile = np.zeros(len(left), kind)
    for at in range(0, len(left), _AT_ONCE):
        some = slice(at, at + _AT_ONCE)
        tile[some] = np.where(near[some], (((left[some] >> TILE_BITS) << across) | (right[some] >> TILE_BITS)) + 1, 0)
    del near
    held = sum(
        (np.bincount(tile[at : at + _AT_ONCE], minlength=(1 << 2 * across) + 1)[1:] for at in range(0, len(tile), _AT_ONCE)),
        np.zeros(1 << 2 * across, np.int64),
    )
    rest = np.ones(len(left), bool)
    for t in np.flatnonzero(held >= (1 << 2 * TILE_BITS) // _DENSE_CELLS):
        mine = np.flatnonzero(tile == t + 1)
        yield int(~t), *dense(left[mine], right[mine], None if counts is None else counts[mine])
        rest[mine] = False
        del mine
    del tile
    left, right, counts = left[rest], right[rest], None if counts is None else counts[rest]
    del rest
    wanted = [left, right]
    del left, right
    a, b, c = summed(wanted.pop(0), wanted.pop(), counts)
    del counts
    of = tile_of(a, b, bits)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield int(of[at[0]]), a[at], b[at], c[at]


def _part(lang: str, block: int, tile: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> dict:
    packed = pack(np.diff(left, prepend=0), right, counts)
    return {"block": block, "lang": lang, "tile": tile, "entries": len(left), "packed": packed}


def _opened(packed: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """Pairs and counts of all parts, which are opened one after the other."""
    sizes = [int(np.frombuffer(p.as_buffer(), np.int64, 1, 8)[0]) for p in packed]
    out = tuple(np.empty(sum(sizes), np.int64) for _ in range(3))
    end = 0
    for size, p in zip(sizes, packed, strict=True):
        begin, end = end, end + size
        steps, right, counts = unpack(p.as_py())
        np.cumsum(steps, out=out[0][begin:end])
        out[1][begin:end], out[2][begin:end] = right, counts
    return out


def found_at(left: np.ndarray, right: np.ndarray, known: tuple[np.ndarray, ...]) -> np.ndarray:
    """Rank of the pair at each place, -1 where the pair is none of the known ones (left, right, rank)."""
    out = np.full(len(left), -1, np.int64)
    at = np.flatnonzero((left >= 0) & (right >= 0))
    if not len(at) or not len(known[0]):
        return out
    lefts, rights = np.unique(known[0]), np.unique(known[1])
    a, b = np.searchsorted(lefts, left[at]), np.searchsorted(rights, right[at])
    near = (a < len(lefts)) & (b < len(rights))
    at, a, b = at[near], a[near], b[near]
    same = (lefts[a] == left[at]) & (rights[b] == right[at])
    at, keys = at[same], a[same] * len(rights) + b[same]
    table = np.searchsorted(lefts, known[0]) * len(rights) + np.searchsorted(rights, known[1])
    order = np.argsort(table)
    place = np.minimum(np.searchsorted(table[order], keys), len(table) - 1)
    same = table[order][place] == keys
    out[at[same]] = known[2][order][place[same]]
    return out


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """The numbers in 32 bits if they, and one more than each, fit."""
    return numbers.astype(np.int32) if numbers.max(initial=0) < 2**31 - 1 else numbers


def _level(length: int, last: bool, bits: int):
    """Function of a block and what is known of it, ranks of its words or of its phrases: the parts of tiles that the
    phrases of ``length`` words make, and the symbols of the next level unless it is the last."""

    def pairs(key: tuple, blocks: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        for block in blocks.to_pylist():
            words = _narrow(unpack(block["words"])[0]) - 1
            if length == 2:
                table = np.full(max(int(words.max(initial=0)), 0) + 2, -1, np.int64)
                table[known.column("code").to_numpy()] = known.column("id").to_numpy()
                table[-1] = -1
                words = phrases = _narrow(table)[words]
            else:
                phrases = _narrow(unpack(block["phrases"])[0]) - 1
                parts = [unpack(p) for p in known.column("packed").to_pylist()]
                ranks = tuple(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(3))
                phrases = _narrow(found_at(phrases[: len(words) - length + 2], words[length - 2 :], ranks))
                del parts, ranks
            right = words[length - 1 :]
            left, rest = phrases[: len(right)], phrases[1 : len(right) + 1]
            whole = (left >= 0) & (right >= 0) & (rest >= 0)
            if not whole.any():
                continue
            made = tiled(left[whole].astype(np.int64), right[whole].astype(np.int64), None, bits)
            rows += [_part(block["lang"], block["block"], *part) for part in made]
            if not last:
                rows.append(
                    {"block": block["block"], "lang": block["lang"], "words": pack(words + 1), "phrases": pack(phrases + 1)}
                )
        return pa.Table.from_pylist(rows, _LEVEL_SCHEMA)

    return pairs


def merged(parts: DataFrame, bits: int, min_count: int, merge_entries: int) -> DataFrame:
    """Pairs of all blocks with counts of ``min_count`` or more: lang, tile (with the bits of the parts), left, right, count."""
    first_bits, held = bits, None
    while True:
        sizes = parts.groupBy("lang", "tile").agg(F.sum("entries").alias("_all"), F.count("*").alias("_parts"))
        # At most one row for every merge_entries entries, so these are few whatever the size of the corpus.
        large = written(
            sizes.where((F.col("_all") > merge_entries) & (F.col("_parts") > 1))
            .select("lang", "tile", "_all", F.ceil(F.col("_all") / merge_entries).alias("_shares")), "large-tiles"
        )
        before, held = held, large.agg(F.sum("_all")).first()[0]
        # Tiles of fewer cells than merge_entries always shrink; with smaller settings a merge may hold more.
        if held is None or (held == before and bits == _MOST_BITS):
            break
        bits = min(bits + _MORE_BITS, _MOST_BITS)
        share = F.pmod(F.xxhash64("block", F.lit(bits)), F.coalesce("_shares", F.lit(1)))
        dealt = parts.join(F.broadcast(large), ["lang", "tile"], "left").withColumn("_share", share).drop("_shares", "_all")
        parts = written(dealt.groupBy("lang", "tile", "_share").applyInArrow(_merge(bits), _LEVEL), "merged-tiles")

    def total(key: tuple, table: pa.Table) -> pa.Table:
        out = []
        for _, left, right, counts in tiled(*_opened(table.column("packed")), bits):
            often = counts >= min_count
            left, right, counts = left[often], right[often], counts[often]
            lang = pa.array([key[0].as_py()] * len(left), pa.string())
            out.append(
                pa.RecordBatch.from_arrays(
                    [lang, *(pa.array(a, pa.int64()) for a in (tile_of(left, right, first_bits), left, right, counts))],
                    ["lang", "tile", "left", "right", "count"],
                )
            )
        return pa.Table.from_batches(out)

    return parts.groupBy("lang", "tile").applyInArrow(total, "lang string, tile long, left long, right long, count long")


def _merge(bits: int):
    """Function that makes one part of many, split by buckets of more bits."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        parts = tiled(*_opened(table.column("packed")), bits)
        return pa.Table.from_pylist([_part(key[0].as_py(), block, *part) for part in parts], _LEVEL_SCHEMA)

    return merge


def _known(parts: DataFrame, frequent: DataFrame, merge_entries: int) -> DataFrame:
    """For each block and tile, the frequent pairs in it with their ranks: block, lang, packed (left, right, rank)."""
    sizes = parts.groupBy("lang", "tile").agg(F.ceil(F.sum("entries") / merge_entries).alias("_shares"))
    large = written(sizes.where(F.col("_shares") > 1), "large-tiles")
    shares = F.coalesce("_shares", F.lit(1)).cast("long")
    dealt = parts.join(F.broadcast(large), ["lang", "tile"], "left")
    dealt = dealt.select("block", "lang", "tile", "packed", F.pmod(F.xxhash64("block"), shares).alias("_share"))
    copies = frequent.join(F.broadcast(large), ["lang", "tile"], "left")
    copies = copies.select(
        F.col("lang").alias("_lang"), F.col("tile").alias("_tile"), "left", "right", "id",
        F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("_copy"),
    )

    def meet(key: tuple, table: pa.Table, pairs: pa.Table) -> pa.Table:
        ranks = tuple(pairs.column(name).to_numpy() for name in ("left", "right", "id"))
        rows = []
        if len(ranks[0]):
            for block, lang, packed in zip(*(table.column(name).to_pylist() for name in ("block", "lang", "packed")), strict=True):
                steps, right, _ = unpack(packed)
                left = np.cumsum(steps)
                rank = found_at(left, right, ranks)
                at = rank >= 0
                if at.any():
                    rows.append({"block": block, "lang": lang, "packed": pack(left[at], right[at], rank[at])})
        return pa.Table.from_pylist(rows, pa.schema([_LEVEL_SCHEMA.field(n) for n in ("block", "lang", "packed")]))

    grouped = dealt.groupBy("lang", "tile", "_share").cogroup(copies.groupBy("_lang", "_tile", "_copy"))
    return grouped.applyInArrow(meet, "block long, lang string, packed binary")


def ranked(counts: DataFrame, *ties: str) -> DataFrame:
    """``counts`` with ``id``, the place of a row in its language by falling ``count``, from 0; no language is in one task."""
    order = [F.col("lang"), F.col("count").desc(), *(F.col(t) for t in ties)]
    rows = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(
        rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ranked"
    )
    parts = rows.groupBy("lang", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("lang").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # A row for each language in each partition: at most languages and partitions together.
    placed = rows.join(F.broadcast(parts), ["lang", "_part"])
    return placed.withColumn("id", F.col("_before") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_before")


def counts(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
    block_words: int = BLOCK_WORDS, merge_entries: int = MERGE_ENTRIES,
) -> tuple[DataFrame, DataFrame]:
    """Frequent words and phrases (lang, length, phrase, count), and all words of a language (lang, n)."""
    blocks = written(_blocks(docs.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")), block_words), "blocks")
    words = blocks.where(F.col("word").isNotNull())
    totals = written(words.groupBy("lang").agg(F.sum("count").alias("n")), "totals")
    frequent = words.groupBy("lang", "word").agg(F.sum("count").alias("count")).where(F.col("count") >= min_count)
    vocabulary = written(ranked(frequent, "word"), "vocabulary")
    known = words.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).select("block", "code", "id")
    symbols = blocks.where(F.col("symbols").isNotNull())
    symbols = symbols.select("block", "lang", F.col("symbols").alias("words"), F.lit(None).cast("binary").alias("phrases"))
    names = vocabulary.select("lang", "id", F.col("word").alias("phrase"), "count")
    found = [names.withColumn("length", F.lit(1))]
    bits = int(totals.agg(F.sum("n")).first()[0] or 0) // max(merge_entries // 4, 1)
    bits = min(bits.bit_length(), _FIRST_BITS)
    for length in range(2, max_words + 1):
        last = length == max_words
        grouped = symbols.groupBy("block").cogroup(known.withColumnRenamed("block", "_block").groupBy("_block"))
        level = written(grouped.applyInArrow(_level(length, last, bits), _LEVEL), f"level-{length}")
        parts = level.where(F.col("packed").isNotNull()).drop("words", "phrases")
        total = merged(parts, bits, min_count, merge_entries)
        total = written(total if last else ranked(total, "left", "right"), f"pairs-{length}")
        first = found[-1].select("lang", F.col("id").alias("left"), F.col("phrase").alias("_first"))
        second = names.select("lang", F.col("id").alias("right"), F.col("phrase").alias("_second"))
        phrases = total.join(first, ["lang", "left"]).join(second, ["lang", "right"])
        phrases = phrases.withColumn("phrase", F.concat_ws(" ", "_first", "_second")).withColumn("length", F.lit(length))
        found.append(written(phrases.drop("left", "right", "tile", "_first", "_second"), f"phrases-{length}"))
        if not last:
            known = _known(parts, total, merge_entries)
            symbols = level.where(F.col("words").isNotNull()).select("block", "lang", "words", "phrases")
    out = found[0].select("lang", "length", "phrase", "count")
    for more in found[1:]:
        out = out.unionByName(more.select("lang", "length", "phrase", "count"))
    return out, totals


def collocations(
    docs: DataFrame, *, inside_percent: int = INSIDE_PERCENT, top: int | None = TOP, **settings
) -> DataFrame:
    """The first ``top`` phrases of each language (None: all): lang, rank, phrase, a, l, r, n, score.

    ``settings`` are those of ``counts``.
    """
    frequent, totals = counts(docs, **settings)
    phrases = frequent.where(F.col("length") > 1).withColumnRenamed("count", "a")
    # A longer phrase that covers one covers the phrases of one word more in between at least as often.
    longer = phrases.where(F.col("length") > 2).select(
        "lang", "a", F.explode(F.array(_head("phrase", F.col("length") - 1), _tail("phrase", F.lit(1)))).alias("phrase")
    )
    covers = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_over"))
    free = phrases.join(covers, ["lang", "phrase"], "left").where(
        F.col("_over").isNull() | (_exact(100, "_over") < _exact(inside_percent, "a"))
    )
    cuts = free.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")).select(
        "*", _head("phrase", F.col("k")).alias("_head"), _tail("phrase", F.col("k")).alias("_tail")
    )
    known = frequent.select("lang", "phrase", "count")
    cuts = cuts.join(known.toDF("lang", "_head", "l"), ["lang", "_head"]).join(known.toDF("lang", "_tail", "r"), ["lang", "_tail"])
    score = F.expr(
        "cast((cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0)))"
        " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)"
    )
    lowest = (
        cuts.withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
        .select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    )
    placed = ranked(lowest.withColumn("count", F.col("score")).withColumn("_a", -F.col("a")), "_a", "phrase")
    lowest = placed.withColumn("rank", F.col("id") + 1)
    if top is not None:
        lowest = lowest.where(F.col("rank") <= top)
    return lowest.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def _exact(factor: int, column: str):
    return F.col(column).cast("decimal(20,0)") * F.lit(factor).cast("decimal(10,0)")


def _head(phrase: str, words):
    """The first words of a phrase."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), words)


def _tail(phrase: str, words):
    """A phrase without its first words."""
    return F.substring(F.col(phrase), F.length(_head(phrase, words)) + 2, F.length(F.col(phrase)))
