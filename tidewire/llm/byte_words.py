"""Words of many texts at once, from the UTF-8 bytes of an Arrow column.

A word is a run of word bytes; every byte above 0x7F is one, so all characters beyond ASCII are.  Texts are read
in slices of a bounded number of bytes, and no Python string is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text taken at once; one longer text is a slice of its own.
SLICE_BYTES = 8 << 20


class Words(NamedTuple):
    """Words of a slice: their text, the place of their first byte and behind their last one, and their row."""

    array: pa.Array
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    data: np.ndarray


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags that are set in the ranges, ends included."""
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower()


def freed() -> None:
    """Give memory back that Arrow keeps for later: a worker is used again, and by tasks that do other work."""
    pa.default_memory_pool().release_unused()


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows (from, to) with their bytes and the bytes' bounds by row; a null is an empty text."""
    if not len(texts):
        return
    array = texts.cast(pa.large_binary()).fill_null(b"")
    _, bounds, data = array.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(array) + 1, array.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(array):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + size, "right")) - 1)
        end = min(end, len(array))
        yield begin, end, data[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin]
        begin = end


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray, lower_case: bool = True) -> Words:
    """Words of the texts of a slice in order, in lower case for A to Z; ``inside`` flags the bytes of words."""
    lower = LOWER[data] if lower_case else data
    word = inside[lower]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    start = np.flatnonzero(word & (~before | fresh[:-1]))
    end = np.flatnonzero(word & (~after | fresh[1:])) + 1
    row = np.searchsorted(bounds, start, "right") - 1
    kept = lower[word]
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    return Words(array, start, end, row, lower)
