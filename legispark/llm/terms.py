"""Words of whole Arrow batches of texts as exact codes: one dictionary entry per different word, one integer per occurrence."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from legispark.llm.words import _TABLE, _power, as_bytes, mix64, parts

#: Texts are handled in parts of at least one text and about so many bytes.
BLOCK_BYTES = 8 << 20


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes separate words: those of the inclusive ranges."""
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


class Coded(NamedTuple):
    """Words of consecutive texts: the text of each, where it begins and ends, its code, and the word of each code."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    words: pa.Array


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; no byte of another character is in that range."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)


def coded(data: np.ndarray, offset: np.ndarray, separators: np.ndarray, apart: np.ndarray | None = None) -> Coded:
    """The words of the texts that lie at ``offset`` in ``data``. Equal words have equal codes; no hash decides that.

    ``apart`` marks bytes at which a word begins although no separator is before it.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offset] = True
    if apart is not None:
        edge[:n] |= apart
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.repeat(np.arange(len(offset) - 1), np.diff(np.searchsorted(start, offset)))
    place = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    kinds = words.dictionary_encode()
    return Coded(row, start, end, kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64), kinds.dictionary)


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word that depends on its bytes alone."""
    data, offset = as_bytes(words.cast(pa.large_string()))
    up, down = _power(len(data) + 1)
    value = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=value[1:])
    start, end = offset[:-1], offset[1:]
    return mix64((value[end] - value[start]) * down[start] + (end - start).astype(np.uint64))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with about ``size`` bytes of text, at least one, with the bytes of the texts and where each begins."""
    for batch in batches:
        for begin, end in parts(batch[column], size):
            rows = batch.slice(begin, end - begin)
            yield rows, *as_bytes(rows[column])
