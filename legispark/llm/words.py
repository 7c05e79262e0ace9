"""Words and their 64-bit hashes for whole Arrow batches of texts, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: The separators of ``[^\\x20\\x09-\\x0D]+``, and of runs of ASCII letters, digits and non-ASCII characters.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Texts are handled in parts of at least one text and about so many bytes.
PART_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[0x41:0x5B] = _TABLE[0x61:0x7B]
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(max(n, PART_BYTES + 1), base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


class Words(NamedTuple):
    """Words of consecutive texts: ``first[i]:first[i + 1]`` are those of the i-th text."""

    first: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    offset: np.ndarray
    value: np.ndarray


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings of the column and where each begins; a null is as an empty string."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    offset = np.frombuffer(offsets, np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offset[0] : offset[-1]], offset - offset[0]


def parts(column: pa.Array, size: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text."""
    _, offset = as_bytes(column)
    begin, n = 0, len(offset) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offset, offset[begin] + size, "right")) - 1)
        yield begin, end
        begin = end


def split(data: np.ndarray, offset: np.ndarray, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    """Words of the texts that lie at ``offset`` in ``data``. ``lower`` hashes A-Z as a-z."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offset] = True
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    up, down = _power(n + 1)
    value = np.empty(n + 1, np.uint64)
    value[0] = 0
    np.cumsum((_LOWER if lower else _TABLE)[data] * up[:n], out=value[1:])
    hashed = mix64((value[end] - value[start]) * down[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, offset)
    return Words(first, np.repeat(np.arange(len(offset) - 1), np.diff(first)), start, end, hashed, data, offset, value)


def prefixes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first n characters of the words that have so many, and which words these are."""
    begins = (words.data & 0xC0) != 0x80
    chars = np.nonzero(begins)[0]
    rank = np.concatenate(([0], np.cumsum(begins)))
    long = np.nonzero(rank[words.end] - rank[words.start] >= n)[0]
    start, last = words.start[long], rank[words.start[long]] + n
    end = np.where(last < len(chars), chars[np.minimum(last, max(len(chars) - 1, 0))], len(words.data)) if len(long) else start
    down = _power(len(words.data) + 1)[1]
    return mix64((words.value[end] - words.value[start]) * down[start] + (end - start).astype(np.uint64)), long


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words at each word, and which of them lie within one text."""
    total = len(words.hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(total - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + words.hash[k : total - n + 1 + k]
    return mix64(out), words.row[: total - n + 1] == words.row[n - 1 :]
