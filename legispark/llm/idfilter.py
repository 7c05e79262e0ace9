"""A Bloom filter of ids with a size bound, to keep texts that no join wants out of a shuffle.

It only saves work: what passes still meets the exact join, and where more ids come than the bound serves, more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legispark.llm.words import mix64

#: Bits per id, and bits at most (4 MB).
BITS_PER_ID, MOST_BITS = 16, 1 << 25


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix64(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)])


def id_filter(ids: DataFrame) -> np.ndarray:
    """The filter's words for the ids in the first column of ``ids`` (long, no nulls)."""
    n = ids.count()
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS_PER_ID * n):
        bits *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.nonzero(words)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], names=["word", "bits"])

    out = np.zeros(bits // 64, np.uint64)
    for row in ids.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[row[0]] = np.int64(row[1]).view(np.uint64)
    return out


def may_hold(words: np.ndarray, ids: pa.Array) -> np.ndarray:
    """For each id whether it may be in the filter; a null is not."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    at = _places(ids.fill_null(0).to_numpy(), len(words) * 64)
    hit = (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
    return known & (hit[0] & hit[1]).astype(bool)
