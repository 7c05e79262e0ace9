"""Packing documents into training sequences of a fixed length: bounded-space online best fit.

Each partition is read once. Its documents are turned into ids, and their pieces are laid into a fixed number of open
windows: a piece goes whole into the window that it fills best; when it fits none, the fullest window is completed with
the piece's first ids and emitted, and the rest of the piece is placed anew. Pieces are not cut below ``LEAST`` ids, so a
window may be emitted with a gap of fewer. The windows that are open when a partition ends are merged with those of other
partitions, ``FAN_IN`` groups at a time, in rounds, until one group is left; what then does not fill a sequence is cut into
lengths that are powers of two, which need no padding.

Ids are those of the tokenizer, then ``end``. A text is split at white space, which the tokenizer drops, and between
letters and marks, which it never joins; each different word is tokenized once per batch and remembered, and ids are gathered for whole batches.

Null and empty texts have the id ``end`` alone. Every row is a document of its own, also without a doc_id or with one that
others share; ``document`` numbers the rows. An empty table gives no rows. Other columns are not read. A task holds a block
of texts (about ``BLOCK_BYTES``, or one text), its ids, ``OPEN`` windows and at most ``MEMORY`` remembered words.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legispark.llm.storage import materialize
from legispark.llm.terms import blocks, coded, table

#: Bytes at which a text may be split: white space, which this tokenizer drops.
WHITE = table((0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D))
#: Marks that are never in one token with an ASCII letter or digit beside them.
MARKS, ALNUM = table(*((ord(c), ord(c)) for c in ".,;:!?")), table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
LENGTH = 4096
#: Windows that a partition keeps open, and the fewest ids of a piece that a cut leaves on either side.
OPEN, LEAST = 32, 16
#: Partitions whose open windows one task merges.
FAN_IN = 32
#: Words whose ids a worker remembers.
MEMORY = 1 << 20

PIECE = "doc_id long, document long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_FIELDS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("document", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])
#: Sequence numbers: the round and the task above, the sequence of the task below.
TASK_BITS, ROUND_BITS = 30, 57


class _Tokenizer:
    """Ids of different words, remembered between batches of a worker: the words' numbers, and the ids of all of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of the words, which hold until the next call; ``begin`` and ``flat`` have their ids."""
        if len(self.number) + len(words) > MEMORY:
            self._forget()
        new = [w for w in words if w not in self.number]
        if new:
            found = [e.ids for e in self.encode(new, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.number |= zip(new, range(len(self.number), len(self.number) + len(new)), strict=True)
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def tokenized(tokenizer: _Tokenizer, data: np.ndarray, offset: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by ``end``, and where each text's ids begin."""
    mark, alnum, apart = MARKS[data], ALNUM[data], np.zeros(len(data), bool)
    apart[1:] = (mark[1:] & alnum[:-1]) | (mark[:-1] & alnum[1:])
    words = coded(data, offset, WHITE, apart)
    number = tokenizer.numbers(words.words.cast(pa.large_string()).to_pylist())[words.code]
    begin, flat = tokenizer.begin, tokenizer.flat
    size = begin[number + 1] - begin[number]
    n = len(offset) - 1
    per_text = np.bincount(words.row, size, n).astype(np.int64) + 1
    first = np.concatenate(([0], np.cumsum(per_text)))
    # A word's ids lie after those of the words before it and one end for each text before its own.
    before = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    out = np.full(first[-1], end, np.uint32)
    out[step + np.repeat(words.row, size)] = flat[step + np.repeat(begin[number] - before, size)]
    return out, first


class _Windows:
    """Open windows, ordered by the room that is left in them."""

    def __init__(self, length: int):
        self.length, self.rooms, self.held, self.number = length, [], {}, 0
        self.done: list[tuple[int, list]] = []

    def _close(self, window: int) -> None:
        self.done.append((window, self.held.pop(window)))

    def add(self, piece: tuple) -> None:
        """``piece``: doc_id, document, start, doc_tokens, ids."""
        while True:
            size = len(piece[4])
            if size >= self.length:
                self.done.append((self.number, [self._part(piece, 0, self.length)]))
                self.number += 1
                if size == self.length:
                    return
                piece = self._part(piece, self.length, size)
                continue
            at = bisect_left(self.rooms, (size, -1))
            if at < len(self.rooms):
                room, window = self.rooms.pop(at)
                self.held[window].append(piece)
                if room == size:
                    self._close(window)
                else:
                    insort(self.rooms, (room - size, window))
                return
            if len(self.rooms) < OPEN:
                self.held[self.number] = [piece]
                insort(self.rooms, (self.length - size, self.number))
                self.number += 1
                return
            room, window = self.rooms.pop(0)
            head = min(room, size - LEAST)
            if head >= LEAST:
                self.held[window].append(self._part(piece, 0, head))
                piece = self._part(piece, head, size)
            self._close(window)

    @staticmethod
    def _part(piece: tuple, begin: int, end: int) -> tuple:
        return (*piece[:2], piece[2] + begin, piece[3], piece[4][begin:end])

    def emitted(self) -> list[tuple[int, list]]:
        out, self.done = self.done, []
        return out


def _rows(sequences: list[tuple[int | None, list]], with_ids: bool) -> Iterator[pa.RecordBatch]:
    columns: dict[str, list] = {f.name: [] for f in _FIELDS}
    size = 0
    for sequence, pieces in sequences:
        offset = 0
        for doc_id, document, start, total, ids in pieces:
            raw = ids.tobytes()
            row = (doc_id, document, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw if with_ids or sequence is None else None)
            for c, x in zip(columns.values(), row, strict=True):
                c.append(x)
            offset += len(ids)
            size += len(raw)
        if size > 4 << 20 or len(columns["length"]) > 20_000:
            yield pa.RecordBatch.from_pydict(columns, schema=_FIELDS)
            columns, size = {f.name: [] for f in _FIELDS}, 0
    if columns["length"]:
        yield pa.RecordBatch.from_pydict(columns, schema=_FIELDS)


def _pack(path: str, end: int, length: int, with_ids: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        tokenizer, windows, document = _Tokenizer(path), _Windows(length), task << 33
        for rows, data, offset in blocks(batches):
            ids, first = tokenized(tokenizer, data, offset, end)
            for k, doc_id in enumerate(rows["doc_id"].to_pylist()):
                windows.add((doc_id, document, 0, int(first[k + 1] - first[k]), ids[first[k] : first[k + 1]]))
                document += 1
            # Open windows keep copies, so that the block's ids can go.
            for held in windows.held.values():
                held[:] = [(*p[:4], p[4] if p[4].base is None else p[4].copy()) for p in held]
            yield from _rows([(task << TASK_BITS | w, pieces) for w, pieces in windows.emitted()], with_ids)
        yield from _rows([(None, pieces) for pieces in windows.held.values()], with_ids)

    return each


def _merge(length: int, turn: int, last: bool, with_ids: bool):
    """Packs the pieces of the open windows of a group of partitions; ``last`` leaves none open."""

    def each(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        windows, number = _Windows(length), key[0].as_py()
        base = turn << ROUND_BITS | number << TASK_BITS
        rows = zip(*(group[c].to_pylist() for c in ("length", "document", "start", "doc_id", "doc_tokens", "ids")), strict=True)
        for _, document, start, doc_id, total, raw in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
            windows.add((doc_id, document, start, total, np.frombuffer(raw, np.uint32)))
        done: list[tuple[int | None, list]] = [(base | w, pieces) for w, pieces in windows.emitted()]
        left = list(windows.held.values())
        if last:
            rest = _cut([p for pieces in left for p in pieces], length)
            done += [(base | windows.number + k, pieces) for k, pieces in enumerate(rest)]
        else:
            done += [(None, pieces) for pieces in left]
        out = pa.Table.from_batches(_rows(done, with_ids), schema=_FIELDS)
        return out.add_column(0, "group", pa.array([number] * len(out), pa.int64()))

    return each


def _cut(pieces: list[tuple], length: int) -> Iterator[list[tuple]]:
    """The pieces one after another, as whole sequences first and then as the powers of two that make up the rest."""
    total, pieces = sum(len(p[4]) for p in pieces), pieces[::-1]
    for room in [length] * (total // length) + [1 << b for b in range(length.bit_length(), -1, -1) if (total % length) >> b & 1]:
        sequence = []
        while room:
            piece = pieces.pop()
            if len(piece[4]) > room:
                pieces.append(_Windows._part(piece, room, len(piece[4])))
                piece = _Windows._part(piece, 0, room)
            sequence.append(piece)
            room -= len(piece[4])
        yield sequence


def pack(docs: DataFrame, tokenizer: str, end: int = 2, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, document (number of its row), start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, unless ``with_ids`` is false, ids (little-endian unsigned 32-bit).

    ``tokenizer`` is the path of a vocabulary that every executor has. Every id lies in exactly one piece; a sequence has at
    most ``length`` ids. At most one group of ``FAN_IN * OPEN`` windows is merged by a task.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = materialize(read.mapInArrow(_pack(tokenizer, end, length, with_ids), PIECE), "packed")
    parts, turn = [packed.filter("sequence_id IS NOT NULL")], 0
    left = packed.filter("sequence_id IS NULL").withColumn("group", F.shiftrightunsigned(F.col("document"), 33))
    highest = left.agg(F.max("group")).first()[0]
    while highest is not None:
        turn, last = turn + 1, highest < FAN_IN
        grouped = left.withColumn("group", F.shiftright(F.col("group"), FAN_IN.bit_length() - 1)).groupBy("group")
        merged = materialize(grouped.applyInArrow(_merge(length, turn, last, with_ids), f"group long, {PIECE}"), "merged")
        parts.append(merged.filter("sequence_id IS NOT NULL").drop("group"))
        left = merged.filter("sequence_id IS NULL")
        highest = None if last else highest // FAN_IN
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole if with_ids else whole.drop("ids")
