"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words. Its minimiser is the least hash among its ``GRAM``-word grams; windows that
share text share the minimiser. Consecutive windows with one minimiser form a super-k-mer, which needs its words only
once.

1. One pass lists each text's super-k-mers without their words. A minimiser that one document alone has cannot hold a
   repeated window, so only minimisers of several documents go on. Exact copies of a text are settled by the text's
   digest and do not take part.
2. The super-k-mers that are left travel as one packed string each to the bucket of their minimiser, where sorting
   their windows finds the least document of each. Buckets of many rows are dealt out by window instead: each window's
   least document is a grouped minimum, combined before the shuffle.
3. Windows that a smaller document also has come back to their document as word ranges; covered words go.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legispark.llm.idfilter import id_filter, may_hold
from legispark.llm.storage import materialize
from legispark.llm.words import as_bytes, grams, mix64, parts, split

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of a minimiser's gram, and rows above which a bucket is dealt out by window. Both ways are exact; a bucket of
#: more rows than this would stand out among the buckets of a task.
GRAM, BUCKET_ROWS = 16, 1024


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values, by doubling."""
    reach = 1
    while reach * 2 <= n:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (n - reach)], x[n - reach :]) if n > reach else x


def _super_kmers(width: int, gram: int):
    """Per row: id, text hash, words, digest of the words, sha256 of the joined words, and the super-k-mers as three arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offset = as_bytes(batch.column(2))
            for a, b in parts(batch.column(2)):
                part = data[offset[a] : offset[b]]
                words = split(part, offset[a : b + 1] - offset[a])
                raw = part.tobytes()
                spans = list(zip(words.start.tolist(), words.end.tolist(), strict=True))
                least, row = np.zeros(0, np.uint64), words.row
                if len(words.hash) >= width:
                    value, _ = grams(words, gram)
                    least = _sliding_least(value, width - gram + 1)
                    whole = row[: len(least)] == row[width - 1 :]
                    at = np.nonzero(whole)[0]
                    key = least[at]
                    new = np.ones(len(at), bool)
                    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
                    begin = np.nonzero(new)[0]
                    count = np.diff(np.append(begin, len(at)))
                    start, key = at[begin], key[begin].view(np.int64)
                else:
                    start, key, count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                bound = np.searchsorted(start, words.first)
                local = start - words.first[row[start]] if len(start) else start
                digest, sha = [], []
                for k in range(b - a):
                    joined = b" ".join([raw[x:y] for x, y in spans[words.first[k] : words.first[k + 1]]])
                    sha.append(hashlib.sha256(joined).hexdigest())
                    digest.append(hashlib.blake2b(joined, digest_size=16).digest())
                lists = [pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(x)) for x in (key, local.astype(np.int32), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (0, 1)), pa.array(np.diff(words.first).astype(np.int64)), pa.array(digest, pa.binary()), pa.array(sha), *lists], names=["id", "row", "n_words", "digest", "sha", "keys", "starts", "counts"])

    return run


def _cut(width: int):
    """Super-k-mers with their words as one string, from texts and (key, start, count, hot) lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for ident, row, text, runs in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                words = WORD.findall(zlib.decompress(text).decode())
                for r in runs:
                    packed = " ".join(words[r["start"] : r["start"] + r["count"] + width - 1])
                    for column, x in zip(out, (r["key"], ident, row, r["start"], packed, r["hot"]), strict=True):
                        column.append(x)
                if len(out[0]) > 20_000:
                    yield _cut_batch(out)
                    out = [[] for _ in range(6)]
            yield _cut_batch(out)

    return run


def _cut_batch(out: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["key", "id", "row", "start", "words", "hot"])


def _window_digests(data: np.ndarray, offset: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the digest of each window of consecutive texts, its text, and its first word there."""
    words = split(data, offset)
    if len(words.hash) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, whole = grams(words, width)
    two, _ = grams(words._replace(hash=mix64(words.hash ^ np.uint64(0xA0761D6478BD642F))), width)
    at = np.nonzero(whole)[0]
    row = words.row[at]
    return one[at].view(np.int64), two[at].view(np.int64), row, at - words.first[row]


def _count_buckets(width: int):
    """Word ranges of windows that a smaller document has. Rows come sorted by key; whole buckets are sorted together, window by window, until some thousand rows are gathered."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        key, ident, text, start = (np.array([r[c] for r in rows], np.int64) for c in range(4))
        found: list[np.ndarray] = []
        if rows:
            one, two, row, at = _window_digests(*as_bytes(pa.array([r[4] for r in rows], pa.string())), width)
            order = np.lexsort((ident[row], two, one, key[row]))
            k, x, y = key[row][order], one[order], two[order]
            new = np.ones(len(order), bool)
            new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            least = ident[row[order]][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
            marked = np.sort(order[ident[row[order]] > least])  # in the order of rows and places again
            row, at = row[marked], at[marked]
            first = np.ones(len(marked), bool)
            first[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + width)
            begin = np.nonzero(first)[0]
            end = np.append(begin[1:], len(marked)) - 1
            if len(marked):
                found = [ident[row[begin]], text[row[begin]], start[row[begin]] + at[begin], start[row[begin]] + at[end] + width]
        return _range_batch(found or [[], [], [], []])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if len(rows) >= 2048 and rows[-1][0] != r[0]:
                    yield settle(rows)
                    rows = []
                rows.append(r)
        yield settle(rows)

    return run


def _range_batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "row", "low", "high"])


def _windows(width: int):
    """(window digest in two halves, id, text hash, word ranges) of the windows of packed strings, each window of a string once.

    A window that a string repeats, as where a word or line is repeated, has the ranges of all its places, those that
    overlap joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offset = as_bytes(batch.column(3))
            ids, texts, starts = (batch.column(c).to_numpy() for c in range(3))
            for a, b in parts(batch.column(3)):
                one, two, row, at = _window_digests(data[offset[a] : offset[b]], offset[a : b + 1] - offset[a], width)
                order = np.lexsort((at, two, one, row))
                one, two, row, at = one[order], two[order], row[order], at[order]
                other = np.ones(len(at), bool)
                other[1:] = (row[1:] != row[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                apart = other.copy()
                apart[1:] |= at[1:] > at[:-1] + width
                window, begin = np.nonzero(other)[0], np.nonzero(apart)[0]
                end = np.append(begin[1:], len(at))[: len(begin)] - 1
                bound = pa.array(np.append(np.searchsorted(begin, window), len(begin)).astype(np.int32))
                low, high = ((starts[a + row[x]] + at[x] + more).astype(np.int32) for x, more in ((begin, 0), (end, width)))
                lists = [pa.ListArray.from_arrays(bound, pa.array(x)) for x in (low, high)]
                yield pa.RecordBatch.from_arrays([pa.array(one[window]), pa.array(two[window]), pa.array(ids[a + row[window]]), pa.array(texts[a + row[window]]), *lists], names=["one", "two", "id", "row", "lows", "highs"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, words removed, sha256 of what is kept, kept text) of texts with ranges."""
    for batch in batches:
        removed, sha, kept_text = [], [], []
        for text, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words, kept, upto = WORD.findall(zlib.decompress(text).decode()), [], 0
            for r in sorted((r["low"], r["high"]) for r in ranges):
                kept += words[upto : max(upto, r[0])]
                upto = max(upto, r[1])
            kept += words[upto:]
            removed.append(len(words) - len(kept))
            kept_text.append(" ".join(kept))
            sha.append(hashlib.sha256(kept_text[-1].encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], names=["id", "digest", "n_removed", "sha", "kept_text"])


def _packed(wanted: np.ndarray):
    """(id, text hash, compressed text) of documents that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(wanted, batch.column(0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([zlib.compress((t or "").encode(), 1) for t in batch.column(2).to_pylist()], pa.binary())], names=["id", "row", "packed"])

    return run


def remove_repeats(docs: DataFrame, width: int = 50, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) per row; kept_text only where something was removed.

    Every word goes that lies in a window whose words also start in a document of a smaller doc_id; windows are judged
    on the input. Reads doc_id (an integer) and text, whatever other columns there are. A null, empty or short text has
    no window and keeps its words; a row without a doc_id is kept. Rows that share a doc_id are not different documents
    to each other, but each is judged on its own text, and each comes back once. An empty table gives none.
    """
    # A row is known by its id and the hash of its text; rows alike in both share their result.
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")
    gram = min(GRAM, width)
    listed = materialize(docs.mapInArrow(_super_kmers(width, gram), "id long, row long, n_words long, digest binary, sha string, keys array<bigint>, starts array<int>, counts array<int>"), "super-kmers")

    # Copies of a text: a smaller document has all their windows, so every word goes, if there is a window at all.
    long = listed.filter((F.col("n_words") >= width) & F.col("id").isNotNull())
    firsts = long.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("x")).select("x.id", "x.row", "digest")
    sole = long.select("id", "row", "digest", "keys", "starts", "counts").join(firsts, ["id", "row", "digest"], "left_semi")
    runs = sole.select("id", "row", F.explode(F.arrays_zip("keys", "starts", "counts")).alias("r")).select("id", "row", F.col("r.keys").alias("key"), F.col("r.starts").alias("start"), F.col("r.counts").alias("count"))
    # Rows alike list the same runs; a key has several documents if its least and greatest id differ.
    shared = runs.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count(F.lit(1)).alias("n")).filter("x < y").select("key", (F.col("n") > BUCKET_ROWS).alias("hot"))
    wanted = materialize(runs.join(shared, "key").groupBy("id", "row").agg(F.collect_set(F.struct("key", "start", "count", "hot")).alias("runs")), "wanted")
    texts = docs.mapInArrow(_packed(id_filter(wanted.select("id"))), "id long, row long, packed binary")
    cut = materialize(texts.join(wanted, ["id", "row"]).select("id", "row", "packed", "runs"), "texts")
    sent = materialize(cut.mapInArrow(_cut(width), "key long, id long, row long, start int, words string, hot boolean"), "sent")

    usual = sent.filter("not hot").select("key", "id", "row", "start", "words").repartition("key").sortWithinPartitions("key", "id", "start")
    ranges = usual.mapInArrow(_count_buckets(width), "id long, row long, low int, high int")
    windows = materialize(sent.filter("hot").select("id", "row", "start", "words").mapInArrow(_windows(width), "one long, two long, id long, row long, lows array<int>, highs array<int>"), "hot-windows")
    least = windows.groupBy("one", "two").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("one", "two", "least")
    # Written down by itself, so that Spark can split the join where one window is in very many documents.
    hot = windows.join(least, ["one", "two"]).filter("id > least").select("id", "row", F.explode(F.arrays_zip("lows", "highs")).alias("r"))
    hot = materialize(hot.select("id", "row", F.col("r.lows").alias("low"), F.col("r.highs").alias("high")), "hot-ranges")
    marks = ranges.unionByName(hot).groupBy("id", "row").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    changed = cut.select("id", "row", "packed").join(marks, ["id", "row"]).join(firsts, ["id", "row"]).select("id", "digest", "packed", "ranges").mapInArrow(_remove, "id long, digest binary, n_removed long, sha string, kept_text string")
    if not with_text:
        changed = changed.drop("kept_text")
    # One row for each first document of a digest, with what went from it; all rows of its id and digest take that.
    sole = firsts.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    changed = changed.withColumnsRenamed({"id": "_i", "digest": "_d", "sha": "_sha"}).dropDuplicates(["_i", "_d"])
    sole = sole.join(changed, (F.col("_id") == F.col("_i")) & (F.col("_digest") == F.col("_d")), "left").drop("_i", "_d")
    out = listed.select("id", "n_words", "digest", "sha").join(sole, (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    copy = (F.col("n_words") >= width) & F.col("id").isNotNull() & F.col("_id").isNull()
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    sha = F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha", "sha"))
    columns = [F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"), sha.alias("kept_sha256")]
    if with_text:
        columns.append(F.when(copy, "").otherwise(F.col("kept_text")).alias("kept_text"))
    return out.select(*columns)
