r"""Ranked lexical search over document-sharded postings in compressed rows with precomputed integer impacts.

A shard is a block of documents, one row of the index: its terms, where each term's postings begin, and for every posting
the document's place in the shard and its impact. What all documents decide (their number and length) is summed after the
first pass; the second gives every posting its impact, so that a search adds products and divides nothing. A query goes
term by term over the postings of a shard into one dense array of scores, the best k leave it by a partial sort that keeps
every tie and settles it by doc_id, and the best of all shards are ranked.

Terms are maximal runs of bytes ``0-9 A-Z a-z`` and above 0x7F with A-Z lower-cased. Null and empty texts and texts without
a term are documents that nothing finds and that count in nothing. Every row is a document: repeated rows, null or repeated
ids each have their own place; of equal scores the lowest doc_id comes first, null after all. Queries without a term that
occurs find nothing. Empty tables give no rows. Columns but ``doc_id`` and ``text`` (``item_id`` and ``text``) are not read.
A task holds one shard (about ``BLOCK_BYTES`` of text, or one text) at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from legispark.llm.storage import drop, materialize
from legispark.llm.terms import BLOCK_BYTES, blocks, coded, lowered, table

SEPARATORS = table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Queries are answered in blocks of at most so many bytes of text, the only part of them that the driver holds.
QUERY_BYTES = 4 << 20
#: Fixed values of the ranking.
SCALE, LENGTH_SHARE = 1_000_000_000, 25
#: Shards in a file of the index, which a task decodes together.
SHARDS_PER_FILE = 2

_LISTS = ("doc_ids", "known", "terms", "starts", "places")
POSTINGS = "n_docs long, n_terms long, doc_ids binary, known binary, lengths binary, terms binary, starts binary, places binary, counts binary"
INDEX = "doc_ids binary, known binary, terms binary, starts binary, places binary, impacts binary"


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for rows, data, offset in blocks(batches, size=size):
        words = coded(lowered(data), offset, SEPARATORS)
        if not len(words.code):
            continue
        n = len(rows)
        lengths = np.bincount(words.row, minlength=n).astype(np.int64)
        posting, counts = np.unique(words.code * n + words.row, return_counts=True)
        starts = np.searchsorted(posting, np.arange(len(words.words) + 1, dtype=np.int64) * n)
        ids = rows["doc_id"]
        yield pa.RecordBatch.from_pydict({
            "n_docs": pa.array([int((lengths > 0).sum())]),
            "n_terms": pa.array([int(lengths.sum())]),
            "doc_ids": [pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()],
            "known": [pc.is_valid(ids).to_numpy(zero_copy_only=False).tobytes()],
            "lengths": [lengths.tobytes()],
            "terms": [b" ".join(words.words.to_pylist())],
            "starts": [starts.astype(np.int64).tobytes()],
            "places": [(posting % n).astype(np.uint32).tobytes()],
            "counts": [counts.astype(np.uint32).tobytes()],
        }, schema=pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), *((c, pa.binary()) for c in ("doc_ids", "known", "lengths", "terms", "starts", "places", "counts"))]))


def _impacts(total_docs: int, total_terms: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                lengths = np.frombuffer(batch["lengths"][k].as_py(), np.int64)
                places = np.frombuffer(batch["places"][k].as_py(), np.uint32)
                counts = np.frombuffer(batch["counts"][k].as_py(), np.uint32).astype(np.int64)
                m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * total_docs) // total_terms
                impacts = (SCALE * counts) // (1000 * counts + 12 * m[places])
                kept = {c: batch[c].slice(k, 1) for c in _LISTS}
                yield pa.RecordBatch.from_pydict(kept | {"impacts": pa.array([impacts.astype(np.uint32).tobytes()], pa.binary())})

    return each


class Index:
    """The written shards, and the number of documents that have a term."""

    def __init__(self, shards: DataFrame, n_docs: int):
        self.shards, self.n_docs = shards, n_docs


def build_index(docs: DataFrame, shard_bytes: int = BLOCK_BYTES) -> Index:
    """Writes the shards of ``docs`` in ``spark.checkpoint.dir``: once with counts, then with the impacts these have."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(read.mapInArrow(lambda batches: _shards(batches, shard_bytes), POSTINGS), "postings", SHARDS_PER_FILE)
    total = found.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = total.docs or 0, total.terms or 1
    shards = materialize(found.select(*_LISTS, "lengths", "counts").mapInArrow(_impacts(n_docs, n_terms), INDEX), "index", SHARDS_PER_FILE)
    drop(found)
    return Index(shards, n_docs)


def _query_terms(text: str | None) -> Counter:
    data = np.frombuffer((text or "").encode(), np.uint8)
    words = coded(lowered(data), np.array([0, len(data)]), SEPARATORS)
    return Counter({t: int(n) for t, n in zip(words.words.to_pylist(), np.bincount(words.code, minlength=len(words.words)), strict=True)})


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch; only one shard is a Python object at a time."""
    for k in range(len(batch)):
        yield batch.slice(k, 1).to_pylist()[0]


def _places_of(row: dict, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which query terms the shard has, and the shard's code of each."""
    own = pa.array(row["terms"].split(b" "), pa.binary())
    at = pc.index_in(own, terms)
    code = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    return at.drop_null().to_numpy().astype(np.int64), code


def _frequencies(terms: list[bytes]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, total = pa.array(terms, pa.binary()), np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in _one_by_one(batch):
                term, code = _places_of(row, asked)
                starts = np.frombuffer(row["starts"], np.int64)
                total[term] += starts[code + 1] - starts[code]
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(there), "df": pa.array(total[there])})

    return each


def best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, ties to the lowest known id, in order."""
    there = np.flatnonzero(scores)
    if len(there) > k:
        bar = np.partition(scores[there], len(there) - k)[len(there) - k]
        there = there[scores[there] >= bar]
    return there[np.lexsort((ids[there], ~known[there], -scores[there]))][:k]


def _search(items: list[list[tuple[int, int]]], terms: list[bytes], k: int):
    """``items``: for each query its terms with their weights, repeats included."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(terms, pa.binary())
        top: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in _one_by_one(batch):
                term, code = _places_of(row, asked)
                code_of = dict(zip(term.tolist(), code.tolist(), strict=True))
                starts, places, impacts = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["places"], np.uint32), np.frombuffer(row["impacts"], np.uint32).astype(np.int64)
                ids, known = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["known"], bool)
                for item, weights in enumerate(items):
                    scores = np.zeros(len(ids), np.int64)
                    for t, w in weights:
                        c = code_of.get(t)
                        if c is not None:
                            scores[places[starts[c] : starts[c + 1]]] += w * impacts[starts[c] : starts[c + 1]]
                    found = best(scores, ids, known, k)
                    if len(found):
                        s, i, n = top.get(item, (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),))
                        s, i, n = np.concatenate((s, scores[found])), np.concatenate((i, ids[found])), np.concatenate((n, known[found]))
                        kept = best(s, i, n, k)
                        top[item] = s[kept], i[kept], n[kept]
        for item, (s, i, n) in top.items():
            yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(s), pa.int64()), "doc_id": pa.array(i, mask=~n), "score": pa.array(s)})

    return each


def _query_blocks(queries: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    block, size = [], 0
    for row in queries.select("item_id", "text").toLocalIterator():
        if block and size + len(row.text or "") > QUERY_BYTES:
            yield block
            block, size = [], 0
        block.append((row.item_id, _query_terms(row.text)))
        size += len(row.text or "")
    if block:
        yield block


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """Each query's ``k`` best documents: item_id, rank, doc_id, score; each row of ``queries`` is a query of its own.

    A term of df documents weighs floor(1000 * ln((2 * N + 2) / (2 * df + 1))). Queries are stated ones: they come in blocks
    of ``QUERY_BYTES``, each of which reads the shards once for the terms' frequencies and once for the scores.
    """
    spark = index.shards.sparkSession
    kind = queries.schema["item_id"].dataType
    out = []
    for block in _query_blocks(queries):
        terms = sorted(set().union(*(c for _, c in block)))
        found = index.shards.select("terms", "starts").mapInArrow(_frequencies(terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect() if terms else []
        weight = {r.term: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r.df + 1))) for r in found}
        number = {t: i for i, t in enumerate(terms)}
        items = [[(number[t], weight[number[t]] * n) for t, n in c.items() if weight.get(number[t])] for _, c in block]
        scored = index.shards.mapInArrow(_search(items, terms, k), "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], StructType([StructField("item", LongType()), StructField("item_id", kind)]))
        out.append(materialize(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not out:
        return queries.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole

