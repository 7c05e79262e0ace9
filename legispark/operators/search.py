"""Retrieval: exact cosine top-k, BM25 over postings, rank fusion, candidate levels, reranking and promotion.

Queries are rows, so one plan answers all of them. Top-k is a ranked window that Spark prunes before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legispark.storage import materialize

#: Query terms or vectors up to which their side is broadcast.
BROADCAST_ROWS = 100_000
#: Query vectors that one pass over the points answers, those that are scored at a time, and query terms that go into a filter of the texts.
QUERY_BLOCK, SCORED_AT_ONCE, FILTER_TERMS = 20_000, 256, 2_000
#: Rows that wait before a task sorts them into its best, rows that it gives at a time, and tasks that hold the best of a block of queries.
WAITING, GIVEN_ROWS, TASKS_PER_CORE = 250_000, 50_000, 2


def small(df: DataFrame) -> DataFrame:
    """Broadcast if a count shows it small; else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def l2_normalize(v: Column) -> Column:
    v = v.cast("array<double>")
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top_k(scored: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k per query in a total order, with their rank."""
    w = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, and which rows of the column they are: nulls, gaps and zero vectors are left out."""
    if column.null_count or column.flatten().null_count:
        values = column.to_pylist()
        at = np.array([k for k, v in enumerate(values) if v is not None and None not in v], np.int64)
        x = np.array([values[k] for k in at], np.float64).reshape(len(at), -1) if len(at) else np.zeros((0, 1))
    else:
        at = np.arange(len(column))
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    length = np.sqrt((x * x).sum(axis=1))
    keep = length > 0
    return x[keep] / length[keep, None], at[keep]


class _Best:
    """The k best of each query among what a task has met: (query, score, id) by score and id, and the score from which more can enter."""

    def __init__(self, n: int, k: int, least: float, kind: pa.DataType):
        self.k, self.bar, self.waiting, self.n_waiting = k, np.full(n, least), [], 0
        self.kept = pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "id": pa.array([], kind)})
        self.room = max(WAITING, n * k // 2)

    def add(self, q: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        if len(q):
            self.waiting.append(pa.table({"q": q, "score": score, "id": ids.cast(self.kept.schema.field("id").type)}))
            self.n_waiting += len(q)
        if self.n_waiting > self.room:
            self.settle()

    def settle(self) -> pa.Table:
        if self.waiting:
            both = pa.concat_tables([self.kept, *self.waiting])
            both = both.take(compute.sort_indices(both, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")]))
            q = both["q"].to_numpy()
            place = np.arange(len(q)) - np.searchsorted(q, q)
            last = place == self.k - 1
            self.bar[q[last]] = both["score"].to_numpy()[last]
            self.kept, self.waiting, self.n_waiting = both.filter(pa.array(place < self.k)).combine_chunks(), [], 0
        return self.kept

    def give(self, query_ids: pa.Array, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
        kept = self.settle()
        out = pa.table([query_ids.take(kept["q"].combine_chunks()), kept["id"], kept["score"]], names=list(names))
        yield from out.to_batches(max_chunksize=GIVEN_ROWS)


def _few(df: DataFrame) -> DataFrame:
    """In so few partitions that the best of each, for every query, stay little."""
    return df.coalesce(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def dense_top_k(points: DataFrame, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """(query_id, point_id, score, rank) by cosine. Points: (point_id, vector), filtered before; queries: (query_id, vector), a stated set.

    Queries come in blocks of a bounded size, each of which one pass over the points answers: a task multiplies its
    points with the block, holds the best k of each query, and gives these once; a ranked window joins them. Vectors
    that are null, zero or have gaps are left out.
    """
    vectors = lambda c: F.col(c).cast("array<double>").alias("vector")
    p = _few(points.select("point_id", vectors("vector")))
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    kind = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", queries), ("point_id", points))}

    def scored(block: int) -> DataFrame:
        own = queries.select("query_id", vectors("vector"))
        if blocks > 1:
            own = own.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        asked = own.toArrow()
        q, rows = _matrix(asked.column("vector").combine_chunks())
        ids = asked.column("query_id").combine_chunks().take(pa.array(rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                best = best or _Best(len(q), k, -2.0 if least is None else least, batch.column(0).type)
                x, at = _matrix(batch.column(1))
                order = compute.sort_indices(batch.column(0).take(pa.array(at))).to_numpy()
                x, at = x[order], at[order]
                for low in range(0, len(q) if len(at) else 0, SCORED_AT_ONCE):
                    score = np.round(q[low : low + SCORED_AT_ONCE] @ x.T, 6)
                    enters = score >= best.bar[low : low + SCORED_AT_ONCE, None]
                    if np.count_nonzero(enters) > 2 * k * len(score):
                        first = np.argsort(-score, axis=1, kind="stable")[:, :k]
                        inside = np.take_along_axis(enters, first, axis=1)
                        who, where = np.nonzero(inside)[0], first[inside]
                    else:
                        who, where = np.nonzero(enters)
                    best.add(low + who, score[who, where], batch.column(0).take(pa.array(at[where])))
            if best is not None:
                yield from best.give(ids, ("query_id", "point_id", "score"))

        return p.mapInArrow(run, f"query_id {kind['query_id']}, point_id {kind['point_id']}, score double")

    out = scored(0)
    for block in range(1, blocks):
        out = out.unionByName(scored(block))
    return top_k(out, k, F.desc("score"), F.col("point_id"))


def _hits(wanted: list[str]):
    """Of each document its id, its number of words, and which of the wanted words it has how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(wanted, pa.string())
        for batch in batches:
            w = batch.column(1)
            size = w.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            code = compute.index_in(w.flatten(), terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)[code >= 0]
            met, tf = np.unique(row * len(wanted) + code[code >= 0], return_counts=True)
            cut = np.searchsorted(met, np.arange(1, len(size)) * len(wanted))
            pack = lambda x: pa.array([y.astype(np.int32).tobytes() for y in np.split(x, cut)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pack(met % max(1, len(wanted))), pack(tf)], names=["doc_id", "length", "codes", "counts"])

    return run


def _met(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of every hit of a batch."""
    codes = [np.frombuffer(x, np.int32) for x in batch.column("codes").to_pylist()]
    counts = [np.frombuffer(x, np.int32) for x in batch.column("counts").to_pylist()]
    return np.repeat(np.arange(len(codes)), [len(x) for x in codes]), np.concatenate(codes), np.concatenate(counts)


def bm25_top_k(docs: DataFrame, text: Column, terms: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query by BM25 of one field. ``terms``: distinct (query_id, term), a stated set.

    A text's words are cut down to those that are asked for and written with it, a few bytes each. A task then adds up
    the parts of a query's terms over a batch of documents at a time and gives its k best of each query once, so no row
    is made for a query and a document that merely share a word.
    """
    terms = materialize(terms.select("query_id", "term").filter("term IS NOT NULL").distinct(), "query-terms")
    parsed = docs.select("doc_id", words(text).alias("w"))
    blocks = max(1, -(-terms.select("query_id").distinct().count() // QUERY_BLOCK))
    kind = {c: df.schema[c].dataType.simpleString() for c, df in (("query_id", terms), ("doc_id", docs))}

    def scored(block: int) -> DataFrame:
        own = terms if blocks == 1 else terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        asked = own.orderBy("query_id", "term").toArrow()
        query, word = asked.column("query_id").combine_chunks().dictionary_encode(), asked.column("term").combine_chunks().cast(pa.string()).dictionary_encode()
        ids, wanted = query.dictionary, word.dictionary.to_pylist()
        hits = materialize(parsed.mapInArrow(_hits(wanted), f"doc_id {kind['doc_id']}, length long, codes binary, counts binary"), "term-hits")
        total = hits.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()

        def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(wanted), np.int64)
            for batch in batches:
                df += np.bincount(_met(batch)[1], minlength=len(wanted)) if len(batch) else 0
            there = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(df[there])], names=["code", "df"])

        df = np.zeros(len(wanted))
        for r in hits.select("codes", "counts").mapInArrow(frequencies, "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).toLocalIterator():
            df[r.code] = r.df
        n, mean = total.n, total.mean or 0.0
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        own_codes = np.split(word.indices.to_numpy().astype(np.int64), np.flatnonzero(np.diff(query.indices.to_numpy())) + 1) if len(query) else []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                if not len(batch):
                    continue
                best = best or _Best(len(ids), k, -np.inf, batch.column("doc_id").type)
                batch = batch.take(compute.sort_indices(batch.column("doc_id")))
                row, code, tf = _met(batch)
                order = np.argsort(code, kind="stable")
                row, code, tf = row[order], code[order], tf[order].astype(np.float64)
                length = batch.column("length").to_numpy().astype(np.float64)[row]
                part = idf[code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)) if len(row) else tf
                starts = np.searchsorted(code, np.arange(len(wanted) + 1))
                for q, own in enumerate(own_codes):
                    at = [slice(starts[c], starts[c + 1]) for c in own if starts[c] < starts[c + 1]]
                    if not at:
                        continue
                    if len(at) == 1:
                        where, score = row[at[0]], part[at[0]]
                    else:
                        summed, met = np.zeros(len(batch)), np.zeros(len(batch), bool)
                        for s in at:
                            summed[row[s]] += part[s]
                            met[row[s]] = True
                        where = np.flatnonzero(met)
                        score = summed[where]
                    # A part less than half a unit of the last digit below the bar may still round up to it.
                    enters = np.flatnonzero(score >= best.bar[q] - 1e-6)
                    where, score = where[enters], np.round(score[enters], 6)
                    if len(where) > k:
                        first = np.argsort(-score, kind="stable")[:k]
                        where, score = where[first], score[first]
                    best.add(np.full(len(where), q), score, batch.column("doc_id").take(pa.array(where)))
            if best is not None:
                yield from best.give(ids, ("query_id", "doc_id", "score"))

        return _few(hits).mapInArrow(run, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, score double")

    out = scored(0)
    for block in range(1, blocks):
        out = out.unionByName(scored(block))
    return top_k(out, k, F.desc("score"), F.col("doc_id"))


def words(text: Column) -> Column:
    """Lower-case words of a text; a null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def postings(docs: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """(doc_id, field, term, tf, length): lower-case words of each field."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), words(c).alias("terms")) for name, c in fields.items())))
    wide = docs.select("doc_id", each.alias("f")).select("doc_id", "f.field", "f.terms", F.size("f.terms").cast("long").alias("length"))
    return wide.select("doc_id", "field", "length", F.explode("terms").alias("term")).groupBy("doc_id", "field", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def field_stats(docs: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """(field, n, mean) over all documents, empty fields included."""
    sizes = [F.struct(F.lit(name).alias("field"), F.size(words(c)).alias("length")) for name, c in fields.items()]
    return docs.select(F.inline(F.array(*sizes))).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))


def term_postings(docs: DataFrame, fields: Mapping[str, Column], terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings of ``terms`` only, field statistics) from one pass over the texts.

    A text's words are cut down to the query terms where it stands, so only hits leave the scan. Beyond
    ``FILTER_TERMS`` terms the full postings are built and joined instead.
    """
    wanted = [r[0] for r in terms.select("term").filter("term IS NOT NULL").distinct().limit(FILTER_TERMS + 1).collect()]
    if len(wanted) > FILTER_TERMS:
        return postings(docs, fields), field_stats(docs, fields)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), words(c).alias("terms")) for name, c in fields.items())))
    parsed = docs.select("doc_id", each.alias("f")).select("doc_id", "f.field", F.size("f.terms").cast("long").alias("length"), F.filter("f.terms", lambda w: w.isin(*wanted)).alias("hits"))
    kept = materialize(parsed, "term-hits")
    stats = kept.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    counted = F.explode(F.transform(F.array_distinct("hits"), lambda t: F.struct(t.alias("term"), F.size(F.filter("hits", lambda h: h == t)).cast("long").alias("tf"))))
    return kept.filter(F.size("hits") > 0).select("doc_id", "field", "length", counted.alias("p")).select("doc_id", "field", "length", "p.term", "p.tf"), stats


def bm25(posts: DataFrame, stats: DataFrame, terms: DataFrame, boosts: Mapping[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score): BM25 per field, weighted. ``terms``: distinct (query_id, term). Only postings of query terms are joined."""
    used = posts.join(small(terms.select("term").distinct()), "term")
    df = used.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    boost = F.element_at(F.create_map(*(F.lit(x) for pair in boosts.items() for x in pair)), F.col("field"))
    hits = used.join(F.broadcast(stats), "field").join(small(df), ["field", "term"]).join(small(terms), "term")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = boost * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.count_distinct("term").alias("n_terms"))


def reciprocal_rank_fusion(ranked: DataFrame, weights: Mapping[str, float] | None = None, k: int = 60, limit: int | None = None) -> DataFrame:
    """Fuse (query_id, source, point_id, raw_score, rank). A point counts once per source, at its best rank; a source of weight 0 is left out. Order: score, best rank, id."""
    weights = dict(weights or {})
    best = ranked.groupBy("query_id", "source", "point_id").agg(F.min(F.struct("rank", "raw_score")).alias("x")).select("query_id", "source", "point_id", "x.rank", "x.raw_score")
    weight = F.lit(1.0)
    if weights:
        weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("source")), F.lit(1.0))
    fused = best.withColumn("_w", weight).filter("_w <> 0").groupBy("query_id", "point_id").agg(F.round(F.sum(F.col("_w") / (k + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best_rank"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rank")))).alias("source_ranks"))
    out = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "point_id")).cast("long"))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def per_seed(scored: DataFrame, limit: int, n_seeds: int) -> DataFrame:
    """A quota of max(2, ceil(limit / seeds)) per seed, merged by (seed, score, id) and ranked anew."""
    quota = max(2, -(-limit // max(1, n_seeds)))
    inner = scored.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "seed").orderBy(F.desc("score"), "point_id"))).filter(F.col("_r") <= quota)
    return inner.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("seed", F.desc("score"), "point_id")).cast("long")).drop("_r")


def expansion_level(ranked: DataFrame, valid: DataFrame, limit: int, start: int = 50, cap: int = 500) -> DataFrame:
    """Per query the first candidate level (start, doubled up to cap) at which enough candidates are valid or the candidates are exhausted.

    All levels are evaluated as rows of one plan. ``ranked``: (query_id, point_id, rank); ``valid``: (point_id).
    """
    levels = [start]
    while levels[-1] < cap:
        levels.append(min(cap, levels[-1] * 2))
    marked = ranked.join(valid.select("point_id", F.lit(1).alias("_ok")), "point_id", "left")
    each = marked.select("query_id", "rank", F.coalesce("_ok", F.lit(0)).alias("_ok"), F.explode(F.array(*map(F.lit, levels))).alias("level"))
    sums = each.groupBy("query_id", "level").agg(F.count_if(F.col("rank") <= F.col("level")).alias("n"), F.sum(F.when(F.col("rank") <= F.col("level"), F.col("_ok")).otherwise(0)).alias("hydrated"))
    stop = (F.col("hydrated") >= limit) | (F.col("n") < F.col("level")) | (F.col("level") == cap)
    return sums.filter(stop).groupBy("query_id").agg(F.min(F.struct("level", "hydrated")).alias("x")).select("query_id", F.col("x.level").cast("long").alias("level"), F.col("x.hydrated").alias("hydrated"))


def rerank(ranked: DataFrame, first: int) -> DataFrame:
    """The first ``first`` by rerank_score, the tail in its old order."""
    head = F.col("rank") <= first
    order = [F.when(head, 0).otherwise(1), F.when(head, -F.col("rerank_score")), F.when(head, F.col("point_id")), F.col("rank")]
    return ranked.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def promote_seed(ranked: DataFrame, seeds: DataFrame, gap: float = 1.0) -> DataFrame:
    """Results of the best seed document go first if it leads the next one by ``gap``. ``seeds``: (query_id, document_id, seed_score)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("seed_score"), "document_id")
    sure = seeds.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("seed_score").over(w)).filter((F.col("_r") == 1) & (F.col("_next").isNull() | (F.col("seed_score") - F.col("_next") >= gap))).select("query_id", F.col("document_id").alias("_d"))
    joined = ranked.join(sure, "query_id", "left")
    front = F.when(F.col("document_id") == F.col("_d"), 0).otherwise(1)
    return joined.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(front, "rank")).cast("long")).drop("_d")


def search_target(graph_ids: Column, seed_ids: Column, numbers: Column) -> Column:
    """struct(kind, values): what a search is confined to. Documents of the graph come first, then resolved seeds, then the numbers as they were written; else nothing confines it."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(some(graph_ids), F.struct(F.lit("graph").alias("kind"), graph_ids.alias("values"))).when(some(seed_ids), F.struct(F.lit("seeds").alias("kind"), seed_ids.alias("values"))).when(some(numbers), F.struct(F.lit("numbers").alias("kind"), numbers.alias("values"))).otherwise(F.struct(F.lit("open").alias("kind"), F.array().cast("array<string>").alias("values")))
