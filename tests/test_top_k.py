"""The best k of each query: what tasks give stays little, and nothing is lost by it."""

import random

import pytest
from pyspark.sql import functions as F

from legispark.operators import search


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def words(n, seed):
    r = random.Random(seed)
    return [(i, None if i % 50 == 3 else " ".join(r.choice("ab cd ef gh the of to".split()) for _ in range(r.randrange(0, 9)))) for i in range(n)]


def test_a_task_gives_the_best_of_a_query_once(spark, small_batches, monkeypatch):
    r = random.Random(5)
    points = spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(1000)], "point_id long, vector array<float>").coalesce(1)
    queries = points.filter("point_id < 5").withColumnRenamed("point_id", "query_id")
    docs = spark.createDataFrame(words(1000, 1), "doc_id long, text string").coalesce(1)
    terms = spark.createDataFrame([(q, t) for q in range(5) for t in ("the", "of")], "query_id long, term string")
    monkeypatch.setattr(search, "top_k", lambda scored, *a, **b: scored)
    assert search.dense_top_k(points, queries, 3).count() == 15
    assert search.bm25_top_k(docs, F.col("text"), terms, 3).count() <= 15 * docs.sparkSession.sparkContext.defaultParallelism


@pytest.mark.parametrize("block", [20_000, 2])
def test_lexical_top_k_is_that_of_all_scores(spark, small_batches, monkeypatch, block):
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    monkeypatch.setattr(search, "WAITING", 20)
    docs = spark.createDataFrame(words(300, 2), "doc_id long, text string").repartition(3)
    asked = {1: ["the"], 2: ["the", "of"], 3: ["ab", "zz"], 4: ["zz"], 5: ["gh", "ef", "to"]}
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id long, term string")
    posts, stats = search.term_postings(docs, {"text": F.col("text")}, terms)
    want = search.top_k(search.bm25(posts, stats, terms, {"text": 1.0}), 20, F.desc("score"), F.col("doc_id"))
    row = lambda r: (r.query_id, r.rank, r.doc_id, r.score)
    got = sorted(map(row, search.bm25_top_k(docs, F.col("text"), terms, 20).collect()))
    assert got == sorted(map(row, want.collect())) and {r[0] for r in got} == {1, 2, 3, 5}


def test_no_terms_and_no_documents_give_nothing(spark):
    docs = spark.createDataFrame(words(5, 3), "doc_id long, text string")
    none = spark.createDataFrame([], "query_id long, term string")
    one = spark.createDataFrame([(1, "the")], "query_id long, term string")
    assert search.bm25_top_k(docs, F.col("text"), none, 3).count() == 0
    assert search.bm25_top_k(docs.limit(0), F.col("text"), one, 3).count() == 0
