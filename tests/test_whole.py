"""Queries on small tables made so that a part of the rows does not give the result of all."""

import random

from legispark.plans.catalog import QUERIES


def fair(rows, most=12, per_issue=3):
    """The selection of one query by its definition; rows: (issue, item, score, basis)."""
    taken, bases = [], {}
    for turn in range(per_issue):
        for issue in sorted({r[0] for r in rows}):
            left = [r for r in sorted(rows, key=lambda r: (-r[2], r[1])) if r[0] == issue and r[1] not in {i for _, i in taken}]
            fresh = [r for r in left if r[3] not in bases.get(issue, ())] if turn else left
            if len(taken) < most and (fresh or left):
                pick = (fresh or left)[0]
                taken.append((issue, pick[1]))
                bases.setdefault(issue, set()).add(pick[3])
    return [(*x, k) for k, x in enumerate(taken, 1)]


def test_issue_fair_finds_a_new_basis_at_any_depth(spark, tmp_path):
    rows = [(k, 20, "1-URGENT", "F", 1000.0 - k) for k in range(60)] + [(100, 40, "1-URGENT", "F", 1.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r.position, r.item) for r in QUERIES["issue_fair"](spark, str(tmp_path)).collect())
    assert got == [(1, "0"), (2, "100"), (3, "1")]


def test_issue_fair_against_its_definition(spark):
    from legispark.operators.evidence import issue_fair

    rng = random.Random(5)
    rows = []
    for q in range(30):
        basis = {f"{k:03}": f"b{min(rng.randrange(1, 30), rng.randrange(1, 30))}" for k in range(150)}
        for issue in "abcde"[: rng.randrange(1, 6)]:
            rows += [(q, issue, i, float(rng.randrange(20)) if q % 2 else 1000.0 * (basis[i] < "b2") - int(i), basis[i]) for i in rng.sample(sorted(basis), rng.randrange(1, 140))]
    got = {}
    for r in issue_fair(spark.createDataFrame(rows, "query_id long, issue string, item string, score double, basis string")).collect():
        got.setdefault(r.query_id, []).append((r.issue, r.item, r.position))
    for q in range(30):
        assert sorted(got[q], key=lambda x: x[2]) == fair([r[1:] for r in rows if r[0] == q])


def test_ancestor_excerpt_of_short_chunks(spark, tmp_path):
    long = " ".join(f"Word{k}" for k in range(30)) + "."
    rows = [(1, f"A\nA banana.\n{long}", "en", "s"), (2, "Only.", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.chunk_id: " ".join(r.excerpt.split()) for r in QUERIES["ancestor_excerpt"](spark, str(tmp_path)).collect()}
    assert got == {"1::0": f"A banana. {long}", "1::1": f"A {long}", "1::2": "A A banana.", "2::0": ""}


def test_dense_ann_finds_most_of_the_exact_neighbours(spark, data):
    from pyspark.sql import functions as F

    from legispark.operators.search import dense_top_k

    e = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))
    exact = dense_top_k(e, e.filter("point_id % 20 = 0").withColumnRenamed("point_id", "query_id"), 10).select("query_id", "point_id")
    found = QUERIES["dense_ann"](spark, data).join(exact, ["query_id", "point_id"]).count()
    assert found >= 0.9 * exact.count()
