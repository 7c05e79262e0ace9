"""Operators by row and by key: what the ids, the groups and the sizes of the rows do not change."""

import random

from pyspark.sql import functions as F

from legispark.operators import chunking, evaluate, evidence


def test_documents_that_share_an_id_are_chunked_apart(spark):
    rows = [(None, "Alpha one.\nAlpha two."), (None, "Beta one.\nBeta two."), ("7", "Gamma."), ("7", "Delta."), ("x/1", "Điều 1. Một\nnội dung")]
    got = chunking.chunk_documents(spark.createDataFrame(rows, "doc_id string, text string").repartition(2)).collect()
    texts = sorted((r.doc_id or "", r.text) for r in got)
    assert texts == [("", "Alpha one.\nAlpha two."), ("", "Beta one.\nBeta two."), ("7", "Delta."), ("7", "Gamma."), ("x/1", "Điều 1. Một\nnội dung")]
    assert {r.chunk_id for r in got if r.doc_id == "x/1"} == {"x/1::article::1"}


def test_a_list_after_a_signature_is_chunked_as_an_appendix(spark):
    text = "Điều 1. Thi hành\nVăn bản.\nTM. CHÍNH PHỦ\nDANH MỤC KÈM THEO\nSTT và tên\n1. Một"
    got = {r.chunk_type: r for r in chunking.chunk_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect() if r.is_indexable}
    assert got["article"].text == "Điều 1. Thi hành\nVăn bản."
    assert any(r.path == "appendix=DANH MỤC KÈM THEO" for r in got.values())


def test_ranks_within_groups_that_span_ranges(spark):
    rng = random.Random(3)
    rows = [(k, "hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(50)) for k in range(3000)] + [(9000, None, 1), (9001, None, 0)]
    df = spark.createDataFrame(rows, "id int, g string, x int").repartition(7)
    got = {r.id: r["rank"] for r in evaluate.ranked_within(df, "g", F.col("x").desc(), F.col("id")).collect()}
    for g in ("hot", "a", "b", "c", None):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))


def test_round_robin_against_its_definition(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", "b", "b", "c"])) for k in range(400)]
    place = {}
    for g in "abc":
        for n, k in enumerate(sorted(k for k, x in rows if x == g)):
            place[k] = (n, g)
    want = {k: i for i, k in enumerate(sorted(place, key=place.get), 1)}
    got = {r.id: r.position for r in evaluate.round_robin(spark.createDataFrame(rows, "id int, g string"), "g", F.col("id")).collect()}
    assert got == want


def test_budget_packing_against_its_definition(spark):
    rng = random.Random(5)
    rows = [(q, p, f"i{p}", rng.choice([3, 5, 8, 40, 500])) for q in range(20) for p in range(1, rng.randrange(2, 60))]
    got = {r.query_id: (r["items"], r.used) for r in evidence.pack_budget(spark.createDataFrame(rows, "query_id int, position int, item string, tokens int"), 100, 6).collect()}
    for q in {r[0] for r in rows}:
        used, taken = 0, []
        for _, _, item, tokens in sorted(r for r in rows if r[0] == q):
            if used + tokens <= 100 and len(taken) < 6:
                used, taken = used + tokens, [*taken, item]
        assert got[q] == (",".join(taken), used)


def test_entry_stands_without_the_subpackage(tmp_path):
    """The entry imports, and tells what it leaves out, where the training-data folders are not there or do not import."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for broken in (False, True):
        at = tmp_path / str(broken)
        shutil.copytree(os.path.join(top, "legispark"), at / "legispark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(top, "__spark_entry__.py"), at)
        if broken:
            (at / "legispark/llm").mkdir()
            (at / "legispark/llm/__init__.py").write_text("")
            (at / "legispark/llm/queries.py").write_text("import no_such_module\n")
        out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; n = set(e.queries()); print(len(n), 'hybrid_search' in n, any(x.startswith('op') and x[2:3].isdigit() for x in n) or 'pipeline' in n)"], cwd=at, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(at)})
        assert out.stdout.split()[1:] == ["True", "False"], out.stderr
        assert "left out" in out.stderr
