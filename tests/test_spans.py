"""Edges, candidates and coverage of spans against brute force."""

import random

from legispark.operators import spans


def test_border_against_trying_all_lengths():
    rng = random.Random(1)
    for _ in range(5000):
        left, right = ([rng.choice("ab") for _ in range(rng.randrange(9))] for _ in range(2))
        want = max(k for k in range(min(len(left), len(right)) + 1) if left[len(left) - k :] == right[:k])
        assert spans.longest_border(left, right) == want


def test_border_is_linear():
    import time

    words = ["z"] * 300_000
    began = time.time()
    assert spans.longest_border([*words, "y"], [*words, "x"]) == 0
    assert spans.longest_border(words, words) == 300_000
    assert time.time() - began < 5


def test_overlaps_are_taken_off(spark):
    rows = [(1, 0, "a b c d"), (1, 1, "c  d\ne"), (1, 2, "e"), (1, 3, None), (1, 4, "x"), (2, 0, "c d"), (None, 0, "q r"), (None, 1, "r s")]
    got = {(r.doc_id, r.ordinal): (r.overlap_words, r.own_text) for r in spans.strip_overlaps(spark.createDataFrame(rows, "doc_id int, ordinal int, text string")).collect()}
    assert got == {(1, 0): (0, "a b c d"), (1, 1): (2, "e"), (1, 2): (1, ""), (1, 3): (0, ""), (1, 4): (0, "x"), (2, 0): (0, "c d"), (None, 0): (0, "q r"), (None, 1): (1, "s")}


def test_candidates(spark):
    results = [
        (1, "a", 10, 1, "Cũ. Mới ở đây.", "Cũ.", "Chương I. Cũ. Mới ở đây. Hết."),
        (1, "b", 11, 2, " Chỉ cũ ", "Chỉ cũ", "Chỉ cũ và nữa."),
        (1, "c", 12, 3, "Như cha.", None, "Như cha."),
        (1, "d", 13, 4, "Không cha", "khác", None),
    ]
    df = spark.createDataFrame(results, "query_id int, chunk_id string, document_id int, rank int, text string, overlap_text string, parent_text string")
    roles = lambda rows: spark.createDataFrame(rows, "query_id int, document_id int, role string")
    got = {r.chunk_id: r for r in spans.candidates(df, roles([(1, 10, "amending_document"), (1, 12, "guidance_document"), (2, 13, "x")]), roles([(1, 10, "seed_document")])).collect()}
    assert set(got) == {"a", "c", "d"}
    assert (got["a"].role, got["c"].role, got["d"].role) == ("seed_document", "guidance_document", "retrieved_document")
    assert got["a"].leaf == "Mới ở đây."
    assert got["a"].text == "Ngữ cảnh cấp trên:\nChương I. Cũ. Hết.\n\nĐoạn trích:\nMới ở đây."
    assert (got["c"].text, got["d"].text) == ("Như cha.", "Không cha")


def brute(units, chunks):
    held = {p for b, e in units for p in range(b, e)} - {p for b, e in chunks for p in range(b, e)}
    out = []
    for p in sorted(held):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(x) for x in out]


def test_gaps_and_coverage_against_single_positions(spark):
    rng = random.Random(6)
    made = {k: ([(b, b + rng.randrange(8)) for b in (rng.randrange(60) for _ in range(rng.randrange(1, 12)))], [(b, b + rng.randrange(12)) for b in (rng.randrange(60) for _ in range(rng.randrange(8)))]) for k in range(200)}
    frame = lambda n: spark.createDataFrame([(k, *s) for k, both in made.items() for s in both[n]], "doc_id int, begin int, end int")
    units, chunks = frame(0), frame(1)
    got: dict = {}
    for r in spans.gaps(units, chunks, "doc_id").collect():
        got.setdefault(r.doc_id, []).append((r.begin, r.end))
    for k, both in made.items():
        assert sorted(got.get(k, [])) == brute(*both)
    for r in spans.coverage(units, chunks, "doc_id").collect():
        lost = brute(*made[r.doc_id])
        whole = len({p for b, e in made[r.doc_id][0] for p in range(b, e)})
        assert (r.units, r.missing, r.covered, r.gaps, r.longest_gap) == (whole, sum(e - b for b, e in lost), whole - sum(e - b for b, e in lost), len(lost), max((e - b for b, e in lost), default=0))


def test_a_planted_fault_is_found(spark):
    units = [(d, 10 * k, 10 * k + 10) for d in range(5) for k in range(20)]
    chunks = [(d, 20 * k, 20 * k + 20) for d in range(5) for k in range(10) if (d, k) != (3, 4)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, begin int, end int")
    assert [tuple(r) for r in spans.gaps(frame(units), frame(chunks), "doc_id").collect()] == [(3, 80, 100)]


def test_islands(spark):
    rows = [(1, 0, 5), (1, 5, 7), (1, 6, 6), (1, 8, 9), (1, 0, 2), (2, 3, 3)]
    got = spans.islands(spark.createDataFrame(rows, "k int, begin int, end int"), "k").collect()
    assert sorted((r.k, r.begin, r.end, r.n) for r in got) == [(1, 0, 7, 3), (1, 8, 9, 1)]
