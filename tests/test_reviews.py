"""What a judge is asked and answers, what is kept of it, faults that are replayed, and the rows of chunks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from legispark.operators import answering, chunk_rows, evaluate, judging
from legispark.operators import verify as checks

GOOD = {"claim_index": 0, "verdict": "SUPPORTED", "reason": "r"}
COVER = {"issue_id": "I1", "verdict": "COVERED_BY_CLAIMS", "reason": " r ", "claim_indexes": [0]}
WHOLE = {"checks": [GOOD], "plan_complete": True, "plan_reason": " đủ ", "coverage_checks": [COVER]}
READINGS = [
    ({"checks": []}, None),
    ({"checks": [GOOD]}, None),
    (WHOLE, None),
    ("```json\n" + json.dumps(WHOLE) + "\n```", None),
    ("```\n" + json.dumps({"checks": [GOOD]}) + "```", None),
    (None, "INVALID_JSON"),
    ("", "INVALID_JSON"),
    ("{", "INVALID_JSON"),
    (json.dumps(WHOLE) + " và nữa", "INVALID_JSON"),
    ('{"checks": [], "checks": []}', "INVALID_JSON"),
    ('{"checks": [{"claim_index": 0, "claim_index": 1, "verdict": "SUPPORTED", "reason": "r"}]}', "INVALID_JSON"),
    ([], "INVALID_REVIEW"),
    (3, "INVALID_REVIEW"),
    ({}, "INVALID_REVIEW"),
    ({"checks": {}}, "INVALID_REVIEW"),
    ({"checks": None}, "INVALID_REVIEW"),
    ({"checks": [], "more": 1}, "INVALID_REVIEW"),
    ({k: v for k, v in WHOLE.items() if k != "plan_reason"}, "INVALID_REVIEW"),
    ({"checks": [GOOD] * 6}, "INVALID_REVIEW"),
    ({"checks": [3]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [GOOD, None]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [GOOD | {"claim_index": 5}]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [GOOD | {"claim_index": -1}]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [GOOD | {"claim_index": "0"}]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [GOOD | {"claim_index": True}]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [GOOD | {"claim_index": 0.5}]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [GOOD | {"claim_index": 10**30}]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [GOOD | {"verdict": "MAYBE"}]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [GOOD | {"verdict": None}]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [GOOD | {"reason": "  "}]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [GOOD | {"reason": "x" * 201}]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [GOOD | {"reason": 5}]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [GOOD | {"more": 5}]}, "INVALID_CLAIM_CHECK"),
    ({"checks": [{"claim_index": 0, "verdict": "SUPPORTED"}]}, "INVALID_CLAIM_CHECK"),
    (WHOLE | {"plan_complete": "true"}, "INVALID_COVERAGE_REVIEW"),
    (WHOLE | {"plan_complete": None}, "INVALID_COVERAGE_REVIEW"),
    (WHOLE | {"plan_reason": ""}, "INVALID_COVERAGE_REVIEW"),
    (WHOLE | {"coverage_checks": {}}, "INVALID_COVERAGE_REVIEW"),
    (WHOLE | {"coverage_checks": [COVER] * 6}, "INVALID_COVERAGE_REVIEW"),
    (WHOLE | {"coverage_checks": [COVER | {"issue_id": 1}]}, "INVALID_ISSUE_COVERAGE_CHECK"),
    (WHOLE | {"coverage_checks": [COVER | {"verdict": "SUPPORTED"}]}, "INVALID_ISSUE_COVERAGE_CHECK"),
    (WHOLE | {"coverage_checks": [COVER | {"claim_indexes": [0, 5]}]}, "INVALID_ISSUE_COVERAGE_CHECK"),
    (WHOLE | {"coverage_checks": [COVER | {"claim_indexes": [True]}]}, "INVALID_ISSUE_COVERAGE_CHECK"),
    (WHOLE | {"coverage_checks": [COVER | {"claim_indexes": None}]}, "INVALID_ISSUE_COVERAGE_CHECK"),
    (WHOLE | {"coverage_checks": [COVER | {"claim_indexes": []}]}, None),
    (WHOLE | {"coverage_checks": []}, None),
]


def test_strict_reading(spark):
    rows = [(k, v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, (v, _) in enumerate(READINGS)]
    got = {r.id: r.r for r in spark.createDataFrame(rows, "id int, raw string").select("id", judging.parse_review(F.col("raw")).alias("r")).collect()}
    for k, (_, problem) in enumerate(READINGS):
        assert got[k].problem == problem, READINGS[k]
        assert (got[k].review is None) == (problem is not None)
    assert got[2].review.asDict(True) == {"checks": [GOOD], "plan_complete": True, "plan_reason": "đủ", "coverage": [{"issue_id": "I1", "verdict": "COVERED_BY_CLAIMS", "reason": "r", "claim_indexes": [0]}]}
    cut = spark.createDataFrame([("{", "length"), ('{"checks": []}', "stop"), ('{"checks": []}', None), ('```\n{"checks": []}\n```', None)], "raw string, finish string")
    assert [r[0] for r in cut.select(judging.parse_review(F.col("raw"), F.col("finish"), fenced=False)["problem"]).collect()] == ["TRUNCATED", None, None, "INVALID_JSON"]


def test_payload(spark):
    evidence = "array<struct<evidence_id:string,text:string,status:string,status_scope:string,as_of:date,issue_ids:array<string>>>"
    item = lambda n, issues=None: (n, "t", "EFFECTIVE", "document", dt.date(2024, 1, 2), issues)
    row = ("q", [("I1", "một")], [], ["l"], [("a", ["E1"], None), ("b", ["E9"], ["I1"])], [item("E1"), item("E2", ["I1"]), item("E3", ["I2"]), item("E4")])
    df = spark.createDataFrame([row], f"question string, issues array<struct<issue_id:string,question:string>>, resolutions array<struct<issue_id:string>>, limitations array<string>, claims array<struct<text:string,evidence_ids:array<string>,issue_ids:array<string>>>, evidence {evidence}")
    said = json.loads(df.select(judging.payload(df)).first()[0])
    assert list(said) == ["question", "legal_issues", "issue_resolutions", "limitations", "claims", "evidence"]
    assert said["claims"] == [{"claim_index": 0, "text": "a", "evidence_ids": ["E1"], "issue_ids": []}, {"claim_index": 1, "text": "b", "evidence_ids": ["E9"], "issue_ids": ["I1"]}]
    assert [e["evidence_id"] for e in said["evidence"]] == ["E1", "E2"]
    assert said["evidence"][0] == {"evidence_id": "E1", "text": "t", "status": "EFFECTIVE", "status_scope": "document", "as_of": "2024-01-02"}


def test_a_judge_is_asked_once(spark):
    asked = []
    requests = spark.createDataFrame([("k1", "x"), ("k2", "y"), ("k2", "y"), ("k3", "z")], "cache_key string, question string")
    cache = spark.createDataFrame([("k1", '{"checks": []}')], "cache_key string, raw string")

    def judge(df):
        asked.extend(r.cache_key for r in df.collect())
        return df.withColumn("raw", F.when(F.col("cache_key") == "k2", '{"checks": []}').otherwise("?"))

    reviews, kept = judging.review_all(requests, judge, cache)
    assert sorted((r.cache_key, r.problem) for r in reviews.collect()) == [("k1", None), ("k2", None), ("k3", "INVALID_JSON")]
    assert sorted(asked) == ["k2", "k3"]
    assert {r.cache_key for r in kept.collect()} == {"k1", "k2"}


def test_schedules_are_seeded_and_have_their_shares(spark):
    requests = spark.range(4000).withColumnRenamed("id", "request_id")
    one = answering.fault_schedule(requests, 1)
    n = {r.fault: r["count"] for r in one.groupBy("fault").count().collect()}
    assert set(n) == set(answering.FAULTS)
    for fault, share in answering.FAULTS.items():
        assert abs(n[fault] - 8000 * share / 16) < 150
    same = one.join(answering.fault_schedule(requests, 1).withColumnRenamed("fault", "f"), ["request_id", "attempt"])
    assert same.filter("fault <> f").count() == 0
    other = one.join(answering.fault_schedule(requests, 2).withColumnRenamed("fault", "f"), ["request_id", "attempt"])
    assert other.filter("fault <> f").count() > 3000


def test_a_replay_ends_as_the_rules_say(spark, data):
    from legispark.plans.runs import SEED, fault_replay

    done = {r.request_id: (r.state, r.attempts) for r in fault_replay(spark, data).collect()}
    asked = spark.read.parquet(f"{data}/orders.parquet").select(F.col("o_orderkey").alias("request_id"))
    want = {r.request_id: (r.state, r.attempts) for r in answering.expected_states(answering.fault_schedule(asked, SEED)).collect()}
    assert done == want and {s for s, _ in done.values()} == {"VERIFIED", "REFUSED"}


def test_a_replay_collects_no_requests(spark, monkeypatch):
    plans, write = [], answering.materialize

    def seen(df, *rest):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, *rest)

    monkeypatch.setattr(answering, "materialize", seen)
    item = "array(named_struct('evidence_id', 'E1', 'text', 'Điều 1 quy định', 'document_number', null, 'related_numbers', null, 'article', '1', 'clause', null, 'point', null, 'status', 'EFFECTIVE', 'related_statuses', null, 'status_scope', 'provision', 'source_url', null, 'as_of', date'2020-01-01', 'version_id', 'v1', 'content_valid_from', null, 'content_valid_to', null))"
    asked = spark.range(50).selectExpr("id AS request_id", "'Điều 1 nói gì?' AS question", "date'2020-01-01' AS as_of", "'current_law' AS temporal_intent", "true AS historical_content_available", "cast(null AS array<string>) AS warnings", f"cast({item} AS {checks.EVIDENCE}) AS evidence", "cast(null AS array<string>) AS issue_ids")
    claims = "array(named_struct('text', '{}', 'evidence_ids', array('E1'), 'issue_ids', cast(array() AS array<string>)))"
    answers = spark.range(50).selectExpr("id AS request_id", f"{claims.format('Điều 1 có hiệu lực')} AS right", f"{claims.format('Điều 99')} AS wrong")
    schedule = answering.fault_schedule(asked, 3)
    done = {r.request_id: (r.state, r.attempts) for r in answering.replay(asked, answers, schedule).collect()}
    assert done == {r.request_id: (r.state, r.attempts) for r in answering.expected_states(schedule).collect()}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_evaluation_keeps_failures_as_rows(spark):
    cases = spark.createDataFrame([(1, None), (2, "EMPTY_QUERY"), (3, None), (4, None)], "case_id int, problem string")
    grades = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (1, "c", 1), (2, "a", 2), (3, "a", 1), (4, "a", 2)], "case_id int, item string, grade int")
    run = spark.createDataFrame([(1, "x", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1), (3, "a", 1)], "case_id int, item string, rank int")
    got = {r.case_id: r for r in evaluate.evaluation_run(cases, grades, {"r": run}, 10).collect()}
    assert {k: r.problem for k, r in got.items()} == {1: None, 2: "EMPTY_QUERY", 3: "NO_RELEVANT", 4: "NO_RESULT"}
    assert (got[1].relevant, got[1].hits, got[1].recall, got[1].rr) == (2, 1, 0.5, 0.5)
    assert got[1].ndcg == round((7 / 1.5849625007 + 1 / 2) / (7 + 3 / 1.5849625007 + 1 / 2), 6)
    total = evaluate.evaluation_summary(evaluate.evaluation_run(cases, grades, {"r": run}, 10)).first()
    assert (total.cases, total.failed, total.recall, total.hit_rate) == (4, 3, round(0.5 / 3, 6), round(1 / 3, 6))


def test_chunk_ids(spark):
    rows = [("d 1", "Điều 5/a", "", 0, 10), ("d 1", "Điều 5/a", None, 1, 20), ("d 1", "Điều_5_a", None, 2, 20), ("d 1", "Điều 5/a", None, 3, None), ("d 1", "//", "x", 4, 1)]
    df = spark.createDataFrame(rows, "doc_id string, kind string, label string, ordinal int, line_start int")
    got = {r.ordinal: r.chunk_id for r in chunk_rows.chunk_ids(df, "kind", "label").collect()}
    assert got == {0: "d_1::Điều_5_a", 1: "d_1::Điều_5_a::line_20", 2: "d_1::Điều_5_a::dup_3", 3: "d_1::Điều_5_a::dup_4", 4: "d_1::x"}


def test_rows_are_checked_at_the_boundary(spark):
    good = spark.createDataFrame([], chunk_rows.SCHEMA)
    assert chunk_rows.check_rows(good) == []
    bad = good.drop("article").withColumn("ordinal", F.lit("x")).withColumn("extra", F.lit(1))
    assert chunk_rows.check_rows(bad) == ["missing: article", "unknown: extra", "ordinal: string for int"]


@pytest.mark.parametrize("temporal", [False, True])
def test_chunk_rows(spark, temporal):
    chunk = dict(doc_id="d", chunk_id="d::a", parent_id="d::p", parent_type="section", chunk_type="article", strategy="s", is_indexable=True, structure_type="t", part="I", chapter=" ", section=None, appendix=None, article="5", article_title=" Tên ", clause="1", point=None, ordinal=3, line_start=1, text=" Nội dung. ")
    schema = "doc_id string, chunk_id string, parent_id string, parent_type string, chunk_type string, strategy string, is_indexable boolean, structure_type string, part string, chapter string, section string, appendix string, article string, article_title string, clause string, point string, ordinal int, line_start int, text string"
    df = spark.createDataFrame([chunk, chunk | {"doc_id": "other", "is_indexable": False}], schema)
    about = spark.createDataFrame([("d", {"title": " ", "document_title": "Luật  A", "so_ky_hieu": "1/2020", "effective_date": "2020-01-01"})], "doc_id string, metadata map<string,string>")
    got = {r.doc_id: r for r in chunk_rows.chunk_rows(df, about, temporal).collect()}
    lines = ["Văn bản: Luật A", "Số hiệu: 1/2020", *(["Ngày có hiệu lực: 2020-01-01"] if temporal else []), "Phần I", "Điều 5: Tên", "Khoản 1", "Nội dung."]
    assert got["d"].retrieval_text == "\n".join(lines)
    assert (got["d"].chapter, got["d"].text, got["d"].parent_chunk_id, got["d"].overlap_token_count) == (None, "Nội dung.", "d::p", 0)
    assert (got["other"].retrieval_text, got["other"].approx_token_count, got["other"].document_title) == ("", 0, None)
