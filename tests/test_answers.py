"""Goldens of verification, answering, lexical queries, sources, chat, indexes and frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from legispark.functions import tokenizers
from legispark.operators import answering, chat, chunking, lexical, sources, structure
from legispark.operators import verify as checks
from legispark.sources import html, indexes
from legispark.streaming import frames

DAY = dt.date(2024, 1, 1)
SCHEMA = f"id int, question string, as_of date, temporal_intent string, historical_content_available boolean, warnings array<string>, evidence {checks.EVIDENCE}, answer string, claims {checks.CLAIMS}, limitations array<string>, confidence string, issue_ids array<string>, resolutions {checks.RESOLUTIONS}"


def item(**k):
    base = dict(evidence_id="E1", text="Điều 5 quy định", document_number="12/2020/NĐ-CP", related_numbers=None, article="5", clause=None, point=None, status="EFFECTIVE", related_statuses=None, status_scope="provision", source_url="https://vanban.gov.vn/x/", as_of=DAY, version_id="v1", content_valid_from=dt.date(2020, 1, 1), content_valid_to=None)
    return base | k


def case(id, **k):
    base = dict(id=id, question="Điều 5 nói gì?", as_of=DAY, temporal_intent="current_law", historical_content_available=True, warnings=None, evidence=[item()], answer="", claims=[dict(text="Điều 5 có hiệu lực", evidence_ids=["E1"], issue_ids=[])], limitations=[], confidence="high", issue_ids=None, resolutions=None)
    return base | k


def claim(text="Nội dung", ids=("E1",), issues=()):
    return dict(text=text, evidence_ids=list(ids), issue_ids=list(issues))


CASES = [
    (case(0), "VERIFIED", []),
    (case(1, question="Dự đoán chính xác kết quả"), "REFUSED", ["CASE_SPECIFIC_PREDICTION_UNSUPPORTED"]),
    (case(2, evidence=[]), "REFUSED", ["INSUFFICIENT_EVIDENCE"]),
    (case(3, temporal_intent="historical", historical_content_available=False), "REFUSED", ["HISTORICAL_SOURCE_UNAVAILABLE", "HISTORICAL_LIMITATION_MISSING"]),
    (case(4, answer="Không đủ căn cứ", claims=[], confidence="low"), "REFUSED", []),
    (case(5, claims=[], confidence="sure"), "REPAIR_REQUIRED", ["MISSING_CLAIMS", "INVALID_CONFIDENCE"]),
    (case(6, claims=[claim(" ")]), "REPAIR_REQUIRED", ["EMPTY_CLAIM"]),
    (case(7, claims=[claim(ids=()), claim(ids=("E9",))]), "REPAIR_REQUIRED", ["MISSING_CITATION", "UNKNOWN_EVIDENCE_ID"]),
    (case(8, answer="Theo 99/2021/TT-BTC [E7]"), "REPAIR_REQUIRED", ["DOCUMENT_NUMBER_NOT_IN_EVIDENCE", "UNKNOWN_EVIDENCE_ID"]),
    (case(9, evidence=[item(), item(evidence_id="E2", document_number="7/2019/QĐ-X", article="9", text="khác")], claims=[claim("Theo 7/2019/QĐ-X, Điều 9")]), "REPAIR_REQUIRED", ["DOCUMENT_NUMBER_CITATION_MISMATCH", "PROVISION_CITATION_MISMATCH"]),
    (case(10, answer="Khoản 3"), "REPAIR_REQUIRED", ["PROVISION_CITATION_MISMATCH"]),
    (case(11, answer="Văn bản đã hết hiệu lực"), "REPAIR_REQUIRED", ["STATUS_CITATION_MISMATCH"]),
    (case(12, evidence=[item(status="SUSPENDED")], claims=[claim()]), "REPAIR_REQUIRED", ["STATUS_DISCLOSURE_MISSING"]),
    (case(13, evidence=[item(status="SUSPENDED")], claims=[claim()], limitations=["Đang bị đình chỉ"]), "VERIFIED", []),
    (case(14, evidence=[item(status="PARTIALLY_EFFECTIVE", status_scope="document")], claims=[claim("còn hiệu lực một phần")]), "REPAIR_REQUIRED", ["PROVISION_STATUS_LIMITATION_MISSING"]),
    (case(15, evidence=[item(as_of=dt.date(2023, 1, 1))], claims=[claim()]), "REPAIR_REQUIRED", ["AS_OF_MISMATCH"]),
    (case(16, temporal_intent="historical", evidence=[item(content_valid_to=DAY)], claims=[claim()]), "REPAIR_REQUIRED", ["HISTORICAL_VERSION_MISMATCH"]),
    (case(17, answer="Xem https://evil.example/a. và HTTPS://VANBAN.gov.vn/x"), "REPAIR_REQUIRED", ["UNTRUSTED_URL"]),
    (case(18, warnings=["historical text missing"], claims=[claim()]), "REPAIR_REQUIRED", ["HISTORICAL_LIMITATION_MISSING"]),
    (case(19, issue_ids=["I1", "I2", "I3"], claims=[claim(issues=("I1",)), claim(), claim(issues=("I9",))], resolutions=[dict(issue_id="I1", status="ANSWERED", claim_indexes=[0], explanation="x"), dict(issue_id="I1", status="ANSWERED", claim_indexes=[0], explanation="x"), dict(issue_id="I2", status="INSUFFICIENT_EVIDENCE", claim_indexes=[], explanation="thiếu"), dict(issue_id="I8", status="ANSWERED", claim_indexes=[0], explanation="x")]), "REPAIR_REQUIRED", ["MISSING_ISSUE_RESOLUTION", "DUPLICATE_ISSUE_RESOLUTION", "UNKNOWN_ISSUE_ID", "UNKNOWN_ISSUE_ID", "UNKNOWN_ISSUE_ID", "INVALID_ISSUE_RESOLUTION", "INVALID_ISSUE_RESOLUTION", "INVALID_ISSUE_RESOLUTION"]),
]


def test_every_code_of_the_verifier(spark):
    got = {r.id: r for r in checks.verify(spark.createDataFrame([c for c, _, _ in CASES], SCHEMA)).collect()}
    for c, verdict, codes in CASES:
        assert (got[c["id"]].verdict, sorted(p.code for p in got[c["id"]].problems)) == (verdict, sorted(codes)), c["id"]
    given = {p.code for r in got.values() for p in r.problems}
    assert set(checks.STRUCTURAL_CODES) == given
    assert len(set(checks.STRUCTURAL_CODES) | set(checks.OTHER_CODES)) == 33
    assert checks.verify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_contract_of_answers(spark):
    good = dict(answer="", claims=[dict(text="a", evidence_ids=["E1"])], limitations=[], confidence="low")
    bad = [("x", "ROOT_SHAPE_INVALID"), (good | {"confidence": "no"}, "CONFIDENCE_INVALID"), (good | {"extra": 1}, "ROOT_CONTRACT_INVALID"), (good | {"limitations": ["x" * 301]}, "ROOT_CONTRACT_INVALID"), (good | {"claims": [dict(text=" ", evidence_ids=[])]}, "CLAIM_CONTRACT_INVALID"), (good | {"claims": [dict(text="a", evidence_ids=[], supporting_quotes=[dict(evidence_id="E1", quote=" ")])]}, "SUPPORTING_QUOTES_INVALID"), (good | {"issue_resolutions": [dict(issue_id="I1", status="DONE", claim_indexes=[], explanation="x")]}, "ISSUE_RESOLUTION_INVALID"), (good, None)]
    rows = [(k, json.dumps(v) if not isinstance(v, str) else v) for k, (v, _) in enumerate(bad)]
    got = dict(spark.createDataFrame(rows, "id int, raw string").select("id", answering.answer_contract(F.col("raw"))["problem"]).collect())
    assert got == {k: p for k, (_, p) in enumerate(bad)}


def test_issue_plans(spark):
    issue = lambda n, q: dict(issue_id=f"I{n}", question=f" q{n} ", search_query=q)
    plans = [{"issues": [issue(1, "tác động 1/2020/NĐ-CP"), issue(2, "thay thế 1/2020/NĐ-CP"), issue(3, "tác động 2/2020/NĐ-CP")]}, {"issues": [issue(2, "x")]}, {"issues": []}, {"issues": [issue(1, "x" * 501)]}, {"issues": [issue(1, "x")], "more": 1}]
    got = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(plans)], "id int, raw string").select("id", answering.issue_plan(F.col("raw")).alias("p")).orderBy("id").collect()
    assert [(i.issue_id, i.question, i.search_query) for i in got[0].p.issues] == [("I1", "q2", "thay thế 1/2020/NĐ-CP"), ("I2", "q3", "tác động 2/2020/NĐ-CP")]
    assert [r.p.problem for r in got] == [None, "INVALID_ISSUE", "INVALID_PLAN", "INVALID_ISSUE", "INVALID_PLAN"]


def test_reviews(spark):
    rows = [
        (0, [(0, "SUPPORTED", "r")], 1, ["I1"], [("I1", "COVERED_BY_CLAIMS", "r", [0])], None),
        (1, [(0, "SUPPORTED", "r")] * 2, 1, [], [], "INCOMPLETE_OR_DUPLICATE_CLAIM_CHECKS"),
        (2, [(0, "MAYBE", "r")], 1, [], [], "INVALID_VERDICT"),
        (3, [(0, "SUPPORTED", "r")], 1, ["I1"], [], "INCOMPLETE_OR_DUPLICATE_COVERAGE_CHECKS"),
        (4, [(0, "SUPPORTED", "r")], 1, ["I1"], [("I1", "COVERED_BY_CLAIMS", "r", [])], "COVERAGE_WITHOUT_CLAIMS"),
        (5, [], 0, ["I1"], [("I1", "DECLARED_UNANSWERED", "r", [])], None),
        (6, [(0, "SUPPORTED", " ")], 1, [], [], "INVALID_REASON"),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], f"id int, checks {answering.CHECKS}, n int, issues array<string>, coverage {answering.COVERAGE}")
    got = dict(df.select("id", answering.review_error(F.col("checks"), F.col("n"), F.col("issues"), F.col("coverage"))).collect())
    assert got == {r[0]: r[5] for r in rows}


def test_attempts(spark):
    """Verified at once, after a repair, after an invalid response; refused for failures, for repairs that stay wrong, and before anything is made."""
    asked = [{k: v for k, v in case(n).items() if k not in ("answer", "claims", "limitations", "confidence", "resolutions")} for n in range(7)]
    asked[6]["evidence"] = []
    schema = f"request_id int, question string, as_of date, temporal_intent string, historical_content_available boolean, warnings array<string>, evidence {checks.EVIDENCE}, issue_ids array<string>"
    requests = spark.createDataFrame([{"request_id": a.pop("id"), **a} for a in asked], schema)
    ok, wrong = [claim("Điều 5 có hiệu lực.")], [claim("Điều 6")]
    rows = [(0, 1, ok, None), (1, 1, wrong, None), (1, 2, ok, None), (2, 1, None, "invalid_response"), (2, 2, ok, None), (3, 1, None, "timeout"), (4, 1, wrong, None), (4, 2, wrong, None), (5, 1, None, "invalid_response"), (5, 2, None, "invalid_response")]
    prepared = spark.createDataFrame([(i, n, "", c, [], "high", None, f) for i, n, c, f in rows], f"request_id int, attempt int, answer string, claims {checks.CLAIMS}, limitations array<string>, confidence string, resolutions {checks.RESOLUTIONS}, failure string")
    made = answering.answer_requests(requests, answering.queued(prepared)).collect()
    assert {r.request_id: (r.state, r.attempts, sorted(p.code for p in r.problems)) for r in made} == {
        0: ("VERIFIED", 1, []), 1: ("VERIFIED", 2, []), 2: ("VERIFIED", 2, []), 3: ("REFUSED", 1, ["GENERATION_TIMEOUT"]), 4: ("REFUSED", 2, ["PROVISION_CITATION_MISMATCH"]),
        5: ("REFUSED", 2, ["INVALID_STRUCTURED_RESPONSE"]), 6: ("REFUSED", 0, ["INSUFFICIENT_EVIDENCE"]),
    }
    assert {r.request_id: r.answer for r in made}[0] == "Điều 5 có hiệu lực. [E1]"
    off = answering.answer_requests(requests.limit(1), answering.no_answer, attempts=1).collect()
    assert [r.state for r in off] == ["REFUSED"]


def test_settings():
    made = answering.AnswerSettings.from_environment({"ANSWER_WINDOW": "4000", "OTHER": "x"})
    assert (made.budget, made.evidence_total) == (1000, 12)
    with pytest.raises(ValueError):
        answering.AnswerSettings.from_environment({"ANSWER_SEMANTIC_MODE": "loud"})


def test_lexical_queries(spark):
    rows = [(1, "Công ty có được đơn phương chấm dứt hợp đồng không?"), (2, "mức phạt"), (3, "title:x\\"), (4, None)]
    got = {r.query_id: r for r in lexical.build_queries(spark.createDataFrame(rows, "query_id int, query string")).collect()}
    assert [(p.phrase, p.boost) for p in got[1].phrases] == [("đơn phương chấm dứt hợp đồng lao động", 20.0), ("công ty", 4.0), ("đơn phương chấm dứt hợp đồng", 10.0)]
    assert got[1].core == ["công", "ty", "đơn", "phương", "chấm", "dứt", "hợp", "đồng"]
    assert [(p.phrase, p.boost) for p in got[2].phrases] == [("mức phạt", 4.0)] and got[3].terms == ["title", "x"] and got[4].phrases == []
    docs = spark.createDataFrame([(1, "Mức phạt tiền"), (2, "phạt theo mức"), (3, "mức-phạt"), (4, None), (5, "xmức phạt")], "doc_id int, text string")
    built = lexical.build_queries(spark.createDataFrame(rows, "query_id int, query string"))
    assert {(r.query_id, r.doc_id): r.boost for r in lexical.phrase_scores(docs, built).collect()} == {(2, 1): 6.0, (2, 2): 2.0, (2, 3): 6.0}


def test_sources(spark):
    payload = {"results": [{"link": "https://a.gov.vn/1", "name": "T", "items": [{"href": "https://b.vn"}]}, {"url": ""}], "url": "https://top.vn", "content": "c"}
    found = sources.extract_candidates(spark.createDataFrame([(7, json.dumps(payload)), (8, "no json"), (9, None)], "document_id int, payload string")).collect()
    assert [(r.document_id, r.position, r.url, r.title, r.snippet) for r in found] == [(7, 0, "https://top.vn", "", "c"), (7, 1, "https://a.gov.vn/1", "T", ""), (7, 2, "https://b.vn", "", "")]
    links = spark.createDataFrame([("https://g.co/url?sa=t&url=https%3A%2F%2Fa.vn%2Fx&z=1",), ("https://a.vn/x?y=1",), ("",), (None,)], "u string")
    assert [r[0] for r in links.select(sources.direct_link(F.col("u"))).collect()] == ["https://a.vn/x", "https://a.vn/x?y=1", None, None]
    urls = [("https://a.vn/x", True, True), ("ftp://a.vn", False, False), ("http://localhost/x", False, False), ("https://x.local", False, False), ("https://raw.githubusercontent.com/x", True, False), (None, False, False)]
    df = spark.createDataFrame([(u,) for u, _, _ in urls], "u string").select(sources.is_safe_url(F.col("u")), sources.is_readable_source(F.col("u")))
    assert [tuple(r) for r in df.collect()] == [x[1:] for x in urls]
    stored = spark.createDataFrame([(1, "u", "t", 70, "EXPIRED", False, DAY), (2, "v", "t", 95, "VERIFIED", True, DAY)], "document_id int, url string, title string, score int, status string, active boolean, checked_on date")
    new = spark.createDataFrame([(1, "u", "n", 99), (3, "w", "n", 98)], "document_id int, url string, title string, score int")
    after = sources.store(stored, new, F.lit("2024-06-01").cast("date"))
    assert sorted((r.document_id, r.score, r.status, r.active) for r in after.collect()) == [(1, 99, "VERIFIED", True), (2, 95, "VERIFIED", True), (3, 98, "VERIFIED", True)]
    docs = spark.createDataFrame([(1, "o"), (4, "p")], "document_id int, source_url string")
    assert sorted((r.document_id, r.resolved_url, r.status) for r in sources.describe(docs, after).collect()) == [(1, "u", "VERIFIED"), (4, None, "UNRESOLVED")]


def test_chat(spark):
    c = spark.createDataFrame([("w", 1, "p", None, "a"), ("w", 2, None, "t2", "b"), ("x", 1, None, "tx", "c")], "workspace_id string, id int, project_id string, share_token string, title string")
    assert [r.id for r in chat.of_workspace(c, "w").orderBy("id").collect()] == [1, 2] and chat.of_workspace(c, "bad name").count() == 0
    renamed = chat.upsert(c, spark.createDataFrame([("w", 1, "new"), ("w", 9, "made")], "workspace_id string, id int, title string"))
    assert sorted((r.workspace_id, r.id, r.title, r.project_id) for r in renamed.collect()) == [("w", 1, "new", "p"), ("w", 2, "b", None), ("w", 9, "made", None), ("x", 1, "c", None)]
    shared = chat.share(c, spark.createDataFrame([("w", 1, True), ("w", 2, True), ("x", 1, False)], "workspace_id string, id int, shared boolean"), "k")
    tokens = {(r.workspace_id, r.id): r.share_token for r in shared.collect()}
    assert len(tokens["w", 1]) == 32 and tokens["w", 2] == "t2" and tokens["x", 1] is None
    assert {r.project_id for r in chat.delete_projects(c, spark.createDataFrame([("p",)], "project_id string")).collect()} == {None}
    schema = "conversation_id int, client_message_id string, reply_to string, role string, content string, state string, created_at int"
    m = spark.createDataFrame([(1, "a", None, "user", "hi", None, 1)], schema)
    m = chat.put_messages(m, spark.createDataFrame([(1, "a", None, "user", "again", None, 2), (1, "b", None, "user", "two", None, 3), (1, "b", None, "user", "three", None, 4)], schema))
    assert sorted(r.content for r in m.collect()) == ["hi", "two"]
    m = chat.put_replies(m, spark.createDataFrame([(1, None, "a", "assistant", "r1", "REFUSED", 5), (1, None, "a", "assistant", "r2", "VERIFIED", 6)], schema))
    assert [(r.content, r.state) for r in m.filter("reply_to = 'a'").collect()] == [("r2", "completed")]
    opened = chat.shared_with(shared.filter("workspace_id = 'w'"), m, spark.createDataFrame([(tokens["w", 1],), (None,)], "share_token string"))
    assert [r.content for r in opened.collect()] == ["hi", "two", "r2"]
    assert chat.delete_conversations(m, spark.createDataFrame([(1,)], "conversation_id int")).count() == 0


def test_index_builds_resume_and_are_promoted_when_complete(spark, tmp_path):
    points = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(25)], "point_id int, vector array<double>")
    index, aliases = f"{tmp_path}/v1", f"{tmp_path}/aliases.json"
    assert indexes.build_vectors(spark, index, "r1", points, size=10, most_batches=2)["batches"] == 2
    with pytest.raises(ValueError, match="incomplete, count"):
        indexes.promote(spark, aliases, "dense", index, 25)
    assert indexes.build_vectors(spark, index, "r1", points, size=10) | {"cursor": 0} == {"schema": 1, "kind": "vectors", "release": "r1", "cursor": 0, "batches": 3, "complete": True}
    assert indexes.promote(spark, aliases, "dense", index, 25)["dense"]["index"] == index
    indexes.upsert_points(spark, index, spark.createDataFrame([(3, [9.0, 9.0])], points.schema))
    assert {r.point_id: r.vector[0] for r in indexes.read_index(spark, index).collect()} == {k: 9.0 if k == 3 else float(k) for k in range(25)}
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id int, text string")
    lexical_index = f"{tmp_path}/l1"
    indexes.build_postings(spark, lexical_index, "r2", docs, ["text"], size=1)
    assert sorted((r.doc_id, r.term, r.tf) for r in indexes.read_index(spark, lexical_index).collect()) == [(1, "a", 2), (1, "b", 1), (2, "b", 1)]
    with pytest.raises(ValueError, match="release"):
        indexes.promote(spark, aliases, "sparse", lexical_index, 2, beside="dense")
    assert set(indexes.promote(spark, aliases, "sparse", lexical_index, 2)) == {"dense", "sparse"}
    indexes.stage(docs, "staged_docs")
    assert spark.sql("SELECT count(*) FROM staged_docs").first()[0] == 2


def test_model_tokens(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    pytest.importorskip("tokenizers")
    try:
        tokens = tokenizers.load(path)
    except Exception:
        pytest.skip("no vocabulary here")
    text = "Một văn bản dài hơn nhiều so với giới hạn của một mảnh. " * 5
    pieces = tokens.split(text, 20)
    assert "".join("".join(p.split()) for p in pieces) == "".join(text.split()) and all(tokens.count(p) <= 22 for p in pieces)
    assert tokens.tail(text, 20) == pieces[-1] and tokens.split("", 20) == []
    with pytest.raises(ValueError):
        tokens.split(text, 0)
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(tokenizers.model_token_count(F.col("t"), path)).collect()
    assert [r[0] for r in got] == [tokens.count(text), 0, tokens.count("")]
    assert tokenizers.counter()("a, b") == 3
    chunking.use_counter(tokenizers.counter(path))
    try:
        assert chunking.count_tokens(text) == tokens.count(text)
    finally:
        chunking.use_counter()


def test_frames(spark):
    e = spark.createDataFrame([(1, 2, "done", "{}", 40), (1, 1, "delta", '{"t": 1}', 0)], "id int, seq int, event string, data string, at int")
    text = frames.replay(e, "id").first().stream
    assert list(frames.read_frames((frames.KEEP_ALIVE + text).split("\n"))) == [("delta", {"t": 1}), ("done", {})]
    assert list(frames.read_frames(iter(["data: [1,", "data: 2]"]))) == [("message", [1, 2])]
    assert [(r.seq, r.n) for r in frames.keep_alives(e, "id", "at").orderBy("seq").collect()] == [(1, 0), (2, 2)]


# Tables, appendices and pages.


def test_tables(spark):
    text = 'a\n[[TABLE_START]]\n[[TABLE_HEADERS]]["H 1", "K"]\n[[TABLE_ROW]]["x", 2]\nloose\n[[TABLE_ROW]]nope\n[[TABLE_END]]\nb\n[[TABLE_START]]\n[[TABLE_ROW]]["open"]'
    lines = structure.classify(structure.line_tokens(spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string")))
    got = [tuple(r) for r in structure.tables(lines).orderBy("line_start").collect()]
    assert got == [(1, 2, 7, ["H 1", "K"], [["x", "2"]], ["unexpected_table_line:5", "invalid_table_row:6"]), (1, 9, 10, [], [["open"]], ["unterminated_table:9"])]


def test_rows_stay_under_their_headers():
    policy = chunking.ChunkPolicy(target=20, most=30)
    rows = [[f"r{k}", "x"] for k in range(12)]
    found = chunking.table_blocks(["A", "B"], rows, policy)
    assert len(found) > 1 and {c for c, _ in found} == {"A | B"}
    assert " ".join(t for _, t in found).count("r") == 12 and all(chunking.count_tokens(f"{c}\n{t}") <= 30 for c, t in found)
    wide = chunking.table_blocks(["h " * 20], rows, policy)
    assert wide[0][0] != "" and wide[-1][0] == "Bảng dữ liệu" and all(chunking.count_tokens(f"{c}\n{t}") <= 30 for c, t in wide)
    assert chunking.table_blocks(["A"], [], policy) == [("", "A")] and chunking.table_blocks([], [], policy) == []


def test_appendices_keep_articles_tables_and_headings(spark):
    doc = 'Điều 1. Thân\nPHỤ LỤC I\nMỞ ĐẦU\nchữ\nĐiều 1. Trong phụ lục\nnội dung\n[[TABLE_START]]\n[[TABLE_HEADERS]]["Mã"]\n[[TABLE_ROW]]["a"]\n[[TABLE_END]]\nPHỤ LỤC II'
    found = chunking.chunk_documents(spark.createDataFrame([(1, doc)], "doc_id int, text string")).orderBy("ordinal").collect()
    kinds = [r.chunk_type for r in found]
    assert kinds.count("appendix_parent") == 2 and kinds.count("article") == 2 and "appendix_block" in kinds
    parent = next(r for r in found if r.chunk_type == "appendix_parent")
    assert all(r.parent_id == parent.chunk_id for r in found if r.chunk_type == "article" and "phụ lục" in r.text)
    assert any(r.text.startswith("MỞ ĐẦU") and r.context == "PHỤ LỤC I" for r in found)
    assert [r.text for r in found if r.path.endswith("II") and r.is_indexable] == ["PHỤ LỤC II"]
    docs = spark.createDataFrame([(1, doc)], "doc_id int, text string")
    assert chunking.uncovered_lines(docs, chunking.chunk_documents(docs)).count() == 0
    assert [r.line for r in chunking.uncovered_lines(docs, chunking.chunk_documents(docs).filter("chunk_type <> 'article'")).orderBy("line_no").collect()][0] == "Điều 1. Thân"


def test_pages_without_an_end_of_the_head():
    assert html.clean_html("<html><head><title>t</title><meta><p>Nội dung</p>") == "Nội dung"
    assert html.clean_html("<head><title>t</title><body>Nội dung</body>") == "Nội dung"
    assert html.clean_html("<html><head><style>x</style>\n</head>\nNội dung</html>") == "Nội dung"


def test_ranks_of_blocks_of_queries(spark, monkeypatch):
    from legispark.operators import search

    points = spark.createDataFrame([(k, None if k == 7 else [float(k % 5), 1.0, float(k)]) for k in range(40)] + [(50, [0.0, 0.0, 0.0]), (51, [1.0, None, 1.0])], "point_id long, vector array<double>").repartition(3)
    queries = points.filter("point_id % 4 = 0").withColumnRenamed("point_id", "query_id")
    one = sorted(tuple(r) for r in search.dense_top_k(points, queries, 5).collect())
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "SCORED_AT_ONCE", 2)
    assert sorted(tuple(r) for r in search.dense_top_k(points, queries, 5).collect()) == one and len(one) == 50


def test_terms_beyond_the_filter_give_the_same_scores(spark, monkeypatch):
    from legispark.operators import search

    docs = spark.createDataFrame([(1, "a b a c"), (2, "b c"), (3, None), (4, "")], "doc_id int, text string")
    terms = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "z")], "query_id int, term string")

    def scores():
        return sorted(tuple(r) for r in search.bm25(*search.term_postings(docs, {"text": F.col("text")}, terms), terms, {"text": 1.0}).collect())

    few = scores()
    monkeypatch.setattr(search, "FILTER_TERMS", 1)
    assert scores() == few and len(few) == 4


def test_best_excerpts_agree_with_all_pairs(spark):
    from legispark.operators.evidence import best_excerpts

    import random

    rng = random.Random(4)
    text = lambda n: " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(n))
    claims, parts = [(k, text(12)) for k in range(15)], [(d, i, text(15)) for d in range(20) for i in range(3)]
    want = {}
    for c, t in claims:
        own = set(t.split())
        met = [(len(own & set(p.split())), -d, -i) for d, i, p in parts]
        met = [m for m in met if m[0] >= 4 and m[0] >= 0.2 * len(own)]
        if met:
            n, d, i = max(met)
            want[c] = (-d, -i, n)
    got = best_excerpts(spark.createDataFrame(claims, "item_id int, text string"), spark.createDataFrame(parts, "doc_id int, i int, text string")).collect()
    assert {r.item_id: (r.doc_id, r.i, r.n) for r in got} == want and want


def test_best_excerpts_read_the_parts_once(spark):
    from legispark.operators.evidence import best_excerpts

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    claims = [(1, "Một hai ba bốn năm"), (2, "một hai ba"), (3, "a b c d e f g h i k"), (4, None), (5, "x y z u")]
    texts = ["một, hai - ba BỐN", "bốn năm một hai", "năm bốn ba hai một", "một hai ba bốn năm", "a b c", "d c b a", "a a b b c c d d", None, "x x x x", "z y x u v"]
    parts = spark.createDataFrame([(9 - k // 2, k % 2, t) for k, t in enumerate(texts)] + [(7, 5, "d c b a")], "doc_id int, i int, text string")
    got = best_excerpts(spark.createDataFrame(claims, "item_id int, text string"), parts.mapInPandas(counted, parts.schema)).collect()
    assert {r.item_id: (r.doc_id, r.i, r.n) for r in got} == {1: (8, 0, 5), 3: (6, 0, 4), 5: (5, 1, 4)}
    assert read.value == len(texts) + 1
