"""The structural verifier: what an answer claims against the evidence it was given, as expressions over one row.

A row holds a question, its evidence, the answer with its claims, and the issues it had to resolve. Evidence and claims
are short lists by contract, so every check is an expression over arrays: no join, no shuffle, any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = "array<struct<evidence_id:string,text:string,document_number:string,related_numbers:array<string>,article:string,clause:string,point:string,status:string,related_statuses:array<string>,status_scope:string,source_url:string,as_of:date,version_id:string,content_valid_from:date,content_valid_to:date>>"
CLAIMS = "array<struct<text:string,evidence_ids:array<string>,issue_ids:array<string>>>"
RESOLUTIONS = "array<struct<issue_id:string,status:string,claim_indexes:array<int>,explanation:string>>"
PROBLEMS = "array<struct<code:string,claim:int,detail:string>>"

# How numbers, provisions, statuses and limits are worded.
NUMBER = r"(?iuU)(?<!\w)\d{1,4}\s*/\s*\d{4}\s*/\s*[A-ZÀ-ỸĐ0-9]+(?:\s*-\s*[A-ZÀ-ỸĐ0-9]+)*(?!\w)"
#: The same with a serial number of any length, for tables whose keys number the documents.
LONG_NUMBER = NUMBER.replace(r"\d{1,4}", r"\d+", 1)
URL = r"(?i)(?:https?://|www\.)[^\s<>()\[\]{}\"']+"
EVIDENCE_ID = r"\b[EG][1-9][0-9]*\b"
PROVISIONS = {
    "article": r"(?iuU)\bĐiều\s+([0-9]+[A-Za-zĐđ]?)\b",
    "clause": r"(?iuU)\bKhoản\s+([0-9]+[A-Za-zĐđ]?)\b",
    "point": r"(?iuU)(?<!thời )(?<!địa )\bĐiểm\s+([0-9]+|[A-Za-zĐđ])\b",
}
REFUSAL = r"(?iuU)\b(?:không đủ|thiếu)\s+(?:căn cứ|bằng chứng|dữ liệu)|\bkhông thể (?:kết luận|trả lời|xác định)\b|\btừ chối\b"
HISTORICAL_LIMIT = r"(?iuU)(?:không|chưa|thiếu).{0,40}(?:nội dung|phiên bản|nguồn).{0,30}lịch sử|(?:nội dung|phiên bản)\s+hiện (?:tại|hành).{0,50}(?:lịch sử|thời điểm)"
PROVISION_LIMIT = r"(?iuU)(?:chưa|không)\s+có\s+dữ liệu\s+hiệu lực.{0,40}(?:điều|khoản|điểm)|hiệu lực\s+cấp\s+văn bản.{0,60}(?:điều|khoản|điểm)"
STATUS_WORDING = (
    (r"(?iuU)\b(?:hết hiệu lực một phần|còn hiệu lực một phần)\b", ("PARTIALLY_EFFECTIVE",)),
    (r"(?iuU)\b(?:chưa|chưa bắt đầu)\s+có hiệu lực\b", ("NOT_YET_EFFECTIVE", "DRAFT")),
    (r"(?iuU)\b(?:không còn|đã hết|hết)\s+hiệu lực\b|\b(?:bị|đã)\s+bãi bỏ\b", ("EXPIRED", "REPEALED")),
    (r"(?iuU)\b(?:bị\s+)?(?:tạm đình chỉ|đình chỉ|tạm ngưng)\b", ("SUSPENDED",)),
    (r"(?iuU)(?<!không )(?<!chưa )\b(?:vẫn\s+)?(?:còn|đang)\s+(?:có\s+)?hiệu lực\b|(?<!không )(?<!chưa )\bcó hiệu lực\b|\bhiện hành\b", ("EFFECTIVE", "PARTIALLY_EFFECTIVE")),
)
DISCLOSURE = {"PARTIALLY_EFFECTIVE": ("PARTIALLY_EFFECTIVE",), "SUSPENDED": ("SUSPENDED",), "EXPIRED": ("EXPIRED", "REPEALED"), "REPEALED": ("EXPIRED", "REPEALED"), "NOT_YET_EFFECTIVE": ("NOT_YET_EFFECTIVE", "DRAFT"), "DRAFT": ("NOT_YET_EFFECTIVE", "DRAFT")}
PREDICTIONS = (
    r"(?iuU)\bdự\s+đoán\s+chính\s+xác\b",
    r"(?iuU)\b(?:thẩm\s+phán|tòa\s+án)\b.{0,100}\b(?:chính\s+xác\s+)?(?:bao\s+nhiêu|mức\s+bồi\s+thường)\b",
    r"(?iuU)\bchắc\s+chắn\b.{0,80}\b(?:thắng|thua|phạm\s+tội|vô\s+hiệu|trái\s+pháp\s+luật|bồi\s+thường|trả\s+lại)\b|\b(?:thắng|thua|phạm\s+tội|vô\s+hiệu|trái\s+pháp\s+luật|bồi\s+thường|trả\s+lại)\b.{0,80}\bchắc\s+chắn\b",
    r"(?iuU)\b(?:không\s+có|không\s+cung\s+cấp|chưa\s+cung\s+cấp|chưa\s+được\s+cung\s+cấp)\b.{0,120}\b(?:chính\s+xác|kết\s+luận|khẳng\s+định|xác\s+nhận|tính)\b",
    r"(?iuU)\b(?:kết\s+luận|khẳng\s+định|xác\s+nhận|tính)\b.{0,120}\b(?:không\s+có|không\s+cung\s+cấp|chưa\s+cung\s+cấp|chưa\s+được\s+cung\s+cấp)\b",
)
#: The codes that this verifier gives, and those that other stages give with the same meaning of the word.
STRUCTURAL_CODES = (
    "CASE_SPECIFIC_PREDICTION_UNSUPPORTED", "INSUFFICIENT_EVIDENCE", "HISTORICAL_SOURCE_UNAVAILABLE", "HISTORICAL_LIMITATION_MISSING", "HISTORICAL_VERSION_MISMATCH", "MISSING_CLAIMS", "EMPTY_CLAIM",
    "MISSING_CITATION", "UNKNOWN_EVIDENCE_ID", "DOCUMENT_NUMBER_NOT_IN_EVIDENCE", "DOCUMENT_NUMBER_CITATION_MISMATCH", "PROVISION_CITATION_MISMATCH", "STATUS_CITATION_MISMATCH", "STATUS_DISCLOSURE_MISSING",
    "PROVISION_STATUS_LIMITATION_MISSING", "AS_OF_MISMATCH", "UNTRUSTED_URL", "INVALID_CONFIDENCE", "UNKNOWN_ISSUE_ID", "MISSING_ISSUE_RESOLUTION", "DUPLICATE_ISSUE_RESOLUTION", "INVALID_ISSUE_RESOLUTION",
)
OTHER_CODES = ("EMPTY_ANSWER", "CLAIM_NOT_SUPPORTED", "SUPPORTING_QUOTE_INVALID", "SEMANTIC_REVIEW_UNAVAILABLE", "GENERATION_FAILED", "GENERATION_TRUNCATED", "GENERATION_TIMEOUT", "PROVIDER_UNAVAILABLE", "INVALID_STRUCTURED_RESPONSE", "ISSUE_PLAN_INCOMPLETE", "ISSUE_NOT_COVERED")


def _strings(*parts: Column) -> Column:
    return F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group)))


def identifier(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", ""))


def address(url: Column) -> Column:
    """A URL as it is compared: scheme and host in lower case, no slash at the end, no fragment."""
    u = F.regexp_replace(F.trim(url), "/+$", "")
    u = F.when(F.lower(u).startswith("www."), F.concat(F.lit("https://"), u)).otherwise(u)
    head = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0))
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(head == "", F.lower(u)).otherwise(F.concat(head, path, F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)))


def urls(text: Column) -> Column:
    return F.array_distinct(F.transform(_matches(text, URL), lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", "")))


def document_numbers(text: Column, pattern: str = NUMBER) -> Column:
    return _matches(text, pattern)


def known_numbers(evidence: Column, pattern: str = NUMBER) -> Column:
    """The numbers that evidence has: of its documents, of those they relate to, and in its texts."""
    each = F.transform(evidence, lambda e: _strings(F.array(e["document_number"]), e["related_numbers"], document_numbers(e["text"], pattern)))
    return F.filter(F.transform(F.flatten(each), identifier), lambda n: n != "")


def known_provisions(evidence: Column, field: str) -> Column:
    each = F.transform(evidence, lambda e: _strings(F.array(e[field]), _matches(e["text"], PROVISIONS[field], 1)))
    return F.filter(F.transform(F.flatten(each), lambda p: F.lower(F.trim(F.coalesce(p, F.lit(""))))), lambda p: p != "")


def expected_statuses(text: Column) -> Column:
    """For each wording of a status that a text has, the statuses it can mean."""
    text = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.array(*map(F.lit, meant))) for p, meant in STATUS_WORDING)))


def _problem(code: str, claim: Column, detail: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), claim.cast("int").alias("claim"), detail.cast("string").alias("detail"))


def _if(condition: Column, code: str, claim: Column | None = None, detail: Column | None = None) -> Column:
    none = F.lit(None)
    one = F.array(_problem(code, none if claim is None else claim, none if detail is None else detail)).cast(PROBLEMS)
    return F.when(F.coalesce(condition, F.lit(False)), one).otherwise(F.array().cast(PROBLEMS))


def _each(values: Column, code: str, claim: Column | None = None) -> Column:
    return F.transform(values, lambda v: _problem(code, F.lit(None) if claim is None else claim, v)).cast(PROBLEMS)


def _overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def _status_problems(text: Column, statuses: Column, claim: Column | None = None) -> Column:
    wrong = F.filter(expected_statuses(text), lambda meant: ~_overlap(meant, statuses))
    return _each(F.transform(wrong, lambda meant: F.array_join(meant, "|")), "STATUS_CITATION_MISMATCH", claim)


def _provision_problems(text: Column, evidence: Column, claim: Column | None = None) -> Column:
    def of(field: str, pattern: str) -> Column:
        named = F.filter(_matches(text, pattern, 1), lambda p: ~F.array_contains(known_provisions(evidence, field), F.lower(p)))
        return _each(F.transform(named, lambda p: F.concat(F.lit(f"{field} "), p)), "PROVISION_CITATION_MISMATCH", claim)

    return F.concat(*(of(field, pattern) for field, pattern in PROVISIONS.items()))


def _claim_problems(c: Column, i: Column, pattern: str) -> Column:
    """One claim against the evidence that it cites."""
    evidence = F.col("evidence")
    ids = _strings(c["evidence_ids"])
    cited = F.filter(evidence, lambda e: F.array_contains(ids, e["evidence_id"]))
    unknown = F.array_except(ids, F.transform(evidence, lambda e: e["evidence_id"]))
    statuses = F.transform(F.flatten(F.transform(cited, lambda e: _strings(F.array(e["status"]), e["related_statuses"]))), lambda s: F.upper(s))
    stale = F.transform(F.filter(cited, lambda e: ~e["as_of"].eqNullSafe(F.col("as_of"))), lambda e: e["evidence_id"])
    covers = lambda e: F.coalesce((e["version_id"] != "") & (e["content_valid_from"] <= F.col("as_of")) & (e["content_valid_to"].isNull() | (F.col("as_of") < e["content_valid_to"])), F.lit(False))
    other_version = F.transform(F.filter(cited, lambda e: (F.col("temporal_intent") == "historical") & e["evidence_id"].startswith("E") & ~covers(e)), lambda e: e["evidence_id"])
    numbers = F.filter(document_numbers(c["text"], pattern), lambda n: ~F.array_contains(known_numbers(cited, pattern), identifier(n)))
    said = F.flatten(F.concat(expected_statuses(c["text"]), expected_statuses(F.col("_said"))))
    silent = F.filter(F.array_distinct(statuses), lambda s: F.coalesce(*(F.when(s == k, ~_overlap(F.array(*map(F.lit, v)), said)) for k, v in DISCLOSURE.items()), F.lit(False)))
    about_cited = F.concat(
        _each(stale, "AS_OF_MISMATCH", i), _each(other_version, "HISTORICAL_VERSION_MISMATCH", i), _each(numbers, "DOCUMENT_NUMBER_CITATION_MISMATCH", i),
        _provision_problems(c["text"], cited, i), _status_problems(c["text"], statuses, i), _each(silent, "STATUS_DISCLOSURE_MISSING", i),
    )
    return F.concat(
        _if(F.trim(F.coalesce(c["text"], F.lit(""))) == "", "EMPTY_CLAIM", i),
        _if(F.size(ids) == 0, "MISSING_CITATION", i),
        _each(unknown, "UNKNOWN_EVIDENCE_ID", i),
        F.when(F.size(cited) > 0, about_cited).otherwise(F.array().cast(PROBLEMS)),
    )


def issue_problems() -> Column:
    """Exactly one resolution for each issue; claims and resolutions point at each other. Columns: issue_ids, claims, resolutions, limitations."""
    issues, claims, made = F.col("issue_ids"), F.col("claims"), F.col("resolutions")
    resolved = F.transform(made, lambda r: r["issue_id"])
    twice = F.array_distinct(F.filter(resolved, lambda x: F.size(F.filter(resolved, lambda y: x == y)) > 1))
    per_claim = F.flatten(F.transform(claims, lambda c, i: F.concat(_if(F.size(_strings(c["issue_ids"])) == 0, "UNKNOWN_ISSUE_ID", i), _each(F.filter(_strings(c["issue_ids"]), lambda x: ~F.array_contains(issues, x)), "UNKNOWN_ISSUE_ID", i))))
    stray = F.filter(resolved, lambda x: ~F.array_contains(issues, x))

    def wrong(r: Column) -> Column:
        at = F.coalesce(r["claim_indexes"], F.array().cast("array<int>"))
        linked = F.forall(at, lambda k: F.coalesce((k >= 0) & (k < F.size(claims)) & F.array_contains(_strings(F.get(claims, k)["issue_ids"]), r["issue_id"]), F.lit(False)))
        answered = r["status"] == "ANSWERED"
        return F.when(answered, (F.size(at) == 0) | ~linked).otherwise((F.size(at) > 0) | ~F.coalesce(F.array_contains("limitations", r["explanation"]), F.lit(False)))

    bad = F.transform(F.filter(made, lambda r: F.array_contains(issues, r["issue_id"]) & wrong(r)), lambda r: r["issue_id"])
    answered = F.flatten(F.transform(F.filter(made, lambda r: (r["status"] == "ANSWERED") & F.array_contains(issues, r["issue_id"])), lambda r: F.coalesce(r["claim_indexes"], F.array().cast("array<int>"))))
    loose = F.flatten(F.transform(claims, lambda c, i: _if(~F.array_contains(answered, i), "INVALID_ISSUE_RESOLUTION", i)))
    found = F.concat(_each(F.sort_array(F.array_except(issues, resolved)), "MISSING_ISSUE_RESOLUTION"), _each(twice, "DUPLICATE_ISSUE_RESOLUTION"), per_claim, _each(stray, "UNKNOWN_ISSUE_ID"), _each(bad, "INVALID_ISSUE_RESOLUTION"), loose)
    return F.when(F.size(issues) > 0, found).otherwise(F.array().cast(PROBLEMS))


def verify(answers: DataFrame, number: str = NUMBER) -> DataFrame:
    """Adds ``verdict`` (VERIFIED, REPAIR_REQUIRED or REFUSED) and ``problems`` (code, claim, detail; distinct, in the order of the checks).

    Columns: question, as_of, temporal_intent, historical_content_available, warnings, evidence, answer, claims,
    limitations, confidence, issue_ids, resolutions (``EVIDENCE``, ``CLAIMS``, ``RESOLUTIONS``); a null list is empty.
    A question that asks for the outcome of a case, missing evidence and missing historical text refuse at once.
    ``number`` is what counts as a document's number.
    """
    empty = {"warnings": "array<string>", "evidence": EVIDENCE, "claims": CLAIMS, "limitations": "array<string>", "issue_ids": "array<string>", "resolutions": RESOLUTIONS}
    x = answers.withColumns({c: F.coalesce(F.col(c).cast(t), F.array().cast(t)) for c, t in empty.items()})
    text = F.coalesce("answer", F.lit(""))
    limits = F.array_join("limitations", " ")
    x = x.withColumn("_said", F.concat_ws("\n", text, F.array_join("limitations", "\n"))).withColumn("_all", F.concat_ws("\n", text, F.array_join(F.transform("claims", lambda c: F.coalesce(c["text"], F.lit(""))), "\n"), F.array_join("limitations", "\n")))
    evidence = F.col("evidence")
    past = (F.col("temporal_intent") == "historical") & ~F.coalesce("historical_content_available", F.lit(False))
    history = _if((past | F.exists("warnings", lambda w: F.lower(w).contains("historical"))) & ~limits.rlike(HISTORICAL_LIMIT), "HISTORICAL_LIMITATION_MISSING")

    question = F.trim(F.regexp_replace(F.coalesce("question", F.lit("")), r"(?U)\s+", " "))
    predicts = F.lit(False)
    for p in PREDICTIONS:
        predicts = predicts | question.rlike(p)
    unfounded = ~F.exists(evidence, lambda e: F.trim(F.coalesce(e["text"], F.lit(""))) != "")
    refusal = (F.size("claims") == 0) & (F.col("confidence") == "low") & text.rlike(REFUSAL)

    numbers = F.filter(document_numbers(F.col("_all"), number), lambda n: ~F.array_contains(known_numbers(evidence, number), identifier(n)))
    ids = F.array_except(_matches(F.col("_all"), EVIDENCE_ID), F.transform(evidence, lambda e: e["evidence_id"]))
    trusted = F.transform(F.filter(evidence, lambda e: F.coalesce(e["source_url"] != "", F.lit(False))), lambda e: address(e["source_url"]))
    strange = F.filter(urls(F.col("_all")), lambda u: ~F.array_contains(trusted, address(u)))
    cited = F.flatten(F.transform("claims", lambda c: _strings(c["evidence_ids"])))
    coarse = F.exists(evidence, lambda e: F.array_contains(cited, e["evidence_id"]) & (e["status_scope"] == "document") & (F.upper(e["status"]) == "PARTIALLY_EFFECTIVE") & (F.concat_ws("", e["article"], e["clause"], e["point"]) != ""))
    checks = F.concat(
        _if((F.size("claims") == 0) & (F.size("resolutions") == 0), "MISSING_CLAIMS"),
        _if(~F.coalesce(F.col("confidence").isin("high", "medium", "low"), F.lit(False)), "INVALID_CONFIDENCE"),
        _each(numbers, "DOCUMENT_NUMBER_NOT_IN_EVIDENCE"),
        _each(ids, "UNKNOWN_EVIDENCE_ID"),
        _provision_problems(text, evidence),
        _status_problems(text, F.transform(evidence, lambda e: F.upper(e["status"]))),
        _each(strange, "UNTRUSTED_URL"),
        F.flatten(F.transform("claims", lambda c, i: _claim_problems(c, i, number))),
        issue_problems(),
        _if(F.coalesce(coarse, F.lit(False)) & ~limits.rlike(PROVISION_LIMIT), "PROVISION_STATUS_LIMITATION_MISSING"),
        history,
    )
    problems = (
        F.when(predicts, _if(F.lit(True), "CASE_SPECIFIC_PREDICTION_UNSUPPORTED"))
        .when(unfounded, F.concat(_if(F.lit(True), "INSUFFICIENT_EVIDENCE"), history))
        .when(F.coalesce(past, F.lit(False)), F.concat(_if(F.lit(True), "HISTORICAL_SOURCE_UNAVAILABLE"), history))
        .when(F.coalesce(refusal, F.lit(False)), F.array().cast(PROBLEMS))
        .otherwise(F.array_distinct(checks))
    )
    refused = predicts | unfounded | F.coalesce(past, F.lit(False)) | F.coalesce(refusal, F.lit(False))
    out = x.withColumn("problems", problems)
    return out.withColumn("verdict", F.when(refused, "REFUSED").when(F.size("problems") > 0, "REPAIR_REQUIRED").otherwise("VERIFIED")).drop("_said", "_all")


def violations(verified: DataFrame, *ids: str) -> DataFrame:
    """One row (ids, code, claim, detail) for each problem."""
    return verified.select(*ids, F.inline("problems"))
