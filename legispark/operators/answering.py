"""From a question to an answer that may be shown: contracts of what models return, reviews, attempts and refusals.

Models are outside: a generator and a judge are functions from DataFrame to DataFrame. All rules are column
expressions, and a batch of requests goes through the attempts together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legispark.functions import query_parse
from legispark.operators.verify import CLAIMS, PROBLEMS, RESOLUTIONS, verify
from legispark.storage import materialize

# Limits of the contract, verdicts, the texts of refusals, and the words of general and of specific questions.
LIMITS = {"claims": 5, "claim_chars": 500, "evidence_ids": 8, "issue_ids": 5, "quotes": 8, "quote_chars": 1200, "limitations": 5, "limitation_chars": 300, "resolutions": 5, "explanation_chars": 500, "issues": 5, "issue_chars": 500, "reason_chars": 200}
VERDICTS = ("SUPPORTED", "CONTRADICTED", "INSUFFICIENT")
COVERAGE_VERDICTS = ("COVERED_BY_CLAIMS", "DECLARED_UNANSWERED", "MISSING_OR_PARTIAL")
RESOLUTION_STATUSES = ("ANSWERED", "INSUFFICIENT_EVIDENCE", "NEEDS_CLARIFICATION")
REFUSAL = "Không đủ căn cứ trong evidence đã được xác minh để trả lời câu hỏi này."
REFUSAL_LIMIT = "Cần bổ sung nguồn pháp lý phù hợp và đã được xác minh."
PAST_REFUSAL = "Không đủ căn cứ lịch sử đã được xác minh để trả lời tại thời điểm "
PAST_LIMIT = "Nguồn hiện có là nội dung phiên bản hiện tại, không chứng minh nội dung lịch sử tại thời điểm được hỏi."
NO_ISSUE_ANSWERED = "Không đủ căn cứ để trả lời các vấn đề pháp lý đã xác định."
GENERAL_WORD, SPECIFIC_WORDS = "tác động", "thay thế|bãi bỏ|sửa đổi|bổ sung"
FAILURES = {"truncated": "GENERATION_TRUNCATED", "timeout": "GENERATION_TIMEOUT", "unavailable": "PROVIDER_UNAVAILABLE", "invalid_response": "INVALID_STRUCTURED_RESPONSE"}

ANSWER_SCHEMA = "answer string, claims array<struct<text:string,evidence_ids:array<string>,supporting_quotes:array<struct<evidence_id:string,quote:string>>,issue_ids:array<string>>>, limitations array<string>, confidence string, issue_resolutions array<struct<issue_id:string,status:string,claim_indexes:array<int>,explanation:string>>"
PLAN_SCHEMA = "issues array<struct<issue_id:string,question:string,search_query:string>>"
CHECKS = "array<struct<claim_index:int,verdict:string,reason:string>>"
COVERAGE = "array<struct<issue_id:string,verdict:string,reason:string,claim_indexes:array<int>>>"


@dataclass(frozen=True)
class AnswerSettings:
    """What a run is given; ``from_environment`` reads the same names, upper case, behind a prefix."""

    window: int = 8192
    output_reserve: int = 1500
    prompt_reserve: int = 1500
    evidence_total: int = 12
    evidence_per_issue: int = 3
    graph_evidence: int = 2
    semantic_mode: str = "off"
    attempts: int = 2

    @property
    def budget(self) -> int:
        return max(0, self.window - self.output_reserve - self.prompt_reserve)

    @classmethod
    def from_environment(cls, values: Mapping[str, str], prefix: str = "ANSWER_") -> AnswerSettings:
        found = {f.name: values[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in values}
        made = cls(**{k: v if k == "semantic_mode" else int(v) for k, v in found.items()})
        if made.semantic_mode not in ("off", "shadow", "enforce"):
            raise ValueError(f"semantic_mode: {made.semantic_mode}")
        return made


def _first(*cases: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for condition, name in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def _keys(raw: Column) -> Column:
    return F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))


def _blank(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) == ""


def answer_contract(raw: Column) -> Column:
    """struct(answer, problem): the parsed answer, and the first rule of the contract that it breaks, or null."""
    x = F.from_json(raw, ANSWER_SCHEMA)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    allowed = F.array(*map(F.lit, ("answer", "claims", "limitations", "confidence", "issue_resolutions")))
    needed = F.array(*map(F.lit, ("answer", "claims", "limitations", "confidence")))
    claim = lambda c: F.coalesce(_blank(c["text"]) | (F.length(c["text"]) > LIMITS["claim_chars"]) | (size(c["evidence_ids"]) > LIMITS["evidence_ids"]) | (size(c["issue_ids"]) > LIMITS["issue_ids"]), F.lit(True))
    quote = lambda c: (size(c["supporting_quotes"]) > LIMITS["quotes"]) | F.coalesce(F.exists(c["supporting_quotes"], lambda q: q["evidence_id"].isNull() | _blank(q["quote"])), F.lit(False))
    resolution = lambda r: F.coalesce(r["issue_id"].isNull() | ~r["status"].isin(*RESOLUTION_STATUSES) | _blank(r["explanation"]) | (F.length(r["explanation"]) > LIMITS["explanation_chars"]) | F.exists(r["claim_indexes"], lambda k: k < 0), F.lit(True))
    problem = _first(
        (x.isNull() | x["answer"].isNull() | x["claims"].isNull(), "ROOT_SHAPE_INVALID"),
        (x["limitations"].isNull() | F.exists(x["limitations"], lambda v: v.isNull()), "LIMITATIONS_NOT_STRING_ARRAY"),
        (~F.coalesce(x["confidence"].isin("high", "medium", "low"), F.lit(False)), "CONFIDENCE_INVALID"),
        (size(x["issue_resolutions"]) > LIMITS["resolutions"], "ISSUE_RESOLUTIONS_INVALID"),
        ((F.size(F.array_except(_keys(raw), allowed)) > 0) | (F.size(F.array_except(needed, _keys(raw))) > 0) | (size(x["claims"]) > LIMITS["claims"]) | (size(x["limitations"]) > LIMITS["limitations"]) | F.exists(x["limitations"], lambda v: F.length(v) > LIMITS["limitation_chars"]), "ROOT_CONTRACT_INVALID"),
        (F.exists(x["claims"], quote), "SUPPORTING_QUOTES_INVALID"),
        (F.exists(x["claims"], claim), "CLAIM_CONTRACT_INVALID"),
        (F.exists(x["issue_resolutions"], resolution), "ISSUE_RESOLUTION_INVALID"),
    )
    return F.struct(x.alias("answer"), problem.alias("problem"))


def issue_plan(raw: Column) -> Column:
    """struct(issues, problem): the plan of one to five issues in order, without a general question of impact beside a specific one on the same document."""
    issues = F.from_json(raw, PLAN_SCHEMA)["issues"]
    wrong = lambda i, n: F.coalesce((i["issue_id"] != F.concat(F.lit("I"), (n + 1).cast("string"))) | _blank(i["question"]) | _blank(i["search_query"]) | (F.length(i["question"]) > LIMITS["issue_chars"]) | (F.length(i["search_query"]) > LIMITS["issue_chars"]), F.lit(True))
    problem = _first(
        (issues.isNull() | (F.size(F.array_except(_keys(raw), F.array(F.lit("issues")))) > 0) | ~F.size(issues).between(1, LIMITS["issues"]), "INVALID_PLAN"),
        (F.exists(F.transform(issues, wrong), lambda w: w), "INVALID_ISSUE"),
    )
    numbers = lambda i: query_parse.document_numbers(i["search_query"])
    general = lambda i: F.lower(i["search_query"]).contains(GENERAL_WORD) & ~F.lower(i["search_query"]).rlike(SPECIFIC_WORDS)
    beside = lambda i: F.exists(issues, lambda o: (o["issue_id"] != i["issue_id"]) & F.arrays_overlap(numbers(o), numbers(i)) & (F.size(query_parse.relations(o["search_query"])) > 0))
    kept = F.filter(issues, lambda i: ~(general(i) & beside(i)))
    named = F.transform(kept, lambda i, n: F.struct(F.concat(F.lit("I"), (n + 1).cast("string")).alias("issue_id"), F.trim(i["question"]).alias("question"), F.trim(i["search_query"]).alias("search_query")))
    return F.struct(F.when(problem.isNull(), named).alias("issues"), problem.alias("problem"))


def review_error(checks: Column, n_claims: Column, issue_ids: Column, coverage: Column) -> Column:
    """What makes a judge's review unusable: each claim and issue must be judged once, with known verdicts that fit what they point at."""
    at = F.array_sort(F.transform(checks, lambda c: c["claim_index"]))
    wanted = F.when(n_claims > 0, F.sequence(F.lit(0), n_claims - 1)).otherwise(F.array().cast("array<int>"))
    judged = F.array_sort(F.transform(coverage, lambda c: c["issue_id"]))
    asked = F.size(issue_ids) > 0
    points = lambda c: F.size(F.coalesce(c["claim_indexes"], F.array().cast("array<int>")))
    return _first(
        (~(at == wanted), "INCOMPLETE_OR_DUPLICATE_CLAIM_CHECKS"),
        (F.exists(checks, lambda c: ~F.coalesce(c["verdict"].isin(*VERDICTS), F.lit(False))), "INVALID_VERDICT"),
        (F.exists(checks, lambda c: _blank(c["reason"]) | (F.length(c["reason"]) > LIMITS["reason_chars"])), "INVALID_REASON"),
        (asked & ~(judged == F.array_sort(issue_ids)), "INCOMPLETE_OR_DUPLICATE_COVERAGE_CHECKS"),
        (asked & F.exists(coverage, lambda c: ~F.coalesce(c["verdict"].isin(*COVERAGE_VERDICTS), F.lit(False))), "INVALID_COVERAGE_VERDICT"),
        (asked & F.exists(coverage, lambda c: F.exists(c["claim_indexes"], lambda k: (k < 0) | (k >= n_claims))), "INVALID_COVERAGE_CLAIM_INDEX"),
        (asked & F.exists(coverage, lambda c: (c["verdict"] == "COVERED_BY_CLAIMS") & (points(c) == 0)), "COVERAGE_WITHOUT_CLAIMS"),
        (asked & F.exists(coverage, lambda c: (c["verdict"] == "DECLARED_UNANSWERED") & (points(c) > 0)), "UNANSWERED_WITH_CLAIMS"),
    )


def combine_review(verified: DataFrame, mode: str = "enforce") -> DataFrame:
    """Adds to a VERIFIED answer what its review found. Columns checks, coverage, quote_issues (array of claim numbers), plan_complete, review_failed.

    A judge that is unavailable or contradicts itself refuses; so does a plan that misses a part of the question;
    unsupported claims, invalid quotes and uncovered issues ask for a repair. ``shadow`` changes nothing.
    """
    if mode != "enforce":
        return verified
    empty = F.array().cast("array<int>")
    checks, coverage, quotes = F.coalesce(F.col("checks").cast(CHECKS), F.array().cast(CHECKS)), F.coalesce(F.col("coverage").cast(COVERAGE), F.array().cast(COVERAGE)), F.coalesce(F.col("quote_issues").cast("array<int>"), empty)
    error = F.when(F.size(quotes) > 0, F.lit(None).cast("string")).otherwise(review_error(checks, F.size("claims"), F.col("issue_ids"), coverage))
    one = lambda code, claim, detail: F.struct(F.lit(code).alias("code"), claim.cast("int").alias("claim"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    unusable = F.coalesce(F.col("review_failed"), F.lit(False)) | error.isNotNull()
    partial = (F.size("issue_ids") > 0) & (F.size(quotes) == 0) & ~F.coalesce("plan_complete", F.lit(True))
    found = F.concat(
        F.transform(quotes, lambda k: one("SUPPORTING_QUOTE_INVALID", k, none)),
        F.transform(F.filter(checks, lambda c: c["verdict"] != "SUPPORTED"), lambda c: one("CLAIM_NOT_SUPPORTED", c["claim_index"], c["verdict"])),
        F.transform(F.filter(coverage, lambda c: c["verdict"] == "MISSING_OR_PARTIAL"), lambda c: one("ISSUE_NOT_COVERED", none, c["issue_id"])),
    ).cast(PROBLEMS)
    refused = F.when(unusable, F.array(one("SEMANTIC_REVIEW_UNAVAILABLE", none, error))).when(partial, F.array(one("ISSUE_PLAN_INCOMPLETE", none, none))).cast(PROBLEMS)
    held = F.col("verdict") == "VERIFIED"
    verdict = F.when(~held, F.col("verdict")).when(refused.isNotNull(), "REFUSED").when(F.size(found) > 0, "REPAIR_REQUIRED").otherwise("VERIFIED")
    return verified.withColumns({"problems": F.when(held, F.coalesce(refused, found)).otherwise(F.col("problems")), "verdict": verdict})


def rendered(claims: Column) -> Column:
    """The answer as it is shown: each claim with its citations, a paragraph each."""
    paragraph = lambda c: F.trim(F.concat(F.regexp_replace(F.trim(c["text"]), r"\.+$", ""), F.lit(". "), F.array_join(F.transform(c["evidence_ids"], lambda e: F.concat(F.lit("["), e, F.lit("]"))), " ")))
    return F.array_join(F.transform(claims, paragraph), "\n\n")


def refusal(past: Column, as_of: Column) -> Column:
    """struct(answer, limitations): what is said instead of an answer."""
    return F.struct(F.when(past, F.concat(F.lit(PAST_REFUSAL), as_of.cast("string"), F.lit("."))).otherwise(REFUSAL).alias("answer"), F.array(F.when(past, PAST_LIMIT).otherwise(REFUSAL_LIMIT)).alias("limitations"))


def failure_code(reason: Column) -> Column:
    """The code of a generator's failure (truncated, timeout, unavailable, invalid_response; anything else is GENERATION_FAILED)."""
    return F.when(reason.isNotNull(), F.coalesce(*(F.when(reason == k, v) for k, v in FAILURES.items()), F.lit("GENERATION_FAILED")))


OUTPUT = {"answer": "string", "claims": CLAIMS, "limitations": "array<string>", "confidence": "string", "resolutions": RESOLUTIONS, "failure": "string"}


def no_answer(requests: DataFrame, attempt: int) -> DataFrame:
    """The generator of a disabled service: it always refuses."""
    return requests.withColumns({k: F.lit(None).cast(t) for k, t in OUTPUT.items()} | {"answer": F.lit(REFUSAL), "confidence": F.lit("low")})


def _all(requests: DataFrame) -> DataFrame:
    """A side of a join that may have a row for each request. It is shuffled: rows that are alike make files so small that Spark
    would take them for a table to collect and broadcast."""
    return requests.hint("merge")


def queued(prepared: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """A generator that takes the answers of ``prepared`` (request_id, attempt and the columns of ``OUTPUT``); where there is none it fails as unavailable."""

    def generate(requests: DataFrame, attempt: int) -> DataFrame:
        own = prepared.filter(F.col("attempt") == attempt).select("request_id", F.lit(True).alias("_found"), *OUTPUT)
        out = requests.join(_all(own), "request_id", "left")
        return out.withColumn("failure", F.when(F.col("_found").isNull(), "unavailable").otherwise(F.col("failure"))).drop("_found")

    return generate


def answer_requests(requests: DataFrame, generate: Callable[[DataFrame, int], DataFrame], review: Callable[[DataFrame], DataFrame] | None = None, attempts: int = 2) -> DataFrame:
    """(request_id, state, answer, limitations, attempts, problems): VERIFIED with the rendered claims, or REFUSED.

    Each request is checked before anything is generated; then it has ``attempts``. An answer that needs a repair, or
    is no valid response, is generated once more; a generator that fails otherwise, a refusal by a check, and a repair
    that is still not right end in the safe refusal. ``requests``: request_id and the columns of the verifier that the
    answer does not give; ``review`` adds the columns of ``combine_review``.
    """
    past = (F.col("temporal_intent") == "historical") & ~F.coalesce("historical_content_available", F.lit(False))
    safe = refusal(past, F.col("as_of"))

    def refused(df: DataFrame, n: int, problems: Column) -> DataFrame:
        return df.select("request_id", F.lit("REFUSED").alias("state"), safe["answer"].alias("answer"), safe["limitations"].alias("limitations"), F.lit(n).alias("attempts"), problems.cast(PROBLEMS).alias("problems"))

    blank = requests.withColumns({k: F.lit(None).cast(t) for k, t in OUTPUT.items()} | {"answer": safe["answer"], "limitations": safe["limitations"], "confidence": F.lit("low")})
    # What a generator made and a check found is written down: neither is done twice, however often it is read.
    first = materialize(verify(blank).select("request_id", "as_of", "temporal_intent", "historical_content_available", "verdict", "problems"), "preflight")
    stopped = (F.col("verdict") == "REFUSED") & (F.size("problems") > 0)
    done = refused(first.filter(stopped), 0, F.col("problems"))
    open_ = requests.join(_all(first.filter(~stopped).select("request_id")), "request_id", "left_semi")
    for n in range(1, attempts + 1):
        made = materialize(generate(open_, n), "generated")
        failed = F.col("failure").isNotNull()
        again = failed & (F.col("failure") == "invalid_response") if n < attempts else F.lit(False)
        problem = F.array(F.struct(failure_code(F.col("failure")).alias("code"), F.lit(None).cast("int").alias("claim"), F.lit(None).cast("string").alias("detail")))
        done = done.unionByName(refused(made.filter(failed & ~again), n, problem))
        checked = verify(made.filter(~failed))
        if review is not None:
            checked = combine_review(review(checked))
        checked = materialize(checked, "checked")
        good, bad = F.col("verdict") == "VERIFIED", F.col("verdict") == "REFUSED"
        unanswered = (F.size("resolutions") > 0) & ~F.exists("resolutions", lambda r: r["status"] == "ANSWERED")
        shown = checked.filter(good).select("request_id", F.when(unanswered, "REFUSED").otherwise("VERIFIED").alias("state"), F.when(unanswered, NO_ISSUE_ANSWERED).otherwise(rendered(F.col("claims"))).alias("answer"), "limitations", F.lit(n).alias("attempts"), "problems")
        own = checked.filter(bad & (F.size("problems") == 0)).select("request_id", F.lit("REFUSED").alias("state"), "answer", "limitations", F.lit(n).alias("attempts"), "problems")
        done = done.unionByName(shown).unionByName(own).unionByName(refused(checked.filter(bad & (F.size("problems") > 0)), n, F.col("problems")))
        left = checked.filter(F.col("verdict") == "REPAIR_REQUIRED")
        if n == attempts:
            return done.unionByName(refused(left, n, F.col("problems")))
        retry = left.select("request_id").unionByName(made.filter(again).select("request_id"))
        open_ = requests.join(_all(retry), "request_id", "left_semi")
    return done


def entailment_cases(fixture: DataFrame) -> DataFrame:
    """Requests and answers for judging claims, from (case_id, question, evidence, claim): one evidence, one claim that cites it."""
    day = F.to_date(F.lit("2026-09-06"))
    item = F.struct(F.lit("E1").alias("evidence_id"), F.col("evidence").alias("text"), F.lit("01/2026/QH15").alias("document_number"), F.lit("1").alias("article"), F.lit("EFFECTIVE").alias("status"), day.alias("as_of"))
    claim = F.struct(F.col("claim").alias("text"), F.array(F.lit("E1")).alias("evidence_ids"))
    return fixture.select(F.col("case_id").alias("request_id"), "question", day.alias("as_of"), F.array(item).alias("evidence"), F.array(claim).alias("claims"))


def latest_reviews(reviews: DataFrame, key: str = "cache_key") -> DataFrame:
    """The cache of reviews: the last one of each key that has no error."""
    w = Window.partitionBy(key).orderBy(F.desc("reviewed_at"))
    return reviews.filter("error IS NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def review_key(judge: str, *parts: Column) -> Column:
    """What identifies a review: the judge, the request and the answer, as one hash."""
    return F.sha2(F.concat_ws("\x1f", F.lit(judge), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


#: What can befall an attempt, with its share of sixteen: nothing, an answer that needs a repair, or a failure.
FAULTS = {"none": 8, "wrong": 3, "invalid_response": 2, "timeout": 1, "truncated": 1, "unavailable": 1}


def fault_schedule(requests: DataFrame, seed: int, attempts: int = 2) -> DataFrame:
    """(request_id, attempt, fault): what befalls each attempt, by a hash of seed, request and attempt, alike on every run."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("request_id").cast("string"), F.col("attempt").cast("string"))), 1, 1), 16, 10).cast("int")
    fault, upto = F.lit(None).cast("string"), 16
    for name, share in reversed(FAULTS.items()):
        upto -= share
        fault = F.when(drawn.between(upto, upto + share - 1), name).otherwise(fault)
    return requests.select("request_id", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt")).withColumn("fault", fault)


def replay(requests: DataFrame, answers: DataFrame, schedule: DataFrame, attempts: int = 2) -> DataFrame:
    """Runs requests through all attempts under a schedule of faults. ``answers``: (request_id, right, wrong), the claims of a good answer and of one that a check finds."""
    claims = F.when(F.col("fault") == "none", F.col("right")).when(F.col("fault") == "wrong", F.col("wrong"))
    failure = F.when(~F.col("fault").isin("none", "wrong"), F.col("fault"))
    none = lambda k: F.lit(None).cast(OUTPUT[k]).alias(k)
    made = schedule.join(_all(answers), "request_id").select("request_id", "attempt", F.lit("").alias("answer"), claims.cast(CLAIMS).alias("claims"), none("limitations"), F.lit("high").alias("confidence"), none("resolutions"), failure.alias("failure"))
    return answer_requests(requests, queued(materialize(made, "scheduled")), attempts=attempts)


def expected_states(schedule: DataFrame, attempts: int = 2) -> DataFrame:
    """(request_id, state, attempts): how a schedule must end. An attempt that goes well ends it; one that needs a repair or gave no valid response is followed by the next; any other failure refuses."""
    again = F.col("fault").isin("wrong", "invalid_response")
    last = schedule.groupBy("request_id").agg(F.min(F.when(~again, F.col("attempt"))).alias("n"), F.min_by(F.when(~again, F.col("fault")), F.when(~again, F.col("attempt"))).alias("fault"))
    return last.select("request_id", F.when(F.col("fault") == "none", "VERIFIED").otherwise("REFUSED").alias("state"), F.coalesce("n", F.lit(attempts)).alias("attempts"))
