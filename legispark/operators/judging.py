"""What a judge is asked and what it answers: the payload, the strict reading of its JSON, and the reviews that are kept.

A judge is outside and its text is not trusted. A reading keeps to one shape: the keys that must be there and no others, none
twice, each of its own JSON type, all within bounds. Shapes are compared as the types that Spark finds in the parsed value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legispark.operators.answering import CHECKS, COVERAGE, COVERAGE_VERDICTS, LIMITS, VERDICTS

# The keys of a review, and what a check and a coverage check are made of.
SHORT, WHOLE = ("checks",), ("checks", "coverage_checks", "plan_complete", "plan_reason")
CHECK = "OBJECT<claim_index: BIGINT, reason: STRING, verdict: STRING>"
COVERED = tuple(f"OBJECT<claim_indexes: ARRAY<{t}>, issue_id: STRING, reason: STRING, verdict: STRING>" for t in ("BIGINT", "VOID"))
REVIEW = f"struct<checks:{CHECKS},plan_complete:boolean,plan_reason:string,coverage:{COVERAGE}>"
FENCE = r"^\s*```(?:json)?\s*\n?|\n?\s*```\s*$"


def payload(requests: DataFrame) -> Column:
    """The JSON that a judge is sent: the question and its issues, the claims, and the evidence that a claim cites or that belongs to an issue.

    Columns: question, issues (array of issue_id, question), resolutions, limitations, claims, evidence (with issue_ids).
    """
    claims, evidence, issues = F.col("claims"), F.col("evidence"), F.col("issues")
    strings = F.array().cast("array<string>")
    cited = F.flatten(F.transform(claims, lambda c: F.coalesce(c["evidence_ids"], strings)))
    known = F.transform(issues, lambda i: i["issue_id"])
    needed = F.filter(evidence, lambda e: F.array_contains(cited, e["evidence_id"]) | F.coalesce(F.arrays_overlap(F.coalesce(e["issue_ids"], strings), known), F.lit(False)))
    return F.to_json(F.struct(
        F.col("question"),
        F.transform(issues, lambda i: F.struct(i["issue_id"].alias("issue_id"), i["question"].alias("question"))).alias("legal_issues"),
        F.col("resolutions").alias("issue_resolutions"),
        F.col("limitations"),
        F.transform(claims, lambda c, n: F.struct(n.alias("claim_index"), c["text"].alias("text"), c["evidence_ids"].alias("evidence_ids"), F.coalesce(c["issue_ids"], strings).alias("issue_ids"))).alias("claims"),
        F.transform(needed, lambda e: F.struct(e["evidence_id"].alias("evidence_id"), e["text"].alias("text"), e["status"].alias("status"), e["status_scope"].alias("status_scope"), e["as_of"].cast("string").alias("as_of"))).alias("evidence"),
    ), {"ignoreNullFields": "false"})


def _said(x: Column) -> Column:
    """Whether a reason has from one to the most characters."""
    return F.length(F.trim(x)).between(1, LIMITS["reason_chars"])


def parse_review(raw: Column, finish: Column | None = None, fenced: bool = True) -> Column:
    """struct(review, problem): what a judge's answer says, or the first rule that it breaks.

    Problems: TRUNCATED (``finish`` is ``length``), INVALID_JSON (also a key that stands twice), INVALID_REVIEW (other keys,
    checks that are no array or too many), INVALID_CLAIM_CHECK, INVALID_COVERAGE_REVIEW, INVALID_ISSUE_COVERAGE_CHECK. With
    ``fenced`` a Markdown fence around the JSON is taken off.
    """
    body = F.regexp_replace(raw, FENCE, "") if fenced else raw
    of = lambda x, path, kind: F.try_variant_get(x, f"$.{path}", kind)
    # Read as the one element of an array, so that nothing may stand behind it.
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    v = F.when(F.size(alone) == 1, F.get(alone, 0))
    shape = F.schema_of_variant
    keys = F.array_sort(F.json_object_keys(body))
    short, whole = keys == F.array(*map(F.lit, SHORT)), keys == F.array(*map(F.lit, WHOLE))
    checks, covers = of(v, "checks", "array<variant>"), of(v, "coverage_checks", "array<variant>")
    good_check = lambda c: (shape(c) == CHECK) & of(c, "claim_index", "int").between(0, LIMITS["claims"] - 1) & of(c, "verdict", "string").isin(*VERDICTS) & _said(of(c, "reason", "string"))
    good_cover = lambda c: shape(c).isin(*COVERED) & of(c, "verdict", "string").isin(*COVERAGE_VERDICTS) & _said(of(c, "reason", "string")) & F.forall(of(c, "claim_indexes", "array<int>"), lambda k: k.between(0, LIMITS["claims"] - 1))
    every = lambda xs, good: F.coalesce(F.forall(xs, lambda c: F.coalesce(good(c), F.lit(False))), F.lit(False))
    few = lambda xs, most: F.coalesce(F.size(xs).between(0, most), F.lit(False))
    plan = F.coalesce((shape(of(v, "plan_complete", "variant")) == "BOOLEAN") & (shape(of(v, "plan_reason", "variant")) == "STRING") & _said(of(v, "plan_reason", "string")), F.lit(False))
    problem = F.when(F.lit(False) if finish is None else F.coalesce(finish == "length", F.lit(False)), "TRUNCATED").when(v.isNull(), "INVALID_JSON")
    problem = problem.when(~F.coalesce(short | whole, F.lit(False)) | ~few(checks, LIMITS["claims"]), "INVALID_REVIEW").when(~every(checks, good_check), "INVALID_CLAIM_CHECK")
    problem = problem.when(whole & ~(plan & few(covers, LIMITS["issues"])), "INVALID_COVERAGE_REVIEW").when(whole & ~every(covers, good_cover), "INVALID_ISSUE_COVERAGE_CHECK")
    read = F.struct(
        F.transform(checks, lambda c: F.struct(of(c, "claim_index", "int").alias("claim_index"), of(c, "verdict", "string").alias("verdict"), of(c, "reason", "string").alias("reason"))).alias("checks"),
        of(v, "plan_complete", "boolean").alias("plan_complete"),
        F.trim(of(v, "plan_reason", "string")).alias("plan_reason"),
        F.transform(covers, lambda c: F.struct(of(c, "issue_id", "string").alias("issue_id"), of(c, "verdict", "string").alias("verdict"), F.trim(of(c, "reason", "string")).alias("reason"), of(c, "claim_indexes", "array<int>").alias("claim_indexes"))).alias("coverage"),
    )
    return F.struct(F.when(problem.isNull(), read).cast(REVIEW).alias("review"), problem.alias("problem"))


def review_all(requests: DataFrame, judge: Callable[[DataFrame], DataFrame], cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviews, cache): the judge is asked only for keys that no kept review has; what it says without a problem is kept.

    ``requests``: cache_key and what the judge reads; ``judge`` adds raw; ``cache``: (cache_key, raw). A key that stands in
    several requests is asked once.
    """
    keys = requests.select("cache_key").distinct()
    held = cache.join(keys, "cache_key", "left_semi")
    one = Window.partitionBy("cache_key").orderBy(F.xxhash64(*requests.columns))
    new = requests.join(cache.select("cache_key"), "cache_key", "left_anti").withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    said = judge(new).select("cache_key", "raw").withColumn("_r", parse_review(F.col("raw")))
    kept = cache.select("cache_key", "raw").unionByName(said.filter("_r.problem IS NULL").select("cache_key", "raw"))
    read = held.select("cache_key", "raw").withColumn("_r", parse_review(F.col("raw"))).unionByName(said)
    return read.select("cache_key", "_r.review", "_r.problem"), kept
