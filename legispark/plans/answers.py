"""Queries: verification, issue plans, sources, sharing and phrases, each over whole tables that play the roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legispark.operators import answering, chat, lexical, sources
from legispark.operators import verify as checks
from legispark.plans.base import query, table

STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'EXPIRED' WHEN 'O' THEN 'EFFECTIVE' ELSE 'PARTIALLY_EFFECTIVE' END"


def requests(spark: SparkSession, d: str) -> DataFrame:
    """An answer per order: the order is its evidence, the items are its claims."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    status = F.when(F.col("o_orderstatus") == "F", "EXPIRED").when(F.col("o_orderstatus") == "O", "EFFECTIVE").otherwise("PARTIALLY_EFFECTIVE")
    said = F.when(F.col("l_returnflag") == "R", " còn hiệu lực").when(F.col("l_returnflag") == "A", " hết hiệu lực").otherwise("")
    text = F.concat(F.lit("Theo số "), F.col("l_suppkey").cast("string"), F.lit("/2020/NĐ-CP, Điều "), F.col("l_linenumber").cast("string"), said)
    cites = F.when(F.col("l_linestatus") == "F", F.array(F.lit("E1"))).when(F.col("l_quantity") > 25, F.array(F.lit("E2"))).otherwise(F.array().cast("array<string>"))
    claims = li.groupBy(F.col("l_orderkey").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.struct(text.alias("text"), cites.alias("evidence_ids"), F.lit(None).cast("array<string>").alias("issue_ids")).alias("c")))).alias("_c"))
    none, day = F.lit(None).cast("string"), F.col("o_orderdate").cast("date")
    strings = F.lit(None).cast("array<string>")
    item = F.struct(
        F.lit("E1").alias("evidence_id"), F.lit("Nội dung").alias("text"), F.concat(F.col("o_custkey").cast("string"), F.lit("/2020/NĐ-CP")).alias("document_number"), strings.alias("related_numbers"), F.substring("o_orderpriority", 1, 1).alias("article"), none.alias("clause"), none.alias("point"),
        status.alias("status"), strings.alias("related_statuses"), F.lit("document").alias("status_scope"), none.alias("source_url"), day.alias("as_of"), none.alias("version_id"), F.lit(None).cast("date").alias("content_valid_from"), F.lit(None).cast("date").alias("content_valid_to"),
    )
    x = o.join(claims, F.col("o_orderkey") == F.col("_id"), "left")
    return x.select(F.col("o_orderkey").alias("id"), F.lit("Hỏi về hiệu lực").alias("question"), day.alias("as_of"), F.lit("current_law").alias("temporal_intent"), F.lit(True).alias("historical_content_available"), strings.alias("warnings"), F.array(item).alias("evidence"), F.lit("Trả lời").alias("answer"), F.transform("_c", lambda c: c["c"]).alias("claims"), strings.alias("limitations"), F.lit("high").alias("confidence"), strings.alias("issue_ids"), F.lit(None).cast(checks.RESOLUTIONS).alias("resolutions"))


VERIFY_SQL = f"""ev AS (SELECT o_orderkey AS id, o_custkey || '/2020/NĐ-CP' AS num, left(o_orderpriority, 1) AS art, {STATUS_SQL} AS st FROM orders),
cl AS (SELECT l_orderkey AS id, l_suppkey || '/2020/NĐ-CP' AS num, l_linenumber::VARCHAR AS art, l_returnflag AS f, CASE WHEN l_linestatus = 'F' THEN 'E1' WHEN l_quantity > 25 THEN 'E2' END AS cite FROM lineitem),
j AS (SELECT cl.*, ev.num AS enum, ev.art AS eart, ev.st FROM cl JOIN ev USING (id)),
found AS (SELECT id, 'MISSING_CITATION' AS code, NULL::VARCHAR AS detail FROM j WHERE cite IS NULL
UNION ALL SELECT id, 'UNKNOWN_EVIDENCE_ID', 'E2' FROM j WHERE cite = 'E2'
UNION ALL SELECT id, 'DOCUMENT_NUMBER_CITATION_MISMATCH', num FROM j WHERE cite = 'E1' AND num <> enum
UNION ALL SELECT id, 'PROVISION_CITATION_MISMATCH', 'article ' || art FROM j WHERE cite = 'E1' AND art <> eart
UNION ALL SELECT id, 'STATUS_CITATION_MISMATCH', 'EFFECTIVE|PARTIALLY_EFFECTIVE' FROM j WHERE cite = 'E1' AND f = 'R' AND st = 'EXPIRED'
UNION ALL SELECT id, 'STATUS_CITATION_MISMATCH', 'EXPIRED|REPEALED' FROM j WHERE cite = 'E1' AND f = 'A' AND st <> 'EXPIRED'
UNION ALL SELECT id, 'STATUS_DISCLOSURE_MISSING', st FROM j WHERE cite = 'E1' AND ((st = 'EXPIRED' AND f <> 'A') OR (st = 'PARTIALLY_EFFECTIVE' AND f <> 'R'))
UNION ALL SELECT DISTINCT id, 'DOCUMENT_NUMBER_NOT_IN_EVIDENCE', num FROM j WHERE num <> enum
UNION ALL SELECT DISTINCT id, 'PROVISION_STATUS_LIMITATION_MISSING', NULL FROM j WHERE cite = 'E1' AND st = 'PARTIALLY_EFFECTIVE'
UNION ALL SELECT id, 'MISSING_CLAIMS', NULL FROM ev WHERE id NOT IN (SELECT id FROM cl))"""


@query(f"WITH {VERIFY_SQL} SELECT id, code, detail, count(*) AS n FROM found GROUP BY ALL")
def verify_claims(spark: SparkSession, d: str) -> DataFrame:
    return checks.violations(checks.verify(requests(spark, d), checks.LONG_NUMBER), "id").groupBy("id", "code", "detail").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VERIFY_SQL} SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT id FROM found) THEN 'REPAIR_REQUIRED' ELSE 'VERIFIED' END AS verdict FROM orders")
def verify_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return checks.verify(requests(spark, d), checks.LONG_NUMBER).select("id", "verdict")


ASKED = {"1-URGENT": "tác động 1/2020/NĐ-CP", "2-HIGH": "thay thế 1/2020/NĐ-CP"}


@query("""WITH n AS (SELECT o_custkey AS id, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS general, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS specific FROM orders GROUP BY 1)
SELECT id, CASE WHEN n <= 5 THEN n - CASE WHEN specific > 0 THEN general ELSE 0 END END AS issues, CASE WHEN n > 5 THEN 'INVALID_PLAN' END AS problem FROM n""")
def issue_plan(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    asked = F.coalesce(*(F.when(F.col("o_orderpriority") == k, v) for k, v in ASKED.items()), F.lit("hỏi 2/2020/NĐ-CP"))
    each = o.select(F.col("o_custkey").alias("id"), n.alias("n"), F.struct(F.concat(F.lit("I"), n.cast("string")).alias("issue_id"), F.lit("Câu hỏi").alias("question"), asked.alias("search_query")).alias("i"))
    plans = each.groupBy("id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("n", "i"))), lambda x: x["i"]).alias("issues"))).alias("raw"))
    read = plans.select("id", answering.issue_plan(F.col("raw")).alias("p"))
    return read.select("id", F.when(F.col("p.problem").isNull(), F.size("p.issues").cast("long")).alias("issues"), "p.problem")


@query("""SELECT conv_id AS id, CASE WHEN n > 5 THEN 'ROOT_CONTRACT_INVALID' WHEN bad > 0 THEN 'CLAIM_CONTRACT_INVALID' END AS problem
FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE trim(text) = '' OR length(text) > 500) AS bad FROM conversations GROUP BY 1)""")
def answer_contract(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as answers of a model: each turn a claim."""
    claim = F.struct(F.col("text"), F.array(F.lit("E1")).alias("evidence_ids"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(claim).alias("claims"))
    raw = F.to_json(F.struct(F.lit("").alias("answer"), "claims", F.array().cast("array<string>").alias("limitations"), F.lit("high").alias("confidence")))
    return c.select(F.col("conv_id").alias("id"), answering.answer_contract(raw)["problem"].alias("problem"))


# Sources: parts are documents, and each finds itself and its neighbour.

CANDIDATES_SQL = """c AS (SELECT p.p_partkey AS document_id, p.p_brand AS number, p.p_name AS title, p.p_type AS authority, 'https://' || CASE WHEN q.p_size > 25 THEN 'vanban.gov.vn' ELSE 'example.com' END || '/' || q.p_partkey AS url,
  q.p_size > 25 AS official, lower(q.p_name || ' ' || q.p_brand || ' ' || q.p_type || ' https://' || CASE WHEN q.p_size > 25 THEN 'vanban.gov.vn' ELSE 'example.com' END || '/' || q.p_partkey) AS said FROM part p JOIN part q ON q.p_partkey = p.p_partkey OR q.p_partkey = p.p_partkey + 1),
s AS (SELECT *, list_distinct(list_filter(regexp_extract_all(said, '[0-9a-zà-ỹđ]+'), lambda t: length(t) > 2)) AS heard, list_distinct(list_filter(regexp_extract_all(lower(title), '[0-9a-zà-ỹđ]+'), lambda t: length(t) > 2)) AS tt, list_distinct(list_filter(regexp_extract_all(lower(authority), '[0-9a-zà-ỹđ]+'), lambda t: length(t) > 2)) AS ta FROM c),
r AS (SELECT *, CASE WHEN len(tt) = 0 THEN 0.0 ELSE len(list_intersect(tt, heard))::DOUBLE / len(tt) END AS titled, CASE WHEN len(ta) = 0 THEN 1.0 ELSE len(list_intersect(ta, heard))::DOUBLE / len(ta) END AS issued FROM s),
scored AS (SELECT document_id, url, official, CASE WHEN NOT contains(regexp_replace(said, '[^0-9a-zà-ỹđ]+', '', 'g'), regexp_replace(lower(number), '[^0-9a-zà-ỹđ]+', '', 'g')) OR (len(ta) > 0 AND issued < 0.5 AND titled < 0.35) THEN 0
  ELSE 70 + CASE WHEN official THEN 25 ELSE 0 END + least(15, round_even(15 * titled, 0)::INT) + CASE WHEN issued >= 0.5 THEN 10 ELSE 0 END END::BIGINT AS score FROM r)"""


def _documents(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    url = F.when(F.col("p_type") == "ECONOMY", "https://vanban.gov.vn/own").otherwise("https://github.com/own")
    return p.select(F.col("p_partkey").alias("document_id"), F.col("p_brand").alias("number"), F.col("p_name").alias("title"), F.col("p_type").alias("authority"), url.alias("source_url"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    site = F.when(F.col("p_size") > 25, "vanban.gov.vn").otherwise("example.com")
    for_ids = F.explode(F.array(F.col("p_partkey"), F.col("p_partkey") - 1)).alias("document_id")
    found = p.select(for_ids, F.concat(F.lit("https://"), site, F.lit("/"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("snippet"))
    return found.join(p.select(F.col("p_partkey").alias("document_id")), "document_id", "left_semi")


@query(f"WITH {CANDIDATES_SQL} SELECT document_id, url, score FROM scored")
def source_score(spark: SparkSession, d: str) -> DataFrame:
    known = _documents(spark, d).select("document_id", "number", F.col("title").alias("_t"), "authority")
    x = _candidates(spark, d).join(known, "document_id")
    return x.select("document_id", "url", sources.candidate_score(F.col("url"), F.col("title"), F.col("snippet"), F.col("number"), F.col("_t"), F.col("authority")).alias("score"))


@query(f"""WITH {CANDIDATES_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, url) AS n FROM scored) WHERE n = 1)
SELECT document_id, CASE WHEN p_type = 'PROMO' THEN 'VERIFIED' WHEN p_type = 'ECONOMY' THEN 'CORPUS_SOURCE' WHEN score >= 90 AND official THEN 'VERIFIED' ELSE 'GOOGLE_SEARCH' END AS status,
CASE WHEN p_type = 'PROMO' THEN 'https://cache.gov.vn/' || document_id WHEN p_type = 'ECONOMY' THEN 'https://vanban.gov.vn/own' WHEN score >= 90 AND official THEN url END AS url FROM best JOIN part ON p_partkey = document_id""")
def source_cascade(spark: SparkSession, d: str) -> DataFrame:
    today = F.to_date(F.lit("2024-01-31"))
    held = table(spark, d, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("document_id"), F.concat(F.lit("https://cache.gov.vn/"), F.col("p_partkey").cast("string")).alias("url"), F.lit("VERIFIED").alias("status"), F.lit(True).alias("active"), F.to_date(F.lit("2024-01-15")).alias("checked_on"), F.lit(95).alias("score"))
    found = sources.resolve(_documents(spark, d), held, _candidates(spark, d), today)
    return found.select("document_id", "status", F.when(F.col("status") != "GOOGLE_SEARCH", F.col("url")).alias("url"))


@query("SELECT page_id, regexp_matches(lower(url), '^https?://[^/]') AND NOT regexp_matches(host, 'huggingface.co|github.com|google.com') AND host NOT IN ('localhost', '127.0.0.1') AND host NOT LIKE '%.local' AS safe FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)) AS host FROM pages)")
def safe_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", sources.is_safe_url(F.col("url")).alias("safe"))


# Chat.


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN left(sha256('key' || chr(31) || c_mktsegment || chr(31) || c_custkey), 32) WHEN c_acctbal > 0 THEN 'old' END AS share_token FROM customer""")
def share_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Sharing switched on for large balances and off for those below nothing; the others keep what they have."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("workspace_id"), F.when(F.col("c_acctbal") <= 5000, "old").alias("share_token"), "c_acctbal")
    changes = c.filter("c_acctbal > 5000 OR c_acctbal <= 0").select("workspace_id", "id", (F.col("c_acctbal") > 5000).alias("shared"))
    return chat.share(c.drop("c_acctbal"), changes, "key").select("id", "share_token")


# Phrases.

PHRASE_QUERIES = [(1, "that the"), (2, "der und die"), (3, "la: de\\"), (4, "the"), (5, "Tổ chức có được sửa đổi không?")]
WORDS_SQL = "(' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> ''), ' ') || ' ')"
PHRASES_SQL = f"""ph(query_id, phrase, boost) AS (VALUES (1, 'that the', 4.0::DOUBLE), (2, 'der und die', 10.0), (3, 'la de', 4.0), (5, 'tổ chức', 4.0), (5, 'sửa đổi', 4.0)),
co(query_id, terms) AS (VALUES (1, ['that', 'the']), (2, ['der', 'und', 'die']), (3, ['la', 'de']), (5, ['tổ', 'chức', 'sửa', 'đổi'])),
w AS (SELECT doc_id, {WORDS_SQL} AS t FROM documents),
boosts AS (SELECT query_id, doc_id, sum(boost) AS boost FROM (SELECT query_id, doc_id, boost FROM ph JOIN w ON contains(t, ' ' || phrase || ' ') UNION ALL SELECT query_id, doc_id, 2.0 FROM co JOIN w ON list_has_all(string_split(t, ' '), terms)) GROUP BY 1, 2)"""


@query(f"WITH {PHRASES_SQL} SELECT query_id, doc_id, boost FROM boosts")
def phrase_boosts(spark: SparkSession, d: str) -> DataFrame:
    built = lexical.build_queries(spark.createDataFrame(PHRASE_QUERIES, "query_id int, query string"))
    return lexical.phrase_scores(table(spark, d, "documents"), built)
