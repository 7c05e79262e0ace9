"""Queries: chunk audits, release checks and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legispark.operators import evaluate
from legispark.plans.base import CHUNKS, chunks, query, table


@query(f"WITH {CHUNKS} SELECT count(*) AS n, count(*) FILTER (WHERE tokens > 3) AS indexable, count(lang) AS with_lang, count(DISTINCT doc_id) AS documents FROM chunks")
def chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tokens") > 3).alias("indexable"), F.count("lang").alias("with_lang"), F.count_distinct("doc_id").alias("documents"))


@query(f"""WITH {CHUNKS} SELECT min(tokens) AS least, max(tokens) AS most, round(avg(tokens), 6) AS mean, round(stddev_samp(tokens), 6) AS std, round(quantile_cont(tokens, 0.1), 6) AS p10, round(quantile_cont(tokens, 0.5), 6) AS p50,
round(quantile_cont(tokens, 0.9), 6) AS p90, round(quantile_cont(tokens, 0.99), 6) AS p99 FROM chunks""")
def token_distribution(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("tokens")
    return chunks(spark, d).agg(F.min(t).alias("least"), F.max(t).alias("most"), F.round(F.avg(t), 6).alias("mean"), F.round(F.stddev_samp(t), 6).alias("std"), *evaluate.percentiles(t, 0.1, 0.5, 0.9, 0.99))


@query(f"WITH {CHUNKS} SELECT CASE WHEN tokens <= 50 THEN '0-50' WHEN tokens <= 100 THEN '51-100' WHEN tokens <= 300 THEN '101-300' WHEN tokens <= 600 THEN '301-600' ELSE '601+' END AS bucket, count(*) AS n FROM chunks GROUP BY 1")
def token_buckets(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy(evaluate.buckets(F.col("tokens"), [50, 100, 300, 600]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


OVERLAP = CHUNKS + """, prev AS (SELECT *, lag(chunk_id) OVER w AS previous_id, lag(tokens) OVER w AS previous_tokens FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal))"""


def _previous(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    return chunks(spark, d).withColumn("previous_id", F.lag("chunk_id").over(w)).withColumn("previous_tokens", F.lag("tokens").over(w))


@query(f"WITH {OVERLAP} SELECT chunk_id, previous_id FROM prev WHERE previous_tokens >= 60")
def overlap_previous(spark: SparkSession, d: str) -> DataFrame:
    return _previous(spark, d).filter("previous_tokens >= 60").select("chunk_id", "previous_id")


@query(f"WITH {OVERLAP} SELECT min(o) AS least, round(median(o), 6) AS median, round(avg(o), 6) AS mean, max(o) AS most FROM (SELECT (previous_tokens // 8)::BIGINT AS o FROM prev WHERE previous_tokens >= 60)")
def overlap_stats(spark: SparkSession, d: str) -> DataFrame:
    o = _previous(spark, d).filter("previous_tokens >= 60").select(F.floor(F.col("previous_tokens") / 8).alias("o"))
    return o.agg(F.min("o").alias("least"), F.round(F.percentile("o", F.lit(0.5)), 6).alias("median"), F.round(F.avg("o"), 6).alias("mean"), F.max("o").alias("most"))


@query(f"WITH {OVERLAP} SELECT p.chunk_id, p.text, q.text AS previous_text FROM prev p JOIN chunks q ON q.chunk_id = p.previous_id WHERE p.tokens > 100")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _previous(spark, d).filter("tokens > 100").select("chunk_id", "previous_id", "text")
    q = chunks(spark, d).select(F.col("chunk_id").alias("previous_id"), F.col("text").alias("previous_text"))
    return p.join(q, "previous_id").select("chunk_id", "text", "previous_text")


@query(f"WITH {CHUNKS} SELECT lang, count(*) AS n, sum((tokens > 50)::BIGINT)::BIGINT AS long FROM chunks GROUP BY 1 ORDER BY 2 DESC, 1")
def strategy_distribution(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("tokens") > 50).cast("long")).alias("long")).orderBy(F.desc("n"), "lang")


@query(f"WITH {CHUNKS} SELECT source, count(*) AS n FROM chunks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def chunk_type_top10(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) >= 10")
def parents_with_children(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")


@query("SELECT o_orderstatus AS status, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM orders GROUP BY 1")
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("""SELECT (SELECT count(*) FROM orders) AS documents, (SELECT count(DISTINCT o_custkey) FROM orders) AS owners, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS expired, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS partial,
(SELECT count(*) FROM lineitem) AS provisions, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS suspended, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'N') AS unknown, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'F') AS closed,
(SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS without_provisions""")
def enrichment_audit(spark: SparkSession, d: str) -> DataFrame:
    """Nine counts in one row; each table is read once but for the check that joins them."""
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").join(li.select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_has", F.lit(True)), "o_orderkey", "left")
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    left = o.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("o_custkey").alias("owners"), is_("o_orderstatus", "F").alias("expired"), is_("o_orderstatus", "P").alias("partial"), F.count_if(F.col("_has").isNull()).alias("without_provisions"))
    right = li.agg(F.count(F.lit(1)).alias("provisions"), is_("l_returnflag", "R").alias("suspended"), is_("l_returnflag", "N").alias("unknown"), is_("l_linestatus", "F").alias("closed"))
    return left.crossJoin(right)  # one row each


@query("SELECT warning, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN o_totalprice > 400000 THEN 'high' END, CASE WHEN o_orderstatus = 'P' THEN 'partial' END], lambda x: x IS NOT NULL)) AS warning FROM orders) GROUP BY 1")
def import_report(spark: SparkSession, d: str) -> DataFrame:
    warnings = F.array_compact(F.array(F.when(F.col("o_totalprice") > 400000, "high"), F.when(F.col("o_orderstatus") == "P", "partial")))
    return table(spark, d, "orders").select(F.explode(warnings).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


FIRST = ("en", "de", "fr")


@query(f"WITH {CHUNKS} (SELECT 'smallest' AS kind, chunk_id, tokens FROM chunks ORDER BY tokens, chunk_id LIMIT 20) UNION ALL (SELECT 'largest', chunk_id, tokens FROM chunks ORDER BY tokens DESC, chunk_id LIMIT 20)" + "".join(f" UNION ALL (SELECT 'first_{x}', chunk_id, tokens FROM chunks WHERE lang = '{x}' ORDER BY doc_id, ordinal LIMIT 20)" for x in FIRST))
def smallest_largest(spark: SparkSession, d: str) -> DataFrame:
    """The five sets of an audit: the shortest and longest chunks, and the first of three kinds (here languages)."""
    c = chunks(spark, d)
    sets = {"smallest": c.orderBy("tokens", "chunk_id"), "largest": c.orderBy(F.desc("tokens"), "chunk_id")} | {f"first_{x}": c.filter(F.col("lang") == x).orderBy("doc_id", "ordinal") for x in FIRST}
    parts = [df.limit(20).select(F.lit(name).alias("kind"), "chunk_id", "tokens") for name, df in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {CHUNKS} SELECT doc_id, ordinal, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS n FROM chunks) WHERE n <= 5")
def adjacent_chunks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    return chunks(spark, d).withColumn("n", F.row_number().over(w)).filter("n <= 5").select("doc_id", "ordinal", "chunk_id")


@query("SELECT (SELECT count(*) FROM documents) AS expected, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS marked, (SELECT count(*) FROM documents) = (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS complete")
def release_completeness(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "labels").select("doc_id", F.lit(True).alias("_m"))
    x = table(spark, d, "documents").select("doc_id").join(marks, "doc_id", "left")
    return x.agg(F.count(F.lit(1)).alias("expected"), F.count("_m").alias("marked")).withColumn("complete", F.col("expected") == F.col("marked"))


@query(f"WITH {CHUNKS} SELECT chunk_id, tokens FROM chunks ORDER BY md5('7:' || chunk_id), chunk_id LIMIT 30")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    """Thirty chunks in the order of a seeded hash: a sample that any engine draws alike."""
    c = chunks(spark, d).select("chunk_id", "tokens")
    return c.orderBy(F.md5(F.concat(F.lit("7:"), "chunk_id")), "chunk_id").limit(30)


# Evaluation.

RANKINGS = """rankings AS (SELECT lang AS case_id, doc_id AS item, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
grades AS (SELECT lang AS case_id, d.doc_id AS item, quality * 2 + (1 - toxic) AS grade FROM documents d JOIN labels USING (doc_id)), k AS (SELECT 10 AS k)"""


@query(f"""WITH {RANKINGS}, held AS (SELECT * FROM grades WHERE grade > 0), i AS (SELECT case_id, count(*) AS relevant, sum((2.0::DOUBLE ** grade - 1) / log2(r + 1)) FILTER (WHERE r <= 50) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, item) AS r FROM held) GROUP BY 1),
g AS (SELECT case_id, count(*) AS hits, min(rank) AS first, sum((2.0::DOUBLE ** grade - 1) / log2(rank + 1)) AS dcg FROM rankings JOIN held USING (case_id, item) WHERE rank <= 50 GROUP BY 1)
SELECT count(*) AS cases, round(avg(coalesce(hits, 0) / relevant), 6) AS recall, round(avg((coalesce(hits, 0) > 0)::INT), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg FROM i LEFT JOIN g USING (case_id)""")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    rankings = docs.select(F.col("lang").alias("case_id"), F.col("doc_id").alias("item"), F.row_number().over(w).alias("rank"))
    grades = docs.join(table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("case_id"), F.col("doc_id").alias("item"), (F.col("quality") * 2 + 1 - F.col("toxic")).alias("grade"))
    return evaluate.ranking_metrics(rankings, grades, 50)


@query(f"""WITH {RANKINGS}, x AS (SELECT r.case_id, min(rank) FILTER (WHERE grade >= 3) AS strict, min(rank) FILTER (WHERE grade >= 2) AS chunk, min(rank) FILTER (WHERE grade >= 1) AS document, min(rank) FILTER (WHERE grade = 0) AS wrong, min(rank) FILTER (WHERE grade IS NOT NULL) AS graded
FROM rankings r LEFT JOIN grades g USING (case_id, item) WHERE rank <= 20 GROUP BY 1) SELECT *, coalesce(strict <= 10, false) AS hit FROM x""")
def benchmark_v2(spark: SparkSession, d: str) -> DataFrame:
    """The first rank of each of five criteria per case, and whether the strict one is met among the first ten."""
    docs = table(spark, d, "documents")
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    r = docs.select("lang", "doc_id", F.row_number().over(w).cast("long").alias("rank")).filter("rank <= 20")
    g = docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", (F.col("quality") * 2 + 1 - F.col("toxic")).alias("grade"))
    first = lambda c: F.min(F.when(c, F.col("rank")))
    grade = F.col("grade")
    x = r.join(g, "doc_id", "left").groupBy(F.col("lang").alias("case_id")).agg(first(grade >= 3).alias("strict"), first(grade >= 2).alias("chunk"), first(grade >= 1).alias("document"), first(grade == 0).alias("wrong"), first(grade.isNotNull()).alias("graded"))
    return x.withColumn("hit", F.coalesce(F.col("strict") <= 10, F.lit(False)))


GENERATION = """g AS (SELECT event_type <> 'error' AS answerable, CASE WHEN event_id % 5 = 0 THEN 'REFUSED' ELSE 'VERIFIED' END AS status, 1 + (event_id % 7 = 0)::INT AS attempts, value AS latency FROM events)"""


@query(f"""WITH {GENERATION} SELECT count(*) AS total_cases, count(*) FILTER (WHERE answerable) AS answerable_cases, round(count(*) FILTER (WHERE status = 'VERIFIED') / count(*), 6) AS verified_rate,
round(count(*) FILTER (WHERE answerable AND status = 'REFUSED') / nullif(count(*) FILTER (WHERE answerable), 0), 6) AS false_refusal_rate, round(count(*) FILTER (WHERE NOT answerable AND status = 'VERIFIED') / nullif(count(*) FILTER (WHERE NOT answerable), 0), 6) AS unsafe_answer_rate,
round(count(*) FILTER (WHERE attempts = 2) / count(*), 6) AS repair_rate, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, round(max(latency), 6) AS most FROM g""")
def generation_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    answerable, refused = F.col("event_type") != "error", F.col("event_id") % 5 == 0
    r = lambda a, b: F.round(evaluate.ratio(F.count_if(a), F.count_if(b)), 6)
    every = F.lit(True)
    return e.agg(F.count(F.lit(1)).alias("total_cases"), F.count_if(answerable).alias("answerable_cases"), r(~refused, every).alias("verified_rate"), r(answerable & refused, answerable).alias("false_refusal_rate"), r(~answerable & ~refused, ~answerable).alias("unsafe_answer_rate"), r(F.col("event_id") % 7 == 0, every).alias("repair_rate"), *evaluate.percentiles(F.col("value"), 0.5, 0.95), F.round(F.max("value"), 6).alias("most"))


@query("""WITH o AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'historical' ELSE 'current' END AS e, CASE WHEN event_id % 11 = 0 THEN 'current' WHEN event_id % 13 = 0 THEN 'historical' ELSE NULL END AS a, event_id % 17 <> 0 AS available, CASE WHEN event_id % 34 = 0 THEN 'VERIFIED' ELSE 'REFUSED' END AS status, CASE WHEN event_id % 3 = 0 THEN 'v1' END AS ev, CASE event_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['v1'] ELSE ['v1', 'v2'] END AS cited FROM events),
c AS (SELECT count(*) AS total, count(*) FILTER (WHERE e = 'historical' AND a = 'current') AS current_as_historical, count(*) FILTER (WHERE e = 'current' AND a = 'historical') AS historical_as_current,
count(*) FILTER (WHERE available AND ev IS NOT NULL AND (len(cited) = 0 OR list_contains(cited, 'v2'))) AS incorrect_version_citations, count(*) FILTER (WHERE NOT available AND status <> 'REFUSED') AS unavailable_not_refused FROM o)
SELECT *, current_as_historical + historical_as_current + incorrect_version_citations + unavailable_not_refused = 0 AS passed FROM c""")
def historical_gate(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    cited = F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array(F.lit("v1"))).otherwise(F.array(F.lit("v1"), F.lit("v2")))
    rows = table(spark, d, "events").select(F.when(i % 2 == 0, "historical").otherwise("current").alias("expected_kind"), F.when(i % 11 == 0, "current").when(i % 13 == 0, "historical").alias("actual_kind"), (i % 17 != 0).alias("available"), F.when(i % 34 == 0, "VERIFIED").otherwise("REFUSED").alias("status"), F.when(i % 3 == 0, "v1").alias("expected_version"), cited.alias("cited"))
    return evaluate.historical_gate(rows)


@query("""WITH r AS (SELECT event_type <> 'error' AS supported, event_id % 9 = 0 AS failed, event_id % 3 = 0 AS passed, value FROM events)
SELECT count(*) AS cases, count(*) FILTER (WHERE failed) AS review_errors, round(count(*) FILTER (WHERE NOT supported AND NOT failed AND NOT passed) / nullif(count(*) FILTER (WHERE NOT supported), 0), 6) AS detection_rate,
round(count(*) FILTER (WHERE supported AND NOT passed) / nullif(count(*) FILTER (WHERE supported), 0), 6) AS false_flag_rate, count(*) FILTER (WHERE NOT supported AND passed) AS unsafe_accepted FROM r""")
def entailment_summary(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    supported, failed, passed = F.col("event_type") != "error", i % 9 == 0, i % 3 == 0
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("cases"), F.count_if(failed).alias("review_errors"), F.round(evaluate.ratio(F.count_if(~supported & ~failed & ~passed), F.count_if(~supported)), 6).alias("detection_rate"), F.round(evaluate.ratio(F.count_if(supported & ~passed), F.count_if(supported)), 6).alias("false_flag_rate"), F.count_if(~supported & passed).alias("unsafe_accepted"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), *evaluate.percentiles(F.col("value"), 0.5, 0.95, 0.99))


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY n, lang) AS position FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.round_robin(table(spark, d, "documents").select("doc_id", "lang"), "lang", F.col("doc_id"))
