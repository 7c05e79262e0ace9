"""Queries: evidence, verification, chat, sources, and document transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legispark.operators import answering, chat, chunking, evidence, load, search, structure, vectors, verify
from legispark.plans.base import CHUNKS, chunks, query, table
from legispark.plans.texts import law
from legispark.sources import html
from legispark.storage import scratch_path

EVIDENCE = """ev AS (SELECT o_custkey % 20 AS query_id, o_orderkey AS item, o_custkey AS document_id, o_orderpriority AS article, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS rank, o_orderkey % 97 + 5 AS tokens FROM orders)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(F.col("o_custkey") % 20).orderBy("o_orderkey")
    return table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("query_id"), F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("article"), F.col("o_totalprice").alias("score"), F.row_number().over(w).cast("long").alias("rank"), (F.col("o_orderkey") % 97 + 5).alias("tokens"), F.col("o_orderstatus"))


ASKED = """ev AS (SELECT o_custkey AS query_id, o_orderkey AS item, o_orderkey % 7 AS document_id, o_orderpriority AS article, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, o_orderkey % 97 + 5 AS tokens FROM orders)"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of each customer: their orders, of seven documents."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 7).alias("document_id"), F.col("o_orderpriority").alias("article"), F.col("o_totalprice").alias("score"), F.row_number().over(w).cast("long").alias("rank"), (F.col("o_orderkey") % 97 + 5).alias("tokens"), F.col("o_orderstatus"))


@query("""SELECT o_custkey AS query_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus <> 'F')::INT DESC, (o_orderkey % 5 = 0)::INT DESC, (o_orderkey % 7 = 0)::INT DESC, o_orderkey % 3 DESC, (o_orderkey % 2 = 0)::INT DESC, o_totalprice DESC, o_orderkey) AS position FROM orders""")
def evidence_priority(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item")
    p = evidence.priority(F.col("o_orderstatus") != "F", i % 5 == 0, i % 7 == 0, i % 3, F.when(i % 2 == 0, 1.0), F.col("score"), i)
    return _asked(spark, d).select("query_id", "item", F.row_number().over(Window.partitionBy("query_id").orderBy(p.desc())).cast("long").alias("position"))


@query("SELECT o_orderkey AS item, (o_orderstatus IN ('F', 'O')) AND (o_orderpriority IN ('1-URGENT')) AS exact FROM orders")
def exact_provision(spark: SparkSession, d: str) -> DataFrame:
    numbers, articles = F.array(F.lit("F"), F.lit("O")), F.array(F.lit("1-URGENT"))
    ok = F.array_contains(numbers, F.col("o_orderstatus")) & F.array_contains(articles, F.col("o_orderpriority")) & (F.size(articles) > 0)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), ok.alias("exact"))


@query(f"""WITH {ASKED}, g AS (SELECT *, max(score) OVER w AS best, min(rank) OVER w AS first FROM ev WINDOW w AS (PARTITION BY query_id, document_id, article))
SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first, document_id, article, score DESC, rank) AS position FROM g""")
def evidence_groups(spark: SparkSession, d: str) -> DataFrame:
    return evidence.group_order(_asked(spark, d)).select("query_id", "item", "position")


@query("SELECT o_custkey AS id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS issues, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS kept FROM orders GROUP BY 1")
def issue_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("issues"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("kept"))


@query(f"WITH {ASKED}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, article ORDER BY score DESC, item) AS n FROM ev) SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY n, article) AS position FROM n")
def issue_round_robin(spark: SparkSession, d: str) -> DataFrame:
    n = _asked(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "article").orderBy(F.desc("score"), "item")))
    return n.select("query_id", "item", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "article")).cast("long").alias("position"))


@query("SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) WHERE length(b.text) >= 40")
def contained_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return evidence.quote_matches(table(spark, d, "benchmark").filter(F.length("text") >= 40), table(spark, d, "documents"), literal=True)


TOKS = "' ' || array_to_string(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''), ' ') || ' '"


@query(f"SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) OR contains({TOKS.format('d.text')}, {TOKS.format('b.text')})")
def quote_in_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.quote_matches(table(spark, d, "benchmark"), table(spark, d, "documents"))


@query(f"""WITH p AS (SELECT doc_id, i, s, list_distinct(list_filter(regexp_split_to_array(lower(s), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)),
c AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')) AS t FROM benchmark),
pw AS (SELECT doc_id, i, unnest(t) AS w FROM p), cw AS (SELECT item_id, len(t) AS whole, unnest(t) AS w FROM c),
x AS (SELECT item_id, doc_id, i, count(*) AS n, any_value(whole) AS whole FROM cw JOIN pw USING (w) GROUP BY 1, 2, 3)
SELECT item_id, arg_max(doc_id, (n, -doc_id, -i)) AS doc_id, max(n)::BIGINT AS n FROM x WHERE n >= 4 AND n >= 0.2 * whole GROUP BY 1""")
def best_excerpt(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return evidence.best_excerpts(table(spark, d, "benchmark"), parts).select("item_id", "doc_id", "n")


@query("SELECT o_orderkey AS id, '[E' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) || '] ' || o_orderpriority || ' | ' || CASE o_orderstatus WHEN 'F' THEN 'hết hiệu lực' WHEN 'O' THEN 'còn hiệu lực' ELSE 'hết hiệu lực một phần' END AS line FROM orders")
def render_evidence(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "hết hiệu lực").when(F.col("o_orderstatus") == "O", "còn hiệu lực").otherwise("hết hiệu lực một phần")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("[E"), n.cast("string"), F.lit("] "), "o_orderpriority", F.lit(" | "), status).alias("line"))


@query("SELECT min(c_custkey) AS id, lower(replace(replace(c_mktsegment, '–', '-'), ' ', '')) AS key FROM customer GROUP BY 2")
def citation_dedupe(spark: SparkSession, d: str) -> DataFrame:
    key = F.regexp_replace(F.translate(F.lower("c_mktsegment"), "–—", "--"), r"\s+", "")
    return load.first_by(table(spark, d, "customer").withColumn("key", key), ["key"], F.col("c_custkey")).select(F.col("c_custkey").alias("id"), "key")


# Verification: each code is a violation query.


@query("SELECT conv_id, turn, 'too_long' AS problem FROM conversations WHERE length(text) > 500 UNION ALL SELECT conv_id, turn, 'empty_claim' FROM conversations WHERE trim(text) = '' UNION ALL SELECT conv_id, min(turn), 'too_many_claims' FROM conversations GROUP BY 1 HAVING count(*) > 5")
def claim_contract(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    long = c.filter(F.length("text") > 500).select("conv_id", "turn", F.lit("too_long").alias("problem"))
    empty = c.filter(F.trim("text") == "").select("conv_id", "turn", F.lit("empty_claim").alias("problem"))
    many = c.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.count(F.lit(1)).alias("n")).filter("n > 5").select("conv_id", "turn", F.lit("too_many_claims").alias("problem"))
    return long.unionByName(empty).unionByName(many)


@query("""SELECT o_orderkey AS issue, CASE WHEN n = 0 THEN 'MISSING_ISSUE_RESOLUTION' ELSE 'DUPLICATE_ISSUE_RESOLUTION' END AS code FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY 1) WHERE n <> 1""")
def issue_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Each order as an answer to one issue, each returned item as a resolution of it."""
    one = F.struct(F.lit("I1").alias("issue_id"), F.lit("INSUFFICIENT_EVIDENCE").alias("status"), F.array().cast("array<int>").alias("claim_indexes"), F.lit("thiếu").alias("explanation"))
    r = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(one).cast(verify.RESOLUTIONS).alias("resolutions"))
    x = table(spark, d, "orders").select("o_orderkey").join(r, "o_orderkey", "left")
    x = x.select("o_orderkey", F.coalesce("resolutions", F.array().cast(verify.RESOLUTIONS)).alias("resolutions"), F.array(F.lit("I1")).alias("issue_ids"), F.array().cast(verify.CLAIMS).alias("claims"), F.array(F.lit("thiếu")).alias("limitations"))
    return x.select(F.col("o_orderkey").alias("issue"), F.explode(verify.issue_problems()).alias("p")).select("issue", "p.code")


@query("""SELECT id, CASE WHEN again THEN 'INCOMPLETE_OR_DUPLICATE_CLAIM_CHECKS' WHEN unknown THEN 'INVALID_VERDICT' END AS error FROM (SELECT id, bool_or(n > 1 AND dear) AS again, bool_or(status = 'P') AS unknown
FROM (SELECT o_custkey AS id, o_orderstatus AS status, o_totalprice > 300000 AS dear, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY id)""")
def judge_contract(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as the checks of a review; dear ones all judge the first claim, pending ones have no known verdict."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    said = F.when(F.col("o_orderstatus") == "F", "SUPPORTED").when(F.col("o_orderstatus") == "O", "CONTRADICTED").otherwise("MAYBE")
    check = F.struct(F.when(F.col("o_totalprice") > 300000, 0).otherwise(n - 1).cast("int").alias("claim_index"), said.alias("verdict"), F.col("o_orderpriority").alias("reason"))
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), check.alias("c")).groupBy("id").agg(F.collect_list("c").alias("checks"))
    error = answering.review_error(F.col("checks"), F.size("checks"), F.array().cast("array<string>"), F.array().cast(answering.COVERAGE))
    return x.select("id", error.alias("error"))


@query("SELECT conv_id, string_agg(trim(regexp_replace(trim(text), '\\.+$', '') || '. [E' || turn || ']'), chr(10) || chr(10) ORDER BY turn) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 5 GROUP BY 1")
def render_answer(spark: SparkSession, d: str) -> DataFrame:
    """The first five turns of a conversation as the claims of an answer."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    claim = F.struct(F.col("text"), F.array(F.concat(F.lit("E"), F.col("turn").cast("string"))).alias("evidence_ids"))
    x = table(spark, d, "conversations").withColumn("n", n).filter("n <= 5").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", claim.alias("c")))).alias("x"))
    return x.select("conv_id", answering.rendered(F.transform("x", lambda c: c["c"])).alias("answer"))


@query("SELECT o_custkey AS id, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'REFUSED' WHEN bool_or(o_orderstatus = 'F') THEN 'REPAIR_REQUIRED' ELSE 'VERIFIED' END AS status FROM orders GROUP BY 1")
def semantic_status(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as the checked claims of an answer; a pending one stands for a judge that failed."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    said = F.when(F.col("o_orderstatus") == "F", "INSUFFICIENT").otherwise("SUPPORTED")
    check = F.struct((n - 1).cast("int").alias("claim_index"), said.alias("verdict"), F.col("o_orderpriority").alias("reason"))
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), check.alias("c"), (F.col("o_orderstatus") == "P").alias("p"))
    claim = F.struct(F.lit("c").alias("text"), F.array(F.lit("E1")).alias("evidence_ids"), F.array().cast("array<string>").alias("issue_ids"))
    held = x.groupBy("id").agg(F.collect_list("c").cast(answering.CHECKS).alias("checks"), F.collect_list(claim).alias("claims"), F.bool_or("p").alias("review_failed"))
    ready = held.withColumns({"verdict": F.lit("VERIFIED"), "problems": F.array().cast(verify.PROBLEMS), "issue_ids": F.array().cast("array<string>"), "coverage": F.array().cast(answering.COVERAGE), "quote_issues": F.array().cast("array<int>"), "plan_complete": F.lit(True)})
    return answering.combine_review(ready).select("id", F.col("verdict").alias("status"))


# Chat and sources.


@query("SELECT conv_id, role, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations GROUP BY 1, 2")
def message_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """All turns put in after those that open their conversations; a role's first message is its client id's only one."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("role").alias("client_message_id"), F.col("turn").alias("created_at"), F.col("text").alias("content"))
    held = c.filter("created_at = 0")
    return chat.put_messages(held, c).select(F.col("conversation_id").alias("conv_id"), F.col("client_message_id").alias("role"), F.col("created_at").alias("turn"), F.col("content").alias("text"))


@query("SELECT conv_id, conv_id % 5 = 0 AS pinned, max(turn) AS updated FROM conversations GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
def conversation_list(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"))
    return c.select("conv_id", (F.col("conv_id") % 5 == 0).alias("pinned"), "updated").orderBy(F.desc("pinned"), F.desc("updated"), "conv_id").limit(20)


@query("SELECT c_custkey AS id, c_mktsegment AS workspace FROM customer WHERE regexp_matches(c_mktsegment, '^[A-Za-z0-9._-]{1,100}$') AND c_mktsegment = 'BUILDING'")
def workspace_scope(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("workspace_id"))
    return chat.of_workspace(c, "BUILDING").select("id", F.col("workspace_id").alias("workspace"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS project FROM orders WHERE o_orderkey % 7 <> 0")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Orders as conversations of their customers' projects: some projects are deleted, and some conversations."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("conversation_id"), F.col("o_custkey").alias("project_id"))
    left = chat.delete_conversations(o, o.filter("conversation_id % 7 = 0"))
    return chat.delete_projects(left, o.filter("project_id % 10 = 0")).select(F.col("conversation_id").alias("id"), F.col("project_id").alias("project"))


@query("SELECT user_id, arg_max(event_id, (value, event_id)) AS source FROM events WHERE event_type IN ('view', 'click') AND value > 1 GROUP BY 1")
def best_source(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type IN ('view', 'click') AND value > 1")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("source"))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, CASE role WHEN 'user' THEN 'message.created' ELSE 'answer.delta' END AS event FROM conversations")
def event_sequence(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    return table(spark, d, "conversations").select("conv_id", n.alias("seq"), F.when(F.col("role") == "user", "message.created").otherwise("answer.delta").alias("event"))


# Transforms that SQL cannot express; tests hold goldens.


@query()
def clean_html(spark: SparkSession, d: str) -> DataFrame:
    return html.clean_pages(table(spark, d, "pages")).select("id", "content_clean")


@query()
def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    return html.clean_pages(table(spark, d, "pages"))


@query()
def parse_documents(spark: SparkSession, d: str) -> DataFrame:
    return structure.containment(structure.classify(structure.line_tokens(law(spark, d))))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents"))


@query(f"""WITH {CHUNKS}, o AS (SELECT doc_id, list(tokens ORDER BY ordinal) AS t FROM chunks GROUP BY 1),
RECURSIVE_fold AS (SELECT doc_id, list_reduce(list_prepend({{s: 0::BIGINT, g: -1::BIGINT}}, list_transform(t, lambda x: {{s: x, g: 0::BIGINT}})), lambda a, x: CASE WHEN a.g < 0 OR a.s >= 60 OR a.s + x.s > 120 THEN {{s: x.s, g: a.g + 1}} ELSE {{s: a.s + x.s, g: a.g}} END) AS r FROM o)
SELECT doc_id, r.g + 1 AS groups FROM RECURSIVE_fold""")
def pack_units(spark: SparkSession, d: str) -> DataFrame:
    t = chunks(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "tokens"))).alias("x"))
    g = structure.pack_groups(F.transform("x", lambda c: c["tokens"]), 60, 120)
    return t.select("doc_id", (F.array_max(g) + 1).cast("long").alias("groups"))


@query()
def semantic_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.chunk_documents(table(spark, d, "documents"))
    return chunking.semantic_overlap(c).filter("overlap_text IS NOT NULL").select("chunk_id", "overlap_from", "overlap_text")


@query(f"""WITH {ASKED}, g AS (SELECT *, max(score) OVER w AS best, min(rank) OVER w AS first FROM ev WINDOW w AS (PARTITION BY query_id, document_id, article)),
p AS (SELECT query_id, item, tokens, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first, document_id, article, score DESC, rank) AS position FROM g),
o AS (SELECT query_id, list({{used: tokens::BIGINT, n: 1::BIGINT, items: [item::VARCHAR]}} ORDER BY position) AS x FROM p GROUP BY 1),
r AS (SELECT query_id, list_reduce(list_prepend({{used: 0::BIGINT, n: 0::BIGINT, items: []::VARCHAR[]}}, x), lambda a, e: CASE WHEN a.used + e.used <= 400 AND a.n < 12 THEN {{used: a.used + e.used, n: a.n + 1, items: list_concat(a.items, e.items)}} ELSE a END) AS p FROM o)
SELECT query_id, array_to_string(p.items, ',') AS items, p.used AS used FROM r""")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    return evidence.pack_budget(evidence.group_order(_asked(spark, d)), 400, 12)


@query()
def issue_fair(spark: SparkSession, d: str) -> DataFrame:
    x = _evidence(spark, d).select("query_id", F.col("article").alias("issue"), F.col("item").cast("string").alias("item"), "score", F.col("document_id").cast("string").alias("basis"))
    return evidence.issue_fair(x)


@query()
def ancestor_excerpt(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("chunk_id", "doc_id", "text")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("_parent"))
    return c.join(docs, "doc_id").select("chunk_id", evidence.ancestor_excerpt(F.col("_parent"), F.col("text")).alias("excerpt"))


@query()
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The turns of each conversation as the evidence of a query."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("string").alias("item"), "text", F.col("turn").alias("position"))
    return evidence.near_duplicates(c)


@query()
def dense_ann(spark: SparkSession, d: str) -> DataFrame:
    """The index of vectors in cells, built over all rows and opened as a search does. Queries: ids divisible by 20."""
    index, points = _vector_index(spark, d)
    return vectors.search_vectors(spark, index, points.filter("point_id % 20 = 0").withColumnRenamed("point_id", "query_id"), 10)


@query()
def dense_ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """For each query of ``dense_ann``: how many of its ten exact neighbours the index finds, and of how many points it reads the integers and the vectors."""
    index, points = _vector_index(spark, d)
    asked = points.filter("point_id % 20 = 0").withColumnRenamed("point_id", "query_id")
    run = vectors.VectorSearch(spark, index, asked, 10)
    exact = search.dense_top_k(points, asked, 10).select("query_id", "point_id")
    found = run.top().select("query_id", "point_id", F.lit(1).alias("f"))
    hits = exact.join(found, ["query_id", "point_id"], "left").groupBy("query_id").agg(F.count("f").alias("found"), F.count(F.lit(1)).alias("exact"))
    scored = run.candidates().groupBy("query_id").agg(F.count(F.lit(1)).alias("scored"))
    return hits.join(scored, "query_id").join(run.scanned(), "query_id").select("query_id", "found", "exact", "scored", F.col("n").alias("scanned"), F.lit(index.points).cast("long").alias("points"), F.lit(index.probes).alias("cells_opened"), F.lit(len(index.centres)).alias("cells"))


def _vector_index(spark: SparkSession, d: str) -> tuple[vectors.VectorIndex, DataFrame]:
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))
    path = scratch_path(spark, "vector-index")
    vectors.build_vector_index(points, path)
    return vectors.open_vector_index(spark, path), points
