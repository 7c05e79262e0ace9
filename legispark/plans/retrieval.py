"""Queries: dense and lexical search, fusion, graph expansion, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legispark.operators import lexical, search, temporal
from legispark.plans.base import EDGES, LEGAL, PERIODS, edges, legal, periods, query, table

DAY = "1996-06-30"
AT = "valid_from <= DATE '1996-06-30' AND (valid_to IS NULL OR DATE '1996-06-30' < valid_to)"
TERMS = [(1, "the"), (1, "tion"), (1, "anon"), (2, "der"), (2, "enst"), (3, "eau"), (3, "les")]
TERMS_SQL = "(VALUES (1, 'the'), (1, 'tion'), (1, 'anon'), (2, 'der'), (2, 'enst'), (3, 'eau'), (3, 'les')) q(query_id, term)"
COSINE = "round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6)"
DENSE = f"""dense AS (SELECT * FROM (SELECT q.vec_id AS query_id, p.vec_id AS point_id, {COSINE} AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, p.vec_id) AS rank FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0) WHERE rank <= 100)"""
WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))


def _terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "query_id long, term string")


#: The lexical side of the stated query set: the first three words of the document of the same id.
OWN_TERMS = f"""own_terms AS (SELECT doc_id AS query_id, unnest(list_distinct(list_slice({WORDS.format('text')}, 1, 3))) AS term FROM documents WHERE doc_id % 20 = 0 AND doc_id IN (SELECT vec_id FROM embeddings))"""


def _own_terms(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("doc_id"))
    first = F.array_distinct(F.slice(search.words(F.col("text")), 1, 3))
    return table(spark, d, "documents").filter("doc_id % 20 = 0").join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), F.explode(first).alias("term"))


def _bm25_sql(name: str, fields: dict[str, tuple[str, float]], terms: str = TERMS_SQL) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {WORDS.format(c)} AS w, {b}::DOUBLE AS boost FROM documents" for f, (c, b) in fields.items())
    return f"""f AS ({parts}), stats AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM f GROUP BY 1),
posts AS (SELECT doc_id, field, boost, len(w) AS length, term, count(*) AS tf FROM (SELECT doc_id, field, boost, w, unnest(w) AS term FROM f) WHERE term IN (SELECT term FROM {terms}) GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM posts GROUP BY 1, 2),
{name} AS (SELECT query_id, doc_id, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(DISTINCT term) AS n_terms
FROM posts JOIN stats USING (field) JOIN dfs USING (field, term) JOIN {terms} USING (term) GROUP BY 1, 2)"""


BM25 = _bm25_sql("bm", {"text": ("text", 1.0)})


def _bm25(spark: SparkSession, d: str, fields: dict[str, float], terms: DataFrame | None = None) -> DataFrame:
    terms = _terms(spark) if terms is None else terms
    return search.bm25(*search.term_postings(table(spark, d, "documents"), {f: F.col(f) for f in fields}, terms), terms, fields)


@query("""SELECT vec_id, round(n, 6) AS norm, abs(list_sum(list_transform(v, lambda x: (x / n) * (x / n))) ** 0.5 - 1) < 0.00001 AS unit
FROM (SELECT vec_id, embedding::DOUBLE[] AS v, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) ** 0.5 AS n FROM embeddings)""")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("_v", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", F.round(search.norm(F.col("_v")), 6).alias("norm"), (F.abs(search.norm(search.l2_normalize(F.col("_v"))) - 1) < 1e-5).alias("unit"))


@query(f"WITH {DENSE} SELECT query_id, point_id, score, rank FROM dense WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.dense_top_k(_points(spark, d), _queries(spark, d), 10)


@query(f"""SELECT * FROM (SELECT q.vec_id AS query_id, p.vec_id AS point_id, {COSINE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, p.vec_id) AS rank
FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0 AND p.label IN (1, 2, 3, 4) AND {COSINE} >= 0.05) WHERE rank <= 10""")
def dense_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    allowed = table(spark, d, "embeddings").filter(F.col("label").isin(1, 2, 3, 4)).select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))
    return search.dense_top_k(allowed, _queries(spark, d), 10, least=0.05)


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(_bm25(spark, d, {"text": 1.0}), 20, F.desc("score"), F.col("doc_id")).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {_bm25_sql('bm', {'text': ('text', 1.0), 'source': ('source', 3.0), 'lang': ('lang', 10.0)})} SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 20")
def bm25_multifield(spark: SparkSession, d: str) -> DataFrame:
    return search.top_k(_bm25(spark, d, {"text": 1.0, "source": 3.0, "lang": 10.0}), 20, F.desc("score"), F.col("doc_id")).select("query_id", "doc_id", "score")


@query(f"WITH {OWN_TERMS}, {_bm25_sql('bm', {'text': ('text', 1.0), 'source': ('source', 3.0)}, 'own_terms')} SELECT query_id, doc_id, score, n_terms, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 20")
def bm25_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """Builds the lexical index of all documents, opens it as a search does, and answers the stated query set from it."""
    from legispark.operators import inverted
    from legispark.storage import scratch_path

    path = scratch_path(spark, "lexical-index")
    inverted.build_lexical_index(table(spark, d, "documents"), path, {"text": F.col("text"), "source": F.col("source")}, cluster=("lang",))
    return inverted.search_index(spark, inverted.open_lexical_index(spark, path), _own_terms(spark, d), {"text": 1.0, "source": 3.0}, 20)


@query(f"""WITH {BM25}, ph AS (SELECT doc_id, contains(' ' || array_to_string({WORDS.format('text')}, ' ') || ' ', ' that the ') AS p, list_has_all({WORDS.format('text')}, ['that', 'the']) AS c FROM documents)
SELECT query_id, doc_id, round(score + CASE WHEN query_id = 1 THEN 4 * p::INT + 2 * c::INT ELSE 0 END, 6) AS score FROM bm JOIN ph USING (doc_id)""")
def bm25_phrase_boost(spark: SparkSession, d: str) -> DataFrame:
    """BM25 with the phrases of the query; the first query of the set has one."""
    built = lexical.build_queries(spark.createDataFrame([(1, "that the")], "query_id long, query string"))
    boost = lexical.phrase_scores(table(spark, d, "documents"), built)
    scored = _bm25(spark, d, {"text": 1.0}).join(boost, ["query_id", "doc_id"], "left")
    return scored.select("query_id", "doc_id", F.round(F.col("score") + F.coalesce("boost", F.lit(0.0)), 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE lower(source) IN ('src1', 'src2') AND lower(lang) IN ('en', 'de')")
def sparse_required_filter(spark: SparkSession, d: str) -> DataFrame:
    return lexical.required_groups(table(spark, d, "documents"), {"source": ["SRC1", "src2 "], "lang": ["EN", "de"], "text": [" "]}).select("doc_id")


@query(f"WITH {BM25} SELECT query_id, doc_id, round(CASE WHEN query_id = 1 THEN score ELSE score + 5 * (d.lang = 'de')::INT END, 6) AS score FROM bm JOIN documents d USING (doc_id) WHERE query_id <> 1 OR d.lang = 'en'")
def structure_requirement(spark: SparkSession, d: str) -> DataFrame:
    """The first query requires its hint, the others add weight for theirs."""
    hints = spark.createDataFrame([(1, True, ["EN "]), (2, False, ["de"]), (3, False, ["de"])], "query_id long, require boolean, hint_lang array<string>")
    scored = _bm25(spark, d, {"text": 1.0}).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("query_id", "doc_id", "score", "lang")
    return lexical.structured_scores(scored, hints, ("lang",)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _ranked(spark: SparkSession, d: str, k: int = 100) -> DataFrame:
    dense = search.dense_top_k(_points(spark, d), _queries(spark, d), k).select("query_id", F.lit("dense").alias("source"), "point_id", F.col("score").alias("raw_score"), "rank")
    sparse = search.bm25_top_k(table(spark, d, "documents"), F.col("text"), _own_terms(spark, d), k).select("query_id", F.lit("sparse").alias("source"), F.col("doc_id").alias("point_id"), F.col("score").alias("raw_score"), "rank")
    return dense.unionByName(sparse)


RANKED = f"""{DENSE}, {OWN_TERMS}, {_bm25_sql('bm', {'text': ('text', 1.0)}, 'own_terms')}, ranked AS (SELECT query_id, 'dense' AS source, point_id, rank FROM dense UNION ALL
  SELECT query_id, 'sparse', doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 100),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, point_id) AS rank FROM
  (SELECT query_id, point_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM ranked GROUP BY 1, 2))"""


@query(f"WITH {RANKED} SELECT query_id, point_id, score, best_rank, rank FROM fused WHERE rank <= 30")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return search.reciprocal_rank_fusion(_ranked(spark, d), limit=30).select("query_id", "point_id", "score", "best_rank", "rank")


@query(f"WITH {DENSE} SELECT query_id, point_id, round(1.0::DOUBLE / (60 + rank), 9) AS score, rank FROM dense WHERE rank <= 30")
def fusion_single_source(spark: SparkSession, d: str) -> DataFrame:
    return search.reciprocal_rank_fusion(_ranked(spark, d), {"sparse": 0.0}, limit=30).select("query_id", "point_id", "score", "rank")


@query(f"""WITH {DENSE}, x AS (SELECT d.*, label AS seed FROM dense d JOIN embeddings ON vec_id = point_id WHERE label IN (1, 2, 3)),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id, seed ORDER BY score DESC, point_id) AS r FROM x)
SELECT query_id, seed, point_id, row_number() OVER (PARTITION BY query_id ORDER BY seed, score DESC, point_id) AS rank FROM y WHERE r <= 4""")
def per_seed_topk(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "embeddings").filter("label IN (1, 2, 3)").select(F.col("vec_id").alias("point_id"), F.col("label").alias("seed"))
    scored = search.dense_top_k(_points(spark, d), _queries(spark, d), 100).drop("rank").join(seeds, "point_id")
    return search.per_seed(scored, 10, 3).select("query_id", "seed", "point_id", "rank")


@query(f"""WITH {DENSE}, {PERIODS}, ok AS (SELECT DISTINCT document_id AS point_id FROM periods WHERE {AT} AND status = 'EFFECTIVE'),
lv AS (SELECT query_id, level, count(*) FILTER (WHERE rank <= level) AS n, count(*) FILTER (WHERE rank <= level AND ok.point_id IS NOT NULL) AS hydrated
  FROM dense LEFT JOIN ok USING (point_id), (VALUES (10), (20), (40), (80), (100)) l(level) GROUP BY 1, 2)
SELECT query_id, min(level)::BIGINT AS level, arg_min(hydrated, level)::BIGINT AS hydrated FROM lv WHERE hydrated >= 5 OR n < level OR level = 100 GROUP BY 1""")
def candidate_expansion(spark: SparkSession, d: str) -> DataFrame:
    valid = temporal.as_of(periods(spark, d), DAY, ["EFFECTIVE"]).select(F.col("document_id").alias("point_id")).distinct()
    return search.expansion_level(search.dense_top_k(_points(spark, d), _queries(spark, d), 100), valid, 5, start=10, cap=100)


@query(f"""WITH {DENSE}, x AS (SELECT d.query_id, point_id, rank, label * 1.0::DOUBLE AS rerank_score FROM dense d JOIN embeddings ON vec_id = point_id WHERE rank <= 30)
SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY rank > 12, CASE WHEN rank <= 12 THEN -rerank_score END, CASE WHEN rank <= 12 THEN point_id END, rank) AS final_rank FROM x""")
def rerank_merge(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").cast("double").alias("rerank_score"))
    ranked = search.dense_top_k(_points(spark, d), _queries(spark, d), 30).join(scores, "point_id")
    return search.rerank(ranked, 12).select("query_id", "point_id", "final_rank")


@query(f"""WITH {DENSE}, x AS (SELECT d.*, label AS document_id FROM dense d JOIN embeddings ON vec_id = point_id WHERE rank <= 30),
seeds AS (SELECT query_id, document_id, round(max(score) * 100, 4) AS sc FROM x GROUP BY 1, 2),
ordered AS (SELECT *, row_number() OVER w AS r, lead(sc) OVER w AS next FROM seeds WINDOW w AS (PARTITION BY query_id ORDER BY sc DESC, document_id)),
best AS (SELECT query_id, document_id FROM ordered WHERE r = 1 AND (next IS NULL OR sc - next >= 1.0))
SELECT x.query_id, point_id, row_number() OVER (PARTITION BY x.query_id ORDER BY CASE WHEN x.document_id = b.document_id THEN 0 ELSE 1 END, rank) AS final_rank FROM x LEFT JOIN best b ON b.query_id = x.query_id""")
def seed_promotion(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("label").alias("document_id"))
    ranked = search.dense_top_k(_points(spark, d), _queries(spark, d), 30).join(docs, "point_id")
    seeds = ranked.groupBy("query_id", "document_id").agg(F.round(F.max("score") * 100, 4).alias("seed_score"))
    return search.promote_seed(ranked, seeds).select("query_id", "point_id", "final_rank")


@query(f"""WITH {RANKED}, {PERIODS} SELECT f.query_id, f.point_id, f.score, p.status, p.valid_from,
row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank) AS rank FROM fused f JOIN (SELECT * FROM periods WHERE {AT} AND status IN ('EFFECTIVE', 'PARTIALLY_EFFECTIVE')) p ON p.document_id = f.point_id""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    fused = search.reciprocal_rank_fusion(_ranked(spark, d))
    now = temporal.as_of(periods(spark, d), DAY).select(F.col("document_id").alias("point_id"), "status", "valid_from")
    kept = fused.join(now, "point_id").withColumnRenamed("rank", "_r")
    return kept.select("query_id", "point_id", "score", "status", "valid_from", F.row_number().over(Window.partitionBy("query_id").orderBy("_r")).cast("long").alias("rank"))


@query("SELECT event_id, CASE WHEN event_type = 'view' AND value > 100 THEN 'historical' WHEN event_type = 'view' THEN 'none' ELSE 'current' END AS target, event_type = 'view' AND value <= 100 AS warned FROM events")
def temporal_router(spark: SparkSession, d: str) -> DataFrame:
    """Views ask for the past; the index of the past is ready for values over 100."""
    intent = F.when(F.col("event_type") == "view", "historical").otherwise("current_law")
    routed = temporal.route(intent, F.col("value") > 100)
    return table(spark, d, "events").select("event_id", routed.alias("r")).select("event_id", "r.target", "r.warned")


@query("SELECT o_custkey AS query_id, max(o_totalprice) AS score, min(o_orderkey) FILTER (WHERE o_totalprice = m) AS document_id, count(*) FILTER (WHERE o_totalprice = m) > 1 AS ambiguous FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) GROUP BY 1")
def status_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("m", F.max("o_totalprice").over(Window.partitionBy("o_custkey")))
    top = F.col("o_totalprice") == F.col("m")
    return o.groupBy(F.col("o_custkey").alias("query_id")).agg(F.max("o_totalprice").alias("score"), F.min(F.when(top, F.col("o_orderkey"))).alias("document_id"), (F.count_if(top) > 1).alias("ambiguous"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'graph' WHEN o_orderpriority < '3' THEN 'seeds' WHEN o_totalprice > 1000 THEN 'numbers' ELSE 'open' END AS target FROM orders")
def search_target(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    some = lambda c: F.when(c, F.array(key)).otherwise(F.array().cast("array<string>"))
    picked = search.search_target(some(F.col("o_orderstatus") == "F"), some(F.col("o_orderpriority") < "3"), some(F.col("o_totalprice") > 1000))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), picked["kind"].alias("target"))


# Graph: one hop over typed, dated edges, from every document.


@query(f"WITH {PERIODS} SELECT l.document_id, coalesce(p.status, l.status) AS status FROM legal l LEFT JOIN (SELECT document_id, status FROM periods WHERE {AT}) p USING (document_id)")
def seed_lookup(spark: SparkSession, d: str) -> DataFrame:
    now = periods(spark, d).filter(temporal.valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(DAY).cast("date"))).select("document_id", F.col("status").alias("_s"))
    return legal(spark, d).join(now, "document_id", "left").select("document_id", F.coalesce("_s", "status").alias("status"))


ROLE_SQL = """CASE direction || ' ' || relation WHEN 'incoming REPLACES' THEN 'current_authority' WHEN 'incoming REPEALS' THEN 'repealing_document' WHEN 'incoming AMENDS' THEN 'amending_document' WHEN 'incoming SUPPLEMENTS' THEN 'supplementing_document' WHEN 'incoming GUIDES' THEN 'guidance_document'
WHEN 'outgoing REPLACES' THEN 'replaced_document' WHEN 'outgoing REPEALS' THEN 'repealed_document' WHEN 'outgoing AMENDS' THEN 'amended_document' WHEN 'outgoing SUPPLEMENTS' THEN 'supplemented_document' WHEN 'outgoing GUIDES' THEN 'guided_document' ELSE 'related_document' END"""
EXPAND = EDGES + f""", hop AS (SELECT target_id AS seed_id, source_id AS document_id, relation, 'incoming' AS direction FROM edges WHERE {AT} UNION ALL SELECT source_id, target_id, relation, 'outgoing' FROM edges WHERE {AT})"""


@query(f"WITH {EXPAND} SELECT seed_id, h.document_id, relation, direction, l.status FROM hop h JOIN legal l ON l.document_id = h.document_id")
def graph_expand(spark: SparkSession, d: str) -> DataFrame:
    from legispark.operators.graph import expand

    return expand(edges(spark, d), legal(spark, d), legal(spark, d).select("document_id"), DAY).select("seed_id", "document_id", "relation", "direction", "status")


@query(f"WITH {EXPAND} SELECT seed_id, document_id, {ROLE_SQL} AS role FROM hop")
def graph_roles(spark: SparkSession, d: str) -> DataFrame:
    from legispark.operators.graph import expand, role

    out = expand(edges(spark, d), legal(spark, d), legal(spark, d).select("document_id"), DAY)
    return out.select("seed_id", "document_id", role(F.col("direction"), F.col("relation")).alias("role"))


SOURCED = f"""{EDGES}, sourced AS (SELECT e.*, coalesce(CASE WHEN l.price > 150000 THEN 'edge:' || source_id END, CASE WHEN l.status = 'EFFECTIVE' THEN 'document:' || source_id END) AS url,
  l.document_type < '3' OR l.status = 'EXPIRED' AS trusted FROM edges e JOIN legal l ON l.document_id = e.source_id)"""


def _sourced(spark: SparkSession, d: str) -> DataFrame:
    """Edges with addresses: of the edge for dear documents, of the document for effective ones."""
    from legispark.operators.graph import edge_source

    x = edges(spark, d).join(legal(spark, d).select(F.col("document_id").alias("source_id"), "price", "status", "document_type"), "source_id")
    own = F.when(F.col("price") > 150000, F.concat(F.lit("edge:"), F.col("source_id").cast("string")))
    document = F.when(F.col("status") == "EFFECTIVE", F.concat(F.lit("document:"), F.col("source_id").cast("string")))
    s = edge_source(own, document, F.col("document_type") < "3", F.col("status") == "EXPIRED")
    return x.withColumn("s", s).select("*", "s.url", "s.trusted")


@query(f"WITH {SOURCED} SELECT source_id, target_id, url, trusted FROM sourced")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _sourced(spark, d).select("source_id", "target_id", "url", "trusted")


@query(f"WITH {SOURCED} SELECT owner, source_id, 'G' || n AS evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY source_id) AS n FROM sourced WHERE trusted AND url IS NOT NULL) WHERE n <= 2")
def graph_evidence(spark: SparkSession, d: str) -> DataFrame:
    from legispark.operators.graph import graph_evidence as pick

    return pick(_sourced(spark, d), "owner", F.col("source_id")).select("owner", "source_id", "evidence_id")


@query(f"""WITH {LEGAL} SELECT document_id, round(100 + CASE WHEN len(o) > 0 THEN 20.0 * len(o) / len(t) ELSE 0 END + CASE WHEN status IN ('EFFECTIVE') THEN 5 ELSE 0 END + CASE WHEN year(effective_date) = 1996 THEN 10 ELSE 0 END, 6) AS score
FROM (SELECT *, list_sort(list_distinct(regexp_extract_all(lower(document_type), '[a-z0-9đ]{{2,}}'))) AS t, list_intersect(list_distinct(regexp_extract_all(lower(document_type), '[a-z0-9đ]{{2,}}')), ['urgent', 'high', 'specified']) AS o FROM legal)""")
def seed_score(spark: SparkSession, d: str) -> DataFrame:
    from legispark.operators.graph import seed_score as score

    x = legal(spark, d)
    return x.select("document_id", F.round(score("urgent high matters specified of 1996", authority=F.col("document_type"), kind=F.lit(None), title=F.lit(None), year=F.year("effective_date"), status=F.col("status"), preferred=["EFFECTIVE"]), 6).alias("score"))
