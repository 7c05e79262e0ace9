"""Queries: scans, temporal filters and joins, loads and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legispark.functions import labels, text
from legispark.operators import load, search, temporal
from legispark.plans.base import CHUNKS, EDGES, LEGAL, PERIODS, PROVISIONS, chunks, edges, legal, periods, provisions, query, table
from legispark.plans.retrieval import DENSE

DAY = "1996-06-30"
AT = "valid_from <= DATE '1996-06-30' AND (valid_to IS NULL OR DATE '1996-06-30' < valid_to)"


# Scans and scopes.


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def scan_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def scan_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(100)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50)")
def scope_semi_join(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(50)
    return table(spark, d, "lineitem").join(ids, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 200")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderkey > 500").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(200)


@query("""SELECT o_orderkey, coalesce(c_name, 'unknown') AS name, c_custkey IS NULL AS missing FROM orders
LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey""")
def metadata_lookup(spark: SparkSession, d: str) -> DataFrame:
    known = load.first_by(table(spark, d, "customer").filter("c_custkey % 3 <> 0"), ["c_custkey"], F.col("c_name").desc())
    return table(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("name"), F.col("c_custkey").isNull().alias("missing"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("""WITH refs AS (SELECT vec_id AS chunk_id, 'c1' AS collection, vec_id * 7 AS point_id FROM embeddings WHERE vec_id % 2 = 0),
fresh AS (SELECT vec_id AS chunk_id, 'c1' AS collection, vec_id * 11 AS point_id FROM embeddings WHERE vec_id % 3 = 0)
SELECT coalesce(f.chunk_id, r.chunk_id) AS chunk_id, coalesce(f.collection, r.collection) AS collection, coalesce(f.point_id, r.point_id) AS point_id
FROM refs r FULL JOIN fresh f ON r.chunk_id = f.chunk_id AND r.collection = f.collection""")
def mark_indexed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    refs = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("chunk_id"), F.lit("c1").alias("collection"), (F.col("vec_id") * 7).alias("point_id"))
    fresh = e.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("chunk_id"), F.lit("c1").alias("collection"), (F.col("vec_id") * 11).alias("_p"))
    return refs.join(fresh, ["chunk_id", "collection"], "full_outer").select("chunk_id", "collection", F.coalesce("_p", "point_id").alias("point_id"))


@query("""SELECT doc_id, to_json({lang: lang, source: source}) AS payload, lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))) AS keyword FROM documents""")
def index_payload(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.to_json(F.struct("lang", "source")).alias("payload"), text.normalize_keyword(F.col("source")).alias("keyword"))


# Valid time.


@query(f"WITH {PERIODS} SELECT * FROM periods")
def derive_periods(spark: SparkSession, d: str) -> DataFrame:
    return periods(spark, d)


@query(f"WITH {PERIODS} SELECT * FROM periods WHERE {AT} AND status IN ('EFFECTIVE', 'PARTIALLY_EFFECTIVE')")
def as_of_filter(spark: SparkSession, d: str) -> DataFrame:
    return temporal.as_of(periods(spark, d), DAY)


@query(f"WITH {LEGAL} SELECT document_id, document_type FROM legal WHERE status IN ('EFFECTIVE', 'EXPIRED') AND (document_type IS NULL OR document_type NOT IN ('5-LOW'))")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return temporal.metadata_filter(legal(spark, d), ["5-LOW"], status=["EFFECTIVE", "EXPIRED", " "], owner=None).select("document_id", "document_type")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("owner").orderBy("effective_date", "document_id")
    x = legal(spark, d)
    until = F.lead("effective_date").over(w)
    return x.select(F.col("owner").alias("document_id"), F.col("document_id").alias("version_id"), F.row_number().over(w).cast("long").alias("version_number"), F.col("effective_date").alias("content_valid_from"), until.alias("content_valid_to"), until.isNull().alias("is_current"), F.col("document_type").alias("revision"))


VERSIONS = LEGAL + """, versions AS (
  SELECT owner AS document_id, document_id AS version_id, row_number() OVER w AS version_number, effective_date AS content_valid_from,
         lead(effective_date) OVER w AS content_valid_to, lead(effective_date) OVER w IS NULL AS is_current, document_type AS revision
  FROM legal WINDOW w AS (PARTITION BY owner ORDER BY effective_date, document_id))"""


@query(f"""WITH {VERSIONS} SELECT version_id, 'current' AS scope FROM versions WHERE is_current
UNION ALL SELECT version_id, 'historical' FROM versions WHERE content_valid_from <= DATE '1996-06-30' AND (content_valid_to IS NULL OR DATE '1996-06-30' < content_valid_to)
UNION ALL SELECT version_id, 'index' FROM versions WHERE content_valid_from IS NOT NULL""")
def version_scope(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d)
    parts = [temporal.version_scope(v, None).select("version_id", F.lit("current").alias("scope")), temporal.version_scope(v, DAY).select("version_id", F.lit("historical").alias("scope")), v.filter("content_valid_from IS NOT NULL").select("version_id", F.lit("index").alias("scope"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {PERIODS} SELECT document_id, l.price, p.status AS status_at, p.valid_from, p.valid_to FROM legal l JOIN periods p USING (document_id) WHERE {AT.replace('valid_', 'p.valid_')} AND p.status IN ('EFFECTIVE', 'PARTIALLY_EFFECTIVE')")
def effective_documents(spark: SparkSession, d: str) -> DataFrame:
    return temporal.effective_documents(legal(spark, d), periods(spark, d), DAY).select("document_id", "price", "status_at", "valid_from", "valid_to")


@query(f"""WITH {PERIODS}, {PROVISIONS} SELECT p.document_id, p.provision_key, coalesce(e.vec_id * 7, p.document_id) AS point_id
FROM provisions p JOIN legal l ON l.document_id = p.document_id JOIN periods s ON s.document_id = p.document_id LEFT JOIN embeddings e ON e.vec_id = p.document_id
WHERE {AT.replace('valid_', 's.valid_')} AND s.status IN ('EFFECTIVE', 'PARTIALLY_EFFECTIVE') AND l.document_type <> '5-LOW'""")
def allowed_points(spark: SparkSession, d: str) -> DataFrame:
    docs = temporal.metadata_filter(legal(spark, d), ["5-LOW"]).filter("document_type IS NOT NULL").select("document_id")
    refs = table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), (F.col("vec_id") * 7).alias("_p"))
    now = temporal.as_of(periods(spark, d), DAY).select("document_id")
    return provisions(spark, d).select("document_id", "provision_key").join(docs, "document_id").join(now, "document_id").join(refs, "document_id", "left").select("document_id", "provision_key", F.coalesce("_p", "document_id").alias("point_id"))


STATUS_RESOLUTION = f"""WITH {PERIODS}, {PROVISIONS}, held AS (SELECT * FROM provisions WHERE {AT}),
rows AS (SELECT p.document_id, p.provision_key, p.article, s.status AS doc_status, s.valid_from AS doc_from, s.valid_to AS doc_to FROM provisions p JOIN (SELECT * FROM periods WHERE {AT}) s USING (document_id))
SELECT r.document_id, r.provision_key, CASE WHEN own THEN s ELSE doc_status END AS status, CASE WHEN own THEN f ELSE doc_from END AS valid_from, CASE WHEN own THEN t ELSE doc_to END AS valid_to, CASE WHEN own THEN 'provision' ELSE 'document' END AS status_scope"""


@query(STATUS_RESOLUTION + " FROM (SELECT r.*, h.status AS s, h.valid_from AS f, h.valid_to AS t, h.status IS NOT NULL AND h.status <> 'UNKNOWN' AS own FROM rows r LEFT JOIN held h USING (document_id, provision_key)) r")
def status_resolution(spark: SparkSession, d: str) -> DataFrame:
    p = provisions(spark, d)
    held = periods(spark, d).filter(temporal.valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(DAY).cast("date"))).select("document_id", F.col("status").alias("doc_status"), F.col("valid_from").alias("doc_from"), F.col("valid_to").alias("doc_to"))
    rows = p.select("document_id", "provision_key").join(held, "document_id")
    return temporal.resolve_status(rows, p, DAY).select("document_id", "provision_key", "status", "valid_from", "valid_to", "status_scope")


@query(f"""WITH {PERIODS}, {PROVISIONS}, {DENSE}, ranked AS (SELECT query_id, point_id AS document_id, rank FROM dense WHERE rank <= 20)
SELECT k.query_id, k.rank, p.document_id, p.provision_key, coalesce(CASE WHEN p.status <> 'UNKNOWN' THEN p.status END, s.status) AS status, l.document_type, parent.provision_key AS parent_key, e.label AS vector_label
FROM ranked k JOIN provisions p USING (document_id) JOIN legal l USING (document_id) JOIN (SELECT * FROM periods WHERE {AT}) s USING (document_id)
LEFT JOIN provisions parent ON parent.document_id = p.document_id AND parent.article = p.article - 1 LEFT JOIN embeddings e ON e.vec_id = p.document_id""")
def hydrate_points(spark: SparkSession, d: str) -> DataFrame:
    """The points of the stated searches with their rows; ranks are those of the search."""
    e = table(spark, d, "embeddings")
    points = e.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))
    ranked = search.dense_top_k(points, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 20)
    ranked = ranked.select("query_id", F.col("point_id").alias("document_id"), "rank")
    p = provisions(spark, d).select("document_id", "article", "provision_key", F.col("status").alias("_own"))
    parent = p.select(F.col("document_id").alias("_d"), (F.col("article") + 1).alias("_a"), F.col("provision_key").alias("parent_key"))
    now = periods(spark, d).filter(temporal.valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(DAY).cast("date"))).select("document_id", F.col("status").alias("doc_status"))
    refs = e.select(F.col("vec_id").alias("document_id"), F.col("label").alias("vector_label"))
    out = ranked.join(p, "document_id").join(legal(spark, d).select("document_id", "document_type"), "document_id").join(now, "document_id").join(refs, "document_id", "left")
    out = out.join(parent, (F.col("document_id") == F.col("_d")) & (F.col("article") == F.col("_a")), "left")
    return out.select("query_id", "rank", "document_id", "provision_key", F.coalesce(F.when(F.col("_own") != "UNKNOWN", F.col("_own")), "doc_status").alias("status"), "document_type", "parent_key", "vector_label")


@query(f"WITH {PROVISIONS} SELECT DISTINCT document_id, provision_key, 'UNKNOWN' AS status FROM provisions JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') ON o_orderkey = document_id WHERE status = 'UNKNOWN' AND NOT EXISTS (SELECT 1 FROM provisions q WHERE q.document_id = provisions.document_id AND q.provision_key = provisions.provision_key AND q.status <> 'UNKNOWN')")
def provision_keys(spark: SparkSession, d: str) -> DataFrame:
    part = legal(spark, d).filter("status = 'PARTIALLY_EFFECTIVE'").select("document_id")
    p = provisions(spark, d)
    keys = p.join(part, "document_id", "left_semi").select("document_id", labels.provision_key(F.col("article").cast("string"), F.lit(""), F.lit(None)).alias("provision_key"), F.lit("UNKNOWN").alias("status")).distinct()
    return load.insert_if_absent(p.filter("status <> 'UNKNOWN'").select("document_id", "provision_key"), keys, ["document_id", "provision_key"])


@query(f"""WITH {PERIODS}, {PROVISIONS} SELECT count(*) AS provisions, count(*) FILTER (WHERE s.document_id IS NOT NULL) AS covered, count(*) FILTER (WHERE p.status = 'UNKNOWN') AS unknown,
round(count(*) FILTER (WHERE s.document_id IS NOT NULL) / count(*), 6) AS coverage
FROM provisions p LEFT JOIN (SELECT DISTINCT document_id FROM periods WHERE {AT}) s USING (document_id)""")
def provision_coverage(spark: SparkSession, d: str) -> DataFrame:
    now = periods(spark, d).filter(temporal.valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(DAY).cast("date"))).select("document_id").distinct().withColumn("_in", F.lit(True))
    x = provisions(spark, d).join(now, "document_id", "left")
    return x.agg(F.count(F.lit(1)).alias("provisions"), F.count("_in").alias("covered"), F.count_if(F.col("status") == "UNKNOWN").alias("unknown"), F.round(F.try_divide(F.count("_in"), F.count(F.lit(1))), 6).alias("coverage"))


# Loads.


@query(f"""WITH {LEGAL}, t AS (SELECT document_id, document_type AS title, price, document_id % 4 = 0 AS trusted FROM legal WHERE document_id % 3 <> 0),
s AS (SELECT document_id, 'new ' || document_type AS title, price + 1 AS price FROM legal WHERE document_id % 2 = 0)
SELECT coalesce(t.document_id, s.document_id) AS document_id, CASE WHEN t.trusted OR s.document_id IS NULL THEN t.title ELSE s.title END AS title,
CASE WHEN t.trusted OR s.document_id IS NULL THEN t.price ELSE s.price END AS price, coalesce(t.trusted, false) AS trusted FROM t FULL JOIN s ON t.document_id = s.document_id""")
def guarded_upsert(spark: SparkSession, d: str) -> DataFrame:
    x = legal(spark, d)
    t = x.filter("document_id % 3 <> 0").select("document_id", F.col("document_type").alias("title"), "price", (F.col("document_id") % 4 == 0).alias("trusted"))
    s = x.filter("document_id % 2 = 0").select("document_id", F.concat(F.lit("new "), "document_type").alias("title"), (F.col("price") + 1).alias("price"))
    return load.guarded_upsert(t, s, "document_id", "trusted")


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderstatus AS a, o_orderpriority AS b FROM orders)
SELECT id, CASE WHEN id % 2 = 0 THEN 'new' ELSE a END AS a, b, CASE WHEN id % 2 = 0 THEN 'yes' END AS c FROM t""")
def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    left = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.col("o_orderpriority"))
    right = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("yes")))
    merged = o.select(F.col("o_orderkey").alias("id"), load.merge_maps(left, right).alias("m"))
    return merged.select("id", *(F.element_at("m", k).alias(k) for k in "abc"))


@query(f"""WITH {VERSIONS} SELECT coalesce(o.version_id, n.version_id) AS version_id, coalesce(o.version_number, n.version_number) AS version_number,
coalesce(o.content_valid_to, n.content_valid_to) AS content_valid_to, coalesce(o.is_current, false) OR coalesce(n.is_current, false) AS is_current
FROM (SELECT version_id, version_number, NULL::DATE AS content_valid_to, false AS is_current FROM versions WHERE version_id % 3 <> 0) o
FULL JOIN (SELECT version_id, version_number + 10 AS version_number, content_valid_to, is_current FROM versions WHERE version_id % 2 = 0) n ON o.version_id = n.version_id""")
def version_upsert(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d)
    old = v.filter("version_id % 3 <> 0").select("version_id", "version_number", F.lit(None).cast("date").alias("content_valid_to"), F.lit(False).alias("is_current"))
    new = v.filter("version_id % 2 = 0").select("version_id", (F.col("version_number") + 10).alias("version_number"), "content_valid_to", "is_current")
    return load.upsert_versions(old, new, ["version_id"])


@query(f"""WITH {VERSIONS}, old AS (SELECT document_id, max(version_number) AS top FROM versions WHERE version_number <= 3 GROUP BY 1),
new AS (SELECT document_id, sha256(version_id::VARCHAR) AS content_hash, CASE WHEN version_id % 4 <> 0 THEN content_valid_from END AS content_valid_from FROM versions WHERE version_number > 3)
SELECT document_id, content_hash, content_valid_from, coalesce(top, 0) + row_number() OVER (PARTITION BY document_id ORDER BY content_valid_from NULLS LAST, content_hash) AS version_number FROM new LEFT JOIN old USING (document_id)""")
def version_assign(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d)
    new = v.filter("version_number > 3").select("document_id", F.sha2(F.col("version_id").cast("string"), 256).alias("content_hash"), F.when(F.col("version_id") % 4 != 0, F.col("content_valid_from")).alias("content_valid_from"))
    return load.assign_versions(v.filter("version_number <= 3"), new)


@query(f"WITH {VERSIONS} SELECT version_id, is_current AND NOT (document_id % 2 = 0) AS is_current FROM versions")
def version_deactivate(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d).withColumn("content_hash", F.sha2(F.col("version_id").cast("string"), 256))
    fresh = v.filter("document_id % 2 = 0").groupBy("document_id").agg(F.lit("other").alias("_hash"))
    joined = v.join(fresh, "document_id", "left")
    return joined.select("version_id", F.when(F.col("_hash").isNotNull() & (F.col("_hash") != F.col("content_hash")), False).otherwise(F.col("is_current")).alias("is_current"))


@query(f"""WITH {VERSIONS}, c AS (SELECT version_id AS chunk_id, document_id, CASE WHEN version_id % 2 = 0 THEN revision END AS revision FROM versions)
SELECT c.chunk_id, c.document_id, v.version_id FROM c JOIN versions v ON c.document_id = v.document_id AND ((c.revision IS NOT NULL AND v.revision = c.revision) OR (c.revision IS NULL AND v.is_current))""")
def chunk_version_join(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d)
    c = v.select(F.col("version_id").alias("chunk_id"), "document_id", F.when(F.col("version_id") % 2 == 0, F.col("revision")).alias("revision"))
    return load.resolve_chunk_versions(c, v)


OFFICIAL = """official AS (SELECT document_id, 'SUSPENDED' AS status, valid_from + 30 AS valid_from, valid_to, 'official' AS reason, document_id % 2 = 0 AS is_official FROM (SELECT * FROM periods WHERE document_id % 5 = 0))"""


@query(f"""WITH {PERIODS}, {OFFICIAL} SELECT document_id, status, valid_from, valid_to, reason FROM official WHERE is_official
UNION ALL SELECT document_id, status, valid_from, valid_to, reason FROM periods p WHERE NOT EXISTS (SELECT 1 FROM official o WHERE is_official AND o.document_id = p.document_id
AND p.valid_from < coalesce(o.valid_to, DATE '9999-12-31') AND o.valid_from < coalesce(p.valid_to, DATE '9999-12-31'))""")
def status_replace_anti(spark: SparkSession, d: str) -> DataFrame:
    p = periods(spark, d).select("document_id", "status", "valid_from", "valid_to", "reason")
    official = p.filter("document_id % 5 = 0").select("document_id", F.lit("SUSPENDED").alias("status"), F.date_add("valid_from", 30).alias("valid_from"), "valid_to", F.lit("official").alias("reason"))
    return load.replace_unless_overlapped(official, p, F.col("document_id") % 2 == 0)


@query(f"""WITH {PERIODS}, {OFFICIAL} SELECT p.document_id, p.status, p.valid_from FROM periods p WHERE NOT EXISTS (SELECT 1 FROM official o WHERE o.document_id = p.document_id
AND p.valid_from < coalesce(o.valid_to, DATE '9999-12-31') AND o.valid_from < coalesce(p.valid_to, DATE '9999-12-31'))""")
def trusted_overlap_delete(spark: SparkSession, d: str) -> DataFrame:
    p = periods(spark, d).select("document_id", "status", "valid_from", "valid_to")
    trusted = p.filter("document_id % 5 = 0").withColumn("valid_from", F.date_add("valid_from", 30))
    kept = load.replace_unless_overlapped(trusted, p, F.lit(True))
    return load.insert_if_absent(trusted, kept, trusted.columns).select("document_id", "status", "valid_from")


@query(f"WITH {PERIODS} SELECT document_id, status, valid_from, valid_to FROM periods p WHERE NOT EXISTS (SELECT 1 FROM periods q WHERE q.document_id % 2 = 0 AND q.document_id = p.document_id AND q.status = p.status AND q.valid_from = p.valid_from AND q.valid_to IS NOT DISTINCT FROM p.valid_to)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    p = periods(spark, d).select("document_id", "status", "valid_from", "valid_to")
    return load.insert_if_absent(p.filter("document_id % 2 = 0"), periods(spark, d).select(*p.columns), p.columns)


@query(f"WITH {CHUNKS}, keep AS (SELECT chunk_id FROM chunks WHERE doc_id % 7 <> 0) SELECT chunk_id, chunk_id NOT IN (SELECT chunk_id FROM keep) AS stale FROM chunks")
def stale_generation(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("chunk_id", "doc_id")
    fresh = c.filter("doc_id % 7 <> 0").select("chunk_id", F.lit(False).alias("_stale"))
    return c.join(fresh, "chunk_id", "left").select("chunk_id", F.coalesce("_stale", F.lit(True)).alias("stale"))


@query(f"WITH {CHUNKS} SELECT c.chunk_id, p.chunk_id AS parent_id FROM chunks c LEFT JOIN chunks p ON p.doc_id = c.doc_id AND p.ordinal = c.ordinal - 1")
def parent_resolve(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).select("chunk_id", "doc_id", "ordinal")
    p = c.select(F.col("chunk_id").alias("parent_id"), "doc_id", (F.col("ordinal") + 1).alias("ordinal"))
    return c.join(p, ["doc_id", "ordinal"], "left").select("chunk_id", "parent_id")


@query("SELECT l_partkey AS article, l_orderkey AS document_id, l_linenumber AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'A' DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def article_dedupe(spark: SparkSession, d: str) -> DataFrame:
    x = load.first_by(table(spark, d, "lineitem"), ["l_partkey"], (F.col("l_returnflag") == "A").desc(), F.col("l_orderkey"), F.col("l_linenumber"))
    return x.select(F.col("l_partkey").alias("article"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ordinal"))


@query(f"""WITH {EDGES}, e AS (SELECT *, row_number() OVER (PARTITION BY owner, relation ORDER BY source_id) AS rn FROM edges)
SELECT source_id, relation, target_id, l.document_id AS resolved_id FROM e LEFT JOIN (SELECT document_id FROM legal WHERE status <> 'EXPIRED') l ON l.document_id = target_id WHERE rn = 1""")
def relationship_load(spark: SparkSession, d: str) -> DataFrame:
    e = load.first_by(edges(spark, d), ["owner", "relation"], F.col("source_id"))
    known = legal(spark, d).filter("status <> 'EXPIRED'").select(F.col("document_id").alias("resolved_id"))
    return e.join(known, F.col("target_id") == F.col("resolved_id"), "left").select("source_id", "relation", "target_id", "resolved_id")


@query(f"""WITH {LEGAL} SELECT document_id, CASE WHEN document_id % 6 = 0 THEN status || '!' ELSE status END AS status, CASE WHEN document_id % 9 = 0 THEN 'insert' ELSE 'update' END AS action FROM legal WHERE document_id % 6 = 0 OR document_id % 9 = 0""")
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    x = legal(spark, d).select("document_id", "status")
    new = x.withColumn("status", F.when(F.col("document_id") % 6 == 0, F.concat("status", F.lit("!"))).otherwise(F.col("status")))
    return load.changed_rows(x.filter("document_id % 9 <> 0"), new, "document_id", ["status"])


@query("SELECT o_orderkey AS k FROM orders UNION SELECT l_orderkey FROM lineitem")
def scope_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).unionByName(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))).distinct()


@query(f"WITH {VERSIONS} SELECT version_id, max(revision) OVER (PARTITION BY document_id) AS tag FROM versions")
def latest_version_tag(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d)
    return v.join(v.groupBy("document_id").agg(F.max("revision").alias("tag")), "document_id").select("version_id", "tag")


@query(f"WITH {EDGES} SELECT source_id, target_id, CASE WHEN source_id % 2 = 0 THEN valid_from ELSE coalesce(l.effective_date, valid_from) END AS dated_from, source_id % 3 = 0 AS is_trusted FROM edges LEFT JOIN legal l ON l.document_id = source_id")
def edge_dating(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).withColumn("_own", F.when(F.col("source_id") % 2 == 0, F.col("valid_from")))
    dates = legal(spark, d).select(F.col("document_id").alias("source_id"), "effective_date")
    return e.join(dates, "source_id", "left").select("source_id", "target_id", F.coalesce("_own", "effective_date", "valid_from").alias("dated_from"), (F.col("source_id") % 3 == 0).alias("is_trusted"))


@query(f"WITH {EDGES} SELECT sha256(concat_ws('|', source_id::VARCHAR, target_id::VARCHAR, relation)) AS event_key, relation AS event_type, valid_from AS event_date FROM edges WHERE relation IN ('REPLACES', 'REPEALS', 'AMENDS', 'SUPPLEMENTS')")
def amendment_events(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).filter(F.col("relation").isin("REPLACES", "REPEALS", "AMENDS", "SUPPLEMENTS"))
    return e.select(F.sha2(F.concat_ws("|", F.col("source_id").cast("string"), F.col("target_id").cast("string"), "relation"), 256).alias("event_key"), F.col("relation").alias("event_type"), F.col("valid_from").alias("event_date"))


# Constraints as violation queries.


@query(f"""WITH {PROVISIONS}, x AS (SELECT *, max(coalesce(valid_to, DATE '9999-12-31')) OVER (PARTITION BY document_id ORDER BY valid_from, provision_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM provisions)
SELECT document_id, provision_key, valid_from FROM x WHERE valid_from < reach""")
def overlap_violations(spark: SparkSession, d: str) -> DataFrame:
    return temporal.overlap_violations(provisions(spark, d), ["document_id"], "provision_key").select("document_id", "provision_key", "valid_from")


@query("SELECT l_partkey AS k, l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness_violations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("""SELECT o_orderkey AS id, 'date_order' AS rule FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING max(l_shipdate) < max(o_orderdate)
UNION ALL SELECT o_orderkey, 'enum' FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT c_custkey, 'range' FROM customer WHERE NOT (c_acctbal BETWEEN 0 AND 9000)""")
def check_violations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    last = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("_last"))
    dates = o.join(last, "o_orderkey").filter("_last < o_orderdate").select(F.col("o_orderkey").alias("id"), F.lit("date_order").alias("rule"))
    enum = o.filter(~F.col("o_orderstatus").isin("F", "O")).select(F.col("o_orderkey").alias("id"), F.lit("enum").alias("rule"))
    value = table(spark, d, "customer").filter(~F.col("c_acctbal").between(0, 9000)).select(F.col("c_custkey").alias("id"), F.lit("range").alias("rule"))
    return dates.unionByName(enum).unionByName(value)


@query(f"""WITH {CHUNKS} SELECT chunk_id, 'over_limit' AS problem FROM chunks WHERE tokens > 120 UNION ALL SELECT chunk_id, 'duplicate' FROM chunks GROUP BY chunk_id HAVING count(*) > 1
UNION ALL SELECT c.chunk_id, 'orphan' FROM chunks c WHERE ordinal > 0 AND NOT EXISTS (SELECT 1 FROM chunks p WHERE p.doc_id = c.doc_id AND p.ordinal = c.ordinal - 1)""")
def chunk_integrity(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    over = c.filter("tokens > 120").select("chunk_id", F.lit("over_limit").alias("problem"))
    twice = c.groupBy("chunk_id").count().filter("count > 1").select("chunk_id", F.lit("duplicate").alias("problem"))
    parent = c.select("doc_id", (F.col("ordinal") + 1).alias("ordinal"))
    orphan = c.filter("ordinal > 0").join(parent, ["doc_id", "ordinal"], "left_anti").select("chunk_id", F.lit("orphan").alias("problem"))
    return over.unionByName(twice).unionByName(orphan)


@query(f"WITH {CHUNKS} SELECT c.chunk_id FROM chunks c JOIN documents t ON t.doc_id = c.doc_id WHERE c.tokens > 5 GROUP BY c.chunk_id HAVING NOT bool_or(contains(lower(t.text), c.text))")
def content_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).filter("tokens > 5").select("chunk_id", "doc_id", "text")
    whole = table(spark, d, "documents").select("doc_id", F.lower("text").alias("_t"))
    return c.join(whole, "doc_id").groupBy("chunk_id").agg(F.bool_or(F.expr("contains(_t, text)")).alias("ok")).filter("NOT ok").select("chunk_id")


# Keys and labels.

def _pick(column: str, cases: dict[str, str | None], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {'NULL' if v is None else repr(v)}" for k, v in cases.items()) + f" ELSE {otherwise!r} END"


@query("SELECT o_orderkey AS id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'EFFECTIVE' WHEN '2' THEN 'EXPIRED' WHEN '3' THEN 'PARTIALLY_EFFECTIVE' WHEN '4' THEN CASE o_orderstatus WHEN 'F' THEN 'SUSPENDED' WHEN 'O' THEN 'NOT_YET_EFFECTIVE' ELSE 'PARTIALLY_EFFECTIVE' END ELSE 'UNKNOWN' END AS status FROM orders")
def status_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Labels as sources write them, picked by the priority and status of orders."""
    urgent = _pick("substring(o_orderpriority, 1, 1)", {"1": "Còn hiệu lực", "2": " Hết hiệu lực  toàn bộ ", "3": "hết hiệu lực MỘT phần"}, "")
    fourth = _pick("o_orderstatus", {"F": "Ngưng hiệu lực", "O": "Chưa có\thiệu lực"}, "ngưng hiệu lực một phần")
    fifth = _pick("o_orderstatus", {"F": None, "O": "khác"}, "Chưa xác định")
    label = F.expr(f"CASE WHEN o_orderpriority LIKE '4%' THEN {fourth} WHEN o_orderpriority LIKE '5%' THEN {fifth} ELSE {urgent} END")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), labels.legal_status(label).alias("status"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'REPLACES' WHEN 'AO' THEN 'REPEALS' WHEN 'NF' THEN 'AMENDS' WHEN 'NO' THEN 'CITES' WHEN 'RF' THEN 'SUPPLEMENTS' ELSE 'RELATED_TO' END AS relation FROM lineitem")
def relationship_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Labels as sources write them, picked by the flags of order items."""
    label = F.expr(_pick("concat(l_returnflag, l_linestatus)", {"AF": "Thay thế", "AO": "bãi bỏ", "NF": " Sửa đổi,  bổ sung", "NO": "Căn cứ", "RF": "VĂN BẢN bổ sung"}, "x"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), labels.relation_type(label).alias("relation"))


@query("""SELECT o_orderkey AS id, o_orderdate::DATE AS day FROM orders""")
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("_d", F.col("o_orderdate").cast("date"))
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("_d", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("_d", "yyyy-MM-dd")).otherwise(F.date_format("_d", "d-M-yyyy"))
    return o.select(F.col("o_orderkey").alias("id"), labels.parse_date(form).alias("day"))


@query("""SELECT o_orderkey AS id, 'part=' || o_orderstatus || '|chapter=' || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE o_orderpriority END || '|section=-|appendix=-|article=' || o_custkey AS key FROM orders""")
def article_key(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    path = F.map_filter(F.create_map(F.lit("part"), F.col("o_orderstatus"), F.lit("chapter"), F.when(F.col("o_orderkey") % 2 != 0, F.col("o_orderpriority"))), lambda k, v: v.isNotNull())
    return o.select(F.col("o_orderkey").alias("id"), labels.article_key(path, F.col("o_custkey").cast("string")).alias("key"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT c_custkey AS id, regexp_replace(lower(replace(c_name, '#', ' – ')), '\\s+', '', 'g').replace('–', '-') AS identifier FROM customer")
def normalize_identifier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.normalize_identifier(F.replace("c_name", F.lit("#"), F.lit(" – "))).alias("identifier"))


@query("""SELECT p_partkey AS id, nullif(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), '') AS title, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS metadata, 'v1' AS loader FROM part""")
def normalize_documents(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), text.collapse(F.col("p_name")).alias("title"), F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("metadata"), F.lit("v1").alias("loader"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.' || json_keys(props)[1]), props) AS value, json_valid(props) AS ok FROM events")
def json_tolerant(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    first = F.get(F.json_object_keys("props"), 0)
    return e.select("event_id", F.coalesce(F.element_at(F.from_json("props", "map<string,string>"), first), "props").alias("value"), F.expr("try_parse_json(props) IS NOT NULL").alias("ok"))


@query("""SELECT c_custkey AS id, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_mktsegment END), ''), c_name) AS value FROM customer""")
def metadata_coalesce(spark: SparkSession, d: str) -> DataFrame:
    first = F.when(F.col("c_custkey") % 2 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.coalesce(text.collapse(first), text.collapse(F.col("c_name"))).alias("value"))
