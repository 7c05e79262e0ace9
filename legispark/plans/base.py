"""Registering queries with their SQL twins, and how tables play the roles of the domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legispark.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under the function's name, with the DuckDB SQL of the same result."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legal(spark: SparkSession, d: str) -> DataFrame:
    """Documents with dates and a status, from orders and their items."""
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("_last"))
    o = table(spark, d, "orders")
    start = F.col("o_orderdate").cast("date")
    status = F.when(F.col("o_orderstatus") == "F", "EXPIRED").when(F.col("o_orderstatus") == "O", "EFFECTIVE").otherwise("PARTIALLY_EFFECTIVE")
    return o.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("owner"), start.alias("effective_date"), F.when(F.col("_last") > start, F.col("_last")).alias("expiry_date"), status.alias("status"), F.col("o_orderpriority").alias("document_type"), F.round("o_totalprice", 2).alias("price"))


LEGAL = """legal AS (
  SELECT o_orderkey AS document_id, o_custkey AS owner, o_orderdate::DATE AS effective_date,
         CASE WHEN last > o_orderdate::DATE THEN last END AS expiry_date,
         CASE o_orderstatus WHEN 'F' THEN 'EXPIRED' WHEN 'O' THEN 'EFFECTIVE' ELSE 'PARTIALLY_EFFECTIVE' END AS status,
         o_orderpriority AS document_type, round(o_totalprice, 2) AS price
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate)::DATE AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def periods(spark: SparkSession, d: str) -> DataFrame:
    from legispark.functions.labels import effective_periods

    x = legal(spark, d)
    each = F.inline(effective_periods(F.col("status"), F.lit(None).cast("date"), F.col("effective_date"), F.col("expiry_date")))
    return x.select("document_id", "owner", "document_type", each)


PERIODS = LEGAL + """, periods AS (
  SELECT document_id, owner, document_type, 'EFFECTIVE' AS status, effective_date AS valid_from, expiry_date AS valid_to, 'derived_from_effective_and_expiry_dates' AS reason FROM legal WHERE status = 'EXPIRED' AND expiry_date IS NOT NULL
  UNION ALL SELECT document_id, owner, document_type, 'EXPIRED', expiry_date, NULL, 'derived_from_source_expiry_status' FROM legal WHERE status = 'EXPIRED' AND expiry_date IS NOT NULL
  UNION ALL SELECT document_id, owner, document_type, 'UNKNOWN', effective_date, NULL, 'expiry_transition_date_missing' FROM legal WHERE status = 'EXPIRED' AND expiry_date IS NULL
  UNION ALL SELECT document_id, owner, document_type, status, effective_date, expiry_date, 'derived_from_source_snapshot' FROM legal WHERE status <> 'EXPIRED')"""


def provisions(spark: SparkSession, d: str) -> DataFrame:
    """Provisions with a status of their own, from order items."""
    li = table(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "SUSPENDED").when(F.col("l_returnflag") == "A", "EFFECTIVE").otherwise("UNKNOWN")
    start = F.col("l_shipdate").cast("date")
    return li.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("article"), F.concat(F.lit("article:"), F.col("l_linenumber").cast("string"), F.lit("/clause:/point:")).alias("provision_key"), status.alias("status"), start.alias("valid_from"), F.when(F.col("l_linestatus") == "F", F.date_add(start, 365)).alias("valid_to"))


PROVISIONS = """provisions AS (
  SELECT l_orderkey AS document_id, l_linenumber::BIGINT AS article, 'article:' || l_linenumber || '/clause:/point:' AS provision_key,
         CASE l_returnflag WHEN 'R' THEN 'SUSPENDED' WHEN 'A' THEN 'EFFECTIVE' ELSE 'UNKNOWN' END AS status,
         l_shipdate::DATE AS valid_from, CASE WHEN l_linestatus = 'F' THEN (l_shipdate::DATE + 365) END AS valid_to FROM lineitem)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Typed, dated edges: each order of a customer relates to the one before."""
    from pyspark.sql import Window

    x = legal(spark, d)
    w = Window.partitionBy("owner").orderBy("effective_date", "document_id")
    kind = F.when(F.col("document_type").startswith("1"), "REPLACES").when(F.col("document_type").startswith("2"), "REPEALS").when(F.col("document_type").startswith("3"), "AMENDS").otherwise("CITES")
    return x.select(F.col("document_id").alias("source_id"), F.lag("document_id").over(w).alias("target_id"), kind.alias("relation"), F.col("effective_date").alias("valid_from"), F.col("expiry_date").alias("valid_to"), "owner").filter("target_id IS NOT NULL")


EDGES = LEGAL + """, edges AS (
  SELECT * FROM (SELECT document_id AS source_id, lag(document_id) OVER (PARTITION BY owner ORDER BY effective_date, document_id) AS target_id,
         CASE left(document_type, 1) WHEN '1' THEN 'REPLACES' WHEN '2' THEN 'REPEALS' WHEN '3' THEN 'AMENDS' ELSE 'CITES' END AS relation,
         effective_date AS valid_from, expiry_date AS valid_to, owner FROM legal) WHERE target_id IS NOT NULL)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of the documents as chunks."""
    from legispark.functions.text import token_count

    x = table(spark, d, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("_i", "text")).filter(F.trim("text") != "")
    return x.select(F.concat_ws("::", F.col("doc_id").cast("string"), F.col("_i").cast("string")).alias("chunk_id"), "doc_id", F.col("_i").cast("long").alias("ordinal"), "lang", "source", "text", token_count(F.col("text")).alias("tokens"))


CHUNKS = """chunks AS (
  SELECT doc_id || '::' || ordinal AS chunk_id, doc_id, ordinal, lang, source, text, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'))::BIGINT AS tokens
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS ordinal FROM documents) WHERE trim(text) <> '')"""
