"""Approximate nearest neighbours by random hyperplanes: every row is indexed, candidates are scored exactly."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legispark.operators.search import dot, l2_normalize, small, top_k


def signature(vector: Column, bits: int, table: int, dimension: int) -> Column:
    """The signs of the products with ``bits`` fixed random vectors, as a number."""
    rng = random.Random(977 * table + 13)
    out = F.lit(0).cast("long")
    for k in range(bits):
        plane = F.array(*(F.lit(rng.gauss(0, 1)) for _ in range(dimension)))
        out = out + F.when(dot(vector, plane) > 0, 1 << k).otherwise(0)
    return out


def hyperplane_search(points: DataFrame, queries: DataFrame, k: int, bits: int = 5, tables: int = 8, dimension: int = 64) -> DataFrame:
    """(query_id, point_id, score, rank). Queries probe their own bucket and those one bit away in each table."""
    p = points.select("point_id", l2_normalize(F.col("vector")).alias("_p")).filter("_p IS NOT NULL")
    q = queries.select("query_id", l2_normalize(F.col("vector")).alias("_q")).filter("_q IS NOT NULL")
    keys = lambda v: F.array(*(F.struct(F.lit(t).alias("t"), signature(F.col(v), bits, t, dimension).alias("b")) for t in range(tables)))
    index = p.select("point_id", F.inline(keys("_p")))
    probes = q.select("query_id", F.inline(keys("_q"))).select("query_id", "t", F.explode(F.array(F.col("b"), *(F.col("b").bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(bits)))).alias("b"))
    pairs = index.join(small(probes), ["t", "b"]).select("query_id", "point_id").distinct()
    scored = pairs.join(p, "point_id").join(small(q), "query_id").select("query_id", "point_id", F.round(dot(F.col("_q"), F.col("_p")), 6).alias("score"))
    return top_k(scored, k, F.desc("score"), F.col("point_id"))
