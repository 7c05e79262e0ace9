"""One-hop expansion over typed, dated edges, roles and seed scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legispark.functions.text import significant_tokens

# What a related document is to the one asked for, by direction and type.
ROLES = {
    ("incoming", "REPLACES"): "current_authority",
    ("incoming", "REPEALS"): "repealing_document",
    ("incoming", "AMENDS"): "amending_document",
    ("incoming", "SUPPLEMENTS"): "supplementing_document",
    ("incoming", "GUIDES"): "guidance_document",
    ("outgoing", "REPLACES"): "replaced_document",
    ("outgoing", "REPEALS"): "repealed_document",
    ("outgoing", "AMENDS"): "amended_document",
    ("outgoing", "SUPPLEMENTS"): "supplemented_document",
    ("outgoing", "GUIDES"): "guided_document",
}


def expand(edges: DataFrame, documents: DataFrame, seeds: DataFrame, day: str, types: Sequence[str] | None = None, direction: str | None = None) -> DataFrame:
    """Documents one edge away from the seeds, over edges that hold on a day (open at either end)."""
    on = F.lit(day).cast("date")
    live = edges.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= on)) & (F.col("valid_to").isNull() | (on < F.col("valid_to"))))
    if types:
        live = live.filter(F.col("relation").isin(*types))
    into = live.select(F.col("target_id").alias("seed_id"), F.col("source_id").alias("document_id"), "relation", F.lit("incoming").alias("direction"))
    out = live.select(F.col("source_id").alias("seed_id"), F.col("target_id").alias("document_id"), "relation", F.lit("outgoing").alias("direction"))
    hops = into if direction == "incoming" else out if direction == "outgoing" else into.unionByName(out)
    wanted = seeds.select(F.col("document_id").alias("seed_id")).distinct()
    return hops.join(wanted, "seed_id").join(documents, "document_id")


def role(direction: Column, relation: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for (a, b), r in ROLES.items() for x in (f"{a}/{b}", r)))
    return F.coalesce(F.element_at(pairs, F.concat_ws("/", direction, relation)), F.lit("related_document"))


def edge_source(edge_url: Column, document_url: Column, official: Column, trusted: Column) -> Column:
    """struct(url, trusted): the edge's own address before that of its document; official edges are trusted."""
    present = lambda u: F.nullif(F.trim(u), F.lit(""))
    return F.struct(F.coalesce(present(edge_url), present(document_url)).alias("url"), (F.coalesce(official, F.lit(False)) | F.coalesce(trusted, F.lit(False))).alias("trusted"))


def graph_evidence(edges: DataFrame, by: str, *order: Column, most: int = 2) -> DataFrame:
    """The first edges of each group that are trusted and have an address, as evidence G1, G2."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return edges.filter(F.col("trusted") & F.col("url").isNotNull()).withColumn("_n", n).filter(F.col("_n") <= most).withColumn("evidence_id", F.concat(F.lit("G"), F.col("_n").cast("string"))).drop("_n")


def seed_score(query: str, *, authority: Column, kind: Column, title: Column, year: Column, status: Column, preferred: Sequence[str]) -> Column:
    """100 for the number, up to 20 for the authority, 15 for the type, 10 for the year, up to 10 for the title, 5 for the status."""
    asked = significant_tokens(F.lit(query))

    def share(value: Column, points: float) -> Column:
        tokens = significant_tokens(value)
        return F.when(F.size(F.array_intersect(asked, tokens)) > 0, F.lit(points) * F.size(F.array_intersect(asked, tokens)) / F.greatest(F.lit(1), F.size(tokens))).otherwise(0.0)

    whole = significant_tokens(kind.cast("string"))
    typed = F.when((F.size(whole) > 0) & (F.size(F.array_except(whole, asked)) == 0), 15.0).otherwise(0.0)
    return F.lit(100.0) + share(authority, 20.0) + typed + F.when(F.position(year.cast("string"), F.lit(query)) > 0, 10.0).otherwise(0.0) + share(title.cast("string"), 10.0) + F.when(status.isin(*preferred), 5.0).otherwise(0.0)

