"""Loads: guarded upserts, idempotent inserts, versions and replacements. Each takes and returns DataFrames; a table is replaced by writing the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded_upsert(target: DataFrame, source: DataFrame, key: str, trusted: str, merged: str | None = None) -> DataFrame:
    """Full outer join by key: a trusted target row keeps its values, others take the source's; ``merged`` (a map) is merged with the source winning."""
    old, new = target.alias("o"), source.alias("n")
    columns = []
    for c in target.columns:
        if c == key:
            columns.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c == trusted:
            columns.append(F.coalesce(F.col(f"o.{c}"), F.lit(False)).alias(c))
        elif c == merged:
            columns.append(merge_maps(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            columns.append(F.when(F.col(f"o.{trusted}") | F.col(f"n.{key}").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins."""
    empty = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(left, empty), F.coalesce(right, empty)
    kept = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


def upsert_versions(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null columns are filled from the source, is_current is true if either side says so."""
    old, new = target.alias("o"), source.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    pick = [(F.coalesce(F.col("o.is_current"), F.lit(False)) | F.coalesce(F.col("n.is_current"), F.lit(False))).alias(c) if c == "is_current" else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in target.columns]
    return old.join(new, on, "full_outer").select(*pick)


def assign_versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Numbers new versions of each document after its greatest number, by content start (nulls last), then hash."""
    top = existing.groupBy("document_id").agg(F.max("version_number").alias("_top"))
    order = Window.partitionBy("document_id").orderBy(F.col("content_valid_from").asc_nulls_last(), "content_hash")
    numbered = incoming.withColumn("_n", F.row_number().over(order)).join(top, "document_id", "left")
    return numbered.withColumn("version_number", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("long")).drop("_n", "_top")


def replace_unless_overlapped(target: DataFrame, source: DataFrame, protected: Column) -> DataFrame:
    """Source periods that overlap no protected target period of their document, together with the protected ones."""
    kept = target.filter(protected)
    t, far = kept.alias("t"), F.lit("9999-12-31").cast("date")
    overlap = (F.col("s.document_id") == F.col("t.document_id")) & (F.col("s.valid_from") < F.coalesce("t.valid_to", far)) & (F.col("t.valid_from") < F.coalesce("s.valid_to", far))
    return kept.unionByName(source.alias("s").join(t, overlap, "left_anti").select(*kept.columns))


def insert_if_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows without an equal target row; nulls are equal to nulls."""
    on = [source[k].eqNullSafe(target[k]) for k in keys]
    return source.join(target, on, "left_anti")


def changed_rows(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Source rows that are new or differ from the target in a column, with what happens to them."""
    old, new = target.alias("o"), source.alias("n")
    differs = ~F.col(f"o.{columns[0]}").eqNullSafe(F.col(f"n.{columns[0]}"))
    for c in columns[1:]:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    missing = F.col(f"o.{key}").isNull()
    joined = new.join(old, F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    return joined.filter(missing | differs).select("n.*", F.when(missing, "insert").otherwise("update").alias("action"))


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first in a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def resolve_chunk_versions(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Each chunk with its version: by revision where it names one, else the current one. Two equi-joins, since a disjunction would need a nested loop."""
    named = chunks.filter("revision IS NOT NULL").join(versions.select("document_id", "revision", "version_id"), ["document_id", "revision"])
    current = chunks.filter("revision IS NULL").join(versions.filter("is_current").select("document_id", "version_id"), "document_id")
    return named.select("chunk_id", "document_id", "version_id").unionByName(current.select("chunk_id", "document_id", "version_id"))
