"""Valid-time predicates and joins. A period is half-open; an open end is null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legispark.functions.labels import ACTIVE


def valid_at(valid_from: Column, valid_to: Column, day: Column) -> Column:
    return (valid_from <= day) & (valid_to.isNull() | (day < valid_to))


def as_of(periods: DataFrame, day: str, statuses: Sequence[str] = ACTIVE) -> DataFrame:
    """Periods that hold on a day with one of the statuses."""
    if not statuses:
        raise ValueError("statuses must not be empty")
    return periods.filter(valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(day).cast("date")) & F.col("status").isin(*statuses))


def metadata_filter(documents: DataFrame, excluded_types: Sequence[str] = (), **allowed: Sequence[str] | None) -> DataFrame:
    """Documents whose columns are in the given lists. An absent list is no filter, blanks are dropped, an excluded type lets nulls pass."""
    for name, values in allowed.items():
        values = [v for v in values or [] if not isinstance(v, str) or v.strip()]
        if values:
            documents = documents.filter(F.col(name).isin(*values))
    if excluded_types:
        documents = documents.filter(F.col("document_type").isNull() | ~F.col("document_type").isin(*excluded_types))
    return documents


def version_scope(versions: DataFrame, day: str | None) -> DataFrame:
    """Current versions, or those whose content period holds on a day."""
    if day is None:
        return versions.filter("is_current")
    return versions.filter(valid_at(F.col("content_valid_from"), F.col("content_valid_to"), F.lit(day).cast("date")))


def effective_documents(documents: DataFrame, periods: DataFrame, day: str, statuses: Sequence[str] = ACTIVE) -> DataFrame:
    return documents.join(as_of(periods, day, statuses).select("document_id", F.col("status").alias("status_at"), "valid_from", "valid_to"), "document_id")


def resolve_status(rows: DataFrame, provisions: DataFrame, day: str) -> DataFrame:
    """Adds status, valid_from, valid_to and status_scope: a provision's own status unless that is unknown, else its document's (columns doc_*)."""
    held = provisions.filter(valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(day).cast("date"))).select("document_id", "provision_key", F.col("status").alias("_s"), F.col("valid_from").alias("_f"), F.col("valid_to").alias("_t"))
    own = F.col("_s").isNotNull() & (F.col("_s") != "UNKNOWN")
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b))
    return rows.join(held, ["document_id", "provision_key"], "left").withColumns({"status": pick("_s", "doc_status"), "valid_from": pick("_f", "doc_from"), "valid_to": pick("_t", "doc_to"), "status_scope": F.when(own, "provision").otherwise("document")}).drop("_s", "_f", "_t")


def overlap_violations(periods: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """Periods that begin before an earlier one of the same key has ended."""
    far = F.lit("9999-12-31").cast("date")
    before = Window.partitionBy(*keys).orderBy("valid_from", tie).rowsBetween(Window.unboundedPreceding, -1)
    return periods.withColumn("_reach", F.max(F.coalesce("valid_to", far)).over(before)).filter(F.col("valid_from") < F.col("_reach")).drop("_reach")


def route(intent: Column, historical_ready: Column) -> Column:
    """struct(target, warned): a question on the past goes to the index of the past, or nowhere with a warning; it never falls back to current law."""
    past = intent == "historical"
    return F.struct(F.when(past & historical_ready, "historical").when(past, "none").otherwise("current").alias("target"), (past & ~F.coalesce(historical_ready, F.lit(False))).alias("warned"))
