"""Spans of texts: what consecutive chunks share at their edges, what evidence is after that is taken off, and what no chunk covers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legispark.operators.evidence import ancestor_excerpt

# What may stand between an overlap and the rest, and the headings of a candidate's text.
BETWEEN = " \n:;,-"
ABOVE, EXCERPT = "Ngữ cảnh cấp trên:\n", "Đoạn trích:\n"
PLAIN_ROLE = "retrieved_document"


def longest_border(left: list[str], right: list[str]) -> int:
    """How many words the longest end of ``left`` has that ``right`` begins with, by a prefix function: linear in both."""
    if not right:
        return 0
    fail = [0] * len(right)
    k = 0
    for i in range(1, len(right)):
        while k and right[i] != right[k]:
            k = fail[k - 1]
        k += right[i] == right[k]
        fail[i] = k
    k = 0
    for n, word in enumerate(left[-len(right) :], 1):
        while k and (k == len(right) or word != right[k]):
            k = fail[k - 1]
        k += word == right[k]
        if k == len(right) and n < min(len(left), len(right)):
            k = fail[k - 1]
    return k


def shared_edge(left: Column, right: Column) -> Column:
    """For arrays of words: the length of the longest end of the left that the right begins with; 0 where one is null."""

    @F.pandas_udf("int")
    def edge(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None or y is None else longest_border(list(x), list(y)) for x, y in zip(a, b, strict=True)])

    return edge(left, right)


def strip_overlaps(chunks: DataFrame, key: str = "doc_id", order: str = "ordinal") -> DataFrame:
    """Adds ``overlap_words`` and ``own_text``: a chunk's words without those that end the chunk before it.

    Words are what white space separates, ``own_text`` joins them by a space. The first chunk of a key has its whole text.
    """
    w = Window.partitionBy(key).orderBy(order)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    x = chunks.withColumn("_w", words).withColumn("_before", F.lag("_w").over(w)).withColumn("overlap_words", shared_edge(F.col("_before"), F.col("_w")))
    return x.withColumn("own_text", F.array_join(F.slice("_w", F.col("overlap_words") + 1, F.size("_w")), " ")).drop("_w", "_before")


def strip_known_overlap(text: Column, overlap: Column) -> Column:
    """The text without an overlap that it is known to begin with, and without what separates the two."""
    value, known = F.trim(text), F.trim(F.coalesce(overlap, F.lit("")))
    rest = F.regexp_replace(F.substr(value, F.length(known) + 1), rf"^[{BETWEEN}]+".replace(",-", ",\\-"), "")
    return F.when((known != "") & value.startswith(known), rest).otherwise(value)


def candidates(results: DataFrame, related: DataFrame, seeds: DataFrame, ancestors: bool = True) -> DataFrame:
    """(query_id, chunk_id, document_id, rank, role, leaf, text): what can be evidence of each query.

    ``results``: query_id, chunk_id, document_id, rank, text, overlap_text and, with ``ancestors``, parent_text. A result
    whose text is nothing but an overlap is left out. ``related`` and ``seeds``: (query_id, document_id, role); the role of
    a seed goes before that of a related document; others are retrieved documents.
    """
    key = ["query_id", "document_id"]
    of = lambda df, name: df.groupBy(*key).agg(F.min("role").alias(name))
    leaf = strip_known_overlap(F.col("text"), F.col("overlap_text"))
    x = results.withColumn("leaf", leaf).filter("leaf <> ''").join(of(related, "_related"), key, "left").join(of(seeds, "_seed"), key, "left")
    if ancestors:
        x = x.withColumn("_above", F.when(F.trim("parent_text") != F.trim("leaf"), ancestor_excerpt(F.col("parent_text"), F.col("leaf"))))
    else:
        x = x.withColumn("_above", F.lit(None).cast("string"))
    text = F.when(F.coalesce("_above", F.lit("")) != "", F.concat(F.lit(ABOVE), "_above", F.lit("\n\n" + EXCERPT), "leaf")).otherwise(F.col("leaf"))
    return x.select("query_id", "chunk_id", "document_id", "rank", F.coalesce("_seed", "_related", F.lit(PLAIN_ROLE)).alias("role"), "leaf", text.alias("text"))


def islands(spans: DataFrame, *key: str) -> DataFrame:
    """(key, begin, end, n): runs of spans [begin, end) of a key that overlap or touch, with the number of their spans.

    Spans without an extent are none. A key's spans meet in one sort.
    """
    w = Window.partitionBy(*key).orderBy("begin", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("begin") <= reach, 0).otherwise(1)
    numbered = spans.filter("begin < end").withColumn("_new", new).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "_i").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_i")


def gaps(units: DataFrame, chunks: DataFrame, *key: str) -> DataFrame:
    """(key, begin, end): the stretches of units that no chunk covers; both are spans [begin, end).

    The edges of all spans of a key are swept in one sort, so neither side is joined to the other; a stretch goes on over
    the edges of units that touch.
    """
    kind = lambda df, u, c: df.filter("begin < end").select(*key, F.inline(F.array(F.struct(F.col("begin").alias("at"), F.lit(u).alias("u"), F.lit(c).alias("c")), F.struct(F.col("end").alias("at"), F.lit(-u).alias("u"), F.lit(-c).alias("c")))))
    edges = kind(units, 1, 0).unionByName(kind(chunks, 0, 1)).groupBy(*key, "at").agg(F.sum("u").alias("u"), F.sum("c").alias("c"))
    w = Window.partitionBy(*key).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = edges.withColumns({"_open": F.sum("u").over(run), "_covered": F.sum("c").over(run), "_next": F.lead("at").over(w)})
    bare = swept.filter("_open > 0 AND _covered = 0").select(*key, F.col("at").alias("begin"), F.col("_next").alias("end"))
    return islands(bare, *key).drop("n")


def coverage(units: DataFrame, chunks: DataFrame, *key: str) -> DataFrame:
    """(key, units, covered, missing, longest_gap, gaps): how much of each key's units lies in chunks."""
    held = islands(units, *key).withColumn("size", F.col("end") - F.col("begin")).groupBy(*key).agg(F.sum("size").alias("units"))
    lost = gaps(units, chunks, *key).withColumn("size", F.col("end") - F.col("begin")).groupBy(*key).agg(F.sum("size").alias("missing"), F.max("size").alias("longest_gap"), F.count(F.lit(1)).alias("gaps"))
    x = held.join(lost, list(key), "left").fillna(0, ["missing", "longest_gap", "gaps"])
    return x.withColumn("covered", F.col("units") - F.col("missing"))
