"""Sharding by sampled splitters.

Keys are ordered by (hash of the text, doc_id), so that equal texts stand side by side and an ordinary group of copies
stays within a shard or two, while a huge one is cut by doc_id. A size-weighted sample of keys gives quantile
boundaries for many more ranges than shards; records are dealt to their range; each range then knows its exact bytes,
and a range that reaches over the even share of a shard is subdivided at the record where the share is full. Copies of
one text stay whole unless they exceed both the largest record and 2% of a share. Sizes of shards thus differ by about
one record or 2%, whatever the sample was; the sample only decides how even the ranges are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legispark.llm.storage import materialize

#: Sampled keys per range, and ranges: at least the first, then one for so many rows, at most the last (for the driver's sake).
OVERSAMPLING, RANGES, RANGE_ROWS, MOST_RANGES = 16, 2048, 200_000, 100_000


def record_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def _splitters(keyed: DataFrame, ranges: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``ranges`` boundaries (hash, doc_id). A record is drawn with a chance in proportion to its size, by its own hash, so reruns draw the same; about ``OVERSAMPLING * ranges`` keys come to the driver."""
    chance = F.col("size").cast("double") * float(OVERSAMPLING * ranges) / float(max(total, 1))
    unit = F.pmod(F.xxhash64(F.lit(5), F.col("_hash"), F.col("_id")), F.lit(1 << 52)) / float(1 << 52)
    drawn = keyed.filter(unit < chance).select("_hash", "_id", F.greatest(chance, F.lit(1.0)).alias("weight"))
    rows = sorted((r[0], r[1], r[2]) for r in drawn.toLocalIterator())
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    weight = np.cumsum([r[2] for r in rows])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    cuts = sorted({rows[min(i, len(rows) - 1)][:2] for i in at})
    # The first boundary on a hash lies before all copies of that text; only further ones cut the group by doc_id.
    cuts = [c if k and cuts[k - 1][0] == c[0] else (c[0], -(1 << 63)) for k, c in enumerate(cuts)]
    return np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)


def _range_of(hashes: np.ndarray, ids: np.ndarray):
    @F.pandas_udf("int")
    def find(h: pd.Series, i: pd.Series) -> pd.Series:
        h, i = h.to_numpy(np.int64), i.to_numpy(np.int64)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        out = low.copy()
        for k in np.nonzero(high - low > 0)[0]:
            out[k] += np.searchsorted(ids[low[k] : high[k]], i[k], "right")
        return pd.Series(out.astype(np.int32))

    return find


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """The ``columns`` in one, ``record``, so that no name can clash, with the key (_hash, _id) and the size _size."""
    record = F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(0))
    return docs.select(record.alias("record"), record_bytes(F.col("text")).alias("_size"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_hash"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"))


def _place(records: DataFrame, keys: DataFrame, shards: int, together: float) -> DataFrame:
    """``records`` (with key and size) dealt to ranges that splitters of ``keys`` bound, with _shard and _slot.

    Copies of one text that come to ``together`` of a share, or to the largest record, are not cut.
    """
    counted = keys.agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
    n, total, largest = counted[0], counted[1] or 0, counted[2] or 0
    ranges = min(MOST_RANGES, max(RANGES, n // RANGE_ROWS))
    dealt = records.withColumn("_range", _range_of(*_splitters(keys, ranges, total))(F.col("_hash"), F.col("_id")))
    within = Window.partitionBy("_range").orderBy("_hash", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    copies = Window.partitionBy("_range", "_hash")
    placed = dealt.withColumn("_upto", F.sum("_size").over(within)).withColumn("_row", F.count(F.lit(1)).over(within))
    alike = F.sum("_size").over(copies)
    middle = F.when(alike <= max(total / shards * together, largest), (F.min(F.col("_upto") - F.col("_size")).over(copies) + F.max("_upto").over(copies)) / 2).otherwise(F.col("_upto") - F.col("_size") / 2)
    placed = materialize(placed.withColumn("_middle", middle), "ranges")
    # One row per range from here; their number is bounded above.
    order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.max("_upto").alias("_bytes"), F.max("_row").alias("_rows")).select("_range", F.coalesce(F.sum("_bytes").over(order), F.lit(0)).alias("_bytes_before"), F.coalesce(F.sum("_rows").over(order), F.lit(0)).alias("_rows_before"))
    joined = placed.join(F.broadcast(starts), "_range")
    shard = F.least(F.lit(shards - 1), F.floor((F.col("_bytes_before") + F.col("_middle")) * shards / float(max(total, 1)))).cast("int")
    joined = joined.withColumn("_shard", shard).withColumn("_at", F.col("_rows_before") + F.col("_row") - 1)
    first = joined.groupBy("_shard").agg(F.min("_at").alias("_first"))
    return joined.join(F.broadcast(first), "_shard").withColumn("_slot", (F.col("_at") - F.col("_first")).cast("long"))


def shard_keys(docs: DataFrame, shards: int = 40, together: float = 0.02) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of all rows: law ``bytes``.

    Size is the UTF-8 bytes of the text (null: none) plus 16. Slots count from 0 without gaps in each shard, in key
    order. A null doc_id sorts as the least id, repeated rows each get a slot of their own; an empty table gives none.
    Only keys travel, never texts; extra columns are not read.
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    keyed = materialize(_keyed(docs.select("doc_id", "text", crc.alias("crc")), "doc_id", "crc"), "keys")
    placed = _place(keyed, keyed.select(F.col("_size").alias("size"), "_hash", "_id"), shards, together)
    return placed.select("record.doc_id", F.col("_size").alias("size"), F.col("record.crc").alias("text_crc32"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def assign(docs: DataFrame, shards: int = 40, together: float = 0.02) -> DataFrame:
    """All columns of ``docs`` with ``size``, ``shard`` and ``slot``; columns of these names are replaced.

    The records themselves are dealt to their ranges, in the one shuffle that moves texts; nothing is joined back, so
    rows that repeat each keep a slot of their own. Nulls and an empty table as in ``shard_keys``.
    """
    keys = materialize(_keyed(docs).select(F.col("_size").alias("size"), "_hash", "_id"), "keys")
    placed = _place(_keyed(docs, *docs.columns), keys, shards, together)
    added = {"size": "_size", "shard": "_shard", "slot": "_slot"}
    return placed.select(*(F.col(f"record.`{c}`").alias(c) for c in docs.columns if c.lower() not in added), *(F.col(v).alias(k) for k, v in added.items()))
