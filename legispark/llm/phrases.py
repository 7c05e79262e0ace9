"""Phrases that occur together more often than their parts do, by pivot partitioning.

An n-gram belongs to its rarest word, its pivot. A text is rewritten for each occurrence of a pivot: what can be part of an
n-gram of this pivot is the stretch around it, at most ``longest - 1`` words to either side, that has only words which are
no rarer. Such fragments go to the pivot's partition, equal ones of a task as one row with their number. There the n-grams
that contain the pivot are counted, each by its owner alone, so that no count has to be put together from two partitions.

Words of fewer than ``least`` occurrences are in no candidate and cut a text like punctuation; so does a pair of neighbours
of fewer, which no candidate holds. How frequent a word is comes from a table of a fixed size (``BUCKETS`` bytes): by the
hash of language and word, the order of magnitude of the most frequent word of the bucket. Which pairs are frequent comes
from a bit for each bucket of their hashes, of which there are about as many as words, ``MOST_PAIRS`` at most. A shared
bucket can only keep something rare in or choose another pivot; the counts stay exact, because the order of two words is the
same everywhere.

Null and empty texts have no words; a null lang is ``und``; repeated rows count as often as they stand; an empty table gives
no rows. Other columns are not read. A task holds about ``PART_BYTES`` of texts, or one text, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legispark.llm.storage import materialize
from legispark.llm.terms import Coded, blocks, coded, hashes, lowered, table
from legispark.llm.words import mix64

#: Words are ``[^\x20\x09]+`` of pieces that end at ``[.,;:!?\x0A-\x0D]``.
PIECE_ENDS = table(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
SEPARATORS = PIECE_ENDS | table((0x20, 0x20), (0x09, 0x09))
#: Buckets of the table of frequencies, one byte each.
BUCKETS = 1 << 23
#: Buckets of pairs, as powers of two: the fewest, the most, and into how many ranges they are dealt to be summed.
LEAST_PAIRS, MOST_PAIRS, RANGES = 1 << 20, 1 << 28, 1 << 8
#: Bytes of text that a task handles at a time.
PART_BYTES = 3 << 20
#: A pivot of more occurrences is dealt out to several tasks by fragment, and their counts are summed afterwards.
PIVOT_ROWS = 1 << 21
#: Groups in which each language's phrases are ranked before the last ranking.
RANK_GROUPS = 64
#: Rows of a batch that goes to Spark.
OUT_ROWS = 1 << 16


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Coded, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Words, the language of each as a code, the languages, the bytes and where texts begin."""
    for rows, data, offset in blocks(batches, size=PART_BYTES):
        words = coded(lowered(data), offset, SEPARATORS)
        lang = rows["lang"].cast(pa.string()).fill_null("und").dictionary_encode()
        yield words, lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.row], lang.dictionary, data, offset


def _out(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.table(columns)
    yield from whole.combine_chunks().to_batches(max_chunksize=OUT_ROWS)


def _text(words: pa.Array) -> pa.Array:
    return words.cast(pa.large_string()).cast(pa.string())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each language with their number; the empty word stands for all words."""
    for words, lang, langs, _, _ in _read(batches):
        if not len(words.code):
            continue
        size = len(words.words)
        key, n = np.unique(lang * size + words.code, return_counts=True)
        each, total = np.unique(lang, return_counts=True)
        yield from _out({
            "lang": pa.concat_arrays([langs.take(pa.array(key // size)), langs.take(pa.array(each))]),
            "word": pa.concat_arrays([_text(words.words.take(pa.array(key % size))), pa.array([""] * len(each), pa.string())]),
            "n": pa.array(np.concatenate((n, total)).astype(np.int64)),
        })


def _bucket(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return (mix64(word ^ (lang * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _magnitude(n: np.ndarray, least: int) -> np.ndarray:
    """1 for the least number of occurrences, four more each time it doubles."""
    return np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(n, least) / least))).astype(np.uint8)


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, word, n of the words that occur at least ``least`` times; the empty word has the number of all words."""
    each = docs.select("lang", "text").mapInArrow(_counted, "lang string, word string, n long")
    return each.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("word") == ""))


def frequencies(counts: DataFrame, least: int) -> np.ndarray:
    """One byte for each bucket of words: 0 if no frequent word is there, else the magnitude of the most frequent one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = _bucket(hashes(batch["word"]), hashes(batch["lang"]))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket.astype(np.int32)), "size": pa.array(_magnitude(batch["n"].to_numpy(), least).astype(np.int16))})

    found = counts.filter("word <> ''").mapInArrow(each, "bucket int, size smallint").groupBy("bucket").agg(F.max("size").alias("size")).toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    out[found["bucket"].to_numpy()] = found["size"].to_numpy()
    return out


class _Part(NamedTuple):
    """Words of a part of the texts, as what finding fragments needs; ``key`` is a word's order of rarity, 0 if it is rare."""

    words: Coded
    lang: np.ndarray
    langs: pa.Array
    own: np.ndarray
    tongue: np.ndarray
    key: np.ndarray
    piece: np.ndarray
    pair: np.ndarray


def _ordered(batches: Iterator[pa.RecordBatch], magnitude: np.ndarray) -> Iterator[_Part]:
    """Parts of at least two words. ``pair`` is the hash of a word and the next one, 0 unless both can be in a candidate."""
    for words, lang, langs, data, _ in _read(batches):
        if len(words.code) < 2:
            continue
        own, tongue = hashes(words.words), hashes(langs)
        size = magnitude[_bucket(own[words.code], tongue[lang])].astype(np.uint64)
        key = np.where(size > 0, (size << np.uint64(56)) | (own[words.code] >> np.uint64(8)), np.uint64(0))
        ends = np.cumsum(PIECE_ENDS[data])
        piece = ends[words.start] + words.row
        both = (piece[1:] == piece[:-1]) & (key[1:] > 0) & (key[:-1] > 0)
        mixed = mix64(own[words.code[:-1]] * np.uint64(0xD1342543DE82EF95) + own[words.code[1:]] + tongue[lang[:-1]] * np.uint64(31))
        yield _Part(words, lang, langs, own, tongue, key, piece, np.where(both, mixed | np.uint64(1), np.uint64(0)))


def frequent_pairs(docs: DataFrame, sizes, least: int, buckets: int) -> np.ndarray:
    """A bit for each bucket of pairs that has at least ``least`` of them. A task's buckets travel packed, by range."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _ordered(batches, sizes.value):
            found, n = np.unique((part.pair[part.pair > 0] >> np.uint64(1)) & np.uint64(buckets - 1), return_counts=True)
            cuts = np.searchsorted(found, np.arange(RANGES + 1, dtype=np.uint64) * np.uint64(buckets // RANGES))
            place, n = (found % np.uint64(buckets // RANGES)).astype(np.uint32), np.minimum(n, least).astype(np.uint8)
            at = [k for k in range(RANGES) if cuts[k] < cuts[k + 1]]
            yield pa.RecordBatch.from_pydict({"range": pa.array(at, pa.int32()), "place": pa.array([place[cuts[k] : cuts[k + 1]].tobytes() for k in at], pa.binary()), "n": pa.array([n[cuts[k] : cuts[k + 1]].tobytes() for k in at], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, place, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = total.setdefault(k, np.zeros(buckets // RANGES, np.uint8))
                at = np.frombuffer(place, np.uint32)
                held[at] = np.minimum(held[at].astype(np.int64) + np.frombuffer(n, np.uint8), least)
        yield pa.RecordBatch.from_pydict({"range": pa.array(list(total), pa.int32()), "bits": pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in total.values()], pa.binary())})

    dealt = docs.select("lang", "text").mapInArrow(each, "range int, place binary, n binary").repartition("range")
    out = np.zeros((RANGES, buckets // RANGES // 8), np.uint8)
    for row in dealt.mapInArrow(summed, "range int, bits binary").collect():
        out[row.range] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def _reach(key: np.ndarray, joined: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before and after each word can be in an n-gram with it and are no rarer; of equal words the first is
    the pivot. ``joined``: whether a word and the next one can."""
    n = len(key)
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(1, min(most, n - 1) + 1):
        before[k:] += (before[k:] == k - 1) & joined[: n - k] & (key[:-k] > key[k:])
        after[:-k] += (after[:-k] == k - 1) & joined[k - 1 :] & (key[k:] >= key[:-k])
    return before, after


def _fragments(sizes, pairs, buckets: int, longest: int, least: int, pivot_rows: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magnitude, bits = sizes.value, pairs.value
        for words, lang, langs, own, tongue, key, _, pair in _ordered(batches, magnitude):
            place = (pair >> np.uint64(1)) & np.uint64(buckets - 1)
            frequent = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
            before, after = _reach(key, (pair > 0) & (frequent > 0), longest - 1)
            pivot = np.flatnonzero(before + after > 0)
            if not len(pivot):
                continue
            columns = {"lang": lang[pivot].astype(np.int32), "before": before[pivot].astype(np.int8)}
            for k in range(1 - longest, longest):
                there = (k >= -before[pivot]) & (k <= after[pivot])
                columns[f"w{k}"] = np.where(there, words.code[np.clip(pivot + k, 0, len(key) - 1)], -1).astype(np.int32)
            kinds = pa.table(columns).group_by(list(columns), use_threads=False).aggregate([([], "count_all")])
            n = kinds["count_all"].to_numpy()
            middle, tongues = kinds["w0"].to_numpy().astype(np.int64), kinds["lang"].to_numpy().astype(np.int64)
            texts, mixed = [], np.zeros(len(n), np.uint64)
            for k in range(1 - longest, longest):
                code = kinds[f"w{k}"].to_numpy().astype(np.int64)
                texts.append(_text(words.words.take(pa.array(code, mask=code < 0))))
                mixed = mix64(mixed * np.uint64(31) + np.where(code < 0, np.uint64(0), own[np.maximum(code, 0)]))
            seen = least * 2.0 ** (magnitude[_bucket(own[middle], tongue[tongues])].astype(float) / 4)
            lots = np.maximum(1, np.ceil(seen / pivot_rows)).astype(np.uint64)
            yield from _out({
                "lang": langs.take(pa.array(tongues)),
                "pivot": pa.array(own[middle].view(np.int64)),
                "lot": pa.array((mixed % lots).astype(np.int32)),
                "lots": pa.array(lots.astype(np.int32)),
                "before": pa.array(kinds["before"].to_numpy()),
                "words": pc.binary_join_element_wise(*texts, " ", null_handling="skip"),
                "n": pa.array(n.astype(np.int64)),
            })

    return each


def phrase_counts(docs: DataFrame, sizes: np.ndarray, buckets: int, longest: int, least: int) -> DataFrame:
    """lang, phrase, a of all phrases of 2 to ``longest`` words that occur at least ``least`` times."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(sizes)
    pairs = context.broadcast(frequent_pairs(docs, shared, least, buckets))
    schema = "lang string, pivot long, lot int, lots int, before byte, words string, n long"
    dealt = docs.select("lang", "text").mapInArrow(_fragments(shared, pairs, buckets, longest, least, PIVOT_ROWS), schema).repartition("lang", "pivot", "lot")
    w, at = F.col("w"), F.col("before").cast("int")
    # The n-grams around the pivot, by how far before it they begin and how many words they have.
    ways = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(size).alias("size")) for size in range(2, longest + 1) for b in range(size)))
    fit = F.filter(ways, lambda x: (x["b"] <= at) & (at - x["b"] + x["size"] <= F.size(w)))
    grams = F.transform(fit, lambda x: F.array_join(F.slice(w, at - x["b"] + 1, x["size"]), " "))
    owned = dealt.withColumn("w", F.split("words", " ")).select("lang", "pivot", "lot", "lots", F.explode(grams).alias("phrase"), "n")
    mined = owned.groupBy("lang", "pivot", "lot", "phrase").agg(F.sum("n").alias("n"), F.max("lots").alias("lots"))
    return mined.filter((F.col("lots") > 1) | (F.col("n") >= least)).groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, first: int = 2000, scale: int = 1_000_000) -> DataFrame:
    """Each language's ``first`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``score`` is floor(scale * a * a / (l * r)) at the cut of a phrase where that is lowest, ties to the earliest cut; exact
    as decimals of 38 digits, so up to 10**15 occurrences. A phrase inside a longer candidate that has at least ``share``
    percent of its occurrences is left out. Ranks go by score, then a, both from the highest, then by phrase.
    """
    counts = materialize(word_counts(docs, least), "words")
    total = counts.filter("word = ''").agg(F.sum("n")).first()[0] or 0
    buckets = min(max(LEAST_PAIRS, 1 << total.bit_length()), MOST_PAIRS)
    found = materialize(phrase_counts(docs, frequencies(counts, least), buckets, longest, least), "phrases")
    known = counts.filter("word <> ''").select("lang", F.col("word").alias("part"), "n").unionByName(found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("n")))
    w = F.split("phrase", " ")
    part = lambda words, begin, size: F.array_join(F.slice(words, begin, size), " ")
    cut = found.select("lang", "phrase", "a", w.alias("w")).select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.col("w"), 1, F.col("k")).alias("left"), part(F.col("w"), F.col("k") + 1, F.size("w")).alias("right"))
    left = known.select(F.col("lang"), F.col("part").alias("left"), F.col("n").alias("l"))
    right = known.select(F.col("lang"), F.col("part").alias("right"), F.col("n").alias("r"))
    cut = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    whole = {c: F.col(c).cast("decimal(16,0)") for c in "alr"}
    top, below = F.lit(scale).cast("decimal(7,0)") * whole["a"] * whole["a"], whole["l"] * whole["r"]
    cut = cut.withColumns({"top": top, "below": below}).withColumn("score", F.expr("top div below"))
    scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("a").alias("a")).select("lang", "phrase", "a", "c.score", "c.l", "c.r")
    # What lies inside a longer candidate, with the occurrences of the most frequent of these.
    longer = found.select("lang", "a", w.alias("w")).filter(F.size("w") > 2)
    spans = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(size).alias("size")) for size in range(2, longest) for b in range(longest - size + 1)))
    parts = F.transform(F.filter(spans, lambda x: (x["b"] + x["size"] <= F.size("w")) & (x["size"] < F.size("w"))), lambda x: part(F.col("w"), x["b"] + 1, x["size"]))
    inside = longer.select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer")) if longest > 2 else None
    if inside is not None:
        scored = scored.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(F.lit(100) * F.col("longer") < F.lit(share) * F.col("a"), F.lit(True))).drop("longer")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))
    near = scored.withColumn("_group", group).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*order))).filter(F.col("_rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    totals = counts.filter("word = ''").select("lang", F.col("n").alias("total"))
    out = ranked.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))

