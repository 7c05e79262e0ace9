"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps its measurements and one failure bit per rule. A policy is
a version and the set of rules that reject; applying one, or asking what a rule alone would change (its ablation), is
bitwise arithmetic over the ledger, never a second look at the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legispark.llm.words import as_bytes, grams, parts, split

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_FIRST_BYTE = ((np.arange(256) & 0xC0) != 0x80).astype(np.int64)
#: A word is counted as repeated if a window of so many words that covers it stands twice in the text.
WINDOW = 8


def _sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(values)))
    return upto[high] - upto[low]


def _lines(data: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    kept = [x for x in data.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(kept), len(kept) - len(set(kept))


def measure_part(data: np.ndarray, offset: np.ndarray) -> list[np.ndarray]:
    words = split(data, offset)
    low, high = words.first[:-1], words.first[1:]
    chars = _sums(_FIRST_BYTE[data], words.start, words.end)
    window, whole = grams(words, WINDOW)
    covered = np.zeros(len(words.hash) + 1, np.int64)
    at = np.nonzero(whole)[0]
    if len(at):
        key = window[at] + words.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key, kind="stable")
        same = np.concatenate(([False], (key[order][1:] == key[order][:-1]) & (words.row[at][order][1:] == words.row[at][order][:-1])))
        twice = at[order[same | np.append(same[1:], False)]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    repeated = (np.cumsum(covered)[:-1] > 0).astype(np.int64)
    raw = data.tobytes()
    lines = np.array([_lines(raw[a:b]) for a, b in zip(offset[:-1], offset[1:], strict=True)], np.int64).reshape(-1, 2)
    return [high - low, _sums(chars, low, high), _sums(_SYMBOL[data], offset[:-1], offset[1:]), lines[:, 1], _sums(repeated, low, high), lines[:, 0]]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offset = as_bytes(batch.column(1))
        for a, b in parts(batch.column(1)):
            columns = measure_part(data[offset[a] : offset[b]], offset[a : b + 1] - offset[a])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in columns)], names=["doc_id", *(x.split()[0] for x in MEASURES.split(", "))])


def measurements(docs: DataFrame) -> DataFrame:
    """One row of measurements per row of ``docs``; a null text has no words, lines or symbols. Extra columns are not read."""
    return docs.select("doc_id", "text").mapInArrow(_measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


#: The rules by bit. The first two are the base rules.
def rules() -> list[tuple[str, Column]]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        ("too_few_words", F.col("n_words") < 20),
        ("repeated_windows", F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
        ("symbol_heavy", F.col("n_symbols") * 10 > F.col("n_words") * 7),
        ("repeated_lines", (F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3)),
        ("words_too_long", F.col("word_chars") / n > 25),
        ("words_too_short", F.col("word_chars") / n < 1.5),
    ]


#: Versioned policies: the names of the rules that reject.
POLICIES = {
    1: ("too_few_words", "repeated_windows"),
    2: ("too_few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "words_too_long", "words_too_short"),
}


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed``, a long with bit k set if the k-th rule fails."""
    bits = [F.when(rule, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, (_, rule) in enumerate(rules())]
    failed = bits[0]
    for x in bits[1:]:
        failed = failed.bitwiseOR(x)
    return measurements(docs).withColumn("failed", failed)


def policy_mask(version: int) -> int:
    return sum(1 << k for k, (name, _) in enumerate(rules()) if name in POLICIES[version])


def apply_policy(book: DataFrame, version: int) -> DataFrame:
    """The ledger with ``kept`` under a policy."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0)


def ablations(book: DataFrame, version: int) -> DataFrame:
    """(rule, n_failed, n_only): documents that fail the rule, and those that only this rule of the policy rejects."""
    mask, pairs = policy_mask(version), []
    for k, (name, _) in enumerate(rules()):
        if mask >> k & 1:
            hit = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
            pairs += [F.count_if(hit.bitwiseAND(F.lit(1 << k).cast("long")) != 0).alias(f"{name}_a"), F.count_if(hit == (1 << k)).alias(f"{name}_b")]
    names = [name for k, (name, _) in enumerate(rules()) if mask >> k & 1]
    rows = F.array(*(F.struct(F.lit(x).alias("rule"), F.col(f"{x}_a").alias("n_failed"), F.col(f"{x}_b").alias("n_only")) for x in names))
    return book.agg(*pairs).select(F.inline(rows))
