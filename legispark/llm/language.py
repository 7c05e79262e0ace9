"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is bound from its letters: the vectors, each permuted
(rotated) as often as its letter is from the end, are multiplied. A text bundles (adds up) its n-gram vectors, a
language prototype bundles those of the language's training texts, and the nearest prototype by cosine wins.

Since bundling is linear, the product of a text with a prototype is the sum, over the text's n-grams, of each n-gram's
product with the prototype. These products are tabulated once per model, so scoring is a lookup per letter. The length
of the text's own vector is common to all prototypes; it is taken from its n-gram counts, whose vectors are all but
orthogonal at this dimension.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legispark.llm.storage import drop, materialize
from legispark.llm.toxicity import fold

#: Dimension, letters of an n-gram, codes for letters (0 is the gap between words), and training rows at most.
DIMENSION, GRAM, CODES, SAMPLE = 4096, 3, 96, 24_000
PART_CHARS = 1 << 19


@lru_cache(1)
def letter_codes() -> np.ndarray:
    """A code for every code point: 0 for what is no letter, else 1 to CODES - 1, the same for both cases.

    a-z have codes of their own; all other letters are dealt over the rest by their code point.
    """
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x30000):
        c = chr(point)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()[0]
            table[point] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (CODES - 27)
    return table


@lru_cache(1)
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (CODES, DIMENSION))


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of n-grams, one row each."""
    letters, out = letter_vectors(), np.ones((len(grams), DIMENSION), np.int8)
    for k in range(GRAM):
        code = grams // CODES**k % CODES
        out *= np.roll(letters, k, axis=1)[code]
    return out


def text_grams(text: str) -> np.ndarray:
    """The n-grams of a text as numbers. Runs of what is no letter count as one gap, also before and after the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out, carry = [], np.zeros(1, np.int32)
    for at in range(0, max(1, len(points)), PART_CHARS):  # in parts, so that a long text needs no more memory
        code = np.concatenate((carry, letter_codes()[points[at : at + PART_CHARS]].astype(np.int32)))
        if at + PART_CHARS >= len(points):
            code = np.append(code, np.int32(0))
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
        code = code[keep]
        carry = code[-(GRAM - 1) :]
        if len(code) >= GRAM:
            out.append(sum(code[GRAM - 1 - k : len(code) - k] * CODES**k for k in range(GRAM)))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: For every n-gram its product with each prototype of length one.
    products: np.ndarray

    def cosines(self, text: str) -> np.ndarray | None:
        """None if the text has no letter."""
        grams = text_grams(text)
        if not len(grams) or not len(self.languages):
            return None
        _, n = np.unique(grams, return_counts=True)
        length = np.sqrt(DIMENSION * float((n.astype(np.float64) ** 2).sum()))
        return self.products[grams].sum(0, dtype=np.float64) / length


def _count(languages: list[str]):
    """Gram counts of each language, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), CODES**GRAM), np.float32)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, n = np.unique(text_grams(text), return_counts=True)
                total[languages.index(lang), grams] += n / max(1, n.sum())
        for k, row in enumerate(total):
            at = np.nonzero(row)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.float64))], names=["lang", "gram", "n"])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Prototypes from rows with a language outside fold 0: about ``sample`` of them, drawn by a hash of the id."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "text", "lang")
    per_lang = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    languages = sorted(per_lang)
    if not languages:
        return LanguageModel((), np.zeros((CODES**GRAM, 0), np.float32))
    share = sample / len(languages)
    unit = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    limit = F.element_at(F.create_map(*(x for k, v in per_lang.items() for x in (F.lit(k), F.lit(share / v)))), F.col("lang"))
    counts = known.filter(unit < limit).select("text", "lang").mapInArrow(_count(languages), "lang int, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    weights = np.zeros((len(languages), CODES**GRAM))
    for r in counts.toLocalIterator():  # at most languages * CODES ** GRAM rows
        weights[r[0], r[1]] = r[2]
    drop(counts)
    seen = np.nonzero(weights.sum(0))[0]
    prototypes = np.zeros((len(languages), DIMENSION))
    for at in range(0, len(seen), 4096):
        part = seen[at : at + 4096]
        prototypes += weights[:, part] @ gram_vectors(part).astype(np.float32)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    products = np.zeros((CODES**GRAM, len(languages)), np.float32)
    for at in range(0, len(seen), 4096):  # an n-gram that no training text has is all but orthogonal to every prototype
        part = seen[at : at + 4096]
        products[part] = gram_vectors(part).astype(np.float32) @ prototypes.T.astype(np.float32)
    return LanguageModel(tuple(languages), products)


def predict(docs: DataFrame, model: LanguageModel, sharpness: float = 40.0) -> DataFrame:
    """(doc_id, lang_pred, score, cosine) per row. Reads doc_id and text only.

    ``und`` with score 0 for a null text, one without letters, or a model without languages. The score is the share of
    the winner among exponentials of ``sharpness`` times the cosines. Ties go to the language first in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lang, score, best = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                cosines = None if text is None else model.cosines(text)
                if cosines is None:
                    lang.append("und")
                    score.append(0.0)
                    best.append(None)
                    continue
                k = int(cosines.argmax())
                lang.append(model.languages[k])
                score.append(float(1 / np.exp(sharpness * (cosines - cosines[k])).sum()))
                best.append(float(cosines[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(best, pa.float64())], names=["doc_id", "lang_pred", "score", "cosine"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, cosine double")
