"""Toxicity by maximum-scoring segments.

Units are words and their beginnings (``PREFIXES`` characters), so that the forms of an inflected stem count together.
They get the log-odds of toxic against clean documents under an informative Dirichlet prior. Units whose log-odds are
high and whose share of toxic documents is beyond what chance makes of so many units score, all other words cost a small
drift. One linear scan finds every maximal-scoring segment of a text. By the extreme-value theory of such segments, a
segment of score S in n words is expected by chance ``K * n * exp(-lambda * S)`` times. A document adds up what its
segments have beyond chance, and a logistic curve turns this sum into a probability.

Lambda, K and the curve are fitted on texts that did not choose the units which score them: each fold of the labelled
sample is scored by the units of the other folds. Copies of a text count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legispark.llm.storage import drop, materialize
from legispark.llm.words import PUNCTUATION, Words, as_bytes, grams, mix64, parts, prefixes, split

#: Labelled rows that the fit takes at most, by class (clean, toxic).
SAMPLE = (12_000, 8_000)
#: Folds of the labelled rows: the first is held out, the others fit. Lengths of word beginnings that are units.
FOLDS, PREFIXES = 5, (4, 5, 6)
#: Minima by which copies in the sample are found, and the chance that a unit passes by luck at all.
COPY_KEYS, LUCK = 4, 1.0
#: A unit scores once within so many words: a word that is repeated over and over is no longer passage.
REPEAT_WORDS = 100
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; fold 0 is held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


@dataclass(frozen=True)
class ToxicityModel:
    hashes: np.ndarray
    scores: np.ndarray
    drift: float
    decay: float
    scale: float
    intercept: float
    slope: float
    tokens: tuple[str, ...] = ()

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.slope * np.log1p(evidence))))


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, word after, score), in one pass.

    Only the words at ``places`` score; every other word costs ``drift``. Segments on the stack keep the sums before
    and after them; a new one is joined to the last segment that began lower and ended lower.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, at = 0.0, 0
    for p, s in zip(places, scores, strict=True):
        total -= drift * (p - at)
        at = p + 1
        first, before = p, total
        total += s
        after = total
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= before:
                k -= 1
            if k < 0 or stack[k][3] >= after:
                break
            first, before = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((first, p + 1, before, after))
    return [(a, b, after - before) for a, b, before, after in stack]


def _marked(hashes: np.ndarray) -> np.ndarray:
    """The hash of a beginning, told apart from that of the word of the same letters."""
    return mix64(hashes ^ np.uint64(0xD6E8FEB86659FD93))


def unit_hashes(units: list[str]) -> np.ndarray:
    """Hashes of units, as ``_units`` writes them: words, and beginnings with a star behind."""
    words = split(*as_bytes(pa.array([u.rstrip("*") for u in units], pa.string())), PUNCTUATION, lower=True).hash
    return np.where(np.array([u.endswith("*") for u in units], bool), _marked(words), words)


def _best(words: Words, hashes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, score, unit) of the words that score, each by its highest unit."""
    score, unit = np.zeros(len(words.hash)), np.full(len(words.hash), -1)
    if len(hashes):
        for found, of in ((words.hash, np.arange(len(words.hash))), *((_marked(h), w) for h, w in (prefixes(words, n) for n in PREFIXES))):
            at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            hit = np.nonzero(hashes[at] == found)[0]
            more = hit[scores[at[hit]] > score[of[hit]]]
            score[of[more]], unit[of[more]] = scores[at[more]], at[more]
    place = np.nonzero(unit >= 0)[0]
    return place, score[place], unit[place]


def _scan(column: pa.Array, hashes: np.ndarray, scores: np.ndarray, drift: float) -> Iterator[tuple[int, list[float], list[tuple[int, int, float]]]]:
    """(words, scores of single words, segments) of each text."""
    data, offset = as_bytes(column)
    for a, b in parts(column):
        words = split(data[offset[a] : offset[b]], offset[a : b + 1] - offset[a], PUNCTUATION, lower=True)
        place, value, unit = _best(words, hashes, scores)
        bound = np.searchsorted(place, words.first)
        for k in range(b - a):
            low, high = bound[k], bound[k + 1]
            first = words.first[k]
            places: list[int] = []
            values: list[float] = []
            last: dict[int, int] = {}
            for p, s, u in zip((place[low:high] - first).tolist(), value[low:high].tolist(), unit[low:high].tolist(), strict=True):
                if p - last.get(u, -REPEAT_WORDS) >= REPEAT_WORDS:
                    last[u] = p
                    places.append(p)
                    values.append(s)
            yield int(words.first[k + 1] - first), values, maximal_segments(places, values, drift)


def _evidence(n: int, segments: list[tuple[int, int, float]], decay: float, scale: float) -> float:
    chance = math.log(max(scale * n, 1e-12))
    return sum(max(0.0, decay * s - chance) for _, _, s in segments)


def _units(text: str) -> set[str]:
    words = {w.translate(_LOWER) for w in _WORD.findall(text)}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a unit by class and fold, summed over a task."""
    seen: defaultdict[tuple[int, int], Counter] = defaultdict(Counter)

    def counted() -> pa.RecordBatch:
        rows = [(u, toxic, part, n) for (toxic, part), c in seen.items() for u, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["unit", "toxic", "fold", "n"])

    for batch in batches:
        for text, toxic, part in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            seen[toxic, part].update(_units(text))
        if sum(map(len, seen.values())) > 300_000:
            yield counted()
            seen.clear()
    yield counted()


def _with_copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``COPY_KEYS`` least hashes of a text's five-word runs: copies share all, near copies most, other texts none."""
    for batch in batches:
        keys: list[list[int]] = [[] for _ in range(COPY_KEYS)]
        data, offset = as_bytes(batch.column(0))
        for a, b in parts(batch.column(0)):
            words = split(data[offset[a] : offset[b]], offset[a : b + 1] - offset[a], PUNCTUATION, lower=True)
            run, whole = grams(words, 5)
            for k in range(b - a):
                low, high = words.first[k], words.first[k + 1]
                own = run[low : high - 4][whole[low : high - 4]] if high - low >= 5 else words.hash[low:high]
                for n, out in enumerate(keys):
                    out.append(int(mix64(own ^ np.uint64(n)).min().view(np.int64)) if len(own) else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in keys)], names=[*batch.schema.names, *(f"k{n}" for n in range(COPY_KEYS))])


def _distinct_texts(sample: DataFrame) -> DataFrame:
    """One row of each group of copies or near copies of one label. The sample bounds what is broadcast."""
    names = [f"k{n}" for n in range(COPY_KEYS)]
    keyed = materialize(sample.mapInArrow(_with_copy_keys, "text string, _label int, _fold int, " + ", ".join(f"{k} long" for k in names)), "copy-keys").withColumn("_text", F.xxhash64("text"))
    left = keyed.select("_text", "_label", *names)
    for k in names:
        left = left.groupBy(k, "_label").agg(F.min(F.struct("_text", *(x for x in names if x != k))).alias("x")).select("_label", k, "x.*")
    return keyed.dropDuplicates(["_text", "_label"]).join(F.broadcast(left.select("_text", "_label").distinct()), ["_text", "_label"], "left_semi").select("text", "_label", "_fold")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: tuple[int, int] = SAMPLE) -> tuple[DataFrame, list[int]]:
    """(text, _label, _fold) of at most ``sample`` rows of either class outside fold 0, and how many rows each class has.

    Rows are taken in the order of a hash of the id. Their ids, which the sample bounds, are broadcast to the scan.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    known = materialize(known, "labels")
    totals = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    order = F.xxhash64(F.lit(11), F.col("doc_id"))
    taken = known.filter("_label = 0").orderBy(order, "doc_id").limit(sample[0]).unionByName(known.filter("_label = 1").orderBy(order, "doc_id").limit(sample[1]))
    chosen = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "_label", fold(F.col("doc_id")).cast("int").alias("_fold"))
    return materialize(chosen, "labelled"), [totals.get(0, 0), totals.get(1, 0)]


def _unit_counts(counts: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], float], int]:
    """Per unit of three toxic documents or more its documents as y<class>_<fold>; their totals over all units; and how many units there are."""
    of = lambda c, k: F.sum(F.when((F.col("toxic") == c) & (F.col("fold") == k), F.col("n")).otherwise(0)).cast("double")
    cells = [(c, k) for c in (0, 1) for k in range(1, FOLDS)]
    sums = materialize(counts.groupBy("unit").agg(*(of(c, k).alias(f"y{c}_{k}") for c, k in cells)), "unit-counts")
    row = sums.agg(F.count(F.lit(1)), *(F.sum(f"y{c}_{k}") for c, k in cells)).first()
    often = materialize(sums.filter(sum(F.col(f"y1_{k}") for k in range(1, FOLDS)) >= 3), "toxic-units")
    drop(sums)
    return often, {cell: x or 0.0 for cell, x in zip(cells, row[1:], strict=True)}, row[0]


def _choose_units(often: DataFrame, totals: dict[tuple[int, int], float], n_units: int, prior: float, flat: float, least_odds: float, without: int | None) -> list[tuple[str, float]]:
    """(unit, log-odds) of the units that score, learned from all folds or from all but one.

    A unit in y1 toxic and y0 clean documents is beyond chance if ``exp(-n * KL(y1 / n || p))``, Chernoff's bound for so
    toxic a unit where p is the toxic share of all, is under ``LUCK`` over the number of units.
    """
    folds = [k for k in range(1, FOLDS) if k != without]
    y0, y1 = (sum(F.col(f"y{c}_{k}") for k in folds) for c in (0, 1))
    t0, t1 = (sum(totals[c, k] for k in folds) for c in (0, 1))
    if not t0 or not t1:
        return []
    n, p = y0 + y1, t1 / (t0 + t1)
    # The prior of a unit: its share of all units, and a flat part that keeps rare ones in bounds.
    alpha = F.lit(flat) + F.lit(prior) * n / (t0 + t1)
    odds = lambda y, total: F.log((y + alpha) / (total + prior - y))
    delta = odds(y1, t1) - odds(y0, t0)
    term = lambda y, share: F.when(y > 0, y * F.log(y / n / share)).otherwise(0.0)
    chance = term(y1, p) + term(y0, 1 - p)
    chosen = often.filter((y1 >= 3) & (y1 > n * p) & (chance >= math.log(n_units / LUCK)) & (delta >= least_odds))
    return _longest_stems([tuple(r) for r in chosen.select("unit", delta.alias("delta"), y1.alias("y1")).collect()])


def _longest_stems(units: list[tuple[str, float, float]], alike: float = 0.8) -> list[tuple[str, float]]:
    """Without beginnings that one longer unit explains: where it has most of the toxic documents, other words of that beginning have none of the blame."""
    most: dict[str, float] = {}
    for u, _, y1 in units:
        word = u.rstrip("*")
        for n in PREFIXES:
            if len(word) > n or len(word) == n and word == u:
                most[word[:n] + "*"] = max(most.get(word[:n] + "*", 0.0), y1)
    return sorted((u, delta) for u, delta, y1 in units if not u.endswith("*") or most.get(u, 0.0) < alike * y1)


def _table(units: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray]:
    hashes = unit_hashes([u for u, _ in units])
    order = np.argsort(hashes)
    return hashes[order], np.array([d for _, d in units], float)[order]


def fit(docs: DataFrame, labels: DataFrame, prior: float = 500.0, flat: float = 0.5, least_odds: float = 3.0, drift: float = 0.1) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows (``SAMPLE``), their copies once.

    Needs doc_id and text of ``docs``, doc_id and toxic of ``labels``; other columns are not read. Null labels and null
    ids are left out, a null text is empty, a doc_id that is labelled twice counts as toxic if one label says so.
    Without rows of both classes, as with empty tables, nothing scores.
    """
    sample, totals = labelled_sample(docs, labels)
    sample = materialize(_distinct_texts(sample), "distinct-labelled")
    per_class = {r[0]: r[1] for r in sample.groupBy("_label").count().collect()}
    n0, n1 = per_class.get(0, 0), per_class.get(1, 0)
    blank = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), drift, 1.0, 1.0, -3.0, 1.0)
    if not n0 or not n1:
        return blank
    counts = _unit_counts(sample.mapInArrow(_count_units, "unit string, toxic int, fold int, n long"))
    units = _choose_units(*counts, prior, flat, least_odds, None)
    if not units:
        return blank
    hashes, scores = _table(units)
    others = {k: _table(_choose_units(*counts, prior, flat, least_odds, k)) for k in range(1, FOLDS)}
    drop(counts[0])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, table in others.items():
                own = batch.filter(pa.array(batch.column(2).to_numpy() == k))
                found = list(_scan(own.column(0), *table, drift))
                yield pa.RecordBatch.from_arrays([own.column(1), pa.array([n for n, _, _ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.list_(pa.float64())), pa.array([[s for _, _, s in x] for _, _, x in found], pa.list_(pa.float64()))], names=["label", "n", "singles", "segments"])

    scanned = sample.mapInArrow(scan, "label int, n long, singles array<double>, segments array<double>").collect()
    drop(sample)
    # Chance: clean documents give the score distribution of single words, and how often segments reach a score.
    clean = [r for r in scanned if r["label"] == 0]
    words = max(1, sum(r["n"] for r in clean))
    singles = np.append([s for r in clean for s in r["singles"]], float(np.mean(scores)))  # one more, so that chance is never nil
    # lambda: the mean of exp(lambda * score) over clean words is 1, by bisection above the root at 0.
    moment = lambda x: np.exp(np.minimum(700.0, x * singles)).sum() / words + max(0, words - len(singles)) / words * math.exp(-x * drift) - 1
    low, up = 1e-6, 1.0
    while moment(up) < 0 and up < 1e3:
        up *= 2
    for _ in range(80):
        mid = (low + up) / 2
        low, up = (mid, up) if moment(mid) < 0 else (low, mid)
    decay = up
    segments = np.append([s for r in clean for s in r["segments"]], singles[-1])
    floor = float(np.median(segments))
    scale = (segments >= floor).sum() / (words * math.exp(-decay * floor))
    x = np.log1p([_evidence(r["n"], [(0, 0, s) for s in r["segments"]], decay, scale) for r in scanned])
    y = np.array([r["label"] for r in scanned], float)
    weight = np.where(y == 1, max(totals[1], n1) / n1, max(totals[0], n0) / n0)
    beta = np.array([-2.0, 1.0])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(hashes, scores, drift, decay, scale, float(beta[0]), float(max(beta[1], 1e-6)), tuple(u for u, _ in units))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, n_segments, first_word, end_word) per row: the probability, the number of significant passages, and where the best one lies.

    Reads doc_id and text only. Null and empty texts score as texts without evidence; repeated rows score alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence, count, first, end = [], [], [], []
            for n, _, segments in _scan(batch.column(1), model.hashes, model.scores, model.drift):
                chance = math.log(max(model.scale * n, 1e-12))
                kept = [s for s in segments if model.decay * s[2] > chance]
                best = max(kept, key=lambda s: s[2], default=(None, None, 0))
                evidence.append(_evidence(n, segments, model.decay, model.scale))
                count.append(len(kept))
                first.append(best[0])
                end.append(best[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(np.array(evidence, float))), pa.array(count, pa.int64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "score", "n_segments", "first_word", "end_word"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, n_segments long, first_word long, end_word long")


def keep(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``limit``, whole and unchanged, in one pass and without a join.

    All columns stay as they are, whatever their names. Rows with a null or empty text stay, since nothing in them
    scores; repeated rows stay or go together; an empty table gives an empty table.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence = [_evidence(n, segments, model.decay, model.scale) for n, _, segments in _scan(batch.column(at), model.hashes, model.scores, model.drift)]
            yield batch.filter(pa.array(model.probability(np.array(evidence, float)) < limit))

    return docs.mapInArrow(run, docs.schema)
