"""Phrases, packing and ranked search against brute force, on small fixtures with the awkward cases."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, phrase string, rank int, score long, n long, a long, word string, term string, document long, ids binary"


def frame(spark, rows, parts=3):
    """Rows (doc_id, text, lang) with columns whose names the operators use."""
    return spark.createDataFrame([(i, t, g, "s", 1, 2, "p q", 3, 4, 5, 6, "w", "t", 7, b"x") for i, t, g in rows], SCHEMA).repartition(parts)


def sentence(rng, n, words):
    return " ".join(f"w{int(words * rng.random() ** 3)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [(None, "en"), ("", "en"), ("  \n\t.", None), ("One", "de"), ("é ß 漢字 🙂 é ß", None), (sentence(rng, 20_000, 60), "en")]
    texts += [(sentence(rng, 80, 25).replace("w1 ", "w1. ").replace("w2 ", "W2\tx, "), rng.choice(["en", "de", None, "und", ""])) for _ in range(60)]
    texts += [("The same words again and again; the same words.", "fr")] * 12 + [("z " * 300, "fr")] * 3 + [("a b a b a b", "es")] * 20
    out = [(k * 7 % 401, t, g) for k, (t, g) in enumerate(texts)]
    return [*out, (3, "The same words again", "fr"), (3, "The same words again", "fr"), (None, "nobody owns the same words", "fr"), (None, None, None)]


# 11. Phrases.


def brute_phrases(rows, longest=3, least=10, share=50, first=2000):
    counts, total = {}, Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang if lang is not None else "und"] += len(w)
            for n in range(1, longest + 1):
                for k in range(len(w) - n + 1):
                    counts.setdefault(lang if lang is not None else "und", Counter())[tuple(w[k : k + n])] += 1
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in good.items():
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in good.items() if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q)))]
            if not any(100 * b >= share * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("longest", "first"), [(3, 2000), (2, 7), (4, 2000)])
def test_phrases(spark, rows, longest, first):
    from legispark.llm.phrases import collocations

    got = sorted(tuple(r) for r in collocations(frame(spark, rows), longest=longest, first=first).collect())
    assert got == brute_phrases(rows, longest, first=first)
    assert len(got) > 5


def test_phrases_of_pivots_that_are_dealt_out(spark, rows, monkeypatch):
    """Splitting the occurrences of a pivot over tasks changes no count."""
    from legispark.llm import phrases

    monkeypatch.setattr(phrases, "PIVOT_ROWS", 4)
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows)).collect())
    assert got == brute_phrases(rows)


@pytest.mark.parametrize("buckets", [1 << 11, 1 << 20])
def test_phrases_when_words_or_pairs_share_buckets(spark, rows, buckets):
    """The table of frequencies decides what is pruned and who owns an n-gram, never a count."""
    from legispark.llm import phrases

    want = {(g, p): a for g, _, p, a, *_ in brute_phrases(rows, share=10**6)}
    sizes = np.full(phrases.BUCKETS, 3, np.uint8)
    got = {(r.lang, r.phrase): r.a for r in phrases.phrase_counts(frame(spark, rows), sizes, buckets, 3, 10).collect()}
    assert got == want


def test_pivot_owns_each_ngram_once():
    from legispark.llm.phrases import _reach

    joined = np.array([True, True, False, False, False, True])
    before, after = _reach(np.array([5, 5, 9, 0, 7, 2, 7], np.uint64), joined, 2)
    assert before.tolist() == [0, 0, 0, 0, 0, 0, 0]
    assert after.tolist() == [2, 1, 0, 0, 0, 1, 0]
    before, after = _reach(np.array([5, 9, 5, 9, 5], np.uint64), np.array([True, True, True, False]), 3)
    assert before.tolist() == [0, 0, 1, 0, 0]
    assert after.tolist() == [3, 0, 1, 0, 0]


def test_scores_beyond_64_bits(spark, monkeypatch):
    from legispark.llm import phrases

    big = 3 * 10**12
    monkeypatch.setattr(phrases, "word_counts", lambda docs, least: spark.createDataFrame([("x", "", 10**13), ("x", "p", big + 1), ("x", "q", big + 7)], "lang string, word string, n long"))
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: spark.createDataFrame([("x", "p q", big)], "lang string, phrase string, a long"))
    (row,) = phrases.collocations(frame(spark, [(1, "p q", "x")])).collect()
    assert row.score == int(Fraction(10**6 * big * big, (big + 1) * (big + 7)))


# 12. Packing.

WORD_BPE = "word_bpe_49k.json"


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return public.path(WORD_BPE), Tokenizer.from_file(public.path(WORD_BPE))


def sequences_of(pieces, length):
    """Sequences by id, checked for gaps and length."""
    out = {}
    for r in pieces:
        out.setdefault(r.sequence_id, []).append(r)
    for held in out.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            assert r.length > 0
            at += r.length
        assert at <= length
    return out


def padding(sequences, length):
    fills = [sum(r.length for r in held) for held in sequences.values()]
    return sum(length - n for n in fills if n & (n - 1))


@pytest.mark.parametrize(("length", "parts"), [(4096, 3), (64, 7)])
def test_packing_is_an_exact_round_trip(spark, rows, length, parts):
    from legispark.llm.packing import pack

    path, tok = tokenizer()
    pieces = pack(frame(spark, rows, parts), path, 2, length).collect()
    sequences = sequences_of(pieces, length)
    docs = {}
    for r in pieces:
        docs.setdefault(r.document, []).append(r)
    got = []
    for held in docs.values():
        held.sort(key=lambda r: r.start)
        ids = b"".join(bytes(r.ids) for r in held)
        at = 0
        for r in held:
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(bytes(r.ids)))
            assert len(r.ids) == 4 * r.length
            at += r.length
        got.append((held[0].doc_id, tuple(np.frombuffer(ids, np.uint32).tolist())))
    want = [(i, (*tok.encode(t or "", add_special_tokens=False).ids, 2)) for i, t, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    total = sum(r.length for r in pieces)
    assert padding(sequences, length) <= (0.01 if length > 1000 else 0.2) * total


def test_packing_merges_windows_in_rounds(spark, monkeypatch):
    from legispark.llm import packing

    path, _ = tokenizer()
    monkeypatch.setattr(packing, "FAN_IN", 2)
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('word ', 150) AS text").repartition(9)
    pieces = packing.pack(docs, path).collect()
    sequences = sequences_of(pieces, 4096)
    assert sum(r.length for r in pieces) == 200 * 151
    assert padding(sequences, 4096) == 0
    assert len(sequences) <= 7 + 13


def test_pieces_are_not_cut_small():
    from legispark.llm.packing import LEAST, _Windows

    rng, windows = random.Random(2), _Windows(4096)
    sizes = [rng.randrange(1, 3000) for _ in range(4000)]
    for k, n in enumerate(sizes):
        windows.add((k, k, 0, n, np.zeros(n, np.uint32)))
    done = windows.emitted()
    for _, pieces in done:
        assert sum(len(p[4]) for p in pieces) > 4096 - 2 * LEAST
        assert all(len(p[4]) >= min(LEAST, p[3]) for p in pieces)
    assert sum(len(p[4]) for _, held in [*done, *windows.held.items()] for p in held) == sum(sizes)


def test_tokens_of_odd_texts():
    from legispark.llm.packing import _Tokenizer, tokenized
    from legispark.llm.words import as_bytes

    import pyarrow as pa

    path, tok = tokenizer()
    texts = ["", " ", "á ́b", "x<|endoftext|>y <|startoftext|>", "Don't\x0bstop\x0cnow\x1cA", "ΑΣ ΣΑΣ. İ", "a b c　d\u0085", "1234 ½ ² ٣", "漢字 ﷽ 👩‍👩‍👧", "a.b,c!?;:x 1.2 é.x x.é a—.b .'s a's.'t it's.", "...a...", "a.́"]
    ids, first = tokenized(_Tokenizer(path), *as_bytes(pa.array(texts)), 2)
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2], t


# 13. Ranked search.


def brute_ranks(rows, queries, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    docs = [(i, Counter(terms(t))) for i, t, *_ in rows if terms(t)]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in queries:
        found = []
        for i, c in docs:
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


QUERIES = [(1, "The same words"), (2, "w1 W2 w2 x"), (3, None), (4, "nothing here"), (4, "again z z Z"), (None, "é ß 漢字"), (5, ""), (6, "one")]


@pytest.mark.parametrize("size", [8 << 20, 2000])
def test_ranked_search(spark, rows, size):
    from legispark.llm import ranked

    queries = spark.createDataFrame([(i, t, 9, 9) for i, t in QUERIES], "item_id long, text string, rank int, item int")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in ranked.search(ranked.build_index(frame(spark, rows), size), queries).collect()]
    assert sorted(got, key=str) == brute_ranks(rows, QUERIES)


def test_ranked_search_in_blocks_of_queries(spark, rows, monkeypatch):
    from legispark.llm import ranked

    monkeypatch.setattr(ranked, "QUERY_BYTES", 12)
    queries = spark.createDataFrame([(str(i), t) for i, t in QUERIES], "item_id string, text string")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in ranked.search(ranked.build_index(frame(spark, rows)), queries, 3).collect()]
    assert sorted(got, key=str) == brute_ranks(rows, [(str(i), t) for i, t in QUERIES], 3)


def test_best_keeps_ties():
    from legispark.llm.ranked import best

    scores, ids = np.array([5, 7, 5, 0, 5, 9]), np.array([4, 3, 2, 1, 0, 9])
    known = np.array([True, True, True, True, False, True])
    assert best(scores, ids, known, 3).tolist() == [5, 1, 2]
    assert best(scores, ids, known, 9).tolist() == [5, 1, 2, 0, 4]


def test_empty_tables(spark):
    from legispark.llm.packing import pack
    from legispark.llm.phrases import collocations
    from legispark.llm.ranked import build_index, search

    empty, some = frame(spark, [], 1), frame(spark, [(1, "a b", "en")], 1)
    none = spark.createDataFrame([], "item_id long, text string")
    assert collocations(empty).collect() == []
    assert pack(empty, tokenizer()[0]).collect() == []
    assert search(build_index(empty), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []
    assert search(build_index(some), none).collect() == []
