"""Benchmark decontamination by a prefix-filtered set join (native).

A window (ten consecutive item words, or a whole shorter item) must be contained exactly, so of its tokens, ordered by
rarity, only the first is a necessary prefix: a document that holds the window holds its rarest word. Occurrences of
these words leave the scan together with the few words around them; the length bound (the whole window fits between
the ends of the document) and the positional bound (it starts where the rarest word's place in the window says) give at
most one candidate start per occurrence and window, and the words there are compared exactly. Texts are read twice, to
count and to look up, and never travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legispark.llm.storage import materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Item words up to which the benchmark side is broadcast; beyond it joins are shuffled.
BROADCAST_WORDS = 500_000
#: Distinct words up to which texts are filtered by a literal list before they are exploded; words of a piece of text.
FILTER_WORDS, PIECE_WORDS = 20_000, 4096


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; a null text has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def text_hash(text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def item_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(item_id, window words as one string) for every window; items without words have none."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("_words")).filter(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - width + 1, F.lit(1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("_words"), i, width))).alias("window"))


def _is_one_of(name: str, words: DataFrame) -> str:
    """SQL that tells whether ``name`` is one of the words, if they are few; else it is true, and the join that follows decides. Words are letters and digits, so they need no escape."""
    found = [r[0] for r in words.limit(FILTER_WORDS + 1).collect()]
    if len(found) > FILTER_WORDS:
        return "true"
    return f"{name} IN (" + ", ".join(f"'{w}'" for w in found) + ")" if found else "false"


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, with_hash: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated[, text_hash].

    Each row is judged on its own text, also where rows share a doc_id or have none; rows alike come back as often as
    they came. Null texts and empty items have no words; with an empty benchmark nothing is hit, and an empty table
    gives none. Items that share an item_id count once. Extra columns are not read.
    """
    # A row is known by its doc_id and the hash of its text; rows alike in both are hit alike.
    docs = docs.select("doc_id", text_hash(F.col("text")).alias("_row"), "text")
    windows = materialize(item_windows(benchmark.select("item_id", "text"), width), "windows")
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    small = windows.limit(BROADCAST_WORDS // width + 1).count() * width <= BROADCAST_WORDS
    near = F.broadcast if small else (lambda df: df)

    # Rarity: how often each benchmark word occurs in all documents.
    tokens = docs.select(words_of(F.col("text")).alias("_w")).select(F.explode(F.expr(f"filter(_w, w -> {_is_one_of('w', vocabulary)})")).alias("word"))
    counts = tokens.join(near(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    # The necessary prefix of each distinct window: its rarest word, and where that stands first in the window.
    entries = windows.select("window").distinct().select("window", F.posexplode("window").alias("offset", "word")).join(near(counts), "word", "left")
    ordered = Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "word", "offset")
    prefixes = entries.withColumn("_rank", F.row_number().over(ordered)).filter("_rank = 1").select("window", "word", "offset", F.coalesce("n", F.lit(0)).alias("n"))
    # A word that no document has rules its window out.
    prefixes = materialize(prefixes.filter("n > 0").select("word", "offset", "window"), "prefixes")

    # Occurrences of prefix words, with the words around them, piece by piece of a text. A piece has width - 1 words
    # more at either end, so that each window lies whole in the piece of its rarest word.
    rare = prefixes.select("word").distinct()
    begin = F.sequence(F.lit(0), F.greatest(F.size("_words") - 1, F.lit(0)), F.lit(PIECE_WORDS))
    piece = F.transform(begin, lambda s: F.struct(s.alias("s"), F.greatest(s - (width - 1), F.lit(0)).alias("b"), F.slice("_words", F.greatest(s - (width - 1), F.lit(0)) + 1, PIECE_WORDS + 2 * width - 2).alias("w")))
    pieces = docs.select("doc_id", "_row", words_of(F.col("text")).alias("_words")).select("doc_id", "_row", F.size("_words").cast("long").alias("n_words"), F.explode(piece).alias("x")).select("doc_id", "_row", "n_words", "x.*")
    found_in = F.expr(f"""transform(filter(transform(w, (v, j) -> struct(v AS word, j AS j)), x -> b + x.j >= s AND b + x.j < s + {PIECE_WORDS} AND {_is_one_of('x.word', rare)}),
      x -> struct(x.word AS word, b + x.j AS at, least(x.j, {width - 1}) AS lead, slice(w, greatest(x.j - {width - 1}, 0) + 1, least(x.j, {width - 1}) + {width}) AS around))""")
    met = materialize(pieces.select("doc_id", "_row", "n_words", "s", found_in.alias("met")), "met")

    # The words at the candidate places, compared exactly with the windows.
    key = F.struct("doc_id", "_row").alias("_key")
    places = met.filter(F.size("met") > 0).select(key, F.explode("met").alias("m")).select("_key", "m.*").join(near(prefixes.select("word", "offset", F.size("window").alias("_length")).distinct()), "word")
    fits = places.filter((F.col("lead") >= F.col("offset")) & (F.col("lead") - F.col("offset") + F.col("_length") <= F.size("around")))
    held = fits.select("_key", (F.col("at") - F.col("offset")).alias("start"), F.slice("around", F.greatest(F.col("lead") - F.col("offset"), F.lit(0)) + 1, F.col("_length")).alias("window"))
    hits = materialize(held.join(near(prefixes.select("window")), "window").select("_key", "start", "window").distinct(), "hits")
    spans = hits.groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.size("window")).alias("end")))).alias("_spans"))
    covered = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")),
        lambda a: a["n"],
    )
    items = windows.select(F.col("item_id").cast("string").alias("item"), "window").distinct()
    named = hits.select("_key", "window").distinct().join(near(items), "window").groupBy("_key").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    found = spans.select("_key", covered.cast("long").alias("n_hit")).join(named, "_key", "left").select(F.col("_key.doc_id").alias("_doc"), F.col("_key._row").alias("_text"), "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"))
    zero = F.lit(0).cast("long")
    out = met.filter("s = 0").select("doc_id", "_row", "n_words")
    out = out.join(found, out["doc_id"].eqNullSafe(found["_doc"]) & (out["_row"] == found["_text"]), "left")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.greatest(F.coalesce("n_items", zero), zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"), F.col("_row").alias("text_hash"))
    return out if with_hash else out.drop("text_hash")
