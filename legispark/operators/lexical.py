"""What a lexical query asks: phrases, the terms that must meet, and the groups that a document has to match."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legispark.functions.text import normalize_keyword
from legispark.operators.search import small, words

# Words of a query, the form of a yes-or-no question, phrases that stand for longer ones, and weights.
TOKEN = r"[0-9A-Za-zÀ-ỹĐđ]+(?:[/.-][0-9A-Za-zÀ-ỹĐđ]+)*"
YES_NO = r"(?iuU)^(.*?)\bcó\s+được\b(.+?)\bkhông\s*[?.!]*$"
EXPANSIONS = ((r"(?iuU)\bđơn\s+phương\s+chấm\s+dứt\s+hợp\s+đồng(?:\s+lao\s+động)?\b", "đơn phương chấm dứt hợp đồng lao động", 20.0),)
LONG_PHRASE, SHORT_PHRASE, CORE, NUMBER, HINT = 10.0, 4.0, 2.0, 10.0, 5.0


def safe_query(query: Column) -> Column:
    """A query without the marks that name fields: users ask for words only."""
    return F.regexp_replace(query, r"[\\:]", " ")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def phrases(query: Column) -> Column:
    """array<struct(phrase, boost)>: expansions, then subject and action of a yes-or-no question, or a whole short query."""
    flat = F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " "))
    parts = F.when(flat.rlike(YES_NO), F.array(F.regexp_extract(flat, YES_NO, 1), F.regexp_extract(flat, YES_NO, 2))).otherwise(F.when(F.size(tokens(flat)).between(2, 12), F.array(flat)).otherwise(F.array().cast("array<string>")))
    split = F.filter(F.transform(parts, tokens), lambda t: F.size(t) >= 2)
    made = F.transform(split, lambda t: F.struct(F.lower(F.array_join(t, " ")).alias("phrase"), F.when(F.size(t) >= 3, LONG_PHRASE).otherwise(SHORT_PHRASE).alias("boost")))
    known = F.array_compact(F.array(*(F.when(flat.rlike(p), F.struct(F.lit(e).alias("phrase"), F.lit(b).alias("boost"))) for p, e, b in EXPANSIONS)))
    return F.concat(known, made)


def core_terms(query: Column) -> Column:
    """The distinct words of the phrases but for expansions, if they are two to ten; else none."""
    flat = F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " "))
    expansions = F.array(*(F.lit(e) for _, e, _ in EXPANSIONS))
    own = F.filter(phrases(query), lambda p: ~(F.array_contains(expansions, p["phrase"]) & (F.lower(flat) != p["phrase"])))
    terms = F.array_distinct(F.flatten(F.transform(own, lambda p: F.split(p["phrase"], " "))))
    return F.when(F.size(terms).between(2, 10), terms).otherwise(F.array().cast("array<string>"))


def build_queries(queries: DataFrame) -> DataFrame:
    """(query_id, terms, phrases, core) from (query_id, query): what ``phrase_scores`` and BM25 take."""
    q = safe_query(F.col("query"))
    return queries.select("query_id", F.array_distinct(words(q)).alias("terms"), phrases(q).alias("phrases"), core_terms(q).alias("core"))


def phrase_scores(docs: DataFrame, built: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, doc_id, boost): the weights of the phrases that stand in a text word for word, and of a core all of whose terms do.

    A phrase is looked up by its second word, which is a whole word wherever the phrase stands, a core by its first;
    only documents that have such a word meet the query.
    """
    each = built.select("query_id", F.explode(F.concat(F.transform("phrases", lambda p: F.struct(F.split(p["phrase"], r"[^\p{L}\p{N}_]+").alias("w"), p["boost"].alias("boost"), F.lit(True).alias("ordered"))), F.when(F.size("core") > 0, F.array(F.struct(F.col("core").alias("w"), F.lit(CORE).alias("boost"), F.lit(False).alias("ordered")))).otherwise(F.array().cast("array<struct<w:array<string>,boost:double,ordered:boolean>>")))).alias("x"))
    each = each.select("query_id", F.filter("x.w", lambda w: w != "").alias("w"), "x.boost", "x.ordered").filter(F.size("w") > 0).withColumn("key", F.when(F.col("ordered") & (F.size("w") > 1), F.get("w", 1)).otherwise(F.get("w", 0)))
    d = docs.select("doc_id", words(F.col(text)).alias("_w"))
    keys = small(each.select("key").distinct())
    near = d.select("doc_id", F.explode(F.array_distinct("_w")).alias("key")).join(keys, "key").join(small(each), "key").select("doc_id", "query_id", "w", "boost", "ordered")
    joined = F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" "))
    phrase = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    met = near.join(d.select("doc_id", "_w"), "doc_id").filter(F.when(F.col("ordered"), F.contains(joined, phrase)).otherwise(F.size(F.array_except("w", "_w")) == 0))
    return met.groupBy("query_id", "doc_id").agg(F.sum("boost").alias("boost"))


def required_groups(docs: DataFrame, groups: Mapping[str, list[str]]) -> DataFrame:
    """Documents that match every group, each by any of its values; blank values and empty groups ask for nothing."""
    for name, values in groups.items():
        wanted = [" ".join(v.lower().split()) for v in values if v and v.strip()]
        if wanted:
            docs = docs.filter(normalize_keyword(F.col(name)).isin(*wanted))
    return docs


def structured_scores(scored: DataFrame, hints: DataFrame, fields: tuple[str, ...] = ("article", "clause", "point")) -> DataFrame:
    """Scores (query_id, doc_id, score and ``fields``) under hints (query_id, require, hint_<field> arrays).

    A query that names provisions requires them; else each that a row matches adds ``HINT``.
    """
    joined = scored.join(small(hints), "query_id")
    ok, bonus = F.lit(True), F.lit(0.0)
    for f in fields:
        asked = F.transform(F.coalesce(F.col(f"hint_{f}"), F.array().cast("array<string>")), lambda v: F.lower(F.trim(v)))
        hit = F.coalesce(F.array_contains(asked, normalize_keyword(F.col(f).cast("string"))), F.lit(False))
        ok = ok & ((F.size(asked) == 0) | hit)
        bonus = bonus + F.when(hit, HINT).otherwise(0.0)
    kept = joined.filter(~F.col("require") | ok)
    return kept.withColumn("score", F.when(F.col("require"), F.col("score")).otherwise(F.col("score") + bonus)).select(*scored.columns)
