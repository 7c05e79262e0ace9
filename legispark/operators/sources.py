"""Where a document can be read: candidates from search results, their scores, and the cascade that picks one."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters of the tokens that are compared, hosts that are no source, and points.
PART = r"[0-9a-zà-ỹđ]+"
NOT_PUBLIC = ("huggingface.co", "github.com", "google.com")
NOT_READABLE = ("huggingface.co", "github.com", "raw.githubusercontent.com")
LOCAL = ("localhost", "127.0.0.1", "::1", "[::1]")
LEAST_SCORE, CACHE_DAYS = 90, 30


def compact(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^0-9a-zà-ỹđ]+", "")


def parts(value: Column) -> Column:
    """Distinct words of more than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(PART), F.lit(0)), lambda t: F.length(t) > 2))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))


def _any_in(value: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | value.contains(n)
    return out


def is_safe_url(url: Column) -> Column:
    h = host(url)
    return F.coalesce(F.lower(url).rlike("^https?://") & (h != "") & ~h.isin(*LOCAL) & ~h.endswith(".local") & ~_any_in(h, NOT_PUBLIC), F.lit(False))


def is_readable_source(url: Column) -> Column:
    return is_safe_url(url) & ~_any_in(host(url), NOT_READABLE)


def is_official(h: Column, domains: tuple[str, ...] = ()) -> Column:
    out = h.endswith(".gov.vn")
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return out


def candidate_score(url: Column, title: Column, snippet: Column, number: Column, document_title: Column, authority: Column, domains: tuple[str, ...] = ()) -> Column:
    """0 unless the number stands in the result and the title or the authority tells whose it is; else 70, 25 for an official host, up to 15 for the title, 10 for the authority."""
    said = F.concat_ws(" ", title, snippet, F.try_url_decode(url))
    said = F.coalesce(said, F.concat_ws(" ", title, snippet, url))
    has_number = (compact(number) != "") & F.contains(compact(said), compact(number))
    heard = parts(said)

    def share(value: Column, none: float) -> Column:
        own = parts(value)
        return F.when(F.size(own) == 0, none).otherwise(F.size(F.array_intersect(own, heard)) / F.size(own))

    titled, issued = share(document_title, 0.0), share(authority, 1.0)
    doubtful = (F.size(parts(authority)) > 0) & (issued < 0.5) & (titled < 0.35)
    points = F.lit(70) + F.when(is_official(host(url), domains), 25).otherwise(0) + F.least(F.lit(15), F.bround(15 * titled, 0).cast("int")) + F.when(issued >= 0.5, 10).otherwise(0)
    return F.when(F.coalesce(has_number & ~doubtful, F.lit(False)), points).otherwise(0).cast("long")


def search_text(number: Column, authority: Column, title: Column) -> Column:
    """What to search for: number and authority, or the title where there is no number."""
    quoted = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit('"'), c, F.lit('"')))
    return F.concat_ws(" ", quoted(number), quoted(authority), F.when(F.coalesce(number, F.lit("")) == "", quoted(F.substring(title, 1, 180))), F.lit("toàn văn"))


def fallback_url(query: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(query))


def direct_link(url: Column) -> Column:
    """The target of a redirect link (its url, q or u parameter), else the link."""
    target = F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://[^?]*\?(?:[^#]*&)?(?:url|q|u)=(https?(?:://|%3A%2F%2F|%3a%2f%2f)[^&#]+)", 1)
    return F.when(target != "", F.coalesce(F.try_url_decode(target), target)).otherwise(F.nullif(url, F.lit("")))


def resolve(documents: DataFrame, cached: DataFrame, candidates: DataFrame, today: Column, domains: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, url, status) of documents (document_id, number, title, authority, source_url).

    A verified, active source of the last ``CACHE_DAYS`` days comes first (``cached``: document_id, url, status, active,
    checked_on, score), then the corpus's own address if people can read it, then the best candidate (document_id, url,
    title, snippet) with ``LEAST_SCORE`` on an official host, then a search page.
    """
    held = cached.filter((F.col("status") == "VERIFIED") & F.col("active") & (F.col("checked_on") >= F.date_sub(today, CACHE_DAYS))).groupBy("document_id").agg(F.max_by("url", F.struct("score", "url")).alias("_cached"))
    known = documents.select("document_id", "number", F.col("title").alias("_title"), "authority")
    score = candidate_score(F.col("url"), F.col("title"), F.col("snippet"), F.col("number"), F.col("_title"), F.col("authority"), domains)
    scored = candidates.filter(is_safe_url(F.col("url"))).join(known, "document_id").select("document_id", "url", score.alias("score"))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("score"), "url"))).filter("_n = 1")
    best = best.filter((F.col("score") >= LEAST_SCORE) & is_official(host(F.col("url")), domains)).select("document_id", F.col("url").alias("_found"))
    out = documents.join(held, "document_id", "left").join(best, "document_id", "left")
    own = F.when(is_readable_source(F.col("source_url")), F.col("source_url"))
    url = F.coalesce("_cached", own, "_found", fallback_url(search_text(F.col("number"), F.col("authority"), F.col("title"))))
    status = F.when(F.col("_cached").isNotNull(), "VERIFIED").when(own.isNotNull(), "CORPUS_SOURCE").when(F.col("_found").isNotNull(), "VERIFIED").otherwise("GOOGLE_SEARCH")
    return out.select("document_id", url.alias("url"), status.alias("status"))


def store(stored: DataFrame, found: DataFrame, today: Column) -> DataFrame:
    """The stored sources with verified ones (document_id, url, title, score) put in by (document_id, url)."""
    new = found.select("document_id", "url", F.col("title").alias("_title"), F.col("score").alias("_score")).dropDuplicates(["document_id", "url"])
    both = stored.join(new, ["document_id", "url"], "full_outer")
    fresh = F.col("_score").isNotNull()
    return both.select("document_id", "url", F.when(fresh, F.col("_title")).otherwise(F.col("title")).alias("title"), F.when(fresh, F.col("_score")).otherwise(F.col("score")).alias("score"), F.when(fresh, "VERIFIED").otherwise(F.col("status")).alias("status"), F.when(fresh, True).otherwise(F.col("active")).alias("active"), F.when(fresh, today).otherwise(F.col("checked_on")).alias("checked_on"))


def describe(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """(document_id, original_url, resolved_url, status): what is known of each document's source."""
    best = stored.filter("status = 'VERIFIED' AND active").groupBy("document_id").agg(F.max_by("url", F.struct("score", "url")).alias("resolved_url"))
    out = documents.select("document_id", F.col("source_url").alias("original_url")).join(best, "document_id", "left")
    return out.withColumn("status", F.when(F.col("resolved_url").isNotNull(), "VERIFIED").otherwise("UNRESOLVED"))


def _walk(value: object) -> Iterator[tuple[str, str, str]]:
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            link = next((x[k] for k in ("url", "link", "href") if x.get(k)), None)
            if isinstance(link, str):
                first = lambda *names: str(next((x[k] for k in names if x.get(k)), ""))  # noqa: B023, E731
                yield link, first("title", "name"), first("snippet", "description", "content")
            todo += reversed([v for v in x.values() if isinstance(v, (list, dict))])


def extract_candidates(results: DataFrame) -> DataFrame:
    """(document_id, position, url, title, snippet) of every object with a link in search results (document_id, payload as JSON), at any depth.

    A payload that is no JSON, or null, has none. JSON of unknown depth is beyond a schema, so this is one Arrow pass.
    """
    kind = results.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    found = list(_walk(json.loads(raw or "null")))
                except ValueError:
                    continue
                at += [k] * len(found)
                rows += [(n, *x) for n, x in enumerate(found)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.string())))], names=["document_id", "position", "url", "title", "snippet"])

    return results.select("document_id", "payload").mapInArrow(run, f"document_id {kind}, position int, url string, title string, snippet string")
