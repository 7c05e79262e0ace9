"""Labels, dates, keys and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from legispark.functions.text import collapse

# Labels of the sources and what they mean.
STATUS_LABELS = {
    "còn hiệu lực": "EFFECTIVE",
    "hết hiệu lực toàn bộ": "EXPIRED",
    "hết hiệu lực một phần": "PARTIALLY_EFFECTIVE",
    "chưa xác định": "UNKNOWN",
    "ngưng hiệu lực": "SUSPENDED",
    "ngưng hiệu lực một phần": "PARTIALLY_EFFECTIVE",
    "chưa có hiệu lực": "NOT_YET_EFFECTIVE",
    "không còn phù hợp": "UNKNOWN",
}
RELATION_LABELS = {
    "thay thế": "REPLACES",
    "bãi bỏ": "REPEALS",
    "sửa đổi, bổ sung": "AMENDS",
    "văn bản bổ sung": "SUPPLEMENTS",
    "quy định chi tiết, hướng dẫn thi hành": "GUIDES",
    "văn bản hd, qđ chi tiết": "GUIDES",
    "hướng dẫn áp dụng": "GUIDES",
    "căn cứ": "CITES",
    "văn bản căn cứ": "CITES",
    "dẫn chiếu": "CITES",
    "văn bản dẫn chiếu": "CITES",
}
ACTIVE = ("EFFECTIVE", "PARTIALLY_EFFECTIVE")
POINT_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def _lookup(value: Column, labels: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.element_at(pairs, F.lower(collapse(value))), F.lit(default))


def legal_status(value: Column) -> Column:
    return _lookup(value, STATUS_LABELS, "UNKNOWN")


def relation_type(value: Column) -> Column:
    return _lookup(value, RELATION_LABELS, "RELATED_TO")


def parse_date(value: Column) -> Column:
    """The first of d/M/yyyy, yyyy-M-d and d-M-yyyy that fits; null if none does."""
    clean = collapse(value)
    return F.coalesce(*(F.try_to_date(clean, form) for form in ("d/M/yyyy", "yyyy-M-d", "d-M-yyyy")))


def article_key(path: Column, article: Column) -> Column:
    """``part=..|chapter=..|section=..|appendix=..|article=..`` with ``-`` where a level is missing."""
    levels = [F.concat(F.lit(f"{k}="), F.coalesce(F.element_at(path, k), F.lit("-"))) for k in ("part", "chapter", "section", "appendix")]
    return F.when(F.coalesce(article, F.lit("")) != "", F.concat_ws("|", *levels, F.concat(F.lit("article="), article)))


def provision_key(article: Column, clause: Column, point: Column) -> Column:
    parts = [F.concat(F.lit(f"{name}:"), F.lower(F.trim(F.coalesce(x, F.lit(""))))) for name, x in (("article", article), ("clause", clause), ("point", point))]
    return F.concat_ws("/", *parts)


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """The name-based UUID of version 5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.substr(variant, F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(nibble, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def effective_periods(status: Column, issued: Column, effective: Column, expiry: Column) -> Column:
    """array<struct(status, valid_from, valid_to, reason)>: none without a start, two where a transition is dated, else one. No transition date is invented."""
    start = F.coalesce(effective, issued)
    end = F.when(expiry > start, expiry)
    none = F.lit(None).cast("date")

    def period(s: Column | str, a: Column, b: Column, reason: str) -> Column:
        return F.struct((F.lit(s) if isinstance(s, str) else s).alias("status"), a.alias("valid_from"), b.alias("valid_to"), F.lit(reason).alias("reason"))

    snapshot = "derived_from_source_snapshot"
    return (
        F.when(start.isNull(), F.array().cast("array<struct<status:string,valid_from:date,valid_to:date,reason:string>>"))
        .when((status == "EXPIRED") & end.isNotNull(), F.array(period("EFFECTIVE", start, end, "derived_from_effective_and_expiry_dates"), period("EXPIRED", end, none, "derived_from_source_expiry_status")))
        .when(status == "EXPIRED", F.array(period("UNKNOWN", start, none, "expiry_transition_date_missing")))
        .when((status == "NOT_YET_EFFECTIVE") & (issued < effective), F.array(period("NOT_YET_EFFECTIVE", issued, effective, "derived_from_issued_and_effective_dates"), period("EFFECTIVE", effective, end, "scheduled_effective_date_from_source")))
        .otherwise(F.array(period(status, start, end, snapshot)))
    )
