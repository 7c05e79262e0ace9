"""What a legal question names: dates, document numbers, provisions, relations and intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and the wording of intents, of Vietnamese legal questions.
ISO_DATE = r"(?<!\d)(\d{4}-\d{1,2}-\d{1,2})(?!\d)"
NUMERIC_DATE = r"(?<!\d)(\d{1,2}[/-]\d{1,2}[/-]\d{4})(?!\d)"
TEXT_DATE = r"(?iuU)\bngày\s+(\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4})\b"
DOCUMENT_NUMBER = r"(?iuU)(?<![\w/])\d{1,4}\s*/\s*(?:\d{4}\s*/\s*)?[A-ZÀ-ỸĐ][A-ZÀ-ỸĐ0-9-]*"
PROVISIONS = {"article": r"(?iuU)\bđiều\s+(\d+[a-z]?)\b", "clause": r"(?iuU)\bkhoản\s+(\d+[a-z]?)\b", "point": r"(?iuU)\bđiểm\s+([a-zđ])\b"}
RELATIONS = {"AMENDS": r"(?iuU)\b(?:sửa đổi|điều chỉnh)\b", "SUPPLEMENTS": r"(?iuU)\bbổ sung\b", "REPEALS": r"(?iuU)\b(?:bãi bỏ|hủy bỏ)\b", "REPLACES": r"(?iuU)\bthay thế\b"}
STATUS_WORDS = r"(?iuU)\b(?:hiện\s+)?(?:còn|đã\s+hết|hết)\s+hiệu\s+lực\b|\btrạng\s+thái\s+hiệu\s+lực\b"
CURRENT_WORDS = r"(?iuU)\b(?:hiện\s+nay|hiện\s+hành|đang\s+áp\s+dụng|mới\s+nhất)\b"
PAST_WORDS = r"(?iuU)\b(?:vào|tại)\s+(?:ngày|thời\s+điểm)\b|\btrước\s+ngày\b|\btừng\s+quy\s+định\b"
REFUSED = r"(?iuU)\b(?:tòa|toà)\s+(?:án\s+)?sẽ\b|\bai\s+(?:sẽ\s+)?thắng\b|\bkhả\s+năng\s+thắng\b|\bdự\s+đoán\b|\bbị\s+phạt\s+bao\s+nhiêu\s+năm\b"


def dates(query: Column) -> Column:
    """array<date>, ISO dates first, then numeric, then written ones, without repeats."""
    iso = F.transform(F.regexp_extract_all(query, F.lit(ISO_DATE), F.lit(1)), lambda x: F.try_to_date(x, "yyyy-M-d"))
    numeric = F.transform(F.regexp_extract_all(query, F.lit(NUMERIC_DATE), F.lit(1)), lambda x: F.try_to_date(F.translate(x, "-", "/"), "d/M/yyyy"))
    written = F.transform(F.regexp_extract_all(query, F.lit(TEXT_DATE), F.lit(1)), lambda x: F.try_to_date(F.regexp_replace(x, r"(?iuU)\s+(?:tháng|năm)\s+", "/"), "d/M/yyyy"))
    return F.array_distinct(F.array_compact(F.concat(iso, numeric, written)))


def document_numbers(query: Column) -> Column:
    found = F.regexp_extract_all(query, F.lit(DOCUMENT_NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.upper(x), r"\s+", "")))


def provisions(query: Column, kind: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(PROVISIONS[kind]), F.lit(1)), lambda x: F.lower(x)))


def relations(query: Column) -> Column:
    return F.array_compact(F.array(*(F.when(query.rlike(p), name) for name, p in RELATIONS.items())))


def direction(query: Column) -> Column:
    """outgoing if the document number stands before the first relation word, incoming if after; null without both."""
    number = F.nullif(F.regexp_instr(query, F.lit(DOCUMENT_NUMBER)), F.lit(0))
    word = F.least(*(F.nullif(F.regexp_instr(query, F.lit(p)), F.lit(0)) for p in RELATIONS.values()))
    return F.when(number < word, "outgoing").when(word <= number, "incoming")


def temporal_intent(query: Column) -> Column:
    return F.when(query.rlike(STATUS_WORDS), "status_lookup").when(query.rlike(CURRENT_WORDS), "current_law").when((F.size(dates(query)) > 0) | query.rlike(PAST_WORDS), "historical").otherwise("current_law")


def resolve_as_of(query: Column, explicit: Column, cutoff: Column, today: Column) -> Column:
    """struct(as_of, problem): an explicit day, else the one date named, else the cutoff, else today."""
    found = dates(query)
    day = F.coalesce(explicit, F.get(found, 0), cutoff, today)
    problem = F.when(explicit.isNull() & (F.size(found) > 1), "ambiguous").when(day > cutoff, "after_cutoff")
    return F.struct(F.when(problem.isNull(), day).alias("as_of"), problem.alias("problem"))
