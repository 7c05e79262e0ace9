"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
NO_BREAK_SPACES = "\u00a0\u202f\u2007"
FILLER = r"(?:[._…]\s*){12,}"
FILLER_PLACEHOLDER = "[THÔNG TIN ĐỂ TRỐNG]"
MARKERS = ((r"^(\d+)\s*\.\s*", "."), (r"(?iu)^([a-zđ])\s*\)\s*", ")"), (r"^(\d+)\s*\)\s*", ")"))
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SEED_STOPWORDS = ("ban", "bo", "cac", "cho", "co", "cua", "dan", "dong", "hien", "hoi", "khong", "mot", "nhan", "nhung", "phap", "quyet", "quy", "so", "thanh", "theo", "thi", "tinh", "tren", "trong", "trung", "uy", "van", "va", "ve", "viec")
ACCENTED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵäëïöüñç"
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyaeiounc"


def collapse(text: Column) -> Column:
    """White space as single spaces, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def strip_zero_width(text: Column) -> Column:
    return F.translate(F.translate(text, NO_BREAK_SPACES, "   "), ZERO_WIDTH, "")


def normalize_marker(line: Column) -> Column:
    """A leading number or letter marker or bullet in its usual form; the first that fits is taken."""
    line = F.trim(line)
    out = F.when(line.rlike(r"^[•●▪▫◦‣⁃∙]"), F.trim(F.concat(F.lit("- "), F.regexp_replace(line, r"^[•●▪▫◦‣⁃∙]\s*", "")))).otherwise(line)
    for pattern, close in reversed(MARKERS):
        marked = F.trim(F.concat(F.regexp_extract(line, pattern, 1), F.lit(close + " "), F.trim(F.regexp_replace(line, pattern, ""))))
        out = F.when(line.rlike(pattern), marked).otherwise(out)
    return out


def normalize_line(line: Column) -> Column:
    line = F.regexp_replace(strip_zero_width(line), r"[ \t\f\x0B]+", " ")
    line = F.regexp_replace(line, FILLER, FILLER_PLACEHOLDER)
    return normalize_marker(F.trim(F.regexp_replace(line, r"\s+([,.;:!?])", "$1")))


def normalize_text(text: Column) -> Column:
    """Each line normalised; at most one blank line between others."""
    unified = F.regexp_replace(text, r"\r\n?", "\n")
    joined = F.array_join(F.transform(F.split(unified, "\n"), normalize_line), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def token_count(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), F.lit(0)).cast("long")


def sentences(text: Column) -> Column:
    """Pieces that end after one of .!?;: and white space."""
    return F.filter(F.split(text, r"(?<=[.!?;:])\s+"), lambda s: F.trim(s) != "")


def normalize_identifier(value: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(value), "–—", "--"), r"\s+", "")


def normalize_keyword(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def significant_tokens(value: Column) -> Column:
    """Distinct accent-free tokens of two characters or more that are no stop-words, sorted."""
    found = F.regexp_extract_all(F.translate(F.lower(F.coalesce(value, F.lit(""))), ACCENTED, PLAIN), F.lit("[a-z0-9đ]+"), F.lit(0))
    kept = F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*SEED_STOPWORDS))
    return F.array_sort(F.array_distinct(kept))


def preview(value: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no slash at the end of the path."""
    parts = [F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))]
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(parts[0], F.lit("://"), parts[1], path, query)


def deltas(text: Column, size: int = 180) -> Column:
    """A text as pieces: per paragraph, then at most ``size`` characters."""
    def cut(p: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.greatest(F.length(p), F.lit(1)) - 1) / size).cast("int"))
        return F.transform(starts, lambda i: F.substr(p, i * size + 1, F.lit(size)))

    return F.flatten(F.transform(F.filter(F.split(text, r"\n"), lambda p: p != ""), cut))
