"""The rows that chunks are stored as: one declared projection of chunks and the metadata of their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from legispark.functions.text import collapse, token_count

# The fields in their order, the names under which sources have metadata, and the lines above a text.
SCHEMA = (
    "chunk_id string, doc_id string, parent_chunk_id string, parent_type string, chunk_type string, strategy string, is_indexable boolean, structure_type string, part string, chapter string, section string, appendix string, article string, clause string, point string, "
    "ordinal int, text string, retrieval_text string, approx_token_count long, overlap_text string, overlap_from_chunk_id string, overlap_token_count long, document_title string, document_number string, document_type string, authority string, issued_date string, effective_date string, "
    "expiry_date string, legal_status string, legal_field string, chunker_version string"
)
ALIASES = {
    "document_title": ("title", "document_title"),
    "document_number": ("so_ky_hieu", "document_number"),
    "document_type": ("loai_van_ban", "document_type"),
    "authority": ("co_quan_ban_hanh", "authority"),
    "issued_date": ("ngay_ban_hanh", "issued_date"),
    "effective_date": ("ngay_co_hieu_luc", "effective_date"),
    "expiry_date": ("ngay_het_hieu_luc", "expiry_date"),
    "legal_status": ("tinh_trang_hieu_luc", "legal_status"),
    "legal_field": ("linh_vuc", "legal_field"),
}
CRUMBS = (("Văn bản: ", "document_title"), ("Số hiệu: ", "document_number"), ("Loại văn bản: ", "document_type"), ("Cơ quan ban hành: ", "authority"))
TEMPORAL = (("Ngày có hiệu lực: ", "effective_date"), ("Ngày hết hiệu lực: ", "expiry_date"), ("Tình trạng hiệu lực: ", "legal_status"))
PLACES = (("Phần ", "part"), ("Chương ", "chapter"), ("Mục ", "section"), ("Phụ lục ", "appendix"))
UNSAFE = r"[^0-9A-Za-zÀ-ỹ_.:-]+"
VERSION = "1"


def first_of(metadata: Column, names: tuple[str, ...]) -> Column:
    """The first of the names under which a map has a value that is not blank."""
    return F.coalesce(*(collapse(F.element_at(metadata, n)) for n in names))


def safe_part(value: Column) -> Column:
    """A part of an id: runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value.cast("string"), F.lit(""))), UNSAFE, "_"), "^_+|_+$", "")


def chunk_ids(chunks: DataFrame, *parts: str) -> DataFrame:
    """Adds ``chunk_id``: doc_id and the parts that are not blank, joined by ``::``.

    Of chunks with one such id the first (by ordinal, then line_start) has it; another has its line behind it, or, if a
    chunk before it has that line too or it has none, its number among them.
    """
    said = F.filter(F.array(*(safe_part(F.col(p)) for p in parts)), lambda x: x != "")
    base = F.array_join(F.concat(F.array(safe_part(F.col("doc_id"))), said), "::")
    x = chunks.withColumn("_base", base)
    w = Window.partitionBy("_base").orderBy("ordinal", "line_start")
    x = x.withColumn("_n", F.row_number().over(w))
    line = F.when(F.col("_n") > 1, F.col("line_start"))
    same = F.row_number().over(Window.partitionBy("_base", line).orderBy("ordinal", "line_start"))
    by_line = F.concat(F.col("_base"), F.lit("::line_"), F.col("line_start").cast("string"))
    by_number = F.concat(F.col("_base"), F.lit("::dup_"), F.col("_n").cast("string"))
    return x.withColumn("chunk_id", F.when(F.col("_n") == 1, F.col("_base")).when(line.isNotNull() & (same == 1), by_line).otherwise(by_number)).drop("_base", "_n")


def retrieval_text(text: Column, temporal: bool = False) -> Column:
    """What is searched: lines of metadata, of the places a text stands in, then the text."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(name), c)) for name, c in (*CRUMBS, *(TEMPORAL if temporal else ()), *PLACES)]
    article = F.when(F.col("article").isNotNull(), F.concat(F.lit("Điều "), "article", F.when(F.coalesce(collapse(F.col("article_title")), F.lit("")) != "", F.concat(F.lit(": "), F.trim("article_title"))).otherwise("")))
    inner = [F.when(F.col(c).isNotNull(), F.concat(F.lit(name), c)) for name, c in (("Khoản ", "clause"), ("Điểm ", "point"))]
    return F.trim(F.concat_ws("\n", *lines, article, *inner, F.nullif(text, F.lit(""))))


def chunk_rows(chunks: DataFrame, metadata: DataFrame, temporal: bool = False) -> DataFrame:
    """The rows of ``SCHEMA``. ``chunks``: doc_id, parent_id, parent_type, chunk_type, strategy, is_indexable, structure_type,
    the places, article_title, ordinal, line_start, text and chunk_id; ``metadata``: (doc_id, metadata), a map of strings.

    A document without metadata has nulls; blank values are nulls; what is not indexable has no retrieval text.
    """
    about = metadata.select("doc_id", *(first_of(F.col("metadata"), names).alias(c) for c, names in ALIASES.items()))
    places = {c: collapse(F.col(c).cast("string")) for c in ("part", "chapter", "section", "appendix", "article", "clause", "point")}
    x = chunks.join(about, "doc_id", "left").withColumns(places).withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    x = x.withColumn("retrieval_text", F.when(F.col("is_indexable"), retrieval_text(F.col("text"), temporal)).otherwise(""))
    made = {"parent_chunk_id": F.col("parent_id"), "approx_token_count": token_count(F.col("retrieval_text")), "overlap_text": F.lit(None), "overlap_from_chunk_id": F.lit(None), "overlap_token_count": F.lit(0), "chunker_version": F.lit(VERSION)}
    schema = StructType.fromDDL(SCHEMA)
    return x.select(*(made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema))


def check_rows(rows: DataFrame) -> list[str]:
    """What is wrong with rows at the boundary: fields that are missing, more than there should be, or of another type."""
    want = {f.name: f.dataType for f in StructType.fromDDL(SCHEMA)}
    have = {f.name: f.dataType for f in rows.schema}
    wrong = [f"{n}: {have[n].simpleString()} for {t.simpleString()}" for n, t in want.items() if n in have and have[n] != t]
    return [f"missing: {n}" for n in want if n not in have] + [f"unknown: {n}" for n in have if n not in want] + wrong
