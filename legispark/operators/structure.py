"""Document structure on plain lines: kinds, containment, items and counts, all as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of headings and items. Java needs (?iuU) for the case of all letters.
_END = r"(?=\s|[.:\-–—]|$)\s*(?:[.:\-–—]\s*)?(.*)$"
PATTERNS = {
    "part": r"(?iuU)^\s*PHẦN\s+((?:THỨ\s+\S+)|[IVXLCDM]+|\d+[A-ZĐ]?)" + _END,
    "chapter": r"(?iuU)^\s*CHƯƠNG\s+([IVXLCDM]+|\d+[A-ZĐ]?)" + _END,
    "section": r"(?iuU)^\s*MỤC\s+([IVXLCDM]+|\d+[A-ZĐ]?)" + _END,
    "article": r"(?iuU)^\s*ĐIỀU\s+(\d+[A-ZĐ]?)" + _END,
    "appendix": r"(?iuU)^\s*(PHỤ\s+LỤC(?:\s+[IVXLCDM\d]+)?|MẪU\s+SỐ\s+\S+)" + _END,
    "signature": r"(?iuU)^\s*(?:(?:KT\.|TM\.|TL\.|TUQ\.)\s+.+|NƠI\s+NHẬN\s*:?\s*)$",
    "numbered_item": r"(?iuU)^\s*(\d{1,3}[a-zđ]?)[.)]\s*(.*)$",
    "lettered_item": r"(?iuU)^\s*([a-zđ]\d*)[.)]\s*(.*)$",
    "bullet": r"^\s*[-–—•▪▫◦‣⁃∙]\s*(.*)$",
}
ROMAN_SECTION = r"(?iuU)^\s*([IVXLCDM]+)[.)]\s+(.+)$"
FREE_HEADINGS = r"(?iuU)^\s*(?:QUYẾT\s+ĐỊNH|NGHỊ\s+QUYẾT|THÔNG\s+BÁO|CHỈ\s+THỊ|CÔNG\s+VĂN|KẾ\s+HOẠCH|BÁO\s+CÁO|TỜ\s+TRÌNH|NƠI\s+NHẬN|KÍNH\s+GỬI)\s*:?\s*$"
TITLE_BLOCKERS = r"(?iuU)^\s*(?:Căn\s+cứ|Theo\s+đề\s+nghị|Xét\s+đề\s+nghị|Kính\s+gửi|Nơi\s+nhận|Thực\s+hiện|Quyết\s+định\s*:|Điều\s+\d+|\d{1,3}[a-zđ]?[.)]|[a-zđ]\d*[.)])"
#: Marks of table lines as the HTML cleaner writes them.
TABLE_MARKERS = {"table_start": "[[TABLE_START]]", "table_headers": "[[TABLE_HEADERS]]", "table_row": "[[TABLE_ROW]]", "table_end": "[[TABLE_END]]"}
TABLE_KINDS = tuple(TABLE_MARKERS)
CONTAINERS = ("appendix", "part", "chapter", "section")
STRUCTURAL = (*CONTAINERS, "article", "signature")


def line_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 1, line): stripped lines; blank ones count but are dropped."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("_i", "line"))
    return lines.select("doc_id", (F.col("_i") + 1).cast("long").alias("line_no"), F.trim("line").alias("line")).filter("line <> ''")


def is_free_heading(line: Column) -> Column:
    """A known heading, or at most 140 characters of whose letters nine in ten are capitals."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    # Of up to 140 letters at most 14 may be small, of up to 19 one: most lines are settled without counting.
    small = lambda n: line.rlike(rf"^(?:\P{{Ll}}*+\p{{Ll}}){{{n}}}")
    settled = (F.length(line) > 140) | small(15) | ((F.length(line) < 20) & small(2)) | ~line.rlike(r"\p{Lu}")
    return F.when(line.rlike(FREE_HEADINGS), True).when(settled, False).otherwise(capitals >= letters * 0.9)


def classify(lines: DataFrame) -> DataFrame:
    """Adds kind, label and title; the first pattern that fits decides."""
    line = F.col("line")
    roman = line.rlike(ROMAN_SECTION) & is_free_heading(F.regexp_extract(line, ROMAN_SECTION, 2))
    marked = F.coalesce(*(F.when(line.startswith(mark), name) for name, mark in TABLE_MARKERS.items()))
    kind = F.when(marked.isNotNull(), marked).when(line.rlike(PATTERNS["part"]), "part").when(line.rlike(PATTERNS["chapter"]), "chapter").when(line.rlike(PATTERNS["section"]) | roman, "section")
    for name in ("article", "appendix", "signature", "numbered_item", "lettered_item", "bullet"):
        kind = kind.when(line.rlike(PATTERNS[name]), name)
    kind = kind.when(is_free_heading(line), "free_heading").otherwise("text")
    label, title = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in ("part", "chapter", "article", "appendix"):
        label = F.when(F.col("kind") == name, F.regexp_extract(line, PATTERNS[name], 1)).otherwise(label)
        title = F.when(F.col("kind") == name, F.trim(F.regexp_extract(line, PATTERNS[name], 2))).otherwise(title)
    section = F.col("kind") == "section"
    usual = line.rlike(PATTERNS["section"])
    label = F.when(section & usual, F.regexp_extract(line, PATTERNS["section"], 1)).when(section, F.regexp_extract(line, ROMAN_SECTION, 1)).otherwise(label)
    title = F.when(section & usual, F.trim(F.regexp_extract(line, PATTERNS["section"], 2))).when(section, F.trim(F.regexp_extract(line, ROMAN_SECTION, 2))).otherwise(title)
    return lines.withColumn("kind", kind).withColumn("label", label).withColumn("title", title)


def looks_like_title(line: Column, kind: Column, strict: bool = False, most_chars: int = 180, most_words: int = 24) -> Column:
    """Whether a line can be the title of the heading before it."""
    kind_is_free = ~kind.isin(*TABLE_KINDS)
    words = F.size(F.split(F.trim(line), r"\s+"))
    ok = kind_is_free & ~kind.isin(*STRUCTURAL, "numbered_item", "lettered_item", "bullet") & (F.length(line) <= most_chars) & (words <= most_words) & ~line.rlike(TITLE_BLOCKERS) & ~line.rlike(r"[.;?!]$")
    return ok & ~line.rlike("[,;]") & (words <= 14) if strict else ok


def containment(tokens: DataFrame) -> DataFrame:
    """Adds appendix, part, chapter, section and article: the labels that are open at each line.

    Each level is reset when a higher one opens or a signature closes all. One sort by line serves all levels.
    """
    kind = F.col("kind")
    run = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    above: dict[str, tuple[str, ...]] = {"appendix": ("signature",), "part": ("signature", "appendix"), "chapter": ("signature", "appendix", "part"), "section": ("signature", "appendix", "part", "chapter"), "article": ("signature", "appendix", "part", "chapter", "section")}
    out = tokens
    for level, resets in above.items():
        # The last event of this level or above: its label if it is of this level, else nothing.
        event = F.when(kind == level, F.struct(F.col("label").alias("v"))).when(kind.isin(*resets), F.struct(F.lit(None).cast("string").alias("v")))
        out = out.withColumn(level, F.last(event, ignorenulls=True).over(run)["v"])
    return out


def tables(tokens: DataFrame) -> DataFrame:
    """(doc_id, line_start, line_end, headers, rows, warnings) of the tables of classified lines.

    A table runs from its start mark to the next end mark. Warnings: ``unexpected_table_line:n`` for a line that is no
    part of it, ``invalid_table_row:n`` for one that is no JSON array, ``unterminated_table:n`` where the end is missing.
    """
    in_order = Window.partitionBy("doc_id").orderBy("line_no")
    ended = tokens.withColumn("_t", F.count_if(F.col("kind") == "table_end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    begun = F.min(F.when(F.col("kind") == "table_start", F.col("line_no"))).over(Window.partitionBy("doc_id", "_t"))
    inside = ended.withColumn("_start", begun).filter("line_no >= _start")
    kind, line = F.col("kind"), F.col("line")
    content = F.trim(F.when(kind == "table_headers", F.substr(line, F.lit(len(TABLE_MARKERS["table_headers"]) + 1))).when(kind == "table_row", F.substr(line, F.lit(len(TABLE_MARKERS["table_row"]) + 1))))
    cells = F.transform(F.from_json(F.when(content.startswith("["), content), "array<string>"), lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    payload = kind.isin("table_headers", "table_row")
    warning = F.when(payload & cells.isNull(), F.concat(F.lit("invalid_table_row:"), "line_no")).when(~payload & (kind != "table_end") & (F.col("line_no") > F.col("_start")), F.concat(F.lit("unexpected_table_line:"), "line_no"))
    each = inside.select("doc_id", "_t", "_start", "line_no", "kind", cells.alias("_c"), warning.alias("_w"))
    listed = lambda condition, value: F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("line_no", value.alias("v"))))), lambda x: x["v"])
    found = each.groupBy("doc_id", "_t", "_start").agg(
        F.max("line_no").alias("line_end"),
        listed((F.col("kind") == "table_headers") & F.col("_c").isNotNull(), F.col("_c")).alias("_h"),
        listed((F.col("kind") == "table_row") & F.col("_c").isNotNull(), F.col("_c")).alias("rows"),
        listed(F.col("_w").isNotNull(), F.col("_w")).alias("_w"),
        F.bool_or(F.col("kind") == "table_end").alias("_ok"),
    )
    open_end = F.when(F.col("_ok"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("unterminated_table:"), "_start")))
    headers = F.coalesce(F.try_element_at("_h", F.lit(-1)), F.array().cast("array<string>"))
    return found.select("doc_id", F.col("_start").alias("line_start"), "line_end", headers.alias("headers"), "rows", F.concat("_w", open_end).alias("warnings"))


def article_items(tokens: DataFrame) -> DataFrame:
    """(doc_id, article, item, kind, label, text): clauses and points of articles; plain lines attach to the innermost open item."""
    inside = containment(tokens).filter(F.col("article").isNotNull() & ~F.col("kind").isin(*CONTAINERS))
    run = Window.partitionBy("doc_id", "article").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("kind").isin("article", "numbered_item", "lettered_item")
    grouped = inside.withColumn("item", F.sum(starts.cast("long")).over(run))
    joined = grouped.groupBy("doc_id", "article", "item").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "kind"))).alias("_x"))
    first = F.get("_x", 0)
    kind = F.when(first["kind"] == "numbered_item", "clause").when(first["kind"] == "lettered_item", "point").otherwise("article")
    label = F.when(kind == "clause", F.regexp_extract(first["line"], PATTERNS["numbered_item"], 1)).when(kind == "point", F.regexp_extract(first["line"], PATTERNS["lettered_item"], 1)).otherwise(F.col("article"))
    return joined.select("doc_id", "article", "item", kind.alias("kind"), label.alias("label"), F.array_join(F.transform("_x", lambda t: t["line"]), "\n").alias("text"))


def node_stats(tokens: DataFrame) -> DataFrame:
    """Counts of node kinds per document, and what its structure is called."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    counts = tokens.groupBy("doc_id").agg(n("part").alias("parts"), n("chapter").alias("chapters"), n("section").alias("sections"), n("appendix").alias("appendices"), n("article").alias("articles"), n("numbered_item").alias("clauses"), n("lettered_item").alias("points"), n("free_heading").alias("headings"), n("bullet").alias("list_items"))
    nested = (F.col("parts") + F.col("chapters") + F.col("sections")) > 0
    kind = (
        F.when((F.col("articles") > 0) & nested & (F.col("appendices") > 0), "mixed_hierarchical")
        .when((F.col("articles") > 0) & nested, "hierarchical_article_based")
        .when((F.col("articles") > 0) & (F.col("appendices") > 0), "mixed_article_appendix")
        .when(F.col("articles") > 0, "article_based")
        .when(F.col("appendices") > 0, "appendix_or_form")
        .when(nested, "hierarchical_no_articles")
        .when((F.col("headings") > 0) | (F.col("list_items") > 0), "semi_structured")
        .otherwise("free_form")
    )
    return counts.withColumn("structure_type", kind)


def duplicate_articles(tokens: DataFrame) -> DataFrame:
    """Article numbers that occur twice under one path."""
    path = F.concat_ws("/", *(F.coalesce(c, F.lit("-")) for c in CONTAINERS))
    return containment(tokens).filter("kind = 'article'").groupBy("doc_id", path.alias("path"), "label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def pack_groups(tokens: Column, target: int, most: int) -> Column:
    """A group number for each unit of an array of token counts: a unit opens a new group once the current one has reached the target or would exceed the most."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("g"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        new = (a["g"] < 0) | (a["sum"] >= target) | (a["sum"] + t > most)
        g = F.when(new, a["g"] + 1).otherwise(a["g"]).cast("int")
        return F.struct(F.when(new, t).otherwise(a["sum"] + t).cast("int").alias("sum"), g.alias("g"), F.concat(a["out"], F.array(g)).alias("out"))

    return F.aggregate(tokens.cast("array<int>"), start, step, lambda a: a["out"])
