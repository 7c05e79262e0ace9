"""Queries: text functions, structure, query parsing and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legispark.functions import query_parse, text
from legispark.operators import sources, structure
from legispark.plans.base import query, table
from legispark.sources import html

TOKENS = "[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{TOKENS}'))::BIGINT AS tokens FROM documents")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


@query("SELECT doc_id, length(translate(text, chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279), ''))::BIGINT AS n, md5(translate(text, chr(8203), '')) AS digest FROM documents")
def strip_zero_width(spark: SparkSession, d: str) -> DataFrame:
    clean = text.strip_zero_width(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(clean).cast("long").alias("n"), F.md5(clean).alias("digest"))


ITEM = "CASE WHEN l_returnflag = 'A' THEN {0} WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN {1} WHEN l_returnflag = 'N' THEN {2} ELSE {3} END"


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """A line of each order item, with a marker as scans and pages have them."""
    number, supplier = F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")
    late = F.col("l_linestatus") == "F"
    line = (
        F.when(F.col("l_returnflag") == "A", F.concat(number, F.lit(" .  Nội   dung "), supplier, F.lit(" ;")))
        .when((F.col("l_returnflag") == "N") & late, F.concat(F.lit("Đ )  điểm "), supplier))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("  "), number, F.lit(" ) x\u00a0y\u200b")))
        .otherwise(F.concat(F.lit("•  mục "), supplier, F.lit(" ........................")))
    )
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), line.alias("line"))


MARK_SQL = """CASE WHEN regexp_matches(l, '^\\d+\\s*\\.\\s*') THEN trim(regexp_extract(l, '^(\\d+)', 1) || '. ' || trim(regexp_replace(l, '^\\d+\\s*\\.\\s*', '')))
WHEN regexp_matches(l, '(?i)^[a-zđ]\\s*\\)\\s*') THEN trim(left(l, 1) || ') ' || trim(regexp_replace(l, '(?i)^[a-zđ]\\s*\\)\\s*', '')))
WHEN regexp_matches(l, '^\\d+\\s*\\)\\s*') THEN trim(regexp_extract(l, '^(\\d+)', 1) || ') ' || trim(regexp_replace(l, '^\\d+\\s*\\)\\s*', '')))
WHEN regexp_matches(l, '^[•●▪▫◦‣⁃∙]') THEN trim('- ' || regexp_replace(l, '^[•●▪▫◦‣⁃∙]\\s*', '')) ELSE l END"""


@query("SELECT l_orderkey AS id, l_linenumber AS n, " + ITEM.format("l_linenumber || '. Nội   dung ' || l_suppkey || ' ;'", "'Đ) điểm ' || l_suppkey", "l_linenumber || ') x' || chr(160) || 'y' || chr(8203)", "'- mục ' || l_suppkey || ' ........................'") + " AS line FROM lineitem")
def normalize_marker(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("id", "n", text.normalize_marker(F.col("line")).alias("line"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, " + ITEM.format("l_linenumber || '. Nội dung ' || l_suppkey || ';'", "'Đ) điểm ' || l_suppkey", "l_linenumber || ') x y'", "'- mục ' || l_suppkey || ' [THÔNG TIN ĐỂ TRỐNG]'") + " AS line FROM lineitem")
def normalize_line(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("id", "n", text.normalize_line(F.col("line")).alias("line"))


LINE_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(x, '[ \\t\\f\\v]+', ' ', 'g'), '(?:[._…]\\s*){12,}', '[THÔNG TIN ĐỂ TRỐNG]', 'g'), '\\s+([,.;:!?])', '\\1', 'g'))"


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(list_transform(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {LINE_SQL}), lambda l: {MARK_SQL}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')) AS digest FROM documents""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("digest"))


@query("SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''))::BIGINT AS n FROM documents")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, i AS line_no, trim(l) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE trim(l) <> ''")
def line_tokens(spark: SparkSession, d: str) -> DataFrame:
    return structure.line_tokens(table(spark, d, "documents"))


#: Five small laws that have what invented prose lacks. The structure queries run on them, on a law made of each order and its items, and on all documents.
LAW = [
    (-1, "Căn cứ Luật A;\nPHẦN THỨ NHẤT\nCHƯƠNG I\nQUY ĐỊNH CHUNG\nĐiều 1. Phạm vi\n1. Khoản một\na) Điểm a\ntiếp theo\nb) Điểm b\n2. Khoản hai\nĐiều 2. Đối tượng\n1. Khoản\nMỤC 1\nĐiều 1. Lặp\nCHƯƠNG II. Khác\nĐiều 1. Lại\nTM. CHÍNH PHỦ\nPHỤ LỤC I\nBảng"),
    (-2, "QUYẾT ĐỊNH\nĐiều 1\nĐiều 1. Hai lần\n- gạch đầu dòng\nNơi nhận:\n"),
    (-3, "Chỉ có văn xuôi thôi.\n\nThêm một dòng."),
    (-5, 'Điều 1. Bảng giá\n[[TABLE_START]]\n[[TABLE_HEADERS]]["Mã", "Giá"]\n[[TABLE_ROW]]["a", "1"]\nlạc dòng\n[[TABLE_ROW]]{x}\n[[TABLE_ROW]]["b", ""]\n[[TABLE_END]]\nsau bảng\n[[TABLE_START]]\n[[TABLE_ROW]]["hở"]'),
    (-4, "I. TỔNG QUAN\n- mục\nThông báo\n1) một"),
]
LAW_SQL = "(VALUES " + ", ".join("({}, '{}')".format(i, t.replace("\n", "' || chr(10) || '")) for i, t in LAW) + ") law(doc_id, text)"
ORDER_SQL = """SELECT -1000 - o_orderkey AS doc_id, concat_ws(chr(10), CASE left(o_orderpriority, 1) WHEN '1' THEN 'PHẦN I' || chr(10) || 'QUY ĐỊNH CHUNG' WHEN '2' THEN 'CHƯƠNG II' WHEN '3' THEN 'MỤC 3: Đối tượng' WHEN '4' THEN 'Căn cứ Luật ' || o_custkey || ';' ELSE 'QUYẾT ĐỊNH' END,
  string_agg(CASE WHEN l_returnflag = 'A' THEN 'Điều ' || l_linenumber || '. Điều khoản ' || l_suppkey WHEN l_returnflag = 'N' THEN l_linenumber || '. Khoản ' || l_suppkey WHEN l_linestatus = 'F' THEN 'a) điểm ' || l_suppkey WHEN l_linestatus = 'O' THEN '- gạch ' || l_suppkey END, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus),
  CASE WHEN o_orderstatus = 'F' THEN 'TM. CHÍNH PHỦ' || chr(10) || 'DANH MỤC KÈM THEO' || chr(10) || 'STT' WHEN o_orderstatus = 'P' THEN '[[TABLE_START]]' || chr(10) || '[[TABLE_ROW]]["a", "' || o_custkey || '"]' || CASE WHEN o_custkey % 2 = 0 THEN chr(10) || '[[TABLE_END]]' ELSE '' END
    WHEN o_totalprice > 200000 THEN 'PHỤ LỤC I' || chr(10) || 'Biểu mẫu' END) AS text FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_custkey, o_orderstatus, o_totalprice"""
LAW_SQL = f"(SELECT doc_id::BIGINT AS doc_id, text FROM {LAW_SQL} UNION ALL {ORDER_SQL} UNION ALL SELECT doc_id, text FROM documents)"
HEAD = "(\\s|[.:\\-–—]|$)"
FREE = "(regexp_matches({0}, '(?i)^\\s*(?:QUYẾT\\s+ĐỊNH|NGHỊ\\s+QUYẾT|THÔNG\\s+BÁO|CHỈ\\s+THỊ|CÔNG\\s+VĂN|KẾ\\s+HOẠCH|BÁO\\s+CÁO|TỜ\\s+TRÌNH|NƠI\\s+NHẬN|KÍNH\\s+GỬI)\\s*:?\\s*$') OR (length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g')) > 0 AND length({0}) <= 140 AND length(regexp_replace({0}, '[^\\p{{Lu}}]', '', 'g')) >= 0.9 * length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g'))))"
KINDS = f"""toks AS (SELECT doc_id, i AS line_no, trim(l) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {LAW_SQL} law) WHERE trim(l) <> ''),
kinds AS (SELECT *, CASE WHEN starts_with(line, '[[TABLE_START]]') THEN 'table_start' WHEN starts_with(line, '[[TABLE_HEADERS]]') THEN 'table_headers' WHEN starts_with(line, '[[TABLE_ROW]]') THEN 'table_row' WHEN starts_with(line, '[[TABLE_END]]') THEN 'table_end' WHEN regexp_matches(line, '(?i)^\\s*PHẦN\\s+((THỨ\\s+\\S+)|[IVXLCDM]+|\\d+[A-ZĐ]?){HEAD}') THEN 'part' WHEN regexp_matches(line, '(?i)^\\s*CHƯƠNG\\s+([IVXLCDM]+|\\d+[A-ZĐ]?){HEAD}') THEN 'chapter'
WHEN regexp_matches(line, '(?i)^\\s*MỤC\\s+([IVXLCDM]+|\\d+[A-ZĐ]?){HEAD}') OR (regexp_matches(line, '(?i)^\\s*[IVXLCDM]+[.)]\\s+.+$') AND {FREE.format("regexp_extract(line, '(?i)^[IVXLCDM]+[.)]\\s+(.+)$', 1)")}) THEN 'section'
WHEN regexp_matches(line, '(?i)^\\s*ĐIỀU\\s+\\d+[A-ZĐ]?{HEAD}') THEN 'article' WHEN regexp_matches(line, '(?i)^\\s*(PHỤ\\s+LỤC(\\s+[IVXLCDM\\d]+)?|MẪU\\s+SỐ\\s+\\S+){HEAD}') THEN 'appendix'
WHEN regexp_matches(line, '(?i)^\\s*(KT\\.|TM\\.|TL\\.|TUQ\\.)\\s+.+$|^\\s*NƠI\\s+NHẬN\\s*:?\\s*$') THEN 'signature' WHEN regexp_matches(line, '(?i)^\\s*\\d{{1,3}}[a-zđ]?[.)]') THEN 'numbered_item'
WHEN regexp_matches(line, '(?i)^\\s*[a-zđ]\\d*[.)]') THEN 'lettered_item' WHEN regexp_matches(line, '^\\s*[-–—•▪▫◦‣⁃∙]') THEN 'bullet' WHEN {FREE.format("line")} THEN 'free_heading' ELSE 'text' END AS kind FROM toks),
lab AS (SELECT *, CASE kind WHEN 'part' THEN regexp_extract(line, '(?i)^PHẦN\\s+((THỨ\\s+\\S+)|[IVXLCDM]+|\\d+[A-ZĐ]?)', 1) WHEN 'chapter' THEN regexp_extract(line, '(?i)^CHƯƠNG\\s+([IVXLCDM]+|\\d+[A-ZĐ]?)', 1)
WHEN 'section' THEN coalesce(nullif(regexp_extract(line, '(?i)^MỤC\\s+([IVXLCDM]+|\\d+[A-ZĐ]?)', 1), ''), regexp_extract(line, '(?i)^([IVXLCDM]+)[.)]', 1)) WHEN 'article' THEN regexp_extract(line, '(?i)^ĐIỀU\\s+(\\d+[A-ZĐ]?)', 1)
WHEN 'appendix' THEN regexp_extract(line, '(?i)^(PHỤ\\s+LỤC(\\s+[IVXLCDM\\d]+)?|MẪU\\s+SỐ\\s+\\S+)', 1) END AS label FROM kinds)"""
LEVELS = {"appendix": ("signature",), "part": ("signature", "appendix"), "chapter": ("signature", "appendix", "part"), "section": ("signature", "appendix", "part", "chapter"), "article": ("signature", "appendix", "part", "chapter", "section")}
PATHS = KINDS + ", paths AS (SELECT *, " + ", ".join("nullif(last_value(CASE WHEN kind = '{0}' THEN label WHEN kind IN ({1}) THEN '' END IGNORE NULLS) OVER w, '') AS {0}".format(k, ", ".join(f"'{x}'" for x in v)) for k, v in LEVELS.items()) + " FROM lab WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


def _order_laws(spark: SparkSession, d: str) -> DataFrame:
    """A law of each order: a head by its priority, an article, clause or point of each item, an end by its status."""
    key, owner = F.col("l_suppkey").cast("string"), F.col("o_custkey").cast("string")
    said = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Điều "), "l_linenumber", F.lit(". Điều khoản "), key)).when(F.col("l_returnflag") == "N", F.concat("l_linenumber", F.lit(". Khoản "), key)).when(F.col("l_linestatus") == "F", F.concat(F.lit("a) điểm "), key)).otherwise(F.concat(F.lit("- gạch "), key))
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", said.alias("s")))).alias("x"))
    rank = F.substring("o_orderpriority", 1, 1)
    head = F.when(rank == "1", "PHẦN I\nQUY ĐỊNH CHUNG").when(rank == "2", "CHƯƠNG II").when(rank == "3", "MỤC 3: Đối tượng").when(rank == "4", F.concat(F.lit("Căn cứ Luật "), owner, F.lit(";"))).otherwise("QUYẾT ĐỊNH")
    tables = F.concat(F.lit('[[TABLE_START]]\n[[TABLE_ROW]]["a", "'), owner, F.lit('"]'), F.when(F.col("o_custkey") % 2 == 0, "\n[[TABLE_END]]").otherwise(""))
    tail = F.when(F.col("o_orderstatus") == "F", "TM. CHÍNH PHỦ\nDANH MỤC KÈM THEO\nSTT").when(F.col("o_orderstatus") == "P", tables).when(F.col("o_totalprice") > 200000, "PHỤ LỤC I\nBiểu mẫu")
    made = table(spark, d, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return made.select((-1000 - F.col("o_orderkey")).cast("long").alias("doc_id"), F.concat_ws("\n", head, F.array_join(F.transform("x", lambda x: x["s"]), "\n"), tail).alias("text"))


def law(spark: SparkSession, d: str) -> DataFrame:
    made = spark.createDataFrame(LAW, "doc_id long, text string").unionByName(_order_laws(spark, d))
    return made.unionByName(table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def _law(spark: SparkSession, d: str) -> DataFrame:
    return structure.classify(structure.line_tokens(law(spark, d)))


@query(f"WITH {KINDS} SELECT doc_id, line_no, kind, label FROM lab")
def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _law(spark, d).select("doc_id", "line_no", "kind", "label")


@query(f"WITH {KINDS} SELECT doc_id, line_no, {FREE.format('line')} AS heading FROM toks")
def free_heading(spark: SparkSession, d: str) -> DataFrame:
    return _law(spark, d).select("doc_id", "line_no", structure.is_free_heading(F.col("line")).alias("heading"))


@query(f"""WITH {KINDS}, n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nl, lead(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS nk FROM lab)
SELECT doc_id, line_no, CASE WHEN nk IN ('text', 'free_heading') AND NOT regexp_matches(nl, '[.;?!]$') AND NOT regexp_matches(nl, '(?i)^(Căn\\s+cứ|Kính\\s+gửi|Nơi\\s+nhận|Thực\\s+hiện)') THEN nl END AS title FROM n WHERE kind IN ('part', 'chapter', 'section', 'appendix')""")
def split_title(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("line_no")
    n = _law(spark, d).withColumn("_l", F.lead("line").over(w)).withColumn("_k", F.lead("kind").over(w)).filter(F.col("kind").isin(*structure.CONTAINERS))
    return n.select("doc_id", "line_no", F.when(structure.looks_like_title(F.col("_l"), F.col("_k")), F.col("_l")).alias("title"))


@query(f"""WITH {KINDS}, e AS (SELECT *, count(*) FILTER (WHERE kind = 'table_end') OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM lab),
s AS (SELECT *, min(CASE WHEN kind = 'table_start' THEN line_no END) OVER (PARTITION BY doc_id, t) AS line_start FROM e),
i AS (SELECT *, kind IN ('table_headers', 'table_row') AS pay, CASE kind WHEN 'table_headers' THEN substr(line, 18) WHEN 'table_row' THEN substr(line, 14) END AS body FROM s WHERE line_no >= line_start)
SELECT doc_id, line_start, max(line_no) AS line_end, count(*) FILTER (WHERE kind = 'table_row' AND json_valid(body)) AS n_rows, coalesce(max(body) FILTER (WHERE kind = 'table_headers'), '[]') AS headers,
concat_ws(',', string_agg(CASE WHEN pay AND NOT json_valid(body) THEN 'invalid_table_row:' || line_no WHEN NOT pay AND kind <> 'table_end' AND line_no > line_start THEN 'unexpected_table_line:' || line_no END, ',' ORDER BY line_no),
  CASE WHEN NOT bool_or(kind = 'table_end') THEN 'unterminated_table:' || line_start END) AS warnings FROM i GROUP BY doc_id, t, line_start""")
def parse_tables(spark: SparkSession, d: str) -> DataFrame:
    t = structure.tables(_law(spark, d))
    headers = F.when(F.size("headers") == 0, "[]").otherwise(F.concat(F.lit('["'), F.array_join("headers", '", "'), F.lit('"]')))
    return t.select("doc_id", "line_start", "line_end", F.size("rows").cast("long").alias("n_rows"), headers.alias("headers"), F.array_join("warnings", ",").alias("warnings"))


@query(f"WITH {PATHS} SELECT doc_id, line_no, appendix, part, chapter, section, article FROM paths")
def containment_path(spark: SparkSession, d: str) -> DataFrame:
    return structure.containment(_law(spark, d)).select("doc_id", "line_no", *structure.CONTAINERS, "article")


@query(f"WITH {PATHS} SELECT doc_id, line_no, kind FROM paths WHERE appendix IS NULL AND kind = 'article'")
def nodes_outside_appendix(spark: SparkSession, d: str) -> DataFrame:
    return structure.containment(_law(spark, d)).filter("appendix IS NULL AND kind = 'article'").select("doc_id", "line_no", "kind")


@query(f"""WITH {PATHS}, i AS (SELECT *, sum((kind IN ('article', 'numbered_item', 'lettered_item'))::INT) OVER (PARTITION BY doc_id, article ORDER BY line_no) AS item FROM paths WHERE article IS NOT NULL AND kind NOT IN ('appendix', 'part', 'chapter', 'section'))
SELECT doc_id, article, item::BIGINT AS item, string_agg(line, chr(10) ORDER BY line_no) AS text FROM i GROUP BY 1, 2, 3""")
def article_items(spark: SparkSession, d: str) -> DataFrame:
    return structure.article_items(_law(spark, d)).select("doc_id", "article", "item", "text")


STATS = f"WITH {KINDS}, s AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'part') AS parts, count(*) FILTER (WHERE kind = 'chapter') AS chapters, count(*) FILTER (WHERE kind = 'section') AS sections, count(*) FILTER (WHERE kind = 'appendix') AS appendices, count(*) FILTER (WHERE kind = 'article') AS articles, count(*) FILTER (WHERE kind = 'numbered_item') AS clauses, count(*) FILTER (WHERE kind = 'lettered_item') AS points, count(*) FILTER (WHERE kind = 'free_heading') AS headings, count(*) FILTER (WHERE kind = 'bullet') AS list_items FROM lab GROUP BY 1)"


@query(STATS + " SELECT * FROM s")
def node_stats(spark: SparkSession, d: str) -> DataFrame:
    return structure.node_stats(_law(spark, d)).drop("structure_type")


@query(STATS + """ SELECT doc_id, CASE WHEN articles > 0 AND parts + chapters + sections > 0 THEN CASE WHEN appendices > 0 THEN 'mixed_hierarchical' ELSE 'hierarchical_article_based' END WHEN articles > 0 THEN CASE WHEN appendices > 0 THEN 'mixed_article_appendix' ELSE 'article_based' END
WHEN appendices > 0 THEN 'appendix_or_form' WHEN parts + chapters + sections > 0 THEN 'hierarchical_no_articles' WHEN headings + list_items > 0 THEN 'semi_structured' ELSE 'free_form' END AS structure_type FROM s""")
def structure_type(spark: SparkSession, d: str) -> DataFrame:
    return structure.node_stats(_law(spark, d)).select("doc_id", "structure_type")


@query(f"WITH {PATHS} SELECT doc_id, concat_ws('/', coalesce(appendix, '-'), coalesce(part, '-'), coalesce(chapter, '-'), coalesce(section, '-')) AS path, label, count(*) AS n FROM paths WHERE kind = 'article' GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_articles(spark: SparkSession, d: str) -> DataFrame:
    return structure.duplicate_articles(_law(spark, d))


@query(f"WITH {KINDS} SELECT doc_id, line_no, CASE kind WHEN 'free_heading' THEN 'heading' WHEN 'bullet' THEN 'list_item' WHEN 'numbered_item' THEN 'list_item' WHEN 'lettered_item' THEN 'list_item' ELSE 'paragraph' END AS type FROM lab WHERE doc_id IN (SELECT doc_id FROM lab GROUP BY 1 HAVING count(*) FILTER (WHERE kind IN ('part', 'chapter', 'section', 'appendix', 'article')) = 0)")
def free_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of documents without articles, containers or appendices."""
    kind = F.col("kind")
    lines = _law(spark, d)
    free = structure.node_stats(lines).filter(F.col("structure_type").isin("semi_structured", "free_form")).select("doc_id")
    return lines.join(free, "doc_id", "left_semi").select("doc_id", "line_no", F.when(kind == "free_heading", "heading").when(kind.isin("bullet", "numbered_item", "lettered_item"), "list_item").otherwise("paragraph").alias("type"))


FLAGS = "list_filter([CASE WHEN n_chars > 50000 THEN 'severe:oversize' END, CASE WHEN n_chars > 5000 AND longest > 0.8 * n_chars THEN 'single_node' END, CASE WHEN lines >= 20 THEN 'many_lines' END], lambda x: x IS NOT NULL)"
FLAGS_FROM = "(SELECT doc_id, n_chars, len(string_split(text, chr(10))) AS lines, list_max(list_transform(string_split(text, chr(10)), lambda l: length(l))) AS longest FROM documents)"


def _flags(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    x = table(spark, d, "documents").select("doc_id", "n_chars", F.size(lines).alias("lines"), F.array_max(F.transform(lines, lambda v: F.length(v))).alias("longest"))
    flags = F.array_compact(F.array(F.when(F.col("n_chars") > 50000, "severe:oversize"), F.when((F.col("n_chars") > 5000) & (F.col("longest") > 0.8 * F.col("n_chars")), "single_node"), F.when(F.col("lines") >= 20, "many_lines")))
    return x.select("doc_id", flags.alias("flags"))


@query(f"SELECT doc_id, array_to_string({FLAGS}, ',') AS flags FROM {FLAGS_FROM}")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("doc_id", F.array_join("flags", ",").alias("flags"))


@query(f"SELECT doc_id, CASE WHEN len(list_filter({FLAGS}, lambda x: starts_with(x, 'severe:'))) > 0 THEN 'quarantine' WHEN len({FLAGS}) > 0 THEN 'review' ELSE 'ok' END AS quality FROM {FLAGS_FROM}")
def parse_quality(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("doc_id", F.when(F.exists("flags", lambda f: f.startswith("severe:")), "quarantine").when(F.size("flags") > 0, "review").otherwise("ok").alias("quality"))


#: What can become of a page: five other forms.
FORMS = {1: None, 2: "' '", 3: "'<p></p><script>x</script>'", 4: "'<p>--</p>'", 5: "'<p>a ' || url || '</p>'"}


#: What the cleaner can have made of a page: its own text, what is left without tags, a full stop, nothing, or no answer at all.
OUTCOMES = {"stripped": "trim(regexp_replace(html, '<[^>]*>', '', 'g'))", "stop": "'.'", "nothing": "''", "unread": "NULL"}
LABEL = """CASE WHEN clean <> '' THEN CASE WHEN regexp_matches(clean, '[\\p{L}\\p{N}]') THEN 'ok' ELSE 'no_meaningful_text' END WHEN html IS NULL THEN 'source_null' WHEN trim(html) = '' THEN 'source_blank' WHEN clean IS NULL THEN 'parse_error'
WHEN seen = '' THEN 'no_visible_text' WHEN NOT regexp_matches(seen, '[\\p{L}\\p{N}]') THEN 'no_meaningful_text' ELSE 'cleaner_empty' END"""
SEEN = "trim(regexp_replace(regexp_replace({0}, '<(script|style|noscript|title)\\b.*?(</(script|style|noscript|title)\\s*>|$)|<!--.*?(-->|$)', '', 'gis'), '<[^>]*>', '', 'g'))"
ALL_FORMS = f"""forms AS (SELECT page_id AS id, 'as it is' AS form, html FROM pages UNION ALL SELECT page_id, 'form ' || k, CASE k {" ".join(f"WHEN {k} THEN {v or 'NULL'}" for k, v in FORMS.items())} END FROM pages, (VALUES {", ".join(f"({k})" for k in FORMS)}) v(k)),
cleaned AS (SELECT *, {SEEN.format("html")} AS seen, {SEEN.format("html")} AS clean FROM forms UNION ALL SELECT page_id, name, html, {SEEN.format("html")}, clean FROM (""" + " UNION ALL ".join(f"SELECT page_id, '{k}' AS name, html, {v} AS clean FROM pages" for k, v in OUTCOMES.items()) + "))"


@query(f"WITH {ALL_FORMS} SELECT id, form, {LABEL} AS status FROM cleaned")
def clean_status(spark: SparkSession, d: str) -> DataFrame:
    """The label of every page as the cleaner leaves it, of the page in five other forms, and of four other ends of its cleaning."""
    pages = table(spark, d, "pages").select("page_id", "html", "url")
    form = lambda name, made: F.struct(F.lit(name).alias("form"), made.alias("html"))
    forms = F.array(form("as it is", F.col("html")), *(form(f"form {k}", F.expr(v or "NULL").cast("string")) for k, v in FORMS.items()))
    each = pages.select("page_id", F.inline(forms)).select(F.struct("page_id", "form").alias("page_id"), "html")
    own = html.clean_pages(each).select("id.page_id", "id.form", F.col("clean_status").alias("status"))
    ends = {"stripped": F.trim(F.regexp_replace("html", "<[^>]*>", "")), "stop": F.lit("."), "nothing": F.lit(""), "unread": F.lit(None).cast("string")}
    end = lambda k, clean: F.struct(F.lit(k).alias("form"), html.clean_status(F.col("html"), clean).alias("status"))
    other = pages.select("page_id", F.inline(F.array(*(end(k, v) for k, v in ends.items()))))
    return own.unionByName(other).select(F.col("page_id").alias("id"), "form", "status")


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g'))::BIGINT AS n FROM pages")
def strip_tags_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("n"))


@query("SELECT o_orderkey AS id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(o_orderpriority), '[a-z0-9đ]+'), lambda w: length(w) > 1))).array_to_string(' ') AS tokens FROM orders")
def significant_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(text.significant_tokens(F.col("o_orderpriority")), " ").alias("tokens"))


@query("SELECT id, base || CASE WHEN n > 1 THEN '::' || n ELSE '' END AS chunk_id FROM (SELECT c_custkey AS id, regexp_replace(c_mktsegment, '[^\\p{L}\\p{N}._-]+', '_', 'g') || '::' || c_nationkey AS base, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n FROM customer)")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey")
    base = F.concat_ws("::", F.regexp_replace("c_mktsegment", r"[^\p{L}\p{N}._-]+", "_"), F.col("c_nationkey").cast("string"))
    n = F.row_number().over(w)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(base, F.when(n > 1, F.concat(F.lit("::"), n.cast("string"))).otherwise("")).alias("chunk_id"))


@query("SELECT p_partkey AS id, concat_ws(chr(10), 'Văn bản: ' || p_name, CASE WHEN p_size > 25 THEN 'Số hiệu: ' || p_size END, 'Loại: ' || p_type, 'Nội dung: ' || p_brand) AS text FROM part")
def retrieval_text(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("p_size") > 25, F.concat(F.lit("Số hiệu: "), F.col("p_size").cast("string")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("\n", F.concat(F.lit("Văn bản: "), "p_name"), size, F.concat(F.lit("Loại: "), "p_type"), F.concat(F.lit("Nội dung: "), "p_brand")).alias("text"))


@query(f"SELECT p_partkey AS id, greatest(0, 60 - len(regexp_extract_all('Văn bản: ' || p_name || chr(10) || 'Loại: ' || p_type, '{TOKENS}')))::BIGINT AS left_over FROM part")
def token_budget_left(spark: SparkSession, d: str) -> DataFrame:
    crumbs = F.concat_ws("\n", F.concat(F.lit("Văn bản: "), "p_name"), F.concat(F.lit("Loại: "), "p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.greatest(F.lit(0), 60 - text.token_count(crumbs)).cast("long").alias("left_over"))


@query("SELECT l_orderkey AS id, 'Điều ' || l_orderkey || chr(10) || string_agg(l_linenumber || '. ' || l_returnflag || l_linestatus, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS text FROM lineitem GROUP BY 1")
def render_article(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))).alias("x"))
    lines = F.transform("x", lambda c: F.concat(c["l_linenumber"].cast("string"), F.lit(". "), c["l_returnflag"], c["l_linestatus"]))
    return li.select(F.col("l_orderkey").alias("id"), F.concat_ws("\n", F.concat(F.lit("Điều "), F.col("l_orderkey").cast("string")), F.array_join(lines, "\n")).alias("text"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, concat_ws(', ', CASE WHEN l_returnflag = 'R' THEN 'điểm ' || lower(l_linestatus) END, 'khoản ' || l_linenumber, 'Điều ' || l_orderkey) AS label FROM lineitem")
def citation_label(spark: SparkSession, d: str) -> DataFrame:
    point = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("điểm "), F.lower("l_linestatus")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.concat_ws(", ", point, F.concat(F.lit("khoản "), F.col("l_linenumber").cast("string")), F.concat(F.lit("Điều "), F.col("l_orderkey").cast("string"))).alias("label"))


@query("SELECT doc_id, md5(left(source || chr(10) || text, 12000)) AS digest FROM documents")
def context_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.substring(F.concat_ws("\n", "source", "text"), 1, 12000)).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(f) <= 80 THEN f ELSE rtrim(left(f, 79)) || '…' END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.preview(F.col("text"), 80).alias("preview"))


@query("SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS url FROM pages")
def normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.normalize_url(F.col("url")).alias("url"))


@query("SELECT page_id, host = 'example.com' OR host LIKE '%.example.com' OR host LIKE '%.gov.vn' AS official FROM (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)")
def official_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", sources.is_official(sources.host(F.col("url")), ("example.com",)).alias("official"))


@query("SELECT doc_id, p, i, substr(para, i * 180 + 1, 180) AS piece FROM (SELECT doc_id, p, para, unnest(range(0, (length(para) - 1) // 180 + 1)) AS i FROM (SELECT doc_id, unnest(range(0, len(ps))) AS p, unnest(ps) AS para FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: l <> '') AS ps FROM documents)))")
def answer_deltas(spark: SparkSession, d: str) -> DataFrame:
    paragraphs = F.posexplode(F.filter(F.split("text", "\n"), lambda p: p != ""))
    x = table(spark, d, "documents").select("doc_id", paragraphs.alias("p", "para")).select("doc_id", F.col("p").cast("long").alias("p"), F.posexplode(text.deltas(F.col("para"))).alias("i", "piece"))
    return x.withColumn("i", F.col("i").cast("long"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """A question of each order, in a form that its priority picks; orders that are pending also ask who will win."""
    rank, number = F.substring("o_orderpriority", 1, 1), (F.col("o_custkey") % 9000 + 1).cast("string")
    day = F.col("o_orderdate").cast("date")
    written = F.concat(F.lit("ngày "), F.dayofmonth(day), F.lit(" tháng "), F.month(day), F.lit(" năm "), F.year(day))
    asked = F.concat(F.lit("Vào ngày "), F.date_format(day, "dd/MM/yyyy"), F.lit(" quy định về thuế"))
    q = (
        F.when(rank == "1", F.concat(F.lit("Điều "), F.col("o_orderkey") % 50, F.lit(" khoản "), F.col("o_orderkey") % 7, F.lit(" Nghị định "), number, F.lit("/2020/NĐ-CP hiện hành?")))
        .when(rank == "2", F.when(F.col("o_custkey") % 2 == 0, asked).otherwise(written))
        .when(rank == "3", F.concat(F.lit("Văn bản nào thay thế "), number, F.lit(" / 2015/tt-btc")))
        .when(rank == "4", F.concat(number, F.lit("/2015/TT-BTC sửa đổi văn bản nào, còn hiệu lực không?")))
        .otherwise(F.concat(F.lit("Từ "), F.date_format(day, "yyyy-MM-dd"), F.lit(" đến "), F.date_format(F.date_add(day, 365), "yyyy-MM-dd")))
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(q, F.when(F.col("o_orderstatus") == "P", " Tòa sẽ tuyên ai thắng?").otherwise("")).alias("q"))


#: What is known of a question by the way it was made.
ASKED = "(SELECT o_orderkey AS id, left(o_orderpriority, 1) AS rank, (o_custkey % 9000 + 1)::VARCHAR AS number, o_orderkey AS k, o_orderdate::DATE AS day, o_orderstatus AS status FROM orders)"


@query(f"""SELECT id, CASE rank WHEN '1' THEN number || '/2020/NĐ-CP' WHEN '3' THEN number || '/2015/TT-BTC' WHEN '4' THEN number || '/2015/TT-BTC' ELSE '' END AS numbers, CASE rank WHEN '1' THEN (k % 50)::VARCHAR ELSE '' END AS articles, CASE rank WHEN '1' THEN (k % 7)::VARCHAR ELSE '' END AS clauses,
CASE rank WHEN '3' THEN 'REPLACES' WHEN '4' THEN 'AMENDS' ELSE '' END AS relations, CASE rank WHEN '3' THEN 'incoming' WHEN '4' THEN 'outgoing' END AS direction FROM {ASKED}""")
def parse_queries(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return _questions(spark, d).select("id", F.array_join(query_parse.document_numbers(q), ",").alias("numbers"), F.array_join(query_parse.provisions(q, "article"), ",").alias("articles"), F.array_join(query_parse.provisions(q, "clause"), ",").alias("clauses"), F.array_join(query_parse.relations(q), ",").alias("relations"), query_parse.direction(q).alias("direction"))


@query(f"SELECT id, CASE WHEN rank = '5' OR (rank = '2' AND day > DATE '1997-12-31') THEN NULL WHEN rank = '2' THEN day ELSE DATE '1997-12-31' END AS as_of, CASE WHEN rank = '5' THEN 'ambiguous' WHEN rank = '2' AND day > DATE '1997-12-31' THEN 'after_cutoff' END AS problem FROM {ASKED}")
def resolve_as_of(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("1997-12-31").cast("date")
    x = _questions(spark, d).select("id", query_parse.resolve_as_of(F.col("q"), F.lit(None).cast("date"), day, day).alias("r"))
    return x.select("id", "r.as_of", "r.problem")


@query(f"SELECT id, CASE rank WHEN '4' THEN 'status_lookup' WHEN '1' THEN 'current_law' WHEN '3' THEN 'current_law' ELSE 'historical' END AS intent FROM {ASKED}")
def temporal_intent(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("id", query_parse.temporal_intent(F.col("q")).alias("intent"))


@query(f"SELECT id, status = 'P' AS refused FROM {ASKED}")
def refusal_gate(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("id", F.col("q").rlike(query_parse.REFUSED).alias("refused"))
