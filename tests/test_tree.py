"""The tree of a document against a reader that goes down the lines, and on small laws."""

import random
import re

import pytest

from legispark.operators import tree

CASE = re.IGNORECASE
HEADS = {
    "part": r"PHẦN\s+((?:THỨ\s+\S+)|[IVXLCDM]+|\d+[A-ZĐ]?)",
    "chapter": r"CHƯƠNG\s+([IVXLCDM]+|\d+[A-ZĐ]?)",
    "section": r"MỤC\s+([IVXLCDM]+|\d+[A-ZĐ]?)",
    "article": r"ĐIỀU\s+(\d+[A-ZĐ]?)",
    "appendix": r"(PHỤ\s+LỤC(?:\s+[IVXLCDM\d]+)?|MẪU\s+SỐ\s+\S+)",
}
EVENTS = ("part", "chapter", "section", "article", "appendix", "signature", "table_start")


def kind_of(line):
    for mark, kind in (("[[TABLE_START]]", "table_start"), ("[[TABLE_HEADERS]]", "table_headers"), ("[[TABLE_ROW]]", "table_row"), ("[[TABLE_END]]", "table_end")):
        if line.startswith(mark):
            return kind, None, None
    for kind in ("part", "chapter", "section", "article", "appendix"):
        if m := re.match(HEADS[kind] + r"(?=\s|[.:\-–—]|$)\s*(?:[.:\-–—]\s*)?(.*)$", line, CASE):
            return kind, m[1].strip(), m[2].strip(" \t.:-–—")
        if kind == "section" and (m := re.match(r"([IVXLCDM]+)[.)]\s+(.+)$", line, CASE)) and free(m[2]):
            return kind, m[1], m[2].strip(" \t.:-–—")
    if re.match(r"(?:KT\.|TM\.|TL\.|TUQ\.)\s+.+$|NƠI\s+NHẬN\s*:?\s*$", line, CASE):
        return "signature", None, None
    if re.match(r"\d{1,3}[a-zđ]?[.)]", line, CASE):
        return "number", None, None
    if re.match(r"[a-zđ]\d*[.)]", line, CASE):
        return "letter", None, None
    if re.match(r"[-–—•▪▫◦‣⁃∙]", line):
        return "bullet", None, None
    return "heading" if free(line) else "text", None, None


def free(line):
    if re.match(r"(?:QUYẾT\s+ĐỊNH|NGHỊ\s+QUYẾT|THÔNG\s+BÁO|NƠI\s+NHẬN|KÍNH\s+GỬI)\s*:?\s*$", line, CASE):
        return True
    letters = [c for c in line if c.isalpha()]
    return bool(letters) and len(line) <= 140 and sum(c.isupper() for c in letters) >= 0.9 * len(letters)


def titled(line, kind, strict):
    if kind in EVENTS or kind in ("number", "letter", "bullet", "table_headers", "table_row", "table_end") or len(line) > 180 or len(line.split()) > 18:
        return False
    if re.match(r"(?:Căn\s+cứ|Kính\s+gửi|Nơi\s+nhận|Thực\s+hiện|Điều\s+\d+)", line, CASE) or line[-1] in ".;?!":
        return False
    return not strict or (not re.search("[,;]", line) and len(line.split()) <= 14)


def reader(text):
    """Nodes (id, parent, type, label, title, title_inferred, text) of a document, in one pass down its lines."""
    lines = [(n, s.strip()) for n, s in enumerate((text or "").strip().split("\n"), 1) if s.strip()]
    tokens = [(n, s, *kind_of(s)) for n, s in lines]
    nodes, opened, signed = {}, {}, False

    def node(n, parent, kind, label=None, title=None, inferred=False, text=""):
        nodes[n] = [n, parent, kind, label, title, inferred, text]

    def deepest(*levels):
        return next((opened[c] for c in levels if c in opened), None)

    def loose(n, s, kind):
        m = re.match(r"(\d{1,3}[a-zđ]?[.)]|[a-zđ]\d*[.)]|[-–—•▪▫◦‣⁃∙])\s*(.*)$", s, CASE) if kind in ("number", "letter", "bullet") else None
        node(n, deepest("section", "chapter", "part", "appendix"), "list_item" if m else "heading" if kind == "heading" else "paragraph", ("-" if kind == "bullet" else m[1]) if m else None, text=m[2] if m else s)

    i = next((k for k, t in enumerate(tokens) if t[2] in EVENTS), None)
    if i is None:
        for n, s, kind, *_ in tokens:
            loose(n, s, kind)
        return list(nodes.values())
    if i:
        node(tokens[0][0], None, "preamble", text="\n".join(t[1] for t in tokens[:i]))
    while i < len(tokens):
        n, s, kind, label, title = tokens[i]
        inferred = signed and kind == "heading" and re.match(r"(?:DANH\s+MỤC|BẢNG|BIỂU)(?:\s|$)", s, CASE)
        if kind == "signature":
            opened, signed = {}, True
            node(n, None, "heading", text=s)
            i += 1
        elif kind == "table_start":
            node(n, deepest("section", "chapter", "part", "appendix"), "table")
            i += 1
            while i < len(tokens) and tokens[i][2] != "table_end":
                i += 1
            i += 1
        elif inferred or kind in ("appendix", "part", "chapter", "section"):
            name = title or ""
            took = not name and i + 1 < len(tokens) and titled(tokens[i + 1][1], tokens[i + 1][2], False)
            parents = {"appendix": (), "part": ("appendix",), "chapter": ("part", "appendix"), "section": ("chapter", "part", "appendix")}
            level = "appendix" if inferred else kind
            node(n, deepest(*parents[level]), level, s if inferred else label or s, tokens[i + 1][1] if took else name, bool(took))
            if not inferred:
                for c in ("appendix", "part", "chapter", "section")[("appendix", "part", "chapter", "section").index(kind) :]:
                    opened.pop(c, None)
            opened[level] = n
            if level == "appendix":
                signed = False
            i += 1 + bool(took)
        elif kind == "article":
            i += 1
            took = not title and i < len(tokens) and tokens[i][2] not in EVENTS and titled(tokens[i][1], tokens[i][2], True)
            node(n, deepest("section", "chapter", "part", "appendix"), "article", label, tokens[i][1] if took else title, bool(took))
            i += bool(took)
            clause, last = None, n
            while i < len(tokens) and tokens[i][2] not in EVENTS:
                m, s, kind = tokens[i][:3]
                if kind == "number":
                    x = re.match(r"(\d{1,3}[a-zđ]?)[.)]\s*(.*)$", s, CASE)
                    node(m, n, "clause", x[1], text=x[2])
                    clause = last = m
                elif kind == "letter":
                    x = re.match(r"([a-zđ]\d*)[.)]\s*(.*)$", s, CASE)
                    node(m, clause or n, "point", x[1], text=x[2])
                    last = m
                else:
                    nodes[last][6] = "\n".join(x for x in (nodes[last][6], s) if x)
                i += 1
        else:
            loose(n, s, kind)
            i += 1
    return list(nodes.values())


POOL = ["PHẦN I", "PHẦN THỨ HAI: CHUNG", "Chương II", "CHƯƠNG 3. Tên chương -", "MỤC 1", "MỤC 2: Đối tượng", "I. TỔNG QUAN", "ii) không phải", "Điều 1", "Điều 2. Phạm vi", "ĐIỀU 3a:", "PHỤ LỤC", "Phụ lục II", "MẪU SỐ 01", "KT. CHỦ TỊCH", "Nơi nhận:", "DANH MỤC VĂN BẢN", "BẢNG GIÁ", "Bảng giá", "BIỂU", "1. Khoản", "1.", "2) Hai", "a) Điểm", "đ. Khác", "- gạch", "• chấm", "QUYẾT ĐỊNH", "QUY ĐỊNH CHUNG", "Tên ngắn", "Một câu, có phẩy", "Một câu hết.", "Căn cứ Luật", "[[TABLE_START]]", '[[TABLE_HEADERS]]["a", "b"]', '[[TABLE_ROW]]["1", ""]', "[[TABLE_END]]", "", "  thụt vào  ", "x " * 30]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = ["\n".join(rng.choice(POOL) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    return [None, "", " \n ", "Chỉ văn xuôi.", "\n\nĐiều 1\n\nTên\n", *made]


def test_tree_against_a_reader(spark, texts):
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    got = {}
    for r in tree.document_tree(docs).collect():
        got.setdefault(r.doc_id, []).append([r.node_id, r.parent_id, r.type, r.label, r.title, r.title_inferred, r.text])
    for k, text in enumerate(texts):
        assert sorted(got.get(f"d{k}", [])) == sorted(reader(text)), text


def test_levels_are_those_of_the_parents(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    nodes = {(r.doc_id, r.node_id): r for r in tree.document_tree(docs).collect()}
    assert len(nodes) > 2000
    for (doc, _), r in nodes.items():
        assert r.level == (1 if r.parent_id is None else nodes[doc, r.parent_id].level + 1)
        assert r.parent_id is None or r.parent_id < r.node_id


def test_rows_without_an_id_or_with_one_id_stay_apart(spark):
    docs = spark.createDataFrame([(None, "Điều 1. A\nx"), (None, "Điều 1. B\ny"), (7, "Điều 1. C"), (7, "Điều 1. C")], "doc_id long, text string")
    got = tree.document_tree(docs).collect()
    assert sorted((r.doc_id or 0, r.title, r.text) for r in got) == [(0, "A", "x"), (0, "B", "y"), (7, "C", ""), (7, "C", "")]
    assert len({r.row for r in got}) == 4


def test_a_list_after_a_signature_is_an_appendix(spark):
    text = "Điều 1. Thi hành\nVăn bản này có hiệu lực.\n\nKT. CHỦ TỊCH\nPHÓ CHỦ TỊCH\nNguyễn Văn A\n\nDANH MỤC VĂN BẢN KÈM THEO\nSTT\nTên văn bản"
    got = {r.node_id: r for r in tree.document_tree(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert (got[1].type, got[1].text, got[4].type) == ("article", "Văn bản này có hiệu lực.", "heading")
    assert (got[8].type, got[8].label, got[8].title, got[8].title_inferred) == ("appendix", "DANH MỤC VĂN BẢN KÈM THEO", "STT", True)
    assert (got[10].type, got[10].parent_id, got[10].path) == ("paragraph", 8, "appendix=DANH MỤC VĂN BẢN KÈM THEO")


def test_whole_hierarchy_and_tables(spark):
    text = 'PHẦN I\nQUY ĐỊNH CHUNG\nCHƯƠNG I\nNHỮNG QUY ĐỊNH CHUNG\nMỤC 1\nPHẠM VI\nĐiều 1. Phạm vi điều chỉnh\n1. Văn bản này quy định\na) Nội dung A\ntiếp\n[[TABLE_START]]\n[[TABLE_HEADERS]]["STT", "Tên"]\n[[TABLE_ROW]]["1", " Văn  bản A"]\n[[TABLE_END]]'
    got = {r.node_id: r for r in tree.document_tree(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert [(k, got[k].type, got[k].parent_id, got[k].level) for k in sorted(got)] == [(1, "part", None, 1), (3, "chapter", 1, 2), (5, "section", 3, 3), (7, "article", 5, 4), (8, "clause", 7, 5), (9, "point", 8, 6), (11, "table", 5, 4)]
    assert got[7].path == "part=I/chapter=I/section=1"
    assert got[9].text == "Nội dung A\ntiếp"
    assert (got[11].headers, got[11].rows, got[11].line_end) == (["STT", "Tên"], [["1", "Văn bản A"]], 14)


def test_warnings(spark):
    text = "Điều 1. A\n1. x\n1. y\nđ) a\nĐ) b\nĐiều 2. B\nĐiều 2. C\na) m\na) n\n[[TABLE_START]]\n[[TABLE_ROW]]{"
    got = sorted((r.node_id, r.warning) for r in tree.tree_warnings(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect())
    assert got == [(1, "duplicate_clause_number:article=1"), (3, "duplicate_point_number:article=1,clause=1"), (6, "article_without_body:2"), (6, "duplicate_article_number:article=2,count=2,path="), (7, "duplicate_direct_point_number:article=2"), (10, "invalid_table_row:11"), (10, "unterminated_table:10")]


def test_the_texts_are_shuffled_once_and_no_lines_are_kept(spark, monkeypatch):
    written = []
    kept = tree.materialize
    monkeypatch.setattr(tree, "materialize", lambda df, name, *a: written.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange"))) or kept(df, name, *a))
    docs = spark.createDataFrame([(1, "Điều 1. A\n1. b\n[[TABLE_START]]\nx\n[[TABLE_ROW]] [\"c\"]\n[[TABLE_END]]\nđ\n[[TABLE_START]]\ny"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, tuple(r.warnings)) for r in tree.parsed(docs).select("doc_id", "warnings").collect())
    assert got == [(1, ("unexpected_table_line:4", "unexpected_table_line:9", "unterminated_table:8")), (2, ())]
    assert [n for n, _ in written] == ["parsed", "documents", "tree"] and dict(written)["tree"] == 1


def test_one_sort_serves_all_windows(spark):
    docs = spark.createDataFrame([(1, "Điều 1. A\n1. b")], "doc_id long, text string")
    plan = tree.read_lines(docs)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"\bSort \[", plan)) == 1 and len(re.findall(r"\bWindow \[", plan)) <= 3


def test_white_space_and_heads_as_the_patterns_have_them(spark):
    from pyspark.sql import functions as F

    from legispark.operators.structure import is_free_heading

    chars = spark.range(1, 0x3100).selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c", "id")
    odd = chars.filter("id < 55296").select("id", (F.regexp_replace("c", r"(?U)^\s+|\s+$", "") == "").alias("a"), (F.btrim("c", F.lit(tree.SPACE)) == "").alias("b")).filter("a <> b")
    assert odd.collect() == []
    rng = random.Random(4)
    lines = ["".join(rng.choice(rng.choice(("ABĐÊ", "abđê", " ,.1", "ÁǅʰA"))) for _ in range(rng.choice((1, 3, 10, 19, 20, 40, 139, 140, 141)))) for _ in range(600)]
    lines += ["A" * n + "b" * k for n in (8, 9, 17, 18, 19, 126, 127, 130) for k in (0, 1, 2, 14, 15)]
    letters, capitals = F.length(F.regexp_replace("line", r"[^\p{L}]", "")), F.length(F.regexp_replace("line", r"[^\p{Lu}]", ""))
    x = spark.createDataFrame([(s,) for s in lines], "line string").select("line", is_free_heading(F.col("line")).alias("got"), ((letters > 0) & (F.length("line") <= 140) & (capitals >= letters * 0.9)).alias("want"))
    assert x.filter("got <> want").collect() == [] and x.filter("want").count() > 10


@pytest.mark.parametrize("read", [lambda x: tree.tree_warnings(x), lambda x: tree.parsed(x).select("doc_id", "quality_flags", "parse_quality")], ids=["warnings", "quality"])
def test_texts_of_nodes_are_not_written(spark, monkeypatch, read):
    written = []
    kept = tree.materialize
    monkeypatch.setattr(tree, "materialize", lambda df, name, *a: written.append((name, df.columns)) or kept(df, name, *a))
    found = read(spark.createDataFrame([(1, "Điều 1. A\n1. b\n1. c"), (1, None)], "doc_id long, text string")).collect()
    assert "text" not in dict(written)["tree"] and found
