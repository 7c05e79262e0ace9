"""Known results of single operators."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from legispark.functions import labels, text
from legispark.operators import chunking, evaluate, evidence, search, structure, temporal
from legispark.sources import html


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rank_fusion(spark):
    ranked = spark.createDataFrame([(1, "dense", "a", 0.9, 1), (1, "dense", "b", 0.8, 2), (1, "sparse", "b", 9.0, 1), (1, "sparse", "c", 8.0, 2)], "query_id int, source string, point_id string, raw_score double, rank int")
    assert [r.point_id for r in search.reciprocal_rank_fusion(ranked).orderBy("rank").collect()] == ["b", "a", "c"]


def test_ranking_metrics(spark):
    rankings = spark.createDataFrame([("1", "a", 1), ("1", "x", 2), ("2", "y", 1), ("2", "c", 2)], "case_id string, item string, rank int")
    grades = spark.createDataFrame([("1", "a", 1), ("1", "b", 1), ("2", "c", 1)], "case_id string, item string, grade int")
    r = evaluate.ranking_metrics(rankings, grades, 2).first()
    assert (r.recall, r.hit_rate, r.mrr) == (0.75, 1.0, 0.75)
    assert r.ndcg == pytest.approx(0.6220384732, abs=1e-6)


def test_percentiles(spark):
    x = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    assert tuple(x.agg(*evaluate.percentiles(F.col("v"), 0.5, 0.95)).first()) == (2.5, 3.85)


def test_historical_gate(spark):
    data = [("historical", "current", None, [], True, "VERIFIED"), ("current", "historical", None, [], True, "VERIFIED"), ("historical", "historical", "v1", ["v2"], True, "VERIFIED"), ("historical", None, None, [], False, "VERIFIED")]
    r = evaluate.historical_gate(spark.createDataFrame(data, "expected_kind string, actual_kind string, expected_version string, cited array<string>, available boolean, status string")).first()
    assert tuple(r) == (4, 1, 1, 1, 1, False)


@pytest.mark.parametrize("marker,groups", [("{}. ", ["1-2", "3-4", "5"]), ("{}) ", ["a-b", "c-d", "e"])])
def test_packing_of_five_units(spark, marker, groups):
    names = "12345" if "." in marker else "abcde"
    body = "\n".join(marker.format(n) + " ".join(["chữ"] * 298) for n in names)
    found = chunking.chunk_documents(spark.createDataFrame([(1, "Điều 1. Tên\n" + body)], "doc_id int, text string")).collect()
    assert [r.label for r in found if r.chunk_type.startswith(("clause", "point"))] == groups
    assert [r.is_indexable for r in found if r.chunk_type == "article_parent"] == [False]


@pytest.mark.parametrize("n,whole", [(50, True), (1190, True), (1300, False)])
def test_articles_stay_whole_up_to_the_limit(spark, n, whole):
    kinds = [r.chunk_type for r in chunking.chunk_documents(spark.createDataFrame([(1, "Điều 1. " + "từ " * n)], "doc_id int, text string")).collect()]
    assert (kinds == ["article"]) is whole


def test_every_line_is_in_a_chunk_and_none_is_too_long(spark):
    doc = "Mở đầu\nCHƯƠNG I\nĐiều 1. A\n1. x\nPHỤ LỤC I\nbảng\n" + "từ " * 3000
    found = chunking.chunk_documents(spark.createDataFrame([(1, doc)], "doc_id int, text string")).filter("is_indexable").collect()
    assert max(r.tokens for r in found) <= 1200
    joined = " ".join(r.text for r in found).split()
    assert sorted(joined) == sorted(doc.split())


def test_periods(spark):
    d = dt.date
    x = spark.createDataFrame([("EXPIRED", None, d(2020, 1, 1), d(2021, 1, 1)), ("EXPIRED", None, d(2020, 1, 1), None), ("EFFECTIVE", None, None, None)], "s string, i date, e date, x date")
    out = x.select(labels.effective_periods(F.col("s"), F.col("i"), F.col("e"), F.col("x")).alias("p")).collect()
    assert [(p.status, p.valid_from, p.valid_to) for p in out[0].p] == [("EFFECTIVE", d(2020, 1, 1), d(2021, 1, 1)), ("EXPIRED", d(2021, 1, 1), None)]
    assert [p.status for p in out[1].p] == ["UNKNOWN"]
    assert out[2].p == []


def test_half_open_periods(spark):
    p = spark.createDataFrame([("EFFECTIVE", dt.date(2026, 1, 1), dt.date(2027, 1, 1))], "status string, valid_from date, valid_to date")
    assert temporal.as_of(p, "2026-06-01").count() == 1
    assert temporal.as_of(p, "2027-01-01").count() == 0
    with pytest.raises(ValueError):
        temporal.as_of(p, "2026-06-01", [])


def test_uuid5(spark):
    name = "version:chunk"
    assert spark.range(1).select(labels.uuid5(F.lit(name))).first()[0] == str(uuid.uuid5(uuid.UUID(labels.POINT_NAMESPACE), name))


def test_html_tables_and_fillers():
    out = html.clean_html("<body><script>x</script><p>1 . A<b>B</b></p><table><tr><th>H</th><th>K</th></tr><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr></table>Tên: ................</body>")
    lines = out.split("\n")
    assert lines[0] == "1. AB"
    assert '[[TABLE_HEADERS]]["H", "K"]' in lines and '[[TABLE_ROW]]["a", "b"]' in lines and '[[TABLE_ROW]]["in"]' in lines
    assert lines[-1] == "Tên: [THÔNG TIN ĐỂ TRỐNG]"
    assert lines.index('[[TABLE_ROW]]["in"]') > lines.index('[[TABLE_ROW]]["a", "b"]')


def test_identifier_keeps_separators(spark):
    assert spark.range(1).select(text.normalize_identifier(F.lit(" 12/2020/NĐ–CP "))).first()[0] == "12/2020/nđ-cp"


def test_native_packing(spark):
    got = spark.range(1).select(structure.pack_groups(F.array(*map(F.lit, (300, 300, 300, 300, 300, 50))), 700, 1200)).first()[0]
    assert got == [0, 0, 0, 1, 1, 1]


def test_budget_skips_but_goes_on(spark):
    e = spark.createDataFrame([(1, 1, "a", 60), (1, 2, "b", 60), (1, 3, "c", 40)], "query_id int, position int, item string, tokens int")
    assert evidence.pack_budget(e, 100, 12).first()["items"] == "a,c"


def test_near_duplicates_of_evidence(spark):
    base = "Một quy định dài hơn bốn mươi ký tự để so sánh với nhau."
    e = spark.createDataFrame([(1, "a", base, 1), (1, "b", base + " Thêm.", 2), (1, "c", "khác", 3)], "query_id int, item string, text string, position int")
    assert {r.item: r.kept for r in evidence.near_duplicates(e).collect()} == {"a": True, "b": False, "c": True}


def test_quotes(spark):
    x = spark.createDataFrame([("một hai", "Không một  hai ba"), ("Một, hai ba bốn năm", "x một hai ba bốn năm y"), ("hai ba", "một"), ("", "a")], "q string, e string")
    assert [r[0] for r in x.select(evidence.quote_in(F.col("q"), F.col("e"))).collect()] == [True, True, False, False]


def test_zero_width_and_no_break_spaces(spark):
    assert html.clean_html("<p>a&nbsp;b\u200bc\u202fd</p>") == "a bc d"
    assert spark.range(1).select(text.strip_zero_width(F.lit("a\u00a0b\u200bc"))).first()[0] == "a bc"


def test_quote_matches_agree_with_the_pairwise_test(spark):
    texts = spark.createDataFrame([(1, "Không một  hai ba bốn năm sáu bảy tám"), (2, "xmột hai ba bốn năm sáu bảyx"), (3, "hai"), (4, None)], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, "một hai ba bốn năm sáu bảy"), (2, "Một, hai; ba bốn năm sáu bảy"), (3, "hai"), (4, "ba bốn năm sáu bảy"), (5, "")], "item_id int, text string")
    want = texts.withColumnRenamed("text", "t").crossJoin(quotes).filter(evidence.quote_in(F.col("text"), F.col("t"))).select("item_id", "doc_id")
    assert sorted(rows(evidence.quote_matches(quotes, texts))) == sorted(rows(want)) != []
