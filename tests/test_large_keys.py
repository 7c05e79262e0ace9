"""Queries over keys as large as those of many times the test tables, against DuckDB."""

import duckdb
import pytest

from legispark.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def large(data, tmp_path_factory):
    """Suppliers and customers with keys of five to six digits, in part the same."""
    d, c = tmp_path_factory.mktemp("large"), duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (l_suppkey + 9995 AS l_suppkey) FROM '{data}/lineitem.parquet') TO '{d}/lineitem.parquet'")
    c.execute(f"COPY (SELECT * REPLACE (o_custkey % 20 + 9995 AS o_custkey) FROM '{data}/orders.parquet') TO '{d}/orders.parquet'")
    return str(d)


@pytest.mark.parametrize("name", ["verify_claims", "verify_verdicts"])
def test_numbers_of_five_digits_are_checked(spark, large, name):
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{large}/{t}.parquet'")
    want = c.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    got = QUERIES[name](spark, large).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_the_status_reads_every_page(spark, tmp_path):
    pages = [(i, f"u{i}", "<script>x</script>" if i == 2 else " \n " if i < 8 else "<p>a</p>") for i in range(1, 9)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.id, r.form): r.status for r in QUERIES["clean_status"](spark, str(tmp_path)).collect()}
    assert {i: got[i, "as it is"] for i in range(1, 9)} == {i: "no_visible_text" if i == 2 else "source_blank" if i < 8 else "ok" for i in range(1, 9)}
    assert got[8, "nothing"] == "cleaner_empty" and got[8, "unread"] == "parse_error" and got[8, "form 1"] == "source_null" and len(got) == 80
