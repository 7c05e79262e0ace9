"""Every query that SQL can express against DuckDB, and the others for rows. Operators of the llm subpackage have tests of their own."""

import duckdb
import pytest

from legispark.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return connection


def value(x):
    if x is None or x != x:
        return ""
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)[:19] if hasattr(x, "isoformat") else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(value(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall())


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
