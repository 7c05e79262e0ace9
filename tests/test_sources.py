import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from legispark.sources import tables
from legispark.streaming.loads import read_parts, stream_directory, upsert_parts, upsert_stream


def test_required_and_optional_columns(spark):
    df = spark.createDataFrame([("1", "x")], "id string, t string")
    out = tables.require_columns(df, {"id": "long"}, {"t": "string", "u": "date"})
    assert out.dtypes == [("id", "bigint"), ("t", "string"), ("u", "date")]
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.require_columns(df, {"z": "long"})


def test_lake_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    tables.write_lake(df, f"{tmp_path}/lake", "t")
    assert tables.read_lake(spark, f"{tmp_path}/lake", {"id": "long", "t": "string"}).count() == 2
    (tmp_path / "x.json").write_text('[{"id": 1, "t": "a"},\n {"id": 2}]')
    assert tables.read_json_array(spark, f"{tmp_path}/x.json", df.schema).filter(F.col("t").isNull()).count() == 1
    assert tables.to_schema(df, StructType().add("t", "string").add("v", "integer")).columns == ["t", "v"]


def test_upsert_stream(spark, tmp_path):
    schema = StructType().add("id", "long").add("v", "long")
    for n, rows in enumerate([[(1, 1), (2, 1)], [(2, 2), (3, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        upsert_stream(stream_directory(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", "id", "v", f"{tmp_path}/cp").awaitTermination()
        got = {r.id: r.v for r in spark.read.parquet(f"{tmp_path}/out/generation={n}").collect()}
        assert got == [{1: 1, 2: 1}, {1: 1, 2: 2, 3: 1}][n]


def test_upsert_of_touched_parts(spark, tmp_path):
    schema, target = StructType().add("id", "long").add("v", "long"), f"{tmp_path}/out"
    assert read_parts(spark, target, schema).count() == 0
    want = {}
    for rows in [[(k, 1) for k in range(40)], [(2, 2), (50, 1)], [(2, 3), (2, 1)], [(2, 4)]]:
        for i, v in rows:
            want[i] = max(v, want.get(i, 0))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        upsert_parts(stream_directory(spark, f"{tmp_path}/in", schema), target, "id", "v", f"{tmp_path}/cp", parts=8).awaitTermination()
        assert {r.id: r.v for r in read_parts(spark, target, schema).collect()} == want
    kept = [len(list(p.glob("generation=*"))) for p in (tmp_path / "out").glob("part=*")]
    assert max(kept) == 2 and min(kept) == 1 and len(kept) == 8
