"""Tables that change by commits, and builds that go on where they died."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from legispark.operators.load import guarded_upsert
from legispark.sources import indexes
from legispark.sources.staged import InvalidStage, LostCommit, StagedTable

SCHEMA = StructType([StructField("id", LongType()), StructField("value", StringType()), StructField("at", IntegerType())])


def table(spark, tmp_path, **k):
    return StagedTable(spark, f"{tmp_path}/t", SCHEMA, "id", parts=4, **k)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(df):
    return {r.id: r.value for r in df.collect()}


def test_stage_validate_merge_commit(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.state() == (0, {}) and t.read().collect() == []
    assert t.load(frame(spark, [(k, "a", 1) for k in range(20)]), F.desc("at"), {"at": F.col("at") > 0}) == 1
    stage = t.stage(frame(spark, [(3, "b", 2), (3, "c", 3), (99, "d", 1)]))
    assert held(t.read()) == dict.fromkeys(range(20), "a")
    merged = t.merge(stage, F.desc("at"))
    assert held(t.read()) == dict.fromkeys(range(20), "a")
    assert len(merged.merged) <= 2 < len(t.state()[1])
    assert t.commit(merged) == 2
    assert held(t.read()) == dict.fromkeys(range(20), "a") | {3: "c", 99: "d"}
    assert held(t.read(1)) == dict.fromkeys(range(20), "a")
    before, after = t.state(1)[1], t.state(2)[1]
    assert sum(before.get(p) != f for p, f in after.items()) == len(merged.merged)


def test_rows_that_break_checks_do_not_get_in(spark, tmp_path):
    t = table(spark, tmp_path)
    with pytest.raises(InvalidStage, match="key: 1, value: 2"):
        t.load(frame(spark, [(None, "a", 1), (1, None, 1), (2, "", 1)]), F.desc("at"), {"value": F.col("value") != ""})
    assert t.commits() == []


def test_of_two_loads_one_is_told(spark, tmp_path):
    t = table(spark, tmp_path)
    t.load(frame(spark, [(1, "a", 1)]), F.desc("at"))
    one, two = (t.merge(t.stage(frame(spark, [(1, v, 2)])), F.desc("at")) for v in "xy")
    assert t.commit(one) == 2
    with pytest.raises(LostCommit):
        t.commit(two)
    assert held(t.read()) == {1: "x"}
    assert t.commits() == [1, 2]


def test_a_load_that_lost_merges_anew(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.load(frame(spark, [(1, "a", 1)]), F.desc("at"))
    other, merge, first = table(spark, tmp_path), t.merge, []

    def late(stage, order, combine=None):
        out = merge(stage, order, combine)
        if not first:
            first.append(other.load(frame(spark, [(1, "x", 2), (2, "y", 2)]), F.desc("at")))
        return out

    monkeypatch.setattr(t, "merge", late)
    assert t.load(frame(spark, [(1, "z", 3)]), F.desc("at")) == 3
    assert held(t.read()) == {1: "z", 2: "y"}


def test_a_load_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.load(frame(spark, [(1, "a", 1)]), F.desc("at"))
    t.merge(t.stage(frame(spark, [(1, "dead", 2)])), F.desc("at"))
    assert held(t.read()) == {1: "a"}
    # One that dies between its claim and its commit keeps others out until its claim is given up.
    files, claim = indexes._path(spark, f"{t.path}/claims/2")
    files.createNewFile(claim)
    with pytest.raises(LostCommit):
        t.load(frame(spark, [(1, "b", 2)]), F.desc("at"), tries=2)
    t.release(2)
    assert t.load(frame(spark, [(1, "b", 2)]), F.desc("at")) == 2
    t.release(2)
    assert held(t.read()) == {1: "b"}
    assert t.vacuum(keep=1) >= 3
    assert held(t.read()) == {1: "b"} and t.commits() == [2]


def test_merge_by_another_rule_and_parts_that_empty(spark, tmp_path):
    t = table(spark, tmp_path)
    t.load(frame(spark, [(k, "a", 0) for k in range(8)]), F.desc("at"))
    gone = lambda old, new: old.join(new.select("id"), "id", "left_anti").select(*old.columns)
    t.load(frame(spark, [(k, None, 1) for k in range(8)]), F.desc("at"), combine=gone)
    assert t.read().collect() == [] and t.state()[0] == 2
    schema = StructType([StructField("id", LongType()), StructField("value", StringType()), StructField("trusted", BooleanType())])
    g = StagedTable(spark, f"{tmp_path}/g", schema, "id")
    rows = lambda x: spark.createDataFrame(x, schema)
    merge = lambda old, new: guarded_upsert(old, new, "id", "trusted")
    g.load(rows([(1, "kept", True), (2, "old", False)]), F.col("value"))
    g.load(rows([(1, "x", False), (2, "new", False)]), F.col("value"), combine=merge)
    assert held(g.read()) == {1: "kept", 2: "new"}


def test_a_build_that_died_goes_on(spark, tmp_path):
    points = spark.createDataFrame([(k, [float(k)]) for k in range(100)], "point_id int, vector array<double>")
    index, seen, deadly = f"{tmp_path}/i", [], [2]

    def make(df):
        ids = sorted(r.point_id for r in df.select("point_id").collect())
        if len(seen) in deadly:
            deadly.clear()
            raise RuntimeError("killed")
        seen.append(ids)
        return df

    with pytest.raises(RuntimeError):
        indexes._build(spark, index, "vectors", "r", points, "point_id", 20, make, None)
    assert indexes._ranges(spark, index)["done"] == [0, 1]
    nothing = points.limit(0)  # the rows were read once: what is left comes from the ranges
    state = indexes._build(spark, index, "vectors", "r", nothing, "point_id", 20, make, None)
    assert state["complete"] and state["batches"] == 5
    assert sorted(i for ids in seen for i in ids) == list(range(100)) and all(max(a) < min(b) for a, b in zip(seen, seen[1:], strict=False))
    assert indexes.read_index(spark, index).count() == 100
    assert indexes._build(spark, index, "vectors", "r", nothing, "point_id", 20, make, None) == state
    indexes.upsert_points(spark, index, spark.createDataFrame([(3, [-3.0]), (500, [5.0])], points.schema))
    indexes.upsert_points(spark, index, spark.createDataFrame([(3, [-4.0])], points.schema))
    got = {r.point_id: r.vector[0] for r in indexes.read_index(spark, index).collect()}
    assert got == {k: float(k) for k in range(100)} | {3: -4.0, 500: 5.0}
