"""Incremental loads: a directory stream whose batches go through the same operators as a batch load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from legispark.operators.load import first_by


def stream_directory(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def upsert_stream(source: DataFrame, target: str, key: str, version: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest row per key in generations of ``target``; each batch writes the next one, so a replay of a batch gives the same table.

    The current generation is the greatest number under ``target``.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{target}/generation={number - 1}").unionByName(batch)
        first_by(rows, [key], F.desc(version)).write.mode("overwrite").parquet(f"{target}/generation={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _generations(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """The generations of each part, ascending."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/part=*/generation=*")
    found: dict[int, list[int]] = {}
    for status in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []:
        part, generation = (int(x.split("=")[1]) for x in status.getPath().toString().rstrip("/").split("/")[-2:])
        found.setdefault(part, []).append(generation)
    return {p: sorted(g) for p, g in found.items()}


def upsert_parts(source: DataFrame, target: str, key: str, version: str, checkpoint: str, parts: int = 256) -> StreamingQuery:
    """Keeps the latest row per key in ``parts`` hash parts of ``target``; a batch reads and rewrites only the parts that it touches.

    A batch writes generation ``number`` of a part from the last one before it, so a replay gives the same table; what
    is older than that one is removed. ``read_parts`` has the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        rows = batch.withColumn("part", part)
        touched = sorted(r[0] for r in rows.select("part").distinct().collect())  # no more than there are parts
        before = {p: [g for g in _generations(spark, target).get(p, []) if g < number] for p in touched}
        old = [f"{target}/part={p}/generation={g[-1]}" for p, g in before.items() if g]
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("part", part))
        latest = first_by(rows, [key], F.desc(version)).withColumn("generation", F.lit(number))
        latest.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "generation").parquet(target)
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for p, g in before.items():
            for n in g[:-1]:
                files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/part={p}/generation={n}"), True)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_parts(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The table that ``upsert_parts`` keeps: the last generation of each part."""
    paths = [f"{target}/part={p}/generation={g[-1]}" for p, g in sorted(_generations(spark, target).items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def event_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums per window and type of an event stream with late rows (ts, event_type, value). An extra beside the batch operators."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_available(source: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there now and stop."""
    source.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
