"""Where intermediate tables go: the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: set[tuple[int, str]] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder of its own only in local mode without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        named = context._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="legispark-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    except Exception:  # the JVM may be gone already
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    top = f"{shared_folder(spark)}/legispark-{spark.sparkContext.applicationId}"
    if (id(spark.sparkContext), top) not in _scratch:
        _scratch.add((id(spark.sparkContext), top))
        atexit.register(_delete_at_exit, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return it as read back.

    This cuts the lineage, and any executor can reread the table when another one is lost. ``drop`` removes it;
    what is left goes when the application ends. ``rows_per_file`` is for rows of megabytes: a reader decodes as
    much as 4096 rows of a file at a time, however long they are.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._legispark_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_legispark_path", None)
    if path:
        _delete(df.sparkSession, path)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
