"""Tables and files: schemas checked at the boundary, missing optional columns added, sinks that replace whole."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def require_columns(df: DataFrame, required: Mapping[str, str], optional: Mapping[str, str] | None = None) -> DataFrame:
    """The required columns, cast, and the optional ones, as nulls where absent. Raises on a missing required column."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    columns = [F.col(c).cast(t).alias(c) for c, t in required.items()]
    columns += [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in (optional or {}).items()]
    return df.select(*columns)


def read_lake(spark: SparkSession, path: str, required: Mapping[str, str], optional: Mapping[str, str] | None = None) -> DataFrame:
    return require_columns(spark.read.parquet(path), required, optional)


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a file that holds one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def to_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order; what is missing is null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def write_lake(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
