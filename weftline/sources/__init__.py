"""Sources and sinks: memory, frames, and Spark's file formats with a declared schema."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weftline.plans.dataset import Dataset
from weftline.plans.schema import struct_type

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, fmt: str = "parquet", kind: type | None = None, **options: Any) -> Dataset:
    """A file or folder. With a dataclass, JSON and CSV are read by its schema, and Parquet and ORC checked against it."""
    if fmt not in FORMATS:
        raise ValueError(f"one of {', '.join(FORMATS)}")
    reader = spark.read.options(**options)
    if kind is not None and fmt in ("json", "csv"):
        reader = reader.schema(struct_type(kind))
    return Dataset.from_frame(reader.format(fmt).load(path), kind)


def write(data: Dataset | DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options: Any) -> None:
    df = data.df if isinstance(data, Dataset) else data
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
