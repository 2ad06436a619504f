"""Row positions without gathering the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zip_with_index(df: DataFrame, name: str = "index") -> DataFrame:
    """A 0-based position without gaps, in the order of the partitions. Two passes: rows a partition are counted, and each partition
    starts where those before it end. As a second run might deal the rows otherwise, they are kept between the passes: checkpointed
    where spark.checkpoint.dir is set, which outlives executors, else persisted. The counts (a row for each partition) are summed in
    a window."""
    placed = df.withColumn("_id", F.monotonically_increasing_id())
    placed = placed.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else placed.persist()
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_part", "_first", "_before")
