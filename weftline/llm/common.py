"""What several operators of this folder share: table access, staged tables, batch bounds, components."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder this package lies in.
HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: White space that separates words: U+0020 and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, else the folder given to
    SparkContext.setCheckpointDir. Where neither is set, local mode gets a folder of its own; a cluster gets an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: stages are written there")
        where = tempfile.mkdtemp(prefix="spark-weftline-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@lru_cache(maxsize=64)
def staged_dir(app: str, where: str) -> str:
    """The folder of an application's staged tables, which goes when the driver's Python ends: results have been written by then."""
    path = f"{where}/weftline/{app}"
    spark = SparkSession.active()

    def drop() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone before
            delete(spark, path)

    atexit.register(drop)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage so that lost executors cost no rework."""
    spark = df.sparkSession
    path = f"{staged_dir(spark.sparkContext.applicationId, shared_dir(spark))}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        delete(df.sparkSession, file.rpartition("/")[0])


def python_tasks(spark: SparkSession) -> None:
    """Before a step with Python tasks: Arrow batches are bound by bytes, so that a batch of very long texts stays small (one
    constant for the session, unless it has its own); and the workers look for this package where the driver found it (elsewhere
    it comes with --py-files)."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    env = spark.sparkContext.environment
    if HOME not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [HOME, env.get("PYTHONPATH")]))


def per_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 256) -> DataFrame:
    """``fn`` over Arrow batches of ``df`` of at most ``rows`` rows."""
    python_tasks(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each connected part of the edges (a, b): (node, smallest node), without the smallest nodes themselves."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:  # shorten the chains
            short = new[new]
            if np.array_equal(short, new):
                break
            new = short
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


#: Parts that the rows of one group are dealt to when they meet what is known of the group.
GROUP_PARTS = 64


def part_of(by: str) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(GROUP_PARTS)).cast("int")


def parts_of(by: str) -> Column:
    """Aggregate: the parts that a group has rows in, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), part_of(by))).alias("_parts")


def met_parts(rows: DataFrame, groups: DataFrame, key: str, by: str, how: str = "inner", hint: str | None = None) -> DataFrame:
    """``rows`` with the columns of ``groups`` (key, _parts of ``rows`` by ``by``, ...). A group's rows meet them in GROUP_PARTS parts by
    the hash of ``by``, so no task meets a whole group."""
    parts = F.explode(F.expr(f"filter(sequence(0, {GROUP_PARTS - 1}), p -> getbit(_parts, p) = 1)"))
    dealt = groups.withColumn("_part", parts).drop("_parts")
    return rows.withColumn("_part", part_of(by)).join(dealt.hint(hint) if hint else dealt, [key, "_part"], how).drop("_part")


def with_group(rows: DataFrame, key: str, by: str, *facts: Column) -> DataFrame:
    """``rows`` with ``facts`` (aggregates, combined before their shuffle) of their group of ``key``, which is never NULL."""
    return met_parts(rows, rows.groupBy(key).agg(*facts, parts_of(by)), key, by)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v; any order, repeats allowed): (node, root) for each node but the roots, root the
    smallest node of its component. Alternating large and small stars: each round joins each edge with its end's smallest
    neighbour, part by part, so no node's neighbours are ever gathered in one place; rounds are staged in the shared folder."""
    def distinct(u: Column, v: Column, df: DataFrame) -> DataFrame:
        return df.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()

    e = stage(distinct(F.col("u"), F.col("v"), edges), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = distinct(F.col("v"), F.least("u", "m"), with_group(both, "u", "v", F.min("v").alias("m")).where("v > u"))
        pairs = with_group(large, "u", "v", F.min("v").alias("m"))
        small = distinct(F.col("u"), F.col("m"), pairs.select("u", "m").union(pairs.select("v", "m")))
        new = stage(small, "edges")
        digest = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))]
        if e.agg(*digest).first() == new.agg(*digest).first():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        unstage(e)
        e = new
