"""Each query against its SQL, and each name of the inventory against the functions that are there."""

import os

import pytest
from pyspark.sql import functions as F

from tests.compare import database, differ
from weftline import functions
from weftline.queries import ORACLE_SQL, QUERIES

WIDE = ["time_functions", "theta_sketch_sets", "tuple_sketch_agg", "tuple_sketch_sets", "tuple_sketch_set_aggs"]


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, con):
    assert differ(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name]) is None


@pytest.fixture(scope="module")
def wide(spark, sf_dir, tmp_path_factory):
    """A folder of the tables with more keys of part and lineitem than a day has seconds or a sketch has places."""
    home = tmp_path_factory.mktemp("wide")
    for f in os.listdir(sf_dir):
        if f.split(".")[0] not in ("part", "lineitem"):
            os.symlink(f"{sf_dir}/{f}", home / f)
    part, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    copies = spark.range(500).withColumnRenamed("id", "i")
    part.crossJoin(copies).withColumn("p_partkey", F.col("p_partkey") + F.col("i") * 200).drop("i").write.parquet(str(home / "part.parquet"))
    # the last copies hold fewer combinations of flag and status than all
    lines.crossJoin(copies.where("i < 60")).where("i < 55 OR l_linestatus = 'F'").withColumn("l_partkey", F.col("l_partkey") + F.col("i") * 200).drop("i").write.parquet(str(home / "lineitem.parquet"))
    con = database(sf_dir)
    for t in ("part", "lineitem"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{home}/{t}.parquet/*.parquet')")
    return str(home), con


@pytest.mark.parametrize("name", WIDE)
def test_query_equals_sql_with_many_keys(name, spark, wide):
    home, con = wide
    assert differ(QUERIES[name](spark, home), con, ORACLE_SQL[name]) is None


def test_every_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES)


def test_groups_of_functions():
    assert all(hasattr(functions, g) for g in functions.__all__)
