"""Semi-structured values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.plumbing import column

parse_json, is_variant_null, schema_of_variant = F.parse_json, F.is_variant_null, F.schema_of_variant


def variant_get(c, path: str, kind: str) -> Column:
    return F.variant_get(column(c), path, kind)


def try_variant_get(c, path: str, kind: str) -> Column:
    return F.try_variant_get(column(c), path, kind)


def is_valid_variant(c) -> Column:
    return F.try_parse_json(column(c)).isNotNull()


def variant_explode(df: DataFrame, name: str) -> DataFrame:
    """``df`` with pos, key and value of each element of the variant column ``name``: a row each."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(name).outer()))
