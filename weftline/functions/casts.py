"""Casts between column types."""

from pyspark.sql import Column

from weftline.functions.plumbing import column


def to_long(c) -> Column:
    return column(c).cast("bigint")


def to_double(c) -> Column:
    return column(c).cast("double")


long_to_double = to_double


def to_string(c) -> Column:
    return column(c).cast("string")
