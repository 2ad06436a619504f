"""JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.functions.plumbing import column

to_json = F.to_json


def get_json_object(c, path: str) -> Column:
    return F.get_json_object(column(c), path)


def json_tuple(c, *keys: str) -> Column:
    """The values of top-level keys of an object, as an array of strings; the text is parsed once for all of them."""
    fields = StructType([StructField(k, StringType()) for k in dict.fromkeys(keys)])
    found = F.from_json(F.when(F.ltrim(column(c)).startswith("{"), column(c)), fields)
    values = F.transform(F.array(found), lambda s: F.array(*(s.getField(k) for k in keys)))  # a field of ``found`` itself would be parsed alone
    return F.get(values, F.lit(0))


def from_json(c, schema: str) -> Column:
    """Malformed text gives NULL fields."""
    return F.from_json(column(c), schema)


def schema_of_json(text: str) -> Column:
    return F.schema_of_json(F.lit(text))


def json_array_length(c, path: str = "$") -> Column:
    return F.json_array_length(F.get_json_object(column(c), path))


def json_object_keys(c, path: str = "$") -> Column:
    return F.json_object_keys(F.get_json_object(column(c), path))
