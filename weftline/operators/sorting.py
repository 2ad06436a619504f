"""Sorting by expressions and by Python keys. NULLs come first rising and last falling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from weftline.functions.plumbing import column


def order(specs: tuple[Any, ...]) -> list[Column]:
    """Columns, or (column, "asc" or "desc")."""
    return [getattr(column(s[0]), s[1])() if isinstance(s, tuple) else column(s) for s in specs]


def sort_by_key(df: DataFrame, key: Callable[[Row], Any], kind: str) -> DataFrame:
    names = df.columns
    schema = StructType([*df.schema.fields, StructField("_key", _parse_datatype_string(kind))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = Row(*names)
        for batch in batches:
            yield batch.assign(_key=[key(row(*v)) for v in batch.itertuples(index=False, name=None)])

    return df.mapInPandas(run, schema).orderBy("_key").drop("_key")
