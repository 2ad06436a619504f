"""Column references, literals, names and structs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: Column | str) -> Column:
    """A column by name, or the column itself."""
    return F.col(c) if isinstance(c, str) else c


def cell(name: str) -> Column:
    return F.col(name)


def const(value: Any) -> Column:
    """A literal; lists become arrays, tuples structs, dicts maps, None NULL."""
    if isinstance(value, Column):
        return value
    if isinstance(value, list):
        return F.array(*map(const, value))
    if isinstance(value, tuple):
        return F.struct(*(const(v).alias(f"_{i}") for i, v in enumerate(value, 1)))
    if isinstance(value, dict):
        return F.create_map(*(const(x) for kv in value.items() for x in kv))
    return F.lit(value)


def named(c: Column | str, name: str) -> Column:
    return column(c).alias(name)


def struct(**fields: Column | str) -> Column:
    return F.struct(*(column(c).alias(n) for n, c in fields.items()))


def get_field(c: Column | str, name: str) -> Column:
    return column(c).getField(name)
