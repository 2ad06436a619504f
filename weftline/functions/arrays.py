"""Array functions and generators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.plumbing import column, const

array_size, array_distinct, flatten = F.size, F.array_distinct, F.flatten
array_union, array_intersect, array_except, arrays_overlap = F.array_union, F.array_intersect, F.array_except, F.arrays_overlap
array_max, array_min, array_compact, arrays_zip = F.array_max, F.array_min, F.array_compact, F.arrays_zip
explode, explode_outer, posexplode, inline = F.explode, F.explode_outer, F.posexplode, F.inline
array_repeat, array_sort_by = F.array_repeat, F.array_sort


def array_contains(a, value) -> Column:
    return F.array_contains(column(a), const(value))


def array_sort(a) -> Column:
    """Ascending, NULLs first."""
    return F.sort_array(column(a))


def element_at(a, index) -> Column:
    """1-based, negative from the end; NULL out of range."""
    return F.try_element_at(column(a), const(index))


def get(a, index) -> Column:
    """0-based; NULL out of range."""
    return F.get(column(a), const(index))


def array_slice(a, start, n) -> Column:
    return F.slice(column(a), start, n)


def array_append(a, value) -> Column:
    return F.array_append(column(a), const(value))


def array_prepend(a, value) -> Column:
    return F.array_prepend(column(a), const(value))


def array_insert(a, position, value) -> Column:
    return F.array_insert(column(a), const(position), const(value))


def array_remove(a, value) -> Column:
    return F.array_remove(column(a), const(value))


def array_position(a, value) -> Column:
    return F.array_position(column(a), const(value))


def array_join(a, delimiter: str, null_replacement: str | None = None) -> Column:
    return F.array_join(column(a), delimiter, null_replacement) if null_replacement is not None else F.array_join(column(a), delimiter)
