"""Comparison, boolean logic, conditions and NULL handling, all with SQL's three values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.plumbing import column, const


def gt(left, right) -> Column:
    return column(left) > const(right)


def gte(left, right) -> Column:
    return column(left) >= const(right)


def lt(left, right) -> Column:
    return column(left) < const(right)


def lte(left, right) -> Column:
    return column(left) <= const(right)


def eq(left, right) -> Column:
    return column(left) == const(right)


def neq(left, right) -> Column:
    return column(left) != const(right)


def and_(left: Column, right: Column) -> Column:
    return left & right


def or_(left: Column, right: Column) -> Column:
    return left | right


def not_(c: Column) -> Column:
    return ~column(c)


def when(condition: Column, then: Any, otherwise: Any) -> Column:
    return F.when(condition, const(then)).otherwise(const(otherwise))


def is_null(c) -> Column:
    return column(c).isNull()


def is_not_null(c) -> Column:
    return column(c).isNotNull()


is_defined = is_not_null


def get_or_else(c, default: Any) -> Column:
    return F.coalesce(column(c), const(default))


def as_array(c) -> Column:
    """An array of the value, or an empty one for NULL."""
    return F.array_compact(F.array(column(c)))


def coalesce(*cs) -> Column:
    return F.coalesce(*map(column, cs))


def in_(c, values: list) -> Column:
    return column(c).isin(*values)


def between(c, lower, upper) -> Column:
    return column(c).between(const(lower), const(upper))


def greatest(*cs) -> Column:
    return F.greatest(*map(column, cs))


def least(*cs) -> Column:
    return F.least(*map(column, cs))


def null_if(left, right) -> Column:
    return F.nullif(column(left), const(right))


def if_null(left, right) -> Column:
    return F.ifnull(column(left), const(right))


def nvl2(test, value, alternative) -> Column:
    return F.nvl2(column(test), const(value), const(alternative))


def nanvl(left, right) -> Column:
    return F.nanvl(column(left), const(right))
