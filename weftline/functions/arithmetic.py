"""Arithmetic under ANSI rules: overflow and division by zero are errors, the ``try_`` forms give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.plumbing import column

Operand = Column | str


def add(left: Operand, right: Operand) -> Column:
    return column(left) + column(right)


def sub(left: Operand, right: Operand) -> Column:
    return column(left) - column(right)


def mul(left: Operand, right: Operand) -> Column:
    return column(left) * column(right)


def div_int(left: Operand, right: Operand) -> Column:
    """Integral division, truncated towards zero, as an int."""
    return div_long(left, right).cast("int")


def div_long(left: Operand, right: Operand) -> Column:
    return F.call_function("div", column(left), column(right))


def div_double(left: Operand, right: Operand) -> Column:
    return column(left).cast("double") / column(right)


def mod(left: Operand, right: Operand) -> Column:
    """Remainder with the sign of the dividend."""
    return column(left) % column(right)


def pmod(left: Operand, right: Operand) -> Column:
    """Remainder that is never negative for a positive divisor."""
    return F.pmod(column(left), column(right))


def absolute(c: Operand) -> Column:
    return F.abs(column(c))


def negate(c: Operand) -> Column:
    return -column(c)


def try_add(left: Operand, right: Operand) -> Column:
    return F.try_add(column(left), column(right))


def try_subtract(left: Operand, right: Operand) -> Column:
    return F.try_subtract(column(left), column(right))


def try_multiply(left: Operand, right: Operand) -> Column:
    return F.try_multiply(column(left), column(right))


def try_divide(left: Operand, right: Operand) -> Column:
    """A double, or NULL for a divisor of zero."""
    return F.try_divide(column(left), column(right))


# one name for each operand width
add_int = add_long = add_double = add
sub_int = sub_long = sub_double = sub
mul_int = mul_long = mul_double = mul
mod_int = mod_long = mod
pmod_int = pmod_long = pmod
abs_int = abs_long = abs_double = absolute
negate_int = negate_long = negate_double = negate
try_add_int = try_add_long = try_add
try_subtract_long, try_multiply_long = try_subtract, try_multiply
try_divide_long = try_divide_double = try_divide
