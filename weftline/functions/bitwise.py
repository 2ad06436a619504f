"""Bitwise functions; shift distances may be columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.plumbing import column, const

bit_count, bitwise_not = F.bit_count, F.bitwise_not


def bit_get(c, position) -> Column:
    return F.bit_get(column(c), const(position))


def shift_left(c, n) -> Column:
    return F.call_function("shiftleft", column(c), const(n))


def shift_right(c, n) -> Column:
    return F.call_function("shiftright", column(c), const(n))


def shift_right_unsigned(c, n) -> Column:
    return F.call_function("shiftrightunsigned", column(c), const(n))
