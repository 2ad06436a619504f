"""Mathematical functions over doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.plumbing import column

sqrt, cbrt, exp, expm1 = F.sqrt, F.cbrt, F.exp, F.expm1
log, log10, log2, log1p = F.log, F.log10, F.log2, F.log1p
sin, cos, tan, asin, acos, atan = F.sin, F.cos, F.tan, F.asin, F.acos, F.atan
sinh, cosh, tanh, asinh, acosh, atanh = F.sinh, F.cosh, F.tanh, F.asinh, F.acosh, F.atanh
degrees, radians, signum = F.degrees, F.radians, F.signum
pow_, hypot, atan2 = F.pow, F.hypot, F.atan2
pi, euler = F.pi, F.e
factorial, bin_ = F.factorial, F.bin
rand, randn = F.rand, F.randn


def round_(c, scale: int = 0) -> Column:
    """Half up."""
    return F.round(column(c), scale)


def bround(c, scale: int = 0) -> Column:
    """Half to even."""
    return F.bround(column(c), scale)


def floor(c) -> Column:
    """As a double (Spark alone gives a long)."""
    return F.floor(column(c)).cast("double")


def ceil(c) -> Column:
    return F.ceil(column(c)).cast("double")


def conv(c, from_base: int, to_base: int) -> Column:
    return F.conv(column(c), from_base, to_base)


def width_bucket(value, low, high, buckets) -> Column:
    return F.width_bucket(column(value), low, high, buckets)
