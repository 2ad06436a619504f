"""Aggregates."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.plumbing import column, const

count_distinct, count_if, approx_count_distinct = F.count_distinct, F.count_if, F.approx_count_distinct
sum_int = sum_long = sum_double = F.sum
sum_distinct, avg, max_, min_, max_by, min_by = F.sum_distinct, F.avg, F.max, F.min, F.max_by, F.min_by
collect, collect_set = F.collect_list, F.collect_set
std_dev, std_dev_pop, variance, variance_pop = F.stddev, F.stddev_pop, F.var_samp, F.var_pop
corr, covar_samp, covar_pop = F.corr, F.covar_samp, F.covar_pop
median, mode, kurtosis, skewness = F.median, F.mode, F.kurtosis, F.skewness
regr_avgx, regr_avgy, regr_count, regr_intercept, regr_r2 = F.regr_avgx, F.regr_avgy, F.regr_count, F.regr_intercept, F.regr_r2
regr_slope, regr_sxx, regr_sxy, regr_syy = F.regr_slope, F.regr_sxx, F.regr_sxy, F.regr_syy
bool_and, bool_or, bit_and, bit_or, bit_xor = F.bool_and, F.bool_or, F.bit_and, F.bit_or, F.bit_xor
grouping, grouping_id = F.grouping, F.grouping_id


def count() -> Column:
    return F.count(F.lit(1))


def first(c) -> Column:
    """The first value that is not NULL, in an order that is not fixed."""
    return F.first(column(c), ignorenulls=True)


def last(c) -> Column:
    return F.last(column(c), ignorenulls=True)


def any_value(c) -> Column:
    return F.any_value(column(c), F.lit(True))


@dataclass(frozen=True)
class TopN:
    """The values of the n rows of a group with the largest (``rising``: smallest) ``by``; equal ones by value. Rows whose ``by`` is
    NULL are left out. It stands among the aggregates of ``Dataset.group_by_agg`` and ``aggregate``, where each task keeps n rows of a
    group before anything is shuffled; ``gathered`` is a plain column for other places, which holds a whole group."""

    value: Column
    by: Column
    n: int
    rising: bool
    name: str = "top"

    def alias(self, name: str) -> TopN:
        return replace(self, name=name)

    @property
    def gathered(self) -> Column:
        rows = F.collect_list(F.when(self.by.isNotNull(), F.struct(self.by.alias("k"), self.value.alias("v"))))
        return F.transform(F.slice(F.sort_array(rows, asc=self.rising), 1, self.n), lambda x: x["v"]).alias(self.name)


def max_n(c, n: int) -> TopN:
    """The n largest values, falling."""
    return TopN(column(c), column(c), n, False)


def min_n(c, n: int) -> TopN:
    return TopN(column(c), column(c), n, True)


def max_by_n(value, key, n: int) -> TopN:
    """The values of the n largest keys; equal keys by value."""
    return TopN(column(value), column(key), n, False)


def min_by_n(value, key, n: int) -> TopN:
    return TopN(column(value), column(key), n, True)


def percentile(c, p) -> Column:
    return F.percentile(column(c), const(p))


def percentile_approx(c, p: float, accuracy: int = 10_000) -> Column:
    return F.percentile_approx(column(c), p, accuracy)


def median_approx(c, accuracy: int = 10_000) -> Column:
    return percentile_approx(c, 0.5, accuracy)


def histogram_numeric(c, bins: int) -> Column:
    return F.histogram_numeric(column(c), F.lit(bins))
