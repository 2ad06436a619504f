"""Sketches: KLL quantiles, and tuple and theta sketches as plain structs.

A tuple sketch is here (theta, entries): entries are (u, h, s), the k = 2**lg smallest key hashes at most, in order, each as a
number u from 0 to 1, the hash h and the summary s; theta is 1 while the sketch has seen no more than k keys, else the least u
that was left out. So the entries are all keys seen below theta, and (entries / theta) estimates their number, after set operations
too: those take the lesser theta of both sides and what both have below it. The bytes are not those of other libraries. The
summaries are doubles or longs (``kind``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions.plumbing import column, const

KINDS = ("bigint", "float", "double")
FOLDS = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}
SPAN = float(1 << 64)
#: Parts of a group that are ranked apart before its smallest hashes are ranked together.
PARTS = 64


def kll_sketch_agg(kind: str, c, k: int | None = None) -> Column:
    return F.call_function(f"kll_sketch_agg_{kind}", column(c), *([] if k is None else [F.lit(k)]))


def kll_merge_agg(kind: str, sketch) -> Column:
    return F.call_function(f"kll_merge_agg_{kind}", column(sketch))


def kll_merge(kind: str, left, right) -> Column:
    return F.call_function(f"kll_sketch_merge_{kind}", column(left), column(right))


def kll_n(kind: str, sketch) -> Column:
    return F.call_function(f"kll_sketch_get_n_{kind}", column(sketch))


def kll_quantile(kind: str, sketch, rank) -> Column:
    return F.call_function(f"kll_sketch_get_quantile_{kind}", column(sketch), const(rank))


def kll_rank(kind: str, sketch, quantile) -> Column:
    return F.call_function(f"kll_sketch_get_rank_{kind}", column(sketch), const(quantile))


def tuple_sketch(df: DataFrame, by: list[str], key: str, summary: str, lg: int = 12, mode: str = "sum", kind: str = "double") -> DataFrame:
    """One row a group of ``by`` with the column ``sketch``: summaries folded by ``mode`` (sum, min, max) over equal keys."""
    each = df.where(F.col(key).isNotNull()).groupBy(*by, F.xxhash64(key).alias("h")).agg(AGGREGATES[mode](summary).cast(kind).alias("s"))
    return _smallest(each.select(*by, unit(F.col("h")).alias("u"), "h", "s", F.lit(1.0).alias("t")), by, lg)


def or_empty(sketch, kind: str = "double") -> Column:
    """The sketch of no keys where there is none."""
    return F.coalesce(column(sketch), F.struct(F.lit(1.0).alias("theta"), F.array().cast(f"array<struct<u:double,h:bigint,s:{kind}>>").alias("entries")))


def _smallest(rows: DataFrame, by: list[str], lg: int) -> DataFrame:
    """Sketches of rows (by, u, h, s, t: theta so far). No task ranks a whole group: the smallest of each part go on."""
    most = (1 << lg) + 1
    for keys in ([*by, F.pmod("h", F.lit(PARTS))], by or [F.lit(0)]):
        order = Window.partitionBy(*keys).orderBy("u", "h")
        rows = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
    rows = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("u", "h", "s"))).alias("_e"), F.min("t").alias("_t"))
    return rows.select(*by, _cut(F.col("_t"), F.col("_e"), lg).alias("sketch"))


def _cut(theta: Column, entries: Column, lg: int) -> Column:
    """A sketch of sorted entries: those below theta, and not more than k."""
    least = F.least(theta, F.get(entries, F.lit(1 << lg))["u"])  # NULL if there are not so many, which least skips
    return _let(least, lambda t: F.struct(t.alias("theta"), F.filter(entries, lambda x: x["u"] < t).alias("entries")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(h: Column) -> Column:
    """A hash as a number from 0 to 1, in unsigned order."""
    return (h.cast("double") + F.when(h < 0, F.lit(SPAN)).otherwise(F.lit(0.0))) / F.lit(SPAN)


def theta(sketch) -> Column:
    """The share of the hash space that the sketch covers: 1 until it is full."""
    return column(sketch)["theta"]


def estimate(sketch) -> Column:
    """Distinct keys."""
    s = column(sketch)
    return F.size(s["entries"]) / s["theta"]


def summary(sketch, mode: str = "sum") -> Column:
    """The summaries' sum (scaled up by theta), least or greatest."""
    values = F.transform(column(sketch)["entries"], lambda x: x["s"])
    if mode == "sum":
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / theta(sketch)
    return F.array_min(values) if mode == "min" else F.array_max(values)


def _met(left, right, keep, value, lg: int) -> Column:
    """One sorting of both sides' entries, in which the entry of a hash in both is followed by its twin: ``keep(both, mine)`` says which
    entries stay, ``value(own, twin)`` what the summary of a hash in both is."""
    a, b = column(left), column(right)

    def tagged(side: Column, n: int) -> Column:
        return F.transform(side["entries"], lambda x: F.struct(x["u"].alias("u"), x["h"].alias("h"), F.lit(n).alias("n"), x["s"].alias("s")))

    def folded(rows: Column) -> Column:
        def entry(x: Column, i: Column) -> Column:
            after, before = F.get(rows, i + 1), F.get(rows, i - 1)
            both = after["h"].eqNullSafe(x["h"])
            stays = ~before["h"].eqNullSafe(x["h"]) & keep(both, x["n"] == 0)
            return F.when(stays, F.struct(x["u"].alias("u"), x["h"].alias("h"), F.when(both, value(x["s"], after["s"])).otherwise(x["s"]).alias("s")))

        return F.filter(F.transform(rows, entry), lambda x: x.isNotNull())

    entries = _let(F.array_sort(F.concat(tagged(a, 0), tagged(b, 1))), folded)
    return _let(entries, lambda e: _cut(F.least(a["theta"], b["theta"]), e, lg))


def union(left, right, lg: int = 12, mode: str = "sum") -> Column:
    return _met(left, right, lambda both, mine: F.lit(True), FOLDS[mode], lg)


def intersection(left, right, lg: int = 12, mode: str = "sum") -> Column:
    return _met(left, right, lambda both, mine: both, FOLDS[mode], lg)


def difference(left, right, lg: int = 12) -> Column:
    return _met(left, right, lambda both, mine: mine & ~both, lambda a, b: a, lg)


# A theta sketch has keys alone: (theta, entries) with entries (u, h).


def theta_sketch(sketch) -> Column:
    """The keys of a tuple sketch."""
    s = column(sketch)
    return F.struct(s["theta"].alias("theta"), F.transform(s["entries"], lambda x: F.struct(x["u"].alias("u"), x["h"].alias("h"))).alias("entries"))


def _valued(keys, default) -> Column:
    k = column(keys)
    return F.struct(k["theta"].alias("theta"), F.transform(k["entries"], lambda x: F.struct(x["u"].alias("u"), x["h"].alias("h"), F.lit(default).alias("s"))).alias("entries"))


def union_theta(left, keys, lg: int = 12, default: float = 1.0) -> Column:
    """A tuple sketch with a theta sketch, whose keys bring ``default`` as their summary where they are new."""
    return _met(left, _valued(keys, default), lambda both, mine: F.lit(True), lambda a, b: a, lg)


def intersection_theta(left, keys, lg: int = 12, default: float = 1.0) -> Column:
    return _met(left, _valued(keys, default), lambda both, mine: both, lambda a, b: a, lg)


def difference_theta(left, keys, lg: int = 12, default: float = 1.0) -> Column:
    return difference(left, _valued(keys, default), lg)


def union_agg(df: DataFrame, by: list[str], sketch: str = "sketch", lg: int = 12, mode: str = "sum") -> DataFrame:
    """The union of the sketches of each group: their entries as rows, folded and ranked again."""
    return _smallest(_entries_of(df, by, sketch, mode).drop("_m", "_n"), by, lg)


def intersection_agg(df: DataFrame, by: list[str], sketch: str = "sketch", lg: int = 12, mode: str = "sum") -> DataFrame:
    """The intersection of the sketches of each group: the entries that all of them hold."""
    return _smallest(_entries_of(df, by, sketch, mode).where("_m = _n").drop("_m", "_n"), by, lg)


def _entries_of(df: DataFrame, by: list[str], sketch: str, mode: str) -> DataFrame:
    """(by, u, h, s, t, _m, _n): the entries below the least theta t of a group, folded; _m of its _n sketches hold them."""
    groups = df.groupBy(*by).agg(F.min(F.col(sketch)["theta"]).alias("t"), F.count(F.lit(1)).alias("_n"))
    rows = df.select(*by, F.inline(F.col(sketch)["entries"])).groupBy(*by, "u", "h").agg(AGGREGATES[mode]("s").alias("s"), F.count(F.lit(1)).alias("_m"))
    met = rows.join(groups, by) if by else rows.crossJoin(F.broadcast(groups))  # without groups: one row
    return met.where("u < t").select(*by, "u", "h", "s", "t", "_m", "_n")


def current_path() -> Column:
    return F.concat_ws(".", F.current_catalog(), F.current_schema())
