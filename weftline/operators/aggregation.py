"""Grouped aggregation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.aggregates import TopN
from weftline.functions.plumbing import column


def group_by(df: DataFrame, keys: list[Column | str], aggs: list[Column | TopN]) -> DataFrame:
    """NULL keys are one group; without aggregates, the distinct keys. Bounded aggregates (``TopN``) are made beside the others, each
    from the first n rows of a group, and meet them by key."""
    tops = [a for a in aggs if isinstance(a, TopN)]
    if not tops:
        return df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    names = df.select(*keys).columns
    mark = "_key"
    while any(c.startswith(mark) for c in df.columns):
        mark = "_" + mark
    ids = [f"{mark}{i}" for i in range(len(keys))]
    keyed = [column(k).alias(i) for k, i in zip(keys, ids, strict=True)]
    plain = [a for a in aggs if not isinstance(a, TopN)]
    out = df.select("*", *keyed).groupBy(*ids).agg(*(plain or [F.count(F.lit(1)).alias("_rows")]))
    kept = iter(out.columns[len(ids) :])
    columns = [a.name if isinstance(a, TopN) else next(kept) for a in aggs]
    out = out.toDF(*ids, *(f"_agg{i}" for i, a in enumerate(aggs) if not isinstance(a, TopN)) if plain else ["_rows"])
    for i, top in enumerate(aggs):
        if isinstance(top, TopN):
            out = _joined(out, _top(df.select(*keyed, top.by.alias("_by"), top.value.alias("_value")), ids, top).withColumnRenamed("_top", f"_agg{i}"), ids)
    found = [F.coalesce(f"_agg{i}", F.array()).alias(c) if isinstance(a, TopN) else F.col(f"_agg{i}").alias(c) for i, (a, c) in enumerate(zip(aggs, columns, strict=True))]
    return out.select(*(F.col(k).alias(n) for k, n in zip(ids, names, strict=True)), *found)


def _top(rows: DataFrame, ids: list[str], top: TopN) -> DataFrame:
    rows = rows.where(F.col("_by").isNotNull())
    order = [F.col(c).asc() if top.rising else F.col(c).desc() for c in ("_by", "_value")]
    first = top_per_group(rows, ids, order, top.n) if ids else rows.orderBy(*order).limit(top.n)
    held = F.sort_array(F.collect_list(F.struct("_by", "_value")), asc=top.rising)
    return first.groupBy(*ids).agg(F.transform(held, lambda x: x["_value"]).alias("_top"))


def _joined(left: DataFrame, right: DataFrame, ids: list[str]) -> DataFrame:
    if not ids:
        return left.crossJoin(right)  # a row each
    same = reduce(and_, (left[k].eqNullSafe(right[k]) for k in ids))
    return left.join(right, same, "left").select(*(left[c] for c in left.columns), *(right[c] for c in right.columns if c not in ids))


def grouping_sets(df: DataFrame, sets: list[list[str]], keys: list[str], aggs: list[Column]) -> DataFrame:
    return df.groupingSets([[column(k) for k in s] for s in sets], *keys).agg(*aggs)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group. Spark keeps n rows of a group in each task before it shuffles them."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
