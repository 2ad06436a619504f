"""Window columns, with frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window

from weftline.operators.sorting import order


def with_window(df: DataFrame, partition_by: list, order_by: list, named: dict[str, Column], frame: tuple[int, int] | None = None) -> DataFrame:
    """``df`` with the window functions of ``named`` over one window; ``frame``: rows from and to, as offsets from the current row."""
    w = Window.partitionBy(*partition_by)
    if order_by:
        w = w.orderBy(*order(tuple(order_by)))
    if frame is not None:
        w = w.rowsBetween(*frame)
    return df.withColumns({n: c.over(w) for n, c in named.items()})
