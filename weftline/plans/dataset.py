"""Dataset: a thin, immutable wrapper of a DataFrame with the plan operators by name, and a trace of them for ``tree``.

Nothing here runs a job but the actions, ``narrow``, and ``zip_with_index`` (which counts the rows of each partition)."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator
from types import FunctionType
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from weftline.functions.aggregates import TopN
from weftline.functions.plumbing import column
from weftline.operators import aggregation, indexing, joins, sorting
from weftline.operators import windows as windowing
from weftline.plans import policy, schema


class _Text:
    """What string columns can do beside what columns can: ``+`` joins, ``length`` counts characters."""

    def __add__(self, other: Any) -> Column:
        return text(F.concat(self, other if isinstance(other, Column) else F.lit(other)))

    def __radd__(self, other: Any) -> Column:
        return text(F.concat(F.lit(other), self))

    @property
    def length(self) -> Column:
        return F.length(self)


def text(c: Column) -> Column:
    """A string column for which ``+`` joins strings (a plain column adds numbers)."""
    c.__class__ = type("Text", (_Text, type(c)), {})
    return c


class RowProxy:
    """What a lambda over a row gets: attributes are columns, those of strings as ``text``."""

    def __init__(self, df: DataFrame) -> None:
        self._df = df

    def __getattr__(self, name: str) -> Column:
        kinds = [f.dataType for f in self._df.schema if f.name == name]
        return text(F.col(name)) if kinds and isinstance(kinds[0], StringType) else F.col(name)

    __getitem__ = __getattr__


Expression = Column | str | Callable[[RowProxy], Column]
Predicate = Expression
Aggregated = Column | TopN | Callable[[RowProxy], "Column | TopN"]


class Dataset:
    def __init__(self, df: DataFrame, node: str = "Root", inputs: tuple[Dataset, ...] = ()) -> None:
        self.df, self.node, self.inputs = df, node, inputs

    # sources

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable[Any], kind: StructType | type) -> Dataset:
        return cls(spark.createDataFrame(list(rows), kind if isinstance(kind, StructType) else schema.struct_type(kind)))

    @classmethod
    def from_frame(cls, df: DataFrame, kind: StructType | type | None = None, strict: bool = False) -> Dataset:
        if kind is not None:
            schema.validate(df, kind if isinstance(kind, StructType) else schema.struct_type(kind), strict)
        return cls(df)

    def _next(self, df: DataFrame, node: str, *others: Dataset) -> Dataset:
        return Dataset(df, node, (self, *others))

    def _of(self, x: Any) -> Any:
        """What a lambda over a row makes; anything else as it is."""
        return x(RowProxy(self.df)) if isinstance(x, FunctionType) else x

    # rows

    def filter(self, predicate: Predicate) -> Dataset:
        return self._next(self.df.where(self._of(predicate)), "Filter")

    where = filter

    def map(self, fn: Callable[[Row], tuple], kind: StructType | str) -> Dataset:
        """Each row through a Python function, in Arrow batches. Where an expression will do, ``select`` stays in the JVM."""
        return self.flat_map(lambda row: [fn(row)], kind, "Map")

    def flat_map(self, fn: Callable[[Row], Iterable[tuple]], kind: StructType | str, node: str = "FlatMap") -> Dataset:
        names = self.df.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            row = Row(*names)
            for batch in batches:
                yield pd.DataFrame([x for values in batch.itertuples(index=False, name=None) for x in fn(row(*values))], columns=out)

        out = (kind if isinstance(kind, StructType) else StructType.fromDDL(kind)).names
        return self._next(self.df.mapInPandas(run, kind), node)

    def select(self, *columns: Expression, **named: Expression) -> Dataset:
        return self._next(self.df.select(*map(self._of, columns), *(column(self._of(c)).alias(n) for n, c in named.items())), "SelectExprs")

    def select_rows(self, fn: Callable[[Row], tuple], kind: StructType | str) -> Dataset:
        return self.flat_map(lambda row: [fn(row)], kind, "Select")

    def with_fields(self, **named: Expression) -> Dataset:
        return self._next(self.df.withColumns({n: column(self._of(c)) for n, c in named.items()}), "SelectExprs")

    def project(self, kind: StructType | type) -> Dataset:
        """The columns of another schema, by name."""
        wanted = kind if isinstance(kind, StructType) else schema.struct_type(kind)
        return self._next(self.df.select(*wanted.names), "SelectExprs")

    def distinct(self) -> Dataset:
        return self._next(self.df.distinct(), "Distinct")

    def limit(self, n: int) -> Dataset:
        return self._next(self.df.limit(n), "Limit")

    def sample(self, fraction: float, seed: int, with_replacement: bool = False) -> Dataset:
        return self._next(self.df.sample(with_replacement, fraction, seed), "Sample")

    def partition(self, predicate: Predicate) -> tuple[Dataset, Dataset]:
        """Rows for which the predicate is true, and those for which it is false; NULL is in neither."""
        wanted = self._of(predicate)
        wanted = F.expr(wanted) if isinstance(wanted, str) else wanted
        return self.filter(wanted), self.filter(~wanted)

    # sets

    def union(self, other: Dataset) -> Dataset:
        return self._next(self.df.union(other.df), "Union", other)

    def intersect(self, other: Dataset) -> Dataset:
        return self._next(self.df.intersect(other.df), "Intersect", other)

    def except_(self, other: Dataset) -> Dataset:
        return self._next(self.df.subtract(other.df), "Except", other)

    # joins

    def _join(self, other: Dataset, condition, how: str, node: str, nested: bool = False) -> Dataset:
        return self._next(joins.predicate_join(self.df, other.df, condition, how, nested), node, other)

    def join(self, other: Dataset, condition, nested: bool = False) -> Dataset:
        return self._join(other, condition, "inner", "InnerJoin", nested)

    def left_join(self, other: Dataset, condition, nested: bool = False) -> Dataset:
        return self._join(other, condition, "left", "LeftJoin", nested)

    def right_join(self, other: Dataset, condition, nested: bool = False) -> Dataset:
        return self._join(other, condition, "right", "RightJoin", nested)

    def full_join(self, other: Dataset, condition, nested: bool = False) -> Dataset:
        return self._join(other, condition, "full", "FullJoin", nested)

    def anti_join(self, other: Dataset, condition) -> Dataset:
        return self._join(other, condition, "left_anti", "LeftAntiJoin")

    def _join_on(self, other: Dataset, left, right, how: str, node: str, nested: bool = False) -> Dataset:
        return self._next(joins.key_join(self.df, other.df, left, right, how, nested), node, other)

    def join_on(self, other: Dataset, left, right, nested: bool = False) -> Dataset:
        return self._join_on(other, left, right, "inner", "InnerJoinOn", nested)

    def left_join_on(self, other: Dataset, left, right, nested: bool = False) -> Dataset:
        return self._join_on(other, left, right, "left", "LeftJoinOn", nested)

    def right_join_on(self, other: Dataset, left, right, nested: bool = False) -> Dataset:
        return self._join_on(other, left, right, "right", "RightJoinOn", nested)

    def full_join_on(self, other: Dataset, left, right, nested: bool = False) -> Dataset:
        return self._join_on(other, left, right, "full", "FullJoinOn", nested)

    def anti_join_on(self, other: Dataset, left, right) -> Dataset:
        return self._join_on(other, left, right, "left_anti", "LeftAntiJoinOn")

    def semi_join_on(self, other: Dataset, left, right) -> Dataset:
        return self._join_on(other, left, right, "left_semi", "LeftSemiJoinOn")

    # order

    def sort(self) -> Dataset:
        """By all columns, from left to right."""
        return self._next(self.df.orderBy(*self.df.columns), "Sort")

    def sort_by(self, key: Callable[[Row], Any], kind: str) -> Dataset:
        """By a Python key, computed in Arrow batches, that Spark then sorts by."""
        return self._next(sorting.sort_by_key(self.df, key, kind), "SortBy")

    def sort_by_expr(self, c: Expression) -> Dataset:
        return self._next(self.df.orderBy(column(self._of(c)).asc()), "SortByExpr")

    sort_by_column = sort_by_expr

    def sort_by_exprs(self, *specs: Column | tuple[Column | str, str]) -> Dataset:
        return self._next(self.df.orderBy(*sorting.order(specs)), "SortByExprs")

    # indexes and placement

    def zip_with_index(self, name: str = "index") -> Dataset:
        return self._next(indexing.zip_with_index(self.df, name), "ZipWithIndex")

    def zip_with_unique_id(self, name: str = "id") -> Dataset:
        return self._next(self.df.withColumn(name, F.monotonically_increasing_id()), "ZipWithUniqueId")

    def persist(self) -> Dataset:
        return self._next(self.df.persist(), "Persist")

    def checkpoint(self) -> Dataset:
        """Cuts the plan: the rows are written to spark.checkpoint.dir, which outlives executors (a local folder where it is unset)."""
        spark = self.df.sparkSession
        if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-weftline-"))
        return self._next(self.df.checkpoint(), "Checkpoint")

    def rebalance(self, n: int | None = None) -> Dataset:
        return self._next(self.df.repartition(n) if n else self.df.hint("rebalance"), "Rebalance")

    # groups and windows

    def group_by_agg(self, keys: list[Expression], aggs: list[Aggregated]) -> Dataset:
        return self._next(aggregation.group_by(self.df, [self._of(k) for k in keys], [self._of(a) for a in aggs]), "GroupByAgg")

    def rollup_agg(self, keys: list[Column | str], aggs: list[Column]) -> Dataset:
        return self._next(self.df.rollup(*keys).agg(*aggs), "RollupAgg")

    def cube_agg(self, keys: list[Column | str], aggs: list[Column]) -> Dataset:
        return self._next(self.df.cube(*keys).agg(*aggs), "CubeAgg")

    def aggregate(self, aggs: list[Aggregated]) -> Dataset:
        return self._next(aggregation.group_by(self.df, [], [self._of(a) for a in aggs]), "Aggregate")

    def with_window(self, partition_by: list, order_by: list, frame: tuple[int, int] | None = None, **named: Column) -> Dataset:
        return self._next(windowing.with_window(self.df, partition_by, order_by, named, frame), "WithWindow")

    # policies

    def with_collected_errors(self, max_errors: int = 100, **columns: policy.Guarded | Callable[[RowProxy], policy.Guarded]) -> policy.Collected:
        return policy.collect_errors(self.df, max_errors, **{n: self._of(g) for n, g in columns.items()})

    def with_quarantine(self, preview: int | str | None = 120, redact: Callable[[Column], Column] | None = None, **columns: policy.Guarded | Callable[[RowProxy], policy.Guarded]) -> tuple[Dataset, Dataset]:
        good, bad = policy.quarantine(self.df, preview, redact, **{n: self._of(g) for n, g in columns.items()})
        return self._next(good, "WithPolicy"), self._next(bad, "WithPolicy")

    def narrow(self, kind: StructType | type) -> Dataset:
        return self._next(schema.narrow(self.df, kind if isinstance(kind, StructType) else schema.struct_type(kind)), "Narrow")

    # actions

    def collect(self) -> list[Row]:
        return self.df.collect()

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def take(self, n: int) -> list[Row]:
        return self.df.take(n)

    def show(self, n: int = 20) -> str:
        return table(self.df.columns, self.take(n))

    def tree(self, depth: int = 0) -> str:
        """The operators, the last one first, each above its inputs."""
        return "\n".join(["  " * depth + self.node, *(i.tree(depth + 1) for i in self.inputs)])

    def explain(self, mode: str = "formatted") -> None:
        print(self.tree())
        self.df.explain(mode)

    def materialize(self) -> Materialized:
        """The rows, collected: for results of a size that the driver holds."""
        return Materialized(self.collect(), self.df.schema)

    def to_frame(self) -> DataFrame:
        return self.df


class Materialized:
    """Collected rows with their schema."""

    def __init__(self, rows: list[Row], kind: StructType) -> None:
        self.rows, self.schema = rows, kind

    @classmethod
    def from_rows(cls, rows: Iterable[tuple], kind: StructType) -> Materialized:
        return cls([Row(*kind.names)(*r) for r in rows], kind)

    @property
    def row_count(self) -> int:
        return len(self.rows)

    def column(self, name: str) -> list[Any]:
        return [r[name] for r in self.rows]

    def foreach(self, fn: Callable[[Row], Any]) -> None:
        for r in self.rows:
            fn(r)

    def map(self, fn: Callable[[Row], Any]) -> list[Any]:
        return [fn(r) for r in self.rows]

    def to_list(self) -> list[Row]:
        return list(self.rows)

    def show(self, n: int = 20) -> str:
        return table(self.schema.names, self.rows[:n])


def table(names: list[str], rows: list[Row]) -> str:
    head = " | ".join(names)
    return "\n".join([head, "-" * len(head), *(" | ".join("null" if v is None else str(v) for v in r) for r in rows)])
