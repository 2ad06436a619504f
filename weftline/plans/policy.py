"""Error policies: what a row does whose expression fails.

``Guarded`` pairs a value with the kind of its failure, or NULL, both native expressions; the value counts where nothing failed, and
``guarded`` makes it NULL elsewhere. So an expression grows with its parts, not with their combinations. Guarded values nest: they stand
wherever these functions and their operators take a column, and what fails first, from left to right, is what is told.
``call`` takes any function that cannot fail, ``strict`` any whose only reason to give NULL for values is a failure, ``check`` any
condition. A failure in a branch that is not taken (``choose``, ``either``) is none. ``collect_errors`` gives the values with a bounded
list of errors and complete counts by kind; ``quarantine`` splits the rows. Without either, the plain functions fail fast, as ANSI mode does."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import xpaths
from weftline.functions.plumbing import column
from weftline.operators.indexing import zip_with_index


@dataclass(frozen=True)
class Guarded:
    value: Column
    error: Column

    def __add__(self, other: Any) -> Guarded:
        return arithmetic(F.try_add, self, other)

    def __radd__(self, other: Any) -> Guarded:
        return arithmetic(F.try_add, other, self)

    def __sub__(self, other: Any) -> Guarded:
        return arithmetic(F.try_subtract, self, other)

    def __rsub__(self, other: Any) -> Guarded:
        return arithmetic(F.try_subtract, other, self)

    def __mul__(self, other: Any) -> Guarded:
        return arithmetic(F.try_multiply, self, other)

    def __rmul__(self, other: Any) -> Guarded:
        return arithmetic(F.try_multiply, other, self)

    def __truediv__(self, other: Any) -> Guarded:
        return divide(self, other)

    def __rtruediv__(self, other: Any) -> Guarded:
        return divide(other, self)

    def __mod__(self, other: Any) -> Guarded:
        return modulo(self, other)


def lift(x: Any) -> Guarded:
    """A column, a column's name or a literal as a value that does not fail."""
    if isinstance(x, Guarded):
        return x
    return Guarded(column(x) if isinstance(x, (Column, str)) else F.lit(x), F.lit(None).cast("string"))


def _errors(args: tuple[Any, ...], *own: Column) -> Column:
    return F.coalesce(*(a.error for a in args if isinstance(a, Guarded)), *own, F.lit(None).cast("string"))


def call(fn: Callable[..., Column], *args: Any) -> Guarded:
    """``fn``, which cannot fail, of the values."""
    return Guarded(fn(*(lift(a).value for a in args)), _errors(args))


def check(c: Any, fails: Column, kind: str) -> Guarded:
    """Fails with ``kind`` where ``fails`` is true and nothing failed before."""
    return Guarded(lift(c).value, _errors((c,), F.when(fails, F.lit(kind))))


def strict(fn: Callable[..., Column], *args: Any, kind: str = "InvalidValue") -> Guarded:
    """``fn`` gives NULL where an argument is NULL, and else only where it fails, as the ``try_`` functions do."""
    parts = [lift(a).value for a in args]
    value = fn(*parts)
    whole = reduce(and_, (p.isNotNull() for p in parts))
    return Guarded(value, _errors(args, F.when(whole & value.isNull(), F.lit(kind))))


def divide(left: Any, right: Any) -> Guarded:
    l, r = lift(left).value, lift(right).value
    return Guarded(F.try_divide(l, r), _errors((left, right), F.when(l.isNotNull() & (r == 0), F.lit("DivisionByZero"))))


def modulo(left: Any, right: Any) -> Guarded:
    l, r = lift(left).value, lift(right).value
    return Guarded(F.try_mod(l, r), _errors((left, right), F.when(l.isNotNull() & (r == 0), F.lit("DivisionByZero"))))


def arithmetic(op: Callable[[Column, Column], Column], left: Any, right: Any) -> Guarded:
    """``op``: try_add, try_subtract or try_multiply; a result beyond its type is an Overflow."""
    return strict(op, left, right, kind="Overflow")


def negate(c: Any) -> Guarded:
    return arithmetic(F.try_multiply, c, -1)


def absolute(c: Any) -> Guarded:
    return choose(call(lambda v: v < 0, c), negate(c), c)


def cast(c: Any, kind: str) -> Guarded:
    return strict(lambda v: v.try_cast(kind), c)


def element(array: Any, index: Any) -> Guarded:
    a, i = lift(array).value, lift(index).value
    outside = a.isNotNull() & ((i == 0) | (i > F.size(a)) | (i < -F.size(a)))
    return Guarded(F.try_element_at(a, F.nullif(i.try_cast("int"), F.lit(0))), _errors((array, index), F.when(outside, F.lit("IndexOutOfBounds"))))


def json(c: Any) -> Guarded:
    return strict(F.try_parse_json, c)


def variant(c: Any, path: str, kind: str) -> Guarded:
    """The part of a variant at ``path``: NULL where there is none, a failure where it is of another kind."""
    v = lift(c).value
    part, got = F.try_variant_get(v, path, "variant"), F.try_variant_get(v, path, kind)
    return Guarded(got, _errors((c,), F.when(part.isNotNull() & ~F.is_variant_null(part) & got.isNull(), F.lit("InvalidValue"))))


def date(c: Any, pattern: str | None = None) -> Guarded:
    return strict(lambda v: F.try_to_date(v, pattern) if pattern else F.try_to_date(v), c)


def make_date(year: Any, month: Any, day: Any) -> Guarded:
    zero = F.lit(0)
    return strict(lambda y, m, d: F.try_make_timestamp_ntz(y, m, d, zero, zero, zero).cast("date"), year, month, day)


def timestamp(c: Any, pattern: str | None = None) -> Guarded:
    return strict(lambda v: F.try_to_timestamp(v, F.lit(pattern)) if pattern else F.try_to_timestamp(v), c)


def make_timestamp(*parts: Any) -> Guarded:
    """Of year, month, day, hour, minute and second."""
    return strict(F.try_make_timestamp_ntz, *parts)


def number(c: Any, pattern: str) -> Guarded:
    return strict(lambda v: F.try_to_number(v, F.lit(pattern)), c)


def binary(c: Any, form: str) -> Guarded:
    """``form``: base64, hex or utf-8."""
    return strict(lambda v: F.try_to_binary(v, F.lit(form)), c)


def url_decode(c: Any) -> Guarded:
    return strict(F.try_url_decode, c)


def aes_decrypt(c: Any, key: Any, mode: str = "GCM") -> Guarded:
    return strict(lambda v, k: F.try_aes_decrypt(v, k, F.lit(mode)), c, key)


def xpath(fn: Callable[[Column, str], Column], c: Any, path: str) -> Guarded:
    """``fn``: a ``try_`` function of ``weftline.functions.xpaths``; text that is no XML fails."""
    v = lift(c).value
    return Guarded(fn(v, path), _errors((c,), F.when(v.isNotNull() & ~xpaths.well_formed(v), F.lit("InvalidValue"))))


def choose(condition: Any, then: Any, otherwise: Any) -> Guarded:
    """``then`` where the condition is true; only the branch that is taken can fail."""
    c, t, o = lift(condition), lift(then), lift(otherwise)
    taken = F.coalesce(c.value, F.lit(False))
    return Guarded(F.when(taken, t.value).otherwise(o.value), F.coalesce(c.error, F.when(taken, t.error).otherwise(o.error)))


def either(first: Any, second: Any) -> Guarded:
    """The second where the first is NULL without having failed."""
    f, s = lift(first), lift(second)
    return Guarded(F.coalesce(f.value, s.value), F.coalesce(f.error, F.when(f.value.isNull(), s.error)))


def each(array: Any, fn: Callable[[Column], Guarded]) -> Guarded:
    """``fn`` of each element; the first element that fails fails the array."""
    a = lift(array).value
    first = F.get(F.filter(F.transform(a, lambda x: lift(fn(x)).error), lambda e: e.isNotNull()), F.lit(0))
    return Guarded(F.transform(a, lambda x: lift(fn(x)).value), _errors((array,), first))


def guarded(df: DataFrame, **columns: Guarded) -> DataFrame:
    """``df`` with the guarded values and the column ``_error``: the kind of the first failure in a row, or NULL. All are of the
    columns as they are in ``df``, also where one is named as a guarded value is."""
    error = F.coalesce(*(g.error for g in columns.values())) if columns else F.lit(None).cast("string")
    return df.withColumns({n: F.when(g.error.isNull(), g.value) for n, g in columns.items()} | {"_error": error})


@dataclass(frozen=True)
class Collected:
    rows: DataFrame
    errors: list[tuple[int, str]]
    truncated: bool
    by_kind: dict[str, int]


def collect_errors(df: DataFrame, max_errors: int = 100, **columns: Guarded) -> Collected:
    """Failed rows have NULL values; at most ``max_errors`` of (row, kind), by row, and the counts of all."""
    rows = zip_with_index(guarded(df, **columns), "_row")
    failed = rows.where("_error is not null").select("_row", "_error")
    listed = [(r[0], r[1]) for r in failed.orderBy("_row").limit(max_errors + 1).collect()]
    by_kind = {r[0]: r[1] for r in failed.groupBy("_error").count().collect()}
    return Collected(rows.drop("_row", "_error"), listed[:max_errors], len(listed) > max_errors, by_kind)


def quarantine(df: DataFrame, preview: int | str | None = 120, redact: Callable[[Column], Column] | None = None, **columns: Guarded) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows with ``_error`` and ``_preview``: the row as JSON, through ``redact`` and then cut to ``preview``
    characters; "full" cuts nothing, None leaves the preview out)."""
    rows = guarded(df, **columns)
    bad = rows.where("_error is not null")
    if preview is not None:
        shown = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        shown = redact(shown) if redact else shown
        bad = bad.withColumn("_preview", shown if preview == "full" else F.left(shown, F.lit(preview)))
    return rows.where("_error is null").drop("_error"), bad
