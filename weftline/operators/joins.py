"""Joins by keys and by predicates. Both leave the physical join to Spark: hash, sort-merge, broadcast by measured size, skew split.
A condition that one value is above another is an ``Above``: Spark has no join for it but to look at each pair of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.plumbing import column, const
from weftline.plans.errors import InvalidPlan

LEFT_ONLY = ("left_semi", "left_anti")
#: Rows that a tile of ``Above`` holds at least where a key has more, and the tiles of a key at most.
TILE, TILES = 256, 2048
ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Above:
    """The condition that ``left``, an expression over the left side, is greater than ``right``, one over the right side, and each pair
    of expressions in ``on`` equal. Numbers, dates and timestamps."""

    left: Column | str
    right: Column | str
    on: tuple[tuple[Column | str, Column | str], ...] = ()


def sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where both frames have a column of one name, it is _1_<name> and _2_<name>, so that both can be reached."""
    both = set(left.columns) & set(right.columns)

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").alias(f"{prefix}{c}" if c in both else c) for c in df.columns))

    return named(left, "_1_"), named(right, "_2_")


def _joined(left: DataFrame, right: DataFrame, condition: Column, how: str, nested: bool) -> DataFrame:
    """``nested``: a struct a side, NULL where the side has no row, so an unmatched row differs from one of NULLs."""
    if nested and how not in LEFT_ONLY:
        l = left.withColumn("_1", F.struct(*[F.col(f"`{c}`") for c in left.columns]))
        r = right.withColumn("_2", F.struct(*[F.col(f"`{c}`") for c in right.columns]))
        return l.join(r, condition, how).select("_1", "_2")
    return left.join(right, condition, how)


def predicate_join(left: DataFrame, right: DataFrame, condition, how: str, nested: bool = False) -> DataFrame:
    """On any condition over the columns named by ``sides``: a Column, or a function of (left column by name, right column by name). Equal
    keys in it are found by Spark; without any, each pair of rows is looked at, the smaller side broadcast. An ``Above`` looks at little
    more than the pairs that meet."""
    if isinstance(condition, Above):
        return _ordered(left, right, condition, how, nested)
    names = set(left.columns) & set(right.columns)
    l, r = sides(left, right)
    c = condition if isinstance(condition, Column) else condition(lambda n: F.col(f"_1_{n}" if n in names else n), lambda n: F.col(f"_2_{n}" if n in names else n))
    out = _joined(l, r, c, how, nested)
    return out.toDF(*left.columns) if how in LEFT_ONLY else out


def key_join(left: DataFrame, right: DataFrame, left_keys, right_keys, how: str, nested: bool = False) -> DataFrame:
    """On equal keys, one or several expressions a side, of the same types. NULL keys meet nothing."""
    lk = [column(c) for c in (left_keys if isinstance(left_keys, (list, tuple)) else [left_keys])]
    rk = [column(c) for c in (right_keys if isinstance(right_keys, (list, tuple)) else [right_keys])]
    if len(lk) != len(rk):
        raise InvalidPlan("the sides have different numbers of keys")
    kinds = [[f.dataType for f in df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).schema] for df, keys in ((left, lk), (right, rk))]
    if kinds[0] != kinds[1]:
        raise InvalidPlan("keys of different types; cast one side")
    both = set(left.columns) & set(right.columns)
    lk_names, rk_names = [f"_lk{i}" for i in range(len(lk))], [f"_rk{i}" for i in range(len(rk))]
    l = left.select("*", *(k.alias(n) for k, n in zip(lk, lk_names, strict=True)))
    r = right.select("*", *(k.alias(n) for k, n in zip(rk, rk_names, strict=True)))
    l, r = sides(l, r)
    condition = F.lit(True)
    for a, b in zip(lk_names, rk_names, strict=True):
        condition = condition & (F.col(a) == F.col(b))
    if how in LEFT_ONLY:
        return l.join(r, condition, how).drop(*lk_names).toDF(*left.columns)
    if not nested:
        return l.join(r, condition, how).drop(*lk_names, *rk_names)
    ls = l.withColumn("_1", F.struct(*[F.col(f"_1_{c}" if c in both else f"`{c}`").alias(c) for c in left.columns])).select("_1", *lk_names)
    rs = r.withColumn("_2", F.struct(*[F.col(f"_2_{c}" if c in both else f"`{c}`").alias(c) for c in right.columns])).select("_2", *rk_names)
    return ls.join(rs, condition, how).select("_1", "_2")


def _ordered(left: DataFrame, right: DataFrame, order: Above, how: str, nested: bool) -> DataFrame:
    how = {"outer": "full", "leftouter": "left", "rightouter": "right"}.get(how, how)
    if how not in ("inner", "left", "right", "full", *LEFT_ONLY):
        raise InvalidPlan(f"no join of the kind {how}")
    keys = [f"_k{i}" for i in range(len(order.on))]

    def packed(df: DataFrame, on: list, value: Column | str, side: str) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side)
        return df.select(row, *(column(k).alias(n) for k, n in zip(on, keys, strict=True)), column(value).alias("_v"))

    l = packed(left, [a for a, _ in order.on], order.left, "_1")
    r = packed(right, [b for _, b in order.on], order.right, "_2")
    if [l.schema[k].dataType for k in keys] != [r.schema[k].dataType for k in keys]:
        raise InvalidPlan("keys of different types; cast one side")
    if not all(isinstance(df.schema["_v"].dataType, ORDERED) for df in (l, r)):
        raise InvalidPlan("only numbers, dates and timestamps are above one another; other values need a condition")
    if how in LEFT_ONLY:
        return _unmet(l, r, keys, "_1", True, how == "left_anti").select("_1.*")
    if how == "right":
        pairs = _tiled(r, l, keys, "_2", "_1", False, True)
    else:
        pairs = _tiled(l, r, keys, "_1", "_2", True, how != "inner")
    pairs = pairs.select("_1", "_2")
    if how == "full":
        rest = _unmet(r, l, keys, "_2", False, True)
        pairs = pairs.union(rest.select(F.lit(None).cast(pairs.schema["_1"].dataType).alias("_1"), "_2"))
    if nested:
        return pairs
    both = set(left.columns) & set(right.columns)
    return pairs.select(*(F.col(f"{side}.`{c}`").alias(f"{side}_{c}" if c in both else c) for side, df in (("_1", left), ("_2", right)) for c in df.columns))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    condition = F.lit(True)
    for n in names:
        condition = condition & (a[n] == b[n])
    return condition


def _unmet(rows: DataFrame, others: DataFrame, keys: list[str], side: str, above: bool, unmet: bool) -> DataFrame:
    """The rows that meet none (``unmet`` false: one at least) of the others: a value is above one of them if it is above the least."""
    edge = others.groupBy(*keys).agg((F.min if above else F.max)("_v").alias("_edge"))
    found = rows.join(edge, keys, "left") if keys else rows.crossJoin(F.broadcast(edge))  # without keys: one row
    met = F.coalesce(F.col("_v") > F.col("_edge") if above else F.col("_v") < F.col("_edge"), F.lit(False))
    return found.where(~met if unmet else met).select(side)


def _tiled(rows: DataFrame, others: DataFrame, keys: list[str], side: str, other: str, above: bool, outer: bool) -> DataFrame:
    """Pairs of rows whose value is above (else below) the other's. The others are cut into tiles of near values; a row visits the tiles
    whose least (greatest) value it passes, so each visit finds a pair, and is compared with the rows of the tile alone. Visits are dealt
    by key and tile. ``outer``: rows that visit no tile stay, spread over tiles that no row is in."""
    others = others.where("_v IS NOT NULL").withColumn("_tile", _tile(others, keys, other))
    tiles = others.groupBy(*keys, "_tile").agg((F.min if above else F.max)("_v").alias("_edge"))
    passes = rows["_v"] > tiles["_edge"] if above else rows["_v"] < tiles["_edge"]
    at = _same(rows, tiles, keys) & passes
    visits = rows.join(tiles if keys else F.broadcast(tiles), at, "left" if outer else "inner")  # without keys: TILES rows at most
    visits = visits.select(side, *(rows[k] for k in keys), rows["_v"], "_tile")
    if outer:
        visits = visits.withColumn("_tile", F.coalesce("_tile", -1 - F.pmod(_hash(rows, side), F.lit(TILES)).cast("int")))
    v, o = visits.alias("v"), others.alias("o")
    met = F.col("v._tile") == F.col("o._tile")
    for k in keys:
        met = met & (F.col(f"v.{k}") == F.col(f"o.{k}"))
    met = met & (F.col("v._v") > F.col("o._v") if above else F.col("v._v") < F.col("o._v"))
    return v.join(o.hint("merge"), met, "left" if outer else "inner").select(f"v.{side}", f"o.{other}")


def _tile(others: DataFrame, keys: list[str], side: str) -> Column:
    """The number of a row's tile: between which of the edges, quantiles of all values, its value is. A value at which several edges lie
    is dealt over as many tiles. The pairs are the same whatever the edges, which are literals as two readings must give the same tiles."""
    most = others.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    n = min(TILES, most // TILE)
    if n < 2:
        return F.lit(0)
    edges = others.agg(F.percentile_approx("_v", [i / n for i in range(1, n)], 10_000)).first()[0]
    runs, steps = [1], [1 << b for b in reversed(range(n.bit_length()))]
    for i, e in enumerate(edges):
        runs.append(runs[-1] + 1 if i and e == edges[i - 1] else 1)
    where, width = const(edges), const(runs)

    def step(at: Column, s: Column) -> Column:
        return F.when(F.get(where, at + s - 1) <= F.col("_v"), at + s).otherwise(at)

    place = F.aggregate(const(steps), F.lit(0), step)
    return F.aggregate(F.array(place), F.lit(0), lambda _, p: p - F.pmod(_hash(others, side), F.get(width, p).cast("bigint")).cast("int"))


def _hash(rows: DataFrame, side: str) -> Column:
    """A hash of a row, by the columns that have one."""
    names = [f.name for f in rows.schema[side].dataType if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*[F.col(f"{side}.`{n}`") for n in names])


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """Equal-key join of one column for a key that holds much of ``left``: left rows are dealt over ``salts`` parts of the key, right
    rows copied to each. For inner, left, semi and anti joins."""
    if how not in ("inner", "left", *LEFT_ONLY):
        raise InvalidPlan("only the left side's rows may be dealt out")
    l = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [key, "_salt"], how).drop("_salt")
