"""Schemas declared as dataclasses: StructType from the fields, validation that reports every mismatch, and narrowing."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import types
import typing

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.errors import SchemaMismatch

BASIC = {
    bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(),
    datetime.date: T.DateType(), datetime.datetime: T.TimestampType(), datetime.timedelta: T.DayTimeIntervalType(), decimal.Decimal: T.DecimalType(38, 18),
}


def data_type(hint: object) -> tuple[T.DataType, bool]:
    """Spark type of a type hint, and whether it is optional. A Spark DataType stands for itself; Annotated[int, IntegerType()] picks one."""
    if isinstance(hint, T.DataType):
        return hint, False
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        inner = [a for a in args if a is not type(None)]
        if len(inner) != 1:
            raise SchemaMismatch([f"unsupported union {hint}"])
        return data_type(inner[0])[0], len(inner) < len(args)
    if origin is typing.Annotated:
        return next((a for a in args[1:] if isinstance(a, T.DataType)), None) or data_type(args[0])[0], False
    if origin is list:
        kind, optional = data_type(args[0])
        return T.ArrayType(kind, optional), False
    if origin is dict:
        kind, optional = data_type(args[1])
        return T.MapType(data_type(args[0])[0], kind, optional), False
    if dataclasses.is_dataclass(hint):
        return struct_type(hint), False
    if hint in BASIC:
        return BASIC[hint], False
    raise SchemaMismatch([f"no Spark type for {hint}"])


def struct_type(cls: type, flatten: bool = False) -> T.StructType:
    """The schema of a dataclass. ``flatten``: nested dataclasses give columns <field> (one) or <field>_<inner> (several)."""
    fields = []
    hints = typing.get_type_hints(cls, include_extras=True)
    for f in dataclasses.fields(cls):
        kind, optional = data_type(hints[f.name])
        if flatten and isinstance(kind, T.StructType):
            inner = kind.fields
            fields += [T.StructField(f.name if len(inner) == 1 else f"{f.name}_{i.name}", i.dataType, i.nullable or optional) for i in inner]
        else:
            fields.append(T.StructField(f.name, kind, optional))
    return T.StructType(fields)


def mismatches(df: DataFrame, schema: T.StructType, strict: bool = False) -> list[str]:
    """Every difference by position: count, names and types; ``strict``: also nullable columns where the schema has none."""
    found = []
    if len(df.schema) != len(schema):
        found.append(f"{len(schema)} columns are declared, {len(df.schema)} are there")
    for have, want in zip(df.schema, schema, strict=False):
        if have.name != want.name:
            found.append(f"column {want.name} is declared, {have.name} is there")
        if have.dataType.simpleString() != want.dataType.simpleString():
            found.append(f"column {want.name} is declared {want.dataType.simpleString()}, {have.dataType.simpleString()} is there")
        if strict and have.nullable and not want.nullable:
            found.append(f"column {want.name} may hold NULL")
    return found


def validate(df: DataFrame, schema: T.StructType, strict: bool = False) -> DataFrame:
    if found := mismatches(df, schema, strict):
        raise SchemaMismatch(found)
    return df


def narrow(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` under a schema with fewer NULLs: one early-stopping job fails if a column that is now required holds one."""
    validate(df, schema)
    required = [f.name for f in schema if not f.nullable and df.schema[f.name].nullable]
    if required:
        holds = [F.col(c).isNull() for c in required]
        bad = df.where(" or ".join(f"`{c}` is null" for c in required)).select(*[h.alias(c) for h, c in zip(holds, required, strict=True)]).first()
        if bad is not None:
            raise SchemaMismatch([f"column {c} holds NULL" for c in required if bad[c]])
    return df.to(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]))
