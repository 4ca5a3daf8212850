"""Value kinds and kind-strict equality.

Three kinds of values compare: integers, doubles and strings.  Values of
different kinds are never equal (1 and 1.0 differ), a missing value equals
nothing, NaN differs from itself and -0.0 equals 0.0.  Kinds follow from column
types, so a mismatch is settled when the plan is made.
"""

from __future__ import annotations

import datetime
import decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, DOUBLE, STRING, INVALID = "Integer", "Double", "String", "Invalid"


def kind_of(data_type: T.DataType) -> str:
    """Kind of a column type; types beyond the three kinds are kinds of their own."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return DOUBLE
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return STRING
    if isinstance(data_type, T.NullType):
        return INVALID
    return data_type.simpleString()


def kind_of_value(value: object) -> str:
    """Kind of a Python constant."""
    if value is None:
        return INVALID
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return INTEGER
    if isinstance(value, float):
        return DOUBLE
    if isinstance(value, str):
        return STRING
    names = {datetime.datetime: "timestamp_ntz", datetime.date: "date", bytes: "binary"}
    if type(value) in names:
        return names[type(value)]
    if isinstance(value, decimal.Decimal):
        return "decimal"
    raise TypeError(f"no kind for a constant of type {type(value).__name__}")


def same_kind(a: str, b: str) -> bool:
    """Whether values of the two kinds can be equal."""
    if INVALID in (a, b):
        return False
    return a == b or {a, b} <= {"timestamp", "timestamp_ntz"} or (a.startswith("decimal") and b.startswith("decimal"))


def strict_eq(a: Column, b: Column, kind_a: str, kind_b: str) -> Column:
    """Equality: null where a side is null, else true or false; false across kinds."""
    if not same_kind(kind_a, kind_b):
        return F.lit(False)
    if kind_a == DOUBLE:
        a, b = a.cast("double"), b.cast("double")
        return (a == b) & ~F.isnan(a)
    return a == b


def strict_ne(a: Column, b: Column, kind_a: str, kind_b: str) -> Column:
    """Negation of equality: total, so true where a side is missing."""
    return ~F.coalesce(strict_eq(a, b, kind_a, kind_b), F.lit(False))


def value_hash(a: Column, kind: str) -> Column:
    """A 64-bit hash that equal values share; -0.0 hashes as 0.0, a missing value as null."""
    if kind == INTEGER:
        a = a.cast("long")
    elif kind == DOUBLE:
        a = a.cast("double") + F.lit(0.0)
    return F.when(a.isNotNull(), F.xxhash64(a))


def position(df: DataFrame, column: int | str) -> int:
    """Place of a column given by place or name; IndexError or KeyError if there is none."""
    if isinstance(column, int):
        if not 0 <= column < len(df.columns):
            raise IndexError(f"no column {column} among {len(df.columns)}")
        return column
    if column not in df.columns:
        raise KeyError(column)
    return df.columns.index(column)


def by_position(df: DataFrame, prefix: str) -> DataFrame:
    """``df`` with columns named by place, which makes duplicated names addressable."""
    return df.toDF(*[f"{prefix}{k}" for k in range(len(df.columns))])


def as_python(value: object, kind: str) -> object:
    """A value of the asked kind; TypeError for another kind or a missing value (no coercion)."""
    if kind_of_value(value) != kind:
        raise TypeError(f"{kind_of_value(value)} value where {kind} is asked for")
    return value


def access(df: DataFrame, column: int | str, kind: str) -> Column:
    """A column read as a kind; TypeError where its own kind differs (no coercion)."""
    f = df.schema[position(df, column)]
    if not same_kind(kind_of(f.dataType), kind):
        raise TypeError(f"{kind_of(f.dataType)} column {f.name} where {kind} is asked for")
    return F.col(f"`{f.name}`")
