"""Scan, values, selection, projection and the inner equality join.

All are lazy and address columns by place or name.  Catalyst pushes selections
into the scan, prunes columns and chooses the join strategy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.kinds import by_position, kind_of, kind_of_value, position, same_kind, strict_eq, strict_ne


def scan(spark: SparkSession, source: str) -> DataFrame:
    """Every row of a named relation, or of a Parquet path (anything with a slash)."""
    return spark.read.parquet(source) if "/" in source else spark.table(source)


def values(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """Rows given in the program."""
    return spark.createDataFrame(rows, schema)


def select_eq(df: DataFrame, column: int | str, value: object) -> DataFrame:
    """Rows whose column equals the constant, by kind-strict equality.

    A constant of another kind, NaN and None select nothing.  A conjunction is
    a chain of selections.
    """
    return _selected(df, column, value, strict_eq)


def select_ne(df: DataFrame, column: int | str, value: object) -> DataFrame:
    """Rows whose column doesn't equal the constant; missing values differ from all."""
    return _selected(df, column, value, strict_ne)


def _selected(df: DataFrame, column: int | str, value: object, test: Callable) -> DataFrame:
    k = position(df, column)
    name = df.columns[k]
    kinds = kind_of(df.schema[k].dataType), kind_of_value(value)
    if df.columns.count(name) == 1:
        return df.filter(test(F.col(f"`{name}`"), F.lit(value), *kinds))
    held = by_position(df, "c")
    return held.filter(test(F.col(f"c{k}"), F.lit(value), *kinds)).toDF(*df.columns)


def prepared_select(df: DataFrame, column: int | str) -> Callable[[object], DataFrame]:
    """A selection whose constant is bound at each call."""
    position(df, column)
    return lambda value: select_eq(df, column, value)


def project(df: DataFrame, columns: list[int | str]) -> DataFrame:
    """The columns at the given places, in that order; a place may be named twice.

    The second and later uses of a name get a suffix (_2, _3, ...).
    """
    places = [position(df, c) for c in columns]
    names, seen = [], {}
    for k in places:
        name = df.columns[k]
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    held = by_position(df, "c")
    return held.select(*[F.col(f"c{k}").alias(n) for k, n in zip(places, names)])


def hash_join(left: DataFrame, right: DataFrame, left_column: int | str, right_column: int | str, build: str | None = None) -> DataFrame:
    """Inner join on equality of one column of each side: left columns, then right ones.

    Keys follow kind-strict equality, so keys of different kinds join nothing
    and missing or NaN keys never match.  ``build="left"`` asks for a hash table
    of the left side; otherwise sizes decide at run time.  If names of the two
    sides collide, all columns are renamed f0, f1, ...
    """
    if build not in (None, "left", "right"):
        raise ValueError(f"build is left, right or None, not {build!r}")
    i, j = position(left, left_column), position(right, right_column)
    kinds = kind_of(left.schema[i].dataType), kind_of(right.schema[j].dataType)
    names = [*left.columns, *right.columns]
    if len({n.lower() for n in names}) < len(names):
        names = [f"f{k}" for k in range(len(names))]
    a, b = by_position(left, "l"), by_position(right, "r")
    if not same_kind(*kinds):
        # nothing can match: a plan without any exchange
        return a.limit(0).join(b.limit(0), F.lit(False)).toDF(*names)
    if build == "left":
        a = a.hint("shuffle_hash")
    elif build == "right":
        b = b.hint("shuffle_hash")
    return a.join(b, strict_eq(F.col(f"l{i}"), F.col(f"r{j}"), *kinds), "inner").toDF(*names)
