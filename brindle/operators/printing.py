"""The print sink: one line for each field of each row."""

from __future__ import annotations

import sys
from typing import TextIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.kinds import DOUBLE, INTEGER, STRING, kind_of


def format_field(number: int, kind: str, value: object) -> str:
    """``Field <number>: (<kind>) <value>``; doubles with six significant digits.

    A missing value has no kind and no text, and so leaves only the number.
    """
    if value is None:
        return f"Field {number}: "
    text = f"{value:.6g}" if kind == DOUBLE else str(value)
    return f"Field {number}: ({kind}) {text}"


def format_row(kinds: list[str], row: tuple) -> list[str]:
    return [format_field(k, kind, value) for k, (kind, value) in enumerate(zip(kinds, row))]


def print_rows(df: DataFrame, out: TextIO | None = None) -> int:
    """Write all rows, one partition at a time on the driver; returns their number."""
    out = out or sys.stdout
    kinds = [kind_of(f.dataType) for f in df.schema]
    count = 0
    for row in df.toLocalIterator():
        out.write("".join(line + "\n" for line in format_row(kinds, row)))
        count += 1
    return count


def printed(df: DataFrame) -> Column:
    """The printed lines of a row as a column; doubles are formatted in Arrow batches, the rest by expressions."""

    # defined here, so that it travels by value; Java's formats round and trim otherwise than %g
    @F.pandas_udf(T.StringType())
    def six_digits(held: pd.Series) -> pd.Series:
        return held.map(lambda v: f"{v:.6g}")

    lines = []
    for k, f in enumerate(df.schema):
        kind, c = kind_of(f.dataType), F.col(f"`{f.name}`")
        if kind not in (INTEGER, STRING, DOUBLE):
            raise ValueError(f"column {f.name} of kind {kind} has no printed form as an expression")
        text = F.when(c.isNotNull(), six_digits(c.cast("double"))) if kind == DOUBLE else c.cast("string")
        lines.append(F.concat(F.lit(f"Field {k}: "), F.coalesce(F.concat(F.lit(f"({kind}) "), text), F.lit(""))))
    return F.concat_ws("\n", *lines)
