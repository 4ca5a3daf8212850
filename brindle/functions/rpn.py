"""Integer expressions in reverse Polish notation, as columns.

``0 1 + 2 3 - *`` means (v0 + v1) * (v2 - v3): a number is the index of a
variable.  Arithmetic is on 32-bit integers: sums, differences and products wrap
around, division truncates toward zero and fails on zero.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPERATORS = ("+", "-", "*", "/")


@dataclass(frozen=True)
class Variable:
    index: int


@dataclass(frozen=True)
class Operation:
    operator: str
    left: Variable | Operation
    right: Variable | Operation


def parse_rpn(text: str) -> Variable | Operation:
    """The tree of an expression; ValueError if it isn't one."""
    stack: list[Variable | Operation] = []
    for token in text.split():
        if token in OPERATORS:
            if len(stack) < 2:
                raise ValueError(f"{token} lacks operands in {text!r}")
            right, left = stack.pop(), stack.pop()
            stack.append(Operation(token, left, right))
        elif token.isascii() and token.isdigit():
            stack.append(Variable(int(token)))
        else:
            raise ValueError(f"{token!r} is neither a variable nor an operator")
    if len(stack) != 1:
        raise ValueError(f"{text!r} has {len(stack)} values, not one")
    return stack[0]


def arity(tree: Variable | Operation) -> int:
    """Number of variables: the highest index and one; gaps count."""
    return tree.index + 1 if isinstance(tree, Variable) else max(arity(tree.left), arity(tree.right))


def wrap32(value: Column) -> Column:
    """The 32-bit integer of a long's low bits."""
    return F.shiftright(F.shiftleft(value, 32), 32).cast("int")


def as_column(tree: Variable | Operation, columns: list[Column]) -> Column:
    """The tree over columns, each step in longs and wrapped to 32 bits."""
    if isinstance(tree, Variable):
        return wrap32(columns[tree.index].cast("long"))
    a, b = (as_column(t, columns).cast("long") for t in (tree.left, tree.right))
    if tree.operator == "/":
        return wrap32(F.call_function("div", a, b))
    return wrap32({"+": a.__add__, "-": a.__sub__, "*": a.__mul__}[tree.operator](b))


def calc(df: DataFrame, text: str, columns: list[str], name: str = "r") -> DataFrame:
    """``df`` with the expression over the named columns; ValueError if there are too few."""
    tree = parse_rpn(text)
    if arity(tree) > len(columns):
        raise ValueError(f"{text!r} needs {arity(tree)} variables, {len(columns)} are given")
    return df.withColumn(name, as_column(tree, [F.col(c) for c in columns]))


def evaluate(spark: SparkSession, text: str, numbers: list[int]) -> int:
    """The value of an expression for given variables, as a query over one row."""
    row = spark.range(1).select(*[F.lit(v).cast("int").alias(f"v{k}") for k, v in enumerate(numbers)], F.lit(0).alias("_"))
    return calc(row, text, [f"v{k}" for k in range(len(numbers))]).first()["r"]


if __name__ == "__main__":
    # python -m brindle.functions.rpn "0 1 + 2 3 - *" 1 2 9 4
    if len(sys.argv) < 2:
        sys.exit("usage: python -m brindle.functions.rpn EXPRESSION [VALUE ...]")
    session = SparkSession.builder.appName("calc").getOrCreate()
    print(evaluate(session, sys.argv[1], [int(v) for v in sys.argv[2:]]))
    session.stop()
