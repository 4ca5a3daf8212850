import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions.rpn import OPERATORS, arity, calc, evaluate as evaluate_rpn, parse_rpn
from brindle.operators.sorting import is_sorted, numbered, sort, sort_unsigned, unsigned
from brindle.sources.uint64 import as_unsigned, file_is_sorted, read_uint64, sort_file, write_uint64

CASES = {
    "empty": [],
    "one": [5],
    "duplicates": [3, 3, 1, 3, 1],
    "sorted": list(range(50)),
    "reversed": list(range(50))[::-1],
    "extremes": [2**63, 2**64 - 1, 0, 1, 2**63 - 1],
    "random": [random.Random(1).getrandbits(64) for _ in range(3000)],
}


@pytest.mark.parametrize("case", CASES)
def test_raw_file_is_sorted_as_unsigned(spark, tmp_path, case):
    data = np.array(CASES[case], np.uint64)
    (tmp_path / "in").write_bytes(data.tobytes())
    df = read_uint64(spark, str(tmp_path / "in"))
    assert write_uint64(sort_unsigned(df, "x"), str(tmp_path / "out")) == len(data)
    assert np.fromfile(tmp_path / "out", np.uint64).tolist() == sorted(CASES[case])
    if CASES[case]:
        assert df.select(F.max(as_unsigned("x"))).first()[0] == max(CASES[case])


def test_signed_sort_and_direction(spark):
    df = spark.createDataFrame([(v,) for v in (3, -1, 2, 3)], "v long")
    assert [r.v for r in sort(df, "v", memory_mb=1).collect()] == [-1, 2, 3, 3]
    assert [r.v for r in sort(df, 0, descending=True).collect()] == [3, 3, 2, -1]
    assert [r.v for r in sort_unsigned(df, "v").collect()] == [2, 3, 3, -1]


@pytest.mark.parametrize("descending", [False, True])
def test_numbering_is_a_permutation_in_order(spark, descending):
    values = [random.Random(2).randrange(200) for _ in range(1000)] + [7] * 500
    rows = numbered(spark.createDataFrame([(v,) for v in values], "v long"), F.col("v"), descending).collect()
    assert sorted(r.pos for r in rows) == list(range(1, 1501))
    assert [r.v for r in sorted(rows, key=lambda r: r.pos)] == sorted(values, reverse=descending)
    assert numbered(spark.createDataFrame([], "v long"), F.col("v")).count() == 0


def test_sortedness_check(spark, monkeypatch):
    from brindle.operators import sorting

    monkeypatch.setattr(sorting, "CHECK_ROWS", 4)

    def check(values, strict=False):
        return is_sorted(spark.createDataFrame(list(enumerate(values)), "p long, v long"), "v", "p", strict).first()[0]

    assert check([]) and check([1]) and check(list(range(20)), True)
    assert check([1, 1, 2]) and not check([1, 1, 2], True)
    assert not check([0, 1, 2, 9, 4, 5, 6, 7]) and not check([0, 1, 2, 3, 3], True)
    assert unsigned is not None


def wrap(v):
    return (v + 2**31) % 2**32 - 2**31


def evaluate(tree, v):
    if hasattr(tree, "index"):
        return v[tree.index]
    a, b = evaluate(tree.left, v), evaluate(tree.right, v)
    if tree.operator == "/":
        q = abs(a) // abs(b)
        return wrap(q if (a < 0) == (b < 0) else -q)
    return wrap({"+": a + b, "-": a - b, "*": a * b}[tree.operator])


@pytest.mark.parametrize("text,values,expected", [("0 1 + 2 3 - *", (1, 2, 9, 4), 15), ("0 1 /", (-7, 2), -3), ("0 0 *", (46341,), -2147479015), ("0 1 /", (-(2**31), -1), -(2**31)), ("2", (0, 0, 5), 5)])
def test_expressions(spark, text, values, expected):
    df = spark.createDataFrame([values], ", ".join(f"v{k} int" for k in range(len(values))))
    assert calc(df, text, df.columns).first()["r"] == expected


def test_random_expressions_agree_with_python(spark):
    rng = random.Random(3)

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            return str(rng.randrange(4))
        return f"{grow(depth - 1)} {grow(depth - 1)} {rng.choice(OPERATORS[:3])}"

    rows = [tuple(rng.randrange(-(2**31), 2**31) for _ in range(4)) for _ in range(20)]
    df = spark.createDataFrame(rows, "v0 int, v1 int, v2 int, v3 int")
    for text in {grow(4) for _ in range(8)}:
        got = [r["r"] for r in calc(df, text, df.columns).collect()]
        assert got == [evaluate(parse_rpn(text), r) for r in rows], text


@pytest.mark.parametrize("text", ["", "+", "0 +", "0 1", "-5", "a", "0 1 %", "0 1 + +"])
def test_malformed_expressions(text):
    with pytest.raises(ValueError):
        parse_rpn(text)


def test_too_few_variables_and_division_by_zero(spark):
    df = spark.createDataFrame([(1, 0)], "a int, b int")
    assert arity(parse_rpn("0 7 +")) == 8
    with pytest.raises(ValueError):
        calc(df, "0 2 +", ["a", "b"])
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        calc(df, "0 1 /", ["a", "b"]).collect()


def test_files_and_single_values(spark, tmp_path):
    data = np.array(CASES["random"] + [2**64 - 1, 0, 0], np.uint64)
    (tmp_path / "in").write_bytes(data.tobytes())
    (tmp_path / "out").write_bytes(b"longer than before" * 10**4)
    assert not file_is_sorted(str(tmp_path / "in"))
    assert sort_file(spark, str(tmp_path / "in"), str(tmp_path / "out"), 1) == len(data)
    assert file_is_sorted(str(tmp_path / "out")) and not file_is_sorted(str(tmp_path / "out"), strict=True)
    (tmp_path / "empty").write_bytes(b"")
    assert file_is_sorted(str(tmp_path / "empty"), strict=True)
    assert evaluate_rpn(spark, "0 1 + 2 3 - *", [1, 2, 9, 4]) == 15


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_numbering_in_many_ranges(spark, monkeypatch, descending, kind):
    from brindle.operators import sorting

    monkeypatch.setattr(sorting, "RANGE_ROWS", 20)
    monkeypatch.setattr(sorting, "EQUAL_ROWS", 7)
    # one key holds a third of the rows, and most of its rows are alike
    values = [random.Random(3).randrange(500) for _ in range(800)] + [7] * 400
    data = [(float(v) if kind == "double" else v, 0 if k % 3 else k) for k, v in enumerate(values)]
    rows = numbered(spark.createDataFrame(data, f"v {kind}, w long"), F.col("v"), descending).collect()
    assert sorted(r.pos for r in rows) == list(range(1, 1201))
    assert [r.v for r in sorted(rows, key=lambda r: r.pos)] == sorted((v for v, _ in data), reverse=descending)
    assert sorted((r.v, r.w) for r in rows) == sorted(data)


def test_places_of_a_raw_file(spark, tmp_path):
    from brindle.sources.uint64 import read_placed

    data = np.array(CASES["random"], np.uint64)
    (tmp_path / "in").write_bytes(data.tobytes())
    got = {r.place: r.x % 2**64 for r in read_placed(spark, str(tmp_path / "in")).collect()}
    assert [got[k] for k in range(len(data))] == data.tolist()
    (tmp_path / "none").write_bytes(b"")
    assert read_placed(spark, str(tmp_path / "none")).count() == 0
