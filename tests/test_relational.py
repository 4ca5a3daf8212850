import io
import math

import pytest
from pyspark.sql import functions as F

from brindle.kinds import as_python, kind_of_value, strict_eq, strict_ne, value_hash
from brindle.operators.printing import print_rows
from brindle.operators.relational import hash_join, prepared_select, project, scan, select_eq, select_ne


def test_print_has_a_line_for_each_field(fixture_rows):
    out = io.StringIO()
    assert print_rows(fixture_rows.coalesce(1), out) == 3
    lines = out.getvalue().splitlines()
    assert len(lines) == 9
    assert lines[:3] == ["Field 0: (Integer) 1", "Field 1: (String) Hello World", "Field 2: (Double) 10"]
    assert lines[8] == "Field 2: (Double) 3.14159"


def test_project_reorders_drops_and_repeats(fixture_rows):
    assert [tuple(r) for r in project(fixture_rows, [1, 2]).collect()] == [("Hello World", 10.0), ("Answer", 42.0), ("Pi", 3.14159265359)]
    twice = project(fixture_rows, [1, 0, 1])
    assert twice.columns == ["f1", "f0", "f1_2"]
    assert tuple(twice.first()) == ("Hello World", 1, "Hello World")
    with pytest.raises(IndexError):
        project(fixture_rows, [3])


def test_select_is_kind_strict(fixture_rows):
    assert [tuple(r) for r in select_eq(fixture_rows, 0, 2).collect()] == [(2, "Answer", 42.0)]
    for wrong in (2.0, "2", None, True):
        assert select_eq(fixture_rows, 0, wrong).count() == 0
    assert select_ne(fixture_rows, 0, 2.0).count() == 3
    bound = prepared_select(fixture_rows, "f1")
    assert bound("Pi").count() == 1 and bound("pi").count() == 0
    with pytest.raises(IndexError):
        select_eq(fixture_rows, 9, 1)


def test_self_join_keeps_left_columns_first(fixture_rows):
    joined = hash_join(fixture_rows, fixture_rows, 0, 0)
    assert joined.columns == [f"f{k}" for k in range(6)]
    assert sorted(tuple(r) for r in joined.collect())[1] == (2, "Answer", 42.0, 2, "Answer", 42.0)
    assert hash_join(fixture_rows, fixture_rows, 0, 2).count() == 0


def test_join_is_many_to_many_and_ignores_missing_and_nan(spark):
    a = spark.createDataFrame([(1.0, "a"), (1.0, "b"), (float("nan"), "n"), (None, "z"), (-0.0, "o")], "k double, a string")
    b = spark.createDataFrame([(1.0, "x"), (1.0, "y"), (float("nan"), "n"), (None, "z"), (0.0, "o")], "j double, b string")
    for build in (None, "left", "right"):
        got = sorted((r["a"], r["b"]) for r in hash_join(a, b, "k", "j", build).collect())
        assert got == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("o", "o")]


MATRIX = [
    (None, None, False),
    (7, 7, True),
    (7, 23, False),
    (23.0, 23, False),
    (23.0, 23.0, True),
    (50.0, 23.0, False),
    (50.0, "50", False),
    ("Hallo", "50", False),
    ("Hallo", "Hallo", True),
    ("Hallo", "Welt", False),
    (math.nan, math.nan, False),
    (-0.0, 0.0, True),
]


@pytest.mark.parametrize("a,b,equal", MATRIX)
def test_equality_matrix(spark, a, b, equal):
    kinds = kind_of_value(a), kind_of_value(b)
    row = spark.range(1).select(F.coalesce(strict_eq(F.lit(a), F.lit(b), *kinds), F.lit(False)).alias("eq"), strict_ne(F.lit(a), F.lit(b), *kinds).alias("ne")).first()
    assert (row["eq"], row["ne"]) == (equal, not equal)


@pytest.mark.parametrize("value,kind", [(0, "Integer"), (-45768, "Integer"), (1.0, "Double"), (-10e200, "Double"), ("", "String"), ("Hallo Welt!", "String")])
def test_values_are_read_as_their_kind_only(value, kind):
    assert as_python(value, kind) == value
    for other in {"Integer", "Double", "String"} - {kind}:
        with pytest.raises(TypeError):
            as_python(value, other)
        with pytest.raises(TypeError):
            as_python(None, other)


def test_equal_values_hash_alike(spark):
    row = spark.range(1).select(value_hash(F.lit(-0.0), "Double").alias("a"), value_hash(F.lit(0.0), "Double").alias("b"), value_hash(F.lit(7).cast("int"), "Integer").alias("c"), value_hash(F.lit(7).cast("long"), "Integer").alias("d"), value_hash(F.lit(None).cast("string"), "String").alias("e")).first()
    assert row["a"] == row["b"] and row["c"] == row["d"] and row["e"] is None


def test_scan_prunes_and_pushes(spark):
    df = project(select_eq(scan(spark, "/root/testdata/sf0.001/nation.parquet"), "n_name", "NATION_3"), ["n_nationkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(n_name,NATION_3)" in plan and "n_regionkey" not in plan.split("ReadSchema")[1]
    wrong = select_eq(scan(spark, "/root/testdata/sf0.001/orders.parquet"), "o_custkey", 899.0)
    assert "Scan parquet" not in wrong._jdf.queryExecution().executedPlan().toString()


def test_stream_takes_the_same_operators(spark, tmp_path, fixture_rows):
    from brindle.streaming import follow

    fixture_rows.write.parquet(str(tmp_path / "in"))
    stream = project(select_eq(follow(spark, str(tmp_path / "in"), fixture_rows.schema), 1, "Pi"), [2])
    q = stream.writeStream.format("memory").queryName("followed").start()
    q.processAllAvailable()
    q.stop()
    assert [r[0] for r in spark.table("followed").collect()] == [3.14159265359]
