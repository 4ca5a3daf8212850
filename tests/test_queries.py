"""Every registered query of the engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pyarrow.parquet as pq
import pytest

from brindle.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    expected = duck.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    rows = sorted(str(tuple(r[k] for k in order)) for r in expected.fetchall())
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == rows


def test_whole_table_joins_equal_brute_force(spark):
    read = lambda name, *c: pq.read_table(f"{SF}/{name}.parquet", columns=list(c)).to_pylist()
    keys = {float(r["o_orderkey"] % 50) for r in read("orders", "o_orderkey")}
    lines = sorted((r["l_orderkey"], r["l_linenumber"], r["l_quantity"]) for r in read("lineitem", "l_orderkey", "l_linenumber", "l_quantity") if r["l_quantity"] in keys)
    assert sorted(map(tuple, QUERIES["join_double"](spark, SF).collect())) == lines and lines
    part = read("part", "p_partkey", "p_brand", "p_size")
    sizes = {(r["p_brand"], r["p_size"]) for r in part}
    pairs = sorted((r["p_partkey"], b, n) for r in part for b, n in sizes if b == r["p_brand"])
    assert sorted(map(tuple, QUERIES["join_string"](spark, SF).collect())) == pairs and pairs


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
