"""Orders of the customers of one nation: scan, select, two joins, project."""

from __future__ import annotations

from pyspark.sql import DataFrame

from brindle.operators.relational import hash_join, project, select_eq


def orders_of_nation(nation: DataFrame, customer: DataFrame, orders: DataFrame, name: str) -> DataFrame:
    """o_orderkey, c_name, n_name, o_totalprice."""
    chosen = select_eq(nation, "n_name", name)
    customers = hash_join(chosen, customer, "n_nationkey", "c_nationkey")
    placed = hash_join(customers, orders, "c_custkey", "o_custkey")
    return project(placed, ["o_orderkey", "c_name", "n_name", "o_totalprice"])
