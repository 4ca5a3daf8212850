"""Registered verification queries of the engine's own operators, with their DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.rpn import calc, evaluate
from brindle.kinds import DOUBLE, INTEGER, STRING, access, value_hash
from brindle.operators import index, records
from brindle.operators.printing import printed
from brindle.operators.relational import hash_join, prepared_select, project, scan, select_eq, select_ne, values
from brindle.operators.sorting import is_sorted, numbered, sort, sort_unsigned, unsigned
from brindle.sources import catalog, uint64
from brindle.plans.orders_of_nation import orders_of_nation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a function under its name, with the SQL that it must agree with."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet")


@query("SELECT * FROM nation")
def scan_table(spark, sf_dir):
    return table(spark, sf_dir, "nation")


@query("SELECT * FROM orders WHERE o_custkey = 899")
def select_eq_int(spark, sf_dir):
    return select_eq(table(spark, sf_dir, "orders"), "o_custkey", 899)


@query("SELECT * FROM lineitem WHERE l_quantity = 17.0")
def select_eq_double(spark, sf_dir):
    return select_eq(table(spark, sf_dir, "lineitem"), "l_quantity", 17.0)


@query("SELECT * FROM lineitem WHERE l_returnflag = 'R'")
def select_eq_string(spark, sf_dir):
    return select_eq(table(spark, sf_dir, "lineitem"), "l_returnflag", "R")


@query("SELECT * FROM orders WHERE false")
def select_kind_mismatch(spark, sf_dir):
    return select_eq(table(spark, sf_dir, "orders"), "o_custkey", 899.0)


@query("SELECT * FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'")
def select_ne_string(spark, sf_dir):
    return select_ne(table(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING")


@query("SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2")
def select_conjunction(spark, sf_dir):
    return select_eq(select_eq(table(spark, sf_dir, "lineitem"), "l_returnflag", "R"), "l_linenumber", 2)


@query("SELECT * FROM nation WHERE n_nationkey = 3 UNION ALL SELECT * FROM nation WHERE n_nationkey = 7")
def select_prepared(spark, sf_dir):
    bound = prepared_select(table(spark, sf_dir, "nation"), 0)
    return bound(3).unionAll(bound(7))


@query("SELECT c_name, c_custkey FROM customer")
def project_subset(spark, sf_dir):
    return project(table(spark, sf_dir, "customer"), [1, 0])


@query("SELECT n_name, n_nationkey, n_name AS n_name_2 FROM nation")
def project_dup(spark, sf_dir):
    return project(table(spark, sf_dir, "nation"), [1, 0, 1])


@query("SELECT n.*, c.* FROM nation n JOIN customer c ON n_nationkey = c_nationkey")
def join_int(spark, sf_dir):
    return hash_join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), "n_nationkey", "c_nationkey")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def join_many_to_many(spark, sf_dir):
    joined = hash_join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), "s_nationkey", "c_nationkey")
    return project(joined, ["s_suppkey", "c_custkey"])


@query("SELECT l_orderkey, l_linenumber, k FROM lineitem JOIN (SELECT DISTINCT CAST(o_orderkey % 50 AS DOUBLE) AS k FROM orders) ON l_quantity = k")
def join_double(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).cast("double").alias("k")).distinct()
    return project(hash_join(table(spark, sf_dir, "lineitem"), keys, "l_quantity", "k"), ["l_orderkey", "l_linenumber", "k"])


@query("SELECT a.p_partkey, b.p_brand AS brand, b.p_size AS size FROM part a JOIN (SELECT DISTINCT p_brand, p_size FROM part) b ON a.p_brand = b.p_brand")
def join_string(spark, sf_dir):
    part = project(table(spark, sf_dir, "part"), ["p_partkey", "p_brand", "p_size"])
    return project(hash_join(part, part.select("p_brand", "p_size").distinct(), "p_brand", "p_brand"), [0, 3, 4]).toDF("p_partkey", "brand", "size")


@query("SELECT n.*, s.* FROM nation n JOIN supplier s ON false")
def join_kind_mismatch(spark, sf_dir):
    return hash_join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), "n_nationkey", "s_acctbal")


@query("SELECT n.*, r.* FROM region r JOIN nation n ON n_regionkey = r_regionkey")
def join_build_left(spark, sf_dir):
    joined = hash_join(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"), "r_regionkey", "n_regionkey", build="left")
    return project(joined, [2, 3, 4, 0, 1])


@query("SELECT o_orderkey, c_name, n_name, o_totalprice FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey WHERE n_name = 'NATION_3'")
def pipeline_orders(spark, sf_dir):
    return orders_of_nation(table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "NATION_3")


@query("SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS pos FROM lineitem")
def sort_asc(spark, sf_dir):
    return sort(numbered(table(spark, sf_dir, "lineitem").select("l_orderkey"), F.col("l_orderkey")), "pos")


@query("SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey DESC) AS pos FROM lineitem")
def sort_desc(spark, sf_dir):
    return sort(numbered(table(spark, sf_dir, "lineitem").select("l_orderkey"), F.col("l_orderkey"), True), "l_orderkey", True)


@query("SELECT k, row_number() OVER (ORDER BY k < 0, k) AS pos FROM (SELECT o_orderkey - 7500 AS k FROM orders)")
def sort_unsigned_bits(spark, sf_dir):
    held = table(spark, sf_dir, "orders").select((F.col("o_orderkey") - 7500).alias("k"))
    return sort_unsigned(numbered(held, unsigned(F.col("k"))), "k")


def _check_sql(column: str, source: str, sign: str) -> str:
    return f"SELECT coalesce(bool_and(coalesce(ahead {sign} v, true)), true) AS is_sorted FROM (SELECT {column} AS v, lag({column}) OVER (ORDER BY p) AS ahead FROM (SELECT {column}, row_number() OVER () AS p FROM {source}))"


@query(_check_sql("l_orderkey", "lineitem", "<"))
def sort_check(spark, sf_dir):
    return is_sorted(records.scan_records(spark, f"{sf_dir}/lineitem.parquet"), "l_orderkey", "tid", strict=True)


@query(_check_sql("o_orderkey", "orders", "<="))
def sort_check_loose(spark, sf_dir):
    return is_sorted(records.scan_records(spark, f"{sf_dir}/orders.parquet"), "o_orderkey", "tid")


@query("SELECT l_orderkey, l_linenumber, CAST((l_linenumber + CAST(l_quantity AS BIGINT)) * (l_partkey - l_suppkey) AS INTEGER) AS r FROM lineitem")
def calc_rpn(spark, sf_dir):
    return calc(table(spark, sf_dir, "lineitem"), "0 1 + 2 3 - *", ["l_linenumber", "l_quantity", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "r")


@query("SELECT o_orderkey, CAST((o_orderkey - 7500) // 7 AS INTEGER) AS r FROM orders")
def calc_div(spark, sf_dir):
    held = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") - 7500).alias("a"), F.lit(7).alias("b"))
    return calc(held, "0 1 /", ["a", "b"]).select("o_orderkey", "r")


@query("SELECT o_orderkey, CAST((((o_orderkey * 1000003) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS r FROM orders")
def calc_wrap(spark, sf_dir):
    held = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1000003).alias("m"))
    return calc(held, "0 1 *", ["o_orderkey", "m"]).select("o_orderkey", "r")


def _orders_index(spark, sf_dir) -> index.OrderedIndex:
    return index.OrderedIndex(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")))


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_orderkey >= 14000")
def index_range(spark, sf_dir):
    return _orders_index(spark, sf_dir).range_from(14000)


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_orderkey = 4242")
def index_lookup(spark, sf_dir):
    return _orders_index(spark, sf_dir).at(4242)


@query("SELECT max(o_orderkey) AS max_key FROM orders")
def index_max(spark, sf_dir):
    return _orders_index(spark, sf_dir).max_key()


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders UNION ALL SELECT CAST(999999 AS BIGINT), CAST(1 AS BIGINT)")
def index_insert(spark, sf_dir):
    return _orders_index(spark, sf_dir).insert(spark.createDataFrame([(999999, 1)], "key long, value long"), repeated=True).entries


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE o_orderkey <> 4242")
def index_erase(spark, sf_dir):
    return _orders_index(spark, sf_dir).erase(4242).entries


@query("SELECT o_orderkey AS key, min(o_custkey) AS value FROM orders GROUP BY o_orderkey")
def index_build(spark, sf_dir):
    return index.OrderedIndex.build(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey").entries


@query("SELECT *, CAST(1242 AS BIGINT) AS tid FROM orders LIMIT 1 OFFSET 1242")
def record_lookup(spark, sf_dir):
    return records.fetch(records.scan_records(spark, f"{sf_dir}/orders.parquet"), 1242)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 <> 0")
def record_remove(spark, sf_dir):
    held = records.scan_records(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "tid")
    return records.remove(held, held.where("o_orderkey % 10 = 0")).drop("tid")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'moved' ELSE s_name END AS s_name FROM supplier")
def record_update(spark, sf_dir):
    held = records.scan_records(spark, f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "tid")
    return records.update(held, held.where("s_suppkey % 10 = 0").select("tid", F.lit("moved").alias("s_name"))).drop("tid")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'moved' ELSE s_name END AS s_name FROM supplier")
def record_update_where(spark, sf_dir):
    held = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return records.update_where(held, F.col("s_suppkey") % 10 == 0, {"s_name": F.lit("moved")})


@query("SELECT r_regionkey, r_name, row_number() OVER () - 1 AS tid FROM region UNION ALL SELECT CAST(5 AS INTEGER), 'ATLANTIS', CAST(5 AS BIGINT)")
def record_insert(spark, sf_dir):
    new = values(spark, [(5, "ATLANTIS")], "r_regionkey int, r_name string")
    return records.insert(records.scan_records(spark, f"{sf_dir}/region.parquet"), new)


@query("SELECT s_suppkey, concat('Field 0: (Integer) ', s_suppkey, chr(10), 'Field 1: (String) ', s_name, chr(10), 'Field 2: (Integer) ', s_nationkey) AS line FROM supplier")
def print_rows(spark, sf_dir):
    held = project(table(spark, sf_dir, "supplier"), [0, 1, 2])
    return held.select("s_suppkey", printed(held).alias("line"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Hello World', CAST(10 AS DOUBLE)), (2, 'Answer', 42), (3, 'Pi', 3.14159265359)) v(f0, f1, f2)")
def values_fixture(spark, sf_dir):
    return values(spark, [(1, "Hello World", 10.0), (2, "Answer", 42.0), (3, "Pi", 3.14159265359)], "f0 long, f1 string, f2 double")


@query("SELECT concat('Field 0: (Double) ', printf('%.6g', o_totalprice), chr(10), 'Field 1: (Integer) ', o_orderkey) AS line FROM orders")
def print_doubles(spark, sf_dir):
    held = project(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"])
    return held.select(printed(held).alias("line"))


@query("SELECT *, row_number() OVER () - 1 AS tid FROM supplier")
def record_iterate(spark, sf_dir):
    return records.in_order(records.scan_records(spark, f"{sf_dir}/supplier.parquet"))


def _shared_file(spark, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        top = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_custkey - 700 AS x FROM orders")
def uint64_source(spark, sf_dir):
    path = _shared_file(spark, "values")
    uint64.write_uint64(table(spark, sf_dir, "orders").select((F.col("o_custkey") - 700).alias("x")), path)
    return uint64.read_uint64(spark, path)


@query("SELECT row_number() OVER (ORDER BY x < 0, x) - 1 AS place, x FROM (SELECT o_custkey - 700 AS x FROM orders)")
def uint64_file_sort(spark, sf_dir):
    source, target = _shared_file(spark, "unsorted"), _shared_file(spark, "sorted")
    uint64.write_uint64(table(spark, sf_dir, "orders").select((F.col("o_custkey") - 700).alias("x")), source)
    uint64.sort_file(spark, source, target)
    return uint64.read_placed(spark, target)


@query("SELECT count(*) AS n, true AS is_sorted FROM orders")
def uint64_memory_sort(spark, sf_dir):
    path, target = _shared_file(spark, "unsorted"), _shared_file(spark, "sorted")
    uint64.write_uint64(table(spark, sf_dir, "orders").select((F.col("o_custkey") * 7919 % 1501).alias("x")), path)
    uint64.sort_file(spark, path, target, memory_mb=1)
    placed = uint64.read_placed(spark, target)
    return is_sorted(placed.withColumn("x", unsigned(F.col("x"))), "x", "place").crossJoin(placed.agg(F.count("*").alias("n"))).select("n", "is_sorted")


def _named(spark, df: DataFrame) -> str:
    """A new stored relation; its files lie in the warehouse until ``_dropped``."""
    name = f"relation_{uuid.uuid4().hex}"
    catalog.create_relation(spark, name, df)
    return name


def _dropped(spark, name: str) -> None:
    spark.sql(f"DROP TABLE {name}")


@query("SELECT true AS listed, true AS refused, count(*) AS n FROM nation")
def catalog_create_open(spark, sf_dir):
    held = table(spark, sf_dir, "nation")
    name = _named(spark, held)
    try:
        refused = False
        try:
            catalog.create_relation(spark, name, held)
        except ValueError:
            refused = True
        rows = catalog.open_relation(spark, name).count()
        return values(spark, [(name in catalog.list_relations(spark), refused, rows)], "listed boolean, refused boolean, n long")
    finally:
        _dropped(spark, name)


@query("SELECT * FROM (VALUES (0, 's_suppkey', 'bigint'), (1, 's_name', 'string'), (2, 's_nationkey', 'int'), (3, 's_acctbal', 'double')) v(place, attribute, kind)")
def catalog_describe(spark, sf_dir):
    name = f"view_{uuid.uuid4().hex}"
    catalog.create_relation(spark, name, table(spark, sf_dir, "supplier"), stored=False)
    try:
        return values(spark, [(k, a, t) for k, (a, t) in enumerate(catalog.describe(spark, name))], "place int, attribute string, kind string")
    finally:
        spark.catalog.dropTempView(name)


@query("SELECT true AS grown, true AS counted, CAST(1 AS BIGINT) AS files FROM region LIMIT 1")
def catalog_size(spark, sf_dir):
    name = _named(spark, table(spark, sf_dir, "region").coalesce(1))
    try:
        before = catalog.size_in_bytes(spark, name)
        _, files, pages = catalog.segment(spark, name)
        table(spark, sf_dir, "region").write.insertInto(name)
        spark.catalog.refreshTable(name)
        return values(spark, [(catalog.size_in_bytes(spark, name) > before > 0, pages == -(-before // 4096), files)], "grown boolean, counted boolean, files long")
    finally:
        _dropped(spark, name)


@query("SELECT l_quantity AS value, count(*) AS n, CAST(1 AS BIGINT) AS hashes FROM lineitem GROUP BY l_quantity")
def value_hashes(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").select("l_quantity")
    hashed = held.withColumn("h", value_hash(F.col("l_quantity"), DOUBLE))
    # equal values share a hash, and here different values have different ones
    whole = hashed.groupBy("h").agg(F.min("l_quantity").alias("value"), F.max("l_quantity").alias("top"), F.count("*").alias("n"))
    return whole.groupBy("value").agg(F.sum("n").alias("n"), F.count("*").alias("hashes"))


@query("SELECT o_orderkey AS i, o_totalprice AS d, o_orderstatus AS s, CAST(7 AS INTEGER) AS set_i FROM orders")
def value_access(spark, sf_dir):
    held = table(spark, sf_dir, "orders")
    return held.select(access(held, "o_orderkey", INTEGER).alias("i"), access(held, 3, DOUBLE).alias("d"), access(held, "o_orderstatus", STRING).alias("s"), F.lit(7).alias("set_i"))


@query("SELECT CAST((c1 + c2) * (c3 - c4) AS INTEGER) AS r FROM (SELECT 1 AS c1, 2 AS c2, 9 AS c3, 4 AS c4)")
def calc_once(spark, sf_dir):
    return values(spark, [(evaluate(spark, "0 1 + 2 3 - *", [1, 2, 9, 4]),)], "r int")


@query("SELECT page, unnest([printf('  page%d [shape=record, label=\"{%d .. %d|%d keys}\"];', page, low, high, n), printf('  root -> page%d;', page)]) AS line FROM (SELECT (p - 1) // 1000 AS page, min(k) AS low, max(k) AS high, count(*) AS n FROM (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1)")
def index_dot(spark, sf_dir):
    return _orders_index(spark, sf_dir).dot_lines(1000)
