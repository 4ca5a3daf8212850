import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import records
from brindle.operators.index import DuplicateKey, OrderedIndex
from brindle.sources.catalog import create_relation, describe, list_relations, open_relation, size_in_bytes


def test_tuple_ids_are_stable_over_several_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(5).write.parquet(path)
    first = {r["tid"]: r["id"] for r in records.scan_records(spark, path).collect()}
    again = {r["tid"]: r["id"] for r in records.scan_records(spark, path).repartition(3).collect()}
    assert len(first) == 100 and first == again


def test_records_follow_a_model(spark, tmp_path):
    rng = random.Random(5)
    texts = ["x" * n for n in (35, 77, 42, 123, 3005)]
    model = {k: rng.choice(texts) for k in range(200)}
    held = records.rewrite(spark.createDataFrame(list(model.items()), "tid long, payload string"), str(tmp_path / "v0"))
    for step in range(3):
        gone = rng.sample(sorted(model), 20)
        changed = {k: rng.choice(texts) for k in rng.sample(sorted(set(model) - set(gone)), 40)}
        held = records.remove(held, spark.createDataFrame([(k,) for k in gone], "tid long"))
        held = records.update(held, spark.createDataFrame(list(changed.items()), "tid long, payload string"))
        new = [rng.choice(texts) for _ in range(10)]
        held = records.insert(held, spark.createDataFrame([(x,) for x in new], "payload string"))
        held = records.rewrite(held, str(tmp_path / f"v{step + 1}"))
        for k in gone:
            del model[k]
        model |= changed
        now = {r["tid"]: r["payload"] for r in held.collect()}
        fresh = set(now) - set(model)
        assert len(fresh) == 10 and sorted(now[k] for k in fresh) == sorted(new)
        model |= {k: now[k] for k in fresh}
        assert now == model
    some = sorted(model)[3]
    assert records.lookup(held, some)["payload"] == model[some]
    with pytest.raises(KeyError):
        records.lookup(held, gone[0])


def test_update_may_set_null_and_ignores_unknown_ids(spark):
    held = spark.createDataFrame([(0, "a"), (1, "b")], "tid long, s string")
    out = records.update(held, spark.createDataFrame([(1, None), (9, "z")], "tid long, s string"))
    assert sorted((r["tid"], r["s"]) for r in out.collect()) == [(0, "a"), (1, None)]
    assert sorted(r["s"] for r in records.update_where(held, F.col("tid") == 0, {"s": F.lit("c")}).collect()) == ["b", "c"]


def test_index(spark, tmp_path):
    keys = spark.range(1, 301).select(F.col("id").alias("k"), (2 * F.col("id") + 100).alias("v"))
    index = OrderedIndex.build(keys, "k", "v", str(tmp_path / "index"))
    assert [index.lookup(k) for k in (1, 150, 300)] == [102, 400, 700]
    assert [r["key"] for r in index.range_from(298).collect()] == [298, 299, 300]
    assert index.range_from(301).count() == 0 and index.max_key().first()[0] == 300
    with pytest.raises(KeyError):
        index.lookup(301)
    more = index.insert(spark.createDataFrame([(301, 5), (1, 102)], "key long, value long"))
    assert more.entries.count() == 301 and more.lookup(301) == 5
    with pytest.raises(DuplicateKey):
        index.insert(spark.createDataFrame([(1, 7)], "key long, value long"))
    with pytest.raises(DuplicateKey):
        OrderedIndex.build(spark.createDataFrame([(1, 1), (1, 2)], "k long, v long"), "k", "v")
    less = more.erase(5, 999)
    assert less.entries.count() == 300 and less.entries.where("key = 5").count() == 0
    dot = index.to_dot(4)
    assert dot.startswith("digraph") and "1 .. " in dot and " .. 300" in dot
    plan = index.at(7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,7)" in plan


def test_index_in_another_order(spark):
    index = OrderedIndex(spark.createDataFrame([(1, 1), (-1, 2), (0, 3)], "key long, value long"), lambda k: k.bitwiseXOR(F.lit(-(1 << 63))))
    assert [r["key"] for r in index.range_from(0).collect()] == [0, 1, -1]
    assert index.max_key().first()[0] == -1
    empty = OrderedIndex.empty(spark)
    assert empty.max_key().first()[0] is None and empty.range_from(0).count() == 0


def test_saved_index_and_iteration(spark):
    index = OrderedIndex(spark.createDataFrame([(3, 1), (1, 2)], "key long, value long")).save("saved_index")
    assert index.lookup(3) == 1 and OrderedIndex.open(spark, "saved_index").lookup(1) == 2
    with pytest.raises(KeyError):
        OrderedIndex.open(spark, "no_index")
    spark.sql("DROP TABLE saved_index")
    held = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "tid long, s string")
    assert [r["s"] for r in records.iterate(held)] == ["a", "b", "c"]


def test_catalog(spark):
    df = spark.createDataFrame([(1, "a")], "n long, s string")
    create_relation(spark, "catalog_stored", df)
    create_relation(spark, "catalog_view", df, stored=False)
    assert {"catalog_stored", "catalog_view"} <= set(list_relations(spark))
    assert describe(spark, "catalog_stored") == [("n", "bigint"), ("s", "string")]
    assert open_relation(spark, "catalog_view").count() == 1
    assert size_in_bytes(spark, "catalog_stored") > 0 and size_in_bytes(spark, "catalog_view") == 0
    with pytest.raises(ValueError):
        create_relation(spark, "catalog_stored", df)
    with pytest.raises(KeyError):
        open_relation(spark, "catalog_absent")
    spark.sql("DROP TABLE catalog_stored")


def test_tuple_ids_of_a_partitioned_table(spark, tmp_path):
    # the same file names in every folder, and a value that paths have to escape
    for k, part in enumerate(["a b", "c%d", "e"]):
        spark.range(k * 10, k * 10 + 4).withColumn("p", F.lit(part)).coalesce(1).write.mode("append").partitionBy("p").parquet(str(tmp_path / "t"))
    names = {}
    for f in (tmp_path / "t").rglob("*.parquet"):
        f.rename(f.with_name("part-0.parquet"))
    for limit in (records.MOST_SENT_FILES, 0):
        records.MOST_SENT_FILES, kept = limit, records.MOST_SENT_FILES
        try:
            held = records.scan_records(spark, str(tmp_path / "t"))
            rows = held.collect()
        finally:
            records.MOST_SENT_FILES = kept
        assert len(rows) == 12 and len({r.tid for r in rows}) == 12 and held.columns == ["id", "p", "tid"]
        for r in rows:
            names.setdefault(r.p, set()).add(r.tid >> records.ROW_BITS)
    assert sorted(map(len, names.values())) == [1, 1, 1] and len(set.union(*names.values())) == 3


def test_high_water_mark(spark):
    held = spark.createDataFrame([(0, "a"), (1, "b")], "tid long, s string")
    less = records.remove(held, held.where("tid = 1"))
    new = spark.createDataFrame([("c",)], "s string")
    assert {r.tid for r in records.insert(less, new).collect()} == {0, 1}
    assert {r.tid for r in records.insert(less, new, mark=1).collect()} == {0, 2}


def test_missing_keys_of_an_index(spark):
    index = OrderedIndex(spark.createDataFrame([(1, 1), (None, 2)], "key long, value long"))
    assert [r.key for r in index.erase(None).entries.collect()] == [1]
    assert [r.key for r in index.erase(1).entries.collect()] == [None]
    assert index.erase().entries.count() == 2
    with pytest.raises(DuplicateKey):
        index.insert(spark.createDataFrame([(1, None)], "key long, value long"))


def test_segment_and_access(spark):
    from brindle.kinds import DOUBLE, INTEGER, access
    from brindle.sources.catalog import segment

    df = spark.createDataFrame([(1, "a")], "n long, s string")
    create_relation(spark, "segment_of", df.coalesce(1))
    name, files, pages = segment(spark, "segment_of")
    spark.sql("DROP TABLE segment_of")
    assert (name, files, pages) == ("segment_of", 1, 1)
    assert df.select(access(df, 0, INTEGER)).first()[0] == 1
    with pytest.raises(TypeError):
        access(df, "n", DOUBLE)


def test_inserted_key_that_the_table_holds_stays_beside_it(spark, tmp_path):
    from brindle.queries import QUERIES

    rows = [(999999, 7), (5, 3), (5, 3), (999999, 1)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(tuple(r) for r in QUERIES["index_insert"](spark, str(tmp_path)).collect())
    assert got == sorted([*rows, (999999, 1)])
