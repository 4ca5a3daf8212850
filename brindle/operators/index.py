"""An ordered index: unique keys (repeated ones where a caller asks for them) with values, sorted by range.

Stored as Parquet in key order, point and range reads prune row groups by
their key bounds.  The order may follow a key expression instead of the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.sorting import numbered


class DuplicateKey(ValueError):
    """A key has two values."""


class OrderedIndex:
    """A map from ``key`` to ``value``; every change gives a new index."""

    def __init__(self, entries: DataFrame, order: Callable[[Column], Column] | None = None):
        self.entries = entries.select("key", "value")
        self.order = order or (lambda key: key)

    @classmethod
    def empty(cls, spark: SparkSession, schema: str = "key long, value long") -> OrderedIndex:
        return cls(spark.createDataFrame([], schema))

    @classmethod
    def build(cls, df: DataFrame, key: str, value: str, path: str | None = None, order=None) -> OrderedIndex:
        """From a table's columns; a repeated key is one entry if its values agree, else DuplicateKey.

        With a path the entries are stored there in key order.
        """
        index = cls(_unique(df.select(F.col(key).alias("key"), F.col(value).alias("value"))), order)
        return index if path is None else index.store(path)

    def store(self, path: str) -> OrderedIndex:
        by = self.order(F.col("key"))
        self.entries.repartitionByRange(by).sortWithinPartitions(by).write.mode("error").parquet(path)
        return OrderedIndex(self.entries.sparkSession.read.parquet(path), self.order)

    def save(self, name: str) -> OrderedIndex:
        """Store under a name in the session's catalog, in key order; the name must be free."""
        by = self.order(F.col("key"))
        self.entries.repartitionByRange(by).sortWithinPartitions(by).write.mode("error").saveAsTable(name)
        return OrderedIndex(self.entries.sparkSession.table(name), self.order)

    @classmethod
    def open(cls, spark: SparkSession, name: str, order=None) -> OrderedIndex:
        """A saved index; KeyError for an unknown name."""
        if not spark.catalog.tableExists(name):
            raise KeyError(name)
        return cls(spark.table(name), order)

    def insert(self, new: DataFrame, repeated: bool = False) -> OrderedIndex:
        """With entries (key, value) added; the same entry again changes nothing, another value for a key is an error.

        With ``repeated`` every entry is added beside those that are there, whatever its key.
        """
        both = self.entries.unionByName(new.select("key", "value"))
        return OrderedIndex(both if repeated else _unique(both), self.order)

    def erase(self, *keys: object) -> OrderedIndex:
        """Without some keys; absent ones change nothing, None erases the entry of the missing key."""
        some = [k for k in keys if k is not None]
        gone = F.coalesce(F.col("key").isin(*some), F.lit(False)) if some else F.lit(False)
        if len(some) < len(keys):
            gone = gone | F.col("key").isNull()
        return OrderedIndex(self.entries.where(~gone), self.order)

    def at(self, key: object) -> DataFrame:
        """The entry of a key: one row, or none."""
        return self.entries.where(F.col("key") == F.lit(key))

    def lookup(self, key: object) -> object:
        """The value of a key; KeyError if there is none."""
        found = self.at(key).head()
        if found is None:
            raise KeyError(key)
        return found["value"]

    def range_from(self, start: object) -> DataFrame:
        """Entries from ``start`` (included) on, in key order."""
        by = self.order(F.col("key"))
        return self.entries.where(by >= self.order(F.lit(start))).orderBy(by)

    def max_key(self) -> DataFrame:
        """One row, ``max_key``: the greatest key in the index's order (null if empty)."""
        return self.entries.agg(F.max_by("key", self.order(F.col("key"))).alias("max_key"))

    def pages(self, keys: int) -> DataFrame:
        """page (from 0), low, high, n: the entries in key order, ``keys`` to a page."""
        by = self.order(F.col("key"))
        placed = numbered(self.entries.select("key"), by).withColumn("page", F.floor((F.col("pos") - 1) / keys))
        return placed.groupBy("page").agg(F.min_by("key", "pos").alias("low"), F.max_by("key", "pos").alias("high"), F.count("*").alias("n"))

    def dot_lines(self, keys: int) -> DataFrame:
        """page, line: the lines of the graph that show a page and its edge from the root."""
        box = F.format_string('  page%d [shape=record, label="{%s .. %s|%d keys}"];', "page", F.col("low").cast("string"), F.col("high").cast("string"), "n")
        edge = F.format_string("  root -> page%d;", "page")
        return self.pages(keys).select("page", F.explode(F.array(box, edge)).alias("line"))

    def to_dot(self, pages: int = 16) -> str:
        """A graph of the index: a root and at most ``pages`` key ranges with bounds and sizes."""
        keys = max(1, -(-self.entries.count() // pages))
        # two lines a page
        lines = [r["line"] for r in self.dot_lines(keys).orderBy("page", F.desc("line")).collect()]
        lines = [x for k in range(0, len(lines), 2) for x in sorted(lines[k : k + 2], key=lambda x: "->" in x)]
        return "\n".join(["digraph index {", '  root [shape=record, label="root"];', *lines, "}"]) + "\n"


def _unique(entries: DataFrame) -> DataFrame:
    """Each entry once, checked by one aggregate: DuplicateKey if a key has two values."""
    found = entries.groupBy("key").agg(F.min("value").alias("value"), F.max("value").alias("_top"), (F.count("*") - F.count("value")).alias("_null"), F.count("value").alias("_held"))
    twice = ~F.col("value").eqNullSafe(F.col("_top")) | ((F.col("_null") > 0) & (F.col("_held") > 0))
    if found.where(twice).limit(1).count():
        raise DuplicateKey("a key has several values")
    return found.select("key", "value")
