"""Named relations: create, open, list, describe, size.

Relations are session tables (``saveAsTable``) or temporary views; their
attributes are the schema's fields.  Nothing is dropped or replaced silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create_relation(spark: SparkSession, name: str, df: DataFrame, stored: bool = True) -> DataFrame:
    """Name a relation; ValueError if the name is taken."""
    if spark.catalog.tableExists(name):
        raise ValueError(f"relation {name} exists")
    if stored:
        df.write.mode("error").saveAsTable(name)
    else:
        df.createTempView(name)
    return spark.table(name)


def open_relation(spark: SparkSession, name: str) -> DataFrame:
    """The relation of a name; KeyError if there is none."""
    if not spark.catalog.tableExists(name):
        raise KeyError(name)
    return spark.table(name)


def list_relations(spark: SparkSession) -> list[str]:
    """All names, in order."""
    return sorted(t.name for t in spark.catalog.listTables())


def describe(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    """(attribute, type) in attribute order; KeyError for an unknown name."""
    return [(f.name, f.dataType.simpleString()) for f in open_relation(spark, name).schema]


def size_in_bytes(spark: SparkSession, name: str) -> int:
    """Bytes of the relation's files (0 without files)."""
    df = open_relation(spark, name)
    if not df.inputFiles():
        return 0
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]


def segment(spark: SparkSession, name: str, page_bytes: int = 4096) -> tuple[str, int, int]:
    """(qualified name, files, pages) of a relation: its identity and extent, whole pages of ``page_bytes``.

    A relation without files of its own (a view of values) has none of either.
    """
    df = open_relation(spark, name)
    if not df.inputFiles():
        return name, 0, 0
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    found = files.agg(F.count("*").alias("n"), F.sum(F.ceil(F.col("file_size") / page_bytes)).alias("pages")).first()
    return name, found["n"], found["pages"] or 0
