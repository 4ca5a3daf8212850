"""Records addressed by a stable tuple id.

A stored table's tuple ids come from the files: the place of the file among the
table's files (by whole path) and of the row in the file.  They don't change
under updates.  ``insert`` goes on from the largest id that is present, or from
a high-water mark that the caller has kept; only with the mark is the id of a
removed last record never given out again.  Mutations return a new DataFrame;
``rewrite`` stores one as a new version.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.sorting import numbered

TID = "tid"
#: Bits of a tuple id below the file's number.
ROW_BITS = 40
#: Tables of at most so many files send the list of them to every task.
MOST_SENT_FILES = 100_000


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a Parquet table with their tuple id (column ``tid``).

    A stored ``tid`` column is kept as it is: the ids of a rewritten table are
    those of the rows it was made from.
    """
    df = spark.read.parquet(path)
    if TID in df.columns:
        return df
    row = F.col("_metadata.row_index")
    files = sorted(df.inputFiles())
    if len(files) <= 1:
        return df.select("*", row.alias(TID))
    # a row per file, by its whole path: the same file name may stand in many folders
    known = spark.createDataFrame(list(enumerate(files)), "_number long, _file string")
    if len(files) <= MOST_SENT_FILES:
        known = F.broadcast(known)
    held = df.select("*", row.alias("_row"), F.input_file_name().alias("_file"))
    return held.join(known, "_file").select(*df.columns, (F.shiftleft("_number", ROW_BITS) + F.col("_row")).alias(TID))


def in_order(records: DataFrame) -> DataFrame:
    """Rows in order of their tuple ids."""
    return records.orderBy(TID)


def iterate(records: DataFrame) -> Iterator:
    """Rows in order of their tuple ids, pulled to the driver one partition at a time."""
    return in_order(records).toLocalIterator()


def fetch(records: DataFrame, tid: int) -> DataFrame:
    """The record of a tuple id: one row, or none."""
    return records.filter(F.col(TID) == F.lit(tid))


def lookup(records: DataFrame, tid: int):
    """The record of a tuple id as a Row; KeyError if there is none."""
    found = fetch(records, tid).head()
    if found is None:
        raise KeyError(tid)
    return found


def insert(records: DataFrame, new: DataFrame, mark: int | None = None) -> DataFrame:
    """``records`` and new rows, with fresh tuple ids where records have them.

    Fresh ids go on without gaps from the largest one, or from ``mark`` if that is
    larger: the largest id ever given out, for tables whose last records have
    been removed.  New rows are numbered in order of a hash of their values, the
    same on every run.
    """
    if TID not in records.columns:
        return records.unionByName(new)
    last = records.agg(F.coalesce(F.max(TID), F.lit(-1)).alias("m")).first()["m"]
    last = last if mark is None else max(last, mark)
    plain = [c for c in records.columns if c != TID]
    fresh = numbered(new.select(*plain), F.xxhash64(*plain), name=TID)
    return records.unionByName(fresh.withColumn(TID, F.col(TID) + last).select(*records.columns))


def update(records: DataFrame, changes: DataFrame) -> DataFrame:
    """``records`` with the rows of ``changes`` (tid and new columns) in place; tids stay.

    Rows of ``changes`` without a record are ignored.  Missing values in
    ``changes`` overwrite.
    """
    columns = [c for c in changes.columns if c != TID]
    new = changes.select(F.col(TID).alias("_tid"), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = records.join(new, records[TID] == F.col("_tid"), "left")
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
    return joined.select(*[pick(c) for c in records.columns])


def update_where(records: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """``records`` with columns changed where a condition holds: no join."""
    return records.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})


def remove(records: DataFrame, tids: DataFrame) -> DataFrame:
    """``records`` without those whose tuple id is in ``tids``."""
    return records.join(tids.select(TID), TID, "left_anti").select(*records.columns)


def rewrite(records: DataFrame, path: str) -> DataFrame:
    """Store a version at a new path (never at one that it is read from) and read it."""
    records.write.mode("error").parquet(path)
    return records.sparkSession.read.schema(records.schema).parquet(path)
