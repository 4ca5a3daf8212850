"""Header-less files of native-endian unsigned 64-bit values.

The bits are carried in a long column ``x``; order them with
``brindle.operators.sorting.sort_unsigned``.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.sorting import sort_unsigned

_NATIVE = "<i8" if sys.byteorder == "little" else ">i8"
#: Values that a batch of records holds.
BATCH = 1 << 16


def read_uint64(spark: SparkSession, path: str) -> DataFrame:
    """Column ``x``: every whole 8-byte value of the file; a rest of less than 8 bytes is an error.

    Fixed-length records are the one input that has no DataFrame reader.  The
    file's splits are read as records inside the JVM and unpacked there by an
    expression, so that no value passes through Python.
    """
    held = spark.sparkContext._jsc.binaryRecords(path, 8).rdd()
    frame = DataFrame(spark._jsparkSession.createDataset(held, spark._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    value = F.col(frame.columns[0])
    if sys.byteorder == "little":
        value = F.concat(*[F.substring(value, k, 1) for k in range(8, 0, -1)])
    return frame.select(F.conv(F.hex(value), 16, -10).cast("long").alias("x"))


def read_placed(spark: SparkSession, path: str) -> DataFrame:
    """``place``, ``x``: the values of a file and their places in it, from 0.

    Splits are in order of their offsets, and so are the values of a split; one
    job counts each split's values, which number the next ones.
    """
    held = read_uint64(spark, path).select(F.spark_partition_id().alias("_split"), F.monotonically_increasing_id().alias("_id"), "x")
    # one row per split
    sizes = {r["_split"]: r["n"] for r in held.groupBy("_split").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    if not before:
        return held.select(F.lit(0).cast("long").alias("place"), "x")
    first = F.element_at(F.lit(before).cast("array<bigint>"), F.col("_split") + 1)
    # the low 33 bits number the rows of a split
    return held.select((first + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"), "x")


def _sink(spark: SparkSession, path: str):
    """Something to write bytes to: a local file, or a stream of the file system that a path with a scheme names."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "wb")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)


def write_uint64(df: DataFrame, path: str, column: str = "x") -> int:
    """Write a sorted column to one file, partition by partition; returns the number of values.

    The target is one stream of bytes, so the driver writes it; it holds one
    partition at a time.  A path without a scheme is a local file of the driver.
    """
    count, out = 0, _sink(df.sparkSession, path)
    try:
        held = []
        for row in df.select(column).toLocalIterator():
            held.append(row[0])
            if len(held) == BATCH:
                out.write(np.array(held, _NATIVE).tobytes())
                count, held = count + len(held), []
        if held:
            out.write(np.array(held, _NATIVE).tobytes())
    finally:
        out.close()
    return count + len(held)


def sort_file(spark: SparkSession, source: str, target: str, memory_mb: int | None = None, descending: bool = False) -> int:
    """Write the values of one file to another in unsigned order; returns their number.

    The target is replaced.  ``memory_mb`` is advisory, as in ``sort``.
    """
    return write_uint64(sort_unsigned(read_uint64(spark, source), "x", descending), target)


def file_is_sorted(path: str, strict: bool = False) -> bool:
    """Whether a local file's values ascend as unsigned ones, read a block at a time; an empty file is sorted."""
    last = None
    with open(path, "rb") as f:
        while block := f.read(8 * BATCH):
            values = np.frombuffer(block, _NATIVE.replace("i", "u"))
            if last is not None:
                values = np.concatenate([[last], values]).astype(np.uint64)
            ahead, behind = values[:-1], values[1:]
            if not (ahead < behind if strict else ahead <= behind).all():
                return False
            last = values[-1]
    return True


def as_unsigned(column):
    """The unsigned reading of the bits, as decimal(20, 0)."""
    wide = F.col(column).cast("decimal(20,0)")
    return F.when(F.col(column) < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


if __name__ == "__main__":
    # python -m brindle.sources.uint64 <source> <target> [<memory in MB>]
    if len(sys.argv) not in (3, 4):
        sys.exit("usage: python -m brindle.sources.uint64 SOURCE TARGET [MEMORY_MB]")
    session = SparkSession.builder.appName("sort").getOrCreate()
    print(sort_file(session, sys.argv[1], sys.argv[2], int(sys.argv[3]) if len(sys.argv) == 4 else None))
    session.stop()
