"""Bounded samples that are the same on every run and for every partitioning."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``df``: those whose key has the smallest hashes, one row per key.

    A count of the rows gives a hash below which about that many lie, so that
    tasks send little more than the sample and not ``most`` rows each.  Of
    several rows with one key any is taken that is the smallest as a struct;
    rows without key are no candidates.  Needs comparable columns.
    """
    held = df.where(F.col(key).isNotNull()).withColumn("_h", F.xxhash64(key))
    names = [c for c in df.columns if c != key]
    one = lambda x: x.groupBy(key, "_h").agg(*([F.min(F.struct(*names)).alias("_row")] if names else [F.lit(0).alias("_row")]))
    n = held.count()
    share, short = (most + 10 * sqrt(most) + 20) / max(1, n), True
    while short and share < 1:
        near = held.where(F.col("_h") < F.lit(int(-(1 << 63) + share * (1 << 64))))
        # repeated keys can leave too few: then the hash is raised
        short = near.select(key).distinct().limit(most).count() < most
        if not short:
            held = near
        share *= 4
    return one(held).orderBy("_h", key).limit(most).select(key, *[F.col(f"_row.`{c}`").alias(c) for c in names]).select(*df.columns)
