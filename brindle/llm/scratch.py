"""Tables written between steps, in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Parquet tables under ``spark.checkpoint.dir`` of the session.

    They cut lineage and outlive executors.  Where the setting is absent, a
    session whose tasks all run in the driver's process uses a local folder; on
    a cluster, where that would lose tables, it is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
            top = "file:///tmp/checkpoints"
        self.spark, self.folder = spark, f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.number = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back."""
        self.number += 1
        path = f"{self.folder}/{self.number}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
