"""Prepare a session: the package in Python workers, small Arrow batches."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Whole texts can be long, so that few of them go to a worker at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once an application."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="brindle-")
        archive = shutil.make_archive(os.path.join(folder, "brindle_package"), "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark
