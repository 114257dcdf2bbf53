"""The package on the executors' Python path."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application, so that a job can be started from any folder."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), os.path.basename(package))        # the driver's own copy, which Spark serves
        context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(context.applicationId)
