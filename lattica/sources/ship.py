"""Sending the package to the executors, for clusters on which it isn't installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the Python path of the session's executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):  # else it runs from an archive that was shipped before
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "lattica"), "zip", os.path.dirname(package), os.path.basename(package)))
