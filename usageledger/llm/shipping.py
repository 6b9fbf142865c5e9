"""Makes this package known to Python workers on other machines."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_usageledger_shipped", False):
        return
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="usageledger-")), "usageledger_src.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    context.addPyFile(target)
    context._usageledger_shipped = True


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with the package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
