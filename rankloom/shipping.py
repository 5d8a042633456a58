"""Sends this package to the executors, so that their Python workers can import it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application: a zip of the package's sources, by addPyFile."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="rankloom-"), "rankloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for n in sorted(names):
                    if n.endswith(".py"):
                        z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(here)))
        context.addPyFile(path)
        _sent.add(context.applicationId)
    return spark
