"""Python workers need this package where a query runs Python code; a session gets it once."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the session's executors, present and future."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="kindred-"), "kindred.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith((".py", ".json")):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("kindred", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
