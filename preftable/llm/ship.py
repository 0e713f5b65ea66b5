"""Python code of this package for the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand the package to Spark once per application, so that tasks can import it on every machine.

    Spark's own file server copies the archive to the executors; nothing shared is needed.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="preftable-ship-"), "preftable_llm_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    f = os.path.join(folder, n)
                    z.write(f, os.path.relpath(f, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
