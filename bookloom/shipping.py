"""Gives Python workers this package, wherever the driver imported it from."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows that go to a Python worker at once, where the session has Spark's own number: whole texts are long.
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
AT_ONCE, SPARKS_OWN = "1000", "10000"
#: Bytes that go to a Python worker at once, likewise: a worker holds a batch several times over, as Arrow, strings and results.
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BYTES_AT_ONCE, SPARKS_OWN_BYTES = "4m", 64 << 20
#: Characters or bytes of results after which a worker hands them on.
HELD = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep batches to Python workers small in rows and bytes, so that their memory doesn't grow with the tables."""
    if spark.conf.get(ROWS) == SPARKS_OWN:
        spark.conf.set(ROWS, AT_ONCE)
    if re.sub(r"b$", "", spark.conf.get(BYTES)) == str(SPARKS_OWN_BYTES):
        spark.conf.set(BYTES, BYTES_AT_ONCE)


def ship(spark: SparkSession) -> None:
    """Send the package to all executors, once per application, and keep batches small.

    Spark's own file server carries it, so driver and executors need no folder
    in common.
    """
    if spark.conf.get(ROWS) == SPARKS_OWN:
        spark.conf.set(ROWS, AT_ONCE)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="bookloom-"), "bookloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
