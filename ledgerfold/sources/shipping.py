"""Make this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()

#: Bytes of an Arrow batch that goes to a Python worker: long rows come in smaller batches.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 * 1024 * 1024


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application, and bound Arrow batches in a session that doesn't."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        with tempfile.TemporaryDirectory() as folder:
            shutil.copytree(
                os.path.join(root, "ledgerfold"),
                os.path.join(folder, "in", "ledgerfold"),
                ignore=shutil.ignore_patterns("__pycache__"),
            )
            at = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "ledgerfold"), "zip", os.path.join(folder, "in"))
        context.addPyFile(at)
        _SENT.add(context.applicationId)
    return spark
