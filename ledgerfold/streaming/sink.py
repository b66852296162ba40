"""A sink that writes each micro-batch of updates once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import log
from ..sources import manifest


def checkpointed(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch into a folder of its own, overwritten when the batch is run again.

    The batch number is what a write token is to a service: a second write of
    the same batch changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def chained(folder: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch as a write in a chain of tokens, of which readers see the entries, changed ids and state (sources.manifest).

    A batch that is run again finds its own entry and changes nothing; a second
    stream that writes to the folder is refused.
    """
    last = {"token": ""}

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = {r["writer"]: r["token"] for r in manifest.entries(spark, folder).select("writer", "token").collect()} if not last["token"] else {}
        again = done.get(f"batch {number}")
        last["token"] = again or manifest.append(folder, manifest.head(spark, folder, last["token"]), batch, keys, f"batch {number}")

    return write


def written(spark, folder: str, schema: str | None = None) -> DataFrame:
    """All written batches. schema: of their rows, for a stream that has written none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if schema is not None and (found is None or len(found) == 0):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")


def state(spark, folder: str, keys: list[str], order: list[str]) -> DataFrame:
    """The log that all written batches give when each is merged into what was there: by key the newest record of the last batch."""
    return log.state(written(spark, folder), keys, ["batch", *order]).drop("batch")
