"""Tables kept between rounds of an iteration, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions without spark.checkpoint.dir, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="ledgerfold-"))
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """The shared folder's part that this application writes to."""
    return f"{shared_folder(spark)}/ledgerfold/{spark.sparkContext.applicationId}"


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete what this application stored. To be called when no result that reads it is needed any more."""
    deleted(spark, own_folder(spark))


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
