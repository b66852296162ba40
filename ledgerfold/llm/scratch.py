"""Intermediate tables in the folder that driver and executors share.

Operators that read a result several times, or iterate, write it here once.
A reader then depends on files in shared storage only, so a lost executor costs
a re-read and never a recomputation from the start.
"""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import deleted, shared_folder

#: Bytes up to which a table of known size may be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024

#: The folder of tables that are deleted when the work they are for is done; each thread has its own.
_INNER: contextvars.ContextVar[str | None] = contextvars.ContextVar("folder", default=None)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ledgerfold/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what this application stored. To be called when no result that reads it is needed any more."""
    deleted(spark, _own_folder(spark))


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within, but for lasting ones, are deleted at its end."""
    folder = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    before = _INNER.set(folder)
    try:
        yield
    finally:
        _INNER.reset(before)
        deleted(spark, folder)


def stored(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write df to the shared folder and return a reader of what was written."""
    return stored_at(df, lasting)[0]


def stored_at(df: DataFrame, lasting: bool = False) -> tuple[DataFrame, str]:
    """A reader of what was written, and its folder, to be given to `deleted` when it isn't needed any more."""
    spark = df.sparkSession
    inner = _INNER.get()
    path = f"{_own_folder(spark) if inner is None or lasting else inner}/{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(rows: int, bytes_per_row: int) -> bool:
    """Whether a table of so many rows may be broadcast."""
    return rows * bytes_per_row <= BROADCAST_BYTES


#: Bits of the filter that `sifted` sends to the executors, in rows of ROW_BITS: 16 MB, whatever the tables' sizes.
FILTER_BITS, ROW_BITS = 1 << 27, 1 << 15


def sifted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose key is none of the wanted ones; to be followed by an exact join.

    wanted: one column, named like the key. Rows that no join can match aren't shuffled.
    """
    maybe = "__maybe"
    while maybe in rows.columns:
        maybe += "_"
    return maybe_wanted(rows, key, wanted, maybe).where(maybe).drop(maybe)


def maybe_wanted(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column: false where the key is surely none of the wanted ones. Nulls are keys like others.

    The wanted keys' hashes set bits of a map of fixed size, which is broadcast.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    row, bits, bit = name + "row", name + "bits", place % ROW_BITS
    maps = (
        wanted.select(place.alias("place"))
        .groupBy(F.floor(F.col("place") / ROW_BITS).alias(row))
        .agg(F.bitmap_construct_agg(F.col("place") % ROW_BITS).alias(bits))
    )
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn(row, F.floor(place / ROW_BITS)).join(F.broadcast(maps), row, "left")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0
    return joined.withColumn(name, F.coalesce(is_set, F.lit(False))).select(*rows.columns, name)
