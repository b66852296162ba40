"""Packing of log updates into write requests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Limits of a request.
MOST_UPDATES, MOST_BYTES = 250, 750 * 1024


def by_count(updates: DataFrame, execution: str, order: list[str], most: int = MOST_UPDATES) -> DataFrame:
    """updates with request, from 0, when only their number is limited."""
    seq = F.row_number().over(W.partitionBy(execution).orderBy(*order))
    return updates.withColumn("request", F.floor((seq - 1) / most).cast("long"))


def by_size(updates: DataFrame, execution: str, order: list[str], size: str, most: int = MOST_UPDATES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """updates with request, from 0: greedy in order, a request taking what fits; one too large alone goes alone.

    Where a request ends depends on all before it, so rows are sorted within
    partitions by execution and run through once; no execution is held whole.
    """
    schema = StructType([*updates.schema.fields, StructField("request", LongType())])
    at, at_size = updates.columns.index(execution), updates.columns.index(size)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, request, count, held = object(), 0, 0, 0
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            sizes = batch.column(at_size).to_numpy(zero_copy_only=False)
            code = np.nan_to_num(batch.column(at).dictionary_encode().indices.to_numpy(zero_copy_only=False), nan=-1)
            ends = [*(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            begin = 0
            for end in ends:  # rows of one execution stand together
                key = batch.column(at)[begin].as_py()
                if key != now:
                    now, request, count, held = key, 0, 0, 0
                upto = np.cumsum(sizes[begin:end])
                done = 0
                while done < len(upto):  # once a request
                    before = int(upto[done - 1]) if done else 0
                    fits = min(int(np.searchsorted(upto, before + most_bytes - held, side="right")) - done, most - count)
                    if fits <= 0 and count:
                        request, count, held = request + 1, 0, 0
                        continue
                    fits = max(fits, 1)
                    out[begin + done : begin + done + fits] = request
                    count += fits
                    held += int(upto[min(done + fits, len(upto)) - 1]) - before
                    done += fits
                begin = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "request"])

    return updates.repartition(execution).sortWithinPartitions(execution, *order).mapInArrow(rows, schema)


def windows(updates: DataFrame, execution: str, order: str, gap: Column) -> DataFrame:
    """updates with window, from 1: a new one where gap (a condition on was, the time before) holds."""
    w = W.partitionBy(execution).orderBy(order)
    rows = updates.withColumn("was", F.lag(order).over(w))
    return rows.withColumn("window", F.sum(F.when(F.col("was").isNull() | gap, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def sent(updates: DataFrame, execution: str, seq: str, failed: str) -> DataFrame:
    """Updates that are written: after a failed write nothing more is sent."""
    bad = updates.groupBy(execution).agg(F.min(F.when(F.col(failed), F.col(seq))).alias("failed_at"))
    return updates.join(bad, execution).where(F.col("failed_at").isNull() | (F.col(seq) < F.col("failed_at"))).drop("failed_at")


def admitted(updates: DataFrame, execution: str, seq: str, token: str) -> DataFrame:
    """Updates up to and with the first response that brings no new token; later ones wait for the next invocation."""
    gone = updates.groupBy(execution).agg(F.min(F.when(F.col(token).isNull(), F.col(seq))).alias("withdrawn_at"))
    return updates.join(gone, execution).where(F.col("withdrawn_at").isNull() | (F.col(seq) <= F.col("withdrawn_at"))).drop("withdrawn_at")
