"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Each text is normalised (A-Z to a-z), hashed with SHA-256, and the row
   ``(id, sha, fingerprint, sender)`` is written to the shared folder; texts
   stay where they are.
2. A sender is one partition of that table, or several small ones. It sorts its
   distinct fingerprints, cuts them by owner (a range of the fingerprint space), and codes each
   owner's share as Golomb-Rice gaps.
3. An owner decodes what its senders sent, finds the fingerprints that more
   than one sender holds (or that one sender holds twice), and answers each
   sender with a bitmap over the sender's list.
4. The senders' lists and bitmaps give the suspects. Only suspects' texts are
   shuffled, to be grouped by their bytes, with partial sums before the shuffle
   so that a group of copies costs one row a task whatever its size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from .arrowtext import buffers, steps, tidy
from .scratch import maybe_wanted, partitions, sifted, small_enough, stored

#: Fingerprints of about so many rows go to one owner, and come from one sender at least: however many
#: rows and files there are, a block holds hundreds of fingerprints or blocks are few.
ROWS_PER_OWNER = ROWS_PER_SENDER = 2_000_000


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """(Rice parameter k, bits) of sorted distinct unsigned 64-bit values.

    A gap's high part stands in unary; all low parts of k bits follow the unary
    parts, so that both can be decoded as arrays.
    """
    n = len(values)
    if n == 0:
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, (int(values[-1]) // n).bit_length() - 1)
    ones = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    bits = np.zeros(int(ones[-1]) + 1 + n * k, np.uint8)
    bits[ones] = 1
    low = bits[int(ones[-1]) + 1 :].reshape(n, k)
    for j in range(k):
        low[:, j] = (gaps >> np.uint64(k - 1 - j)) & np.uint64(1)
    return k, np.packbits(bits).tobytes()


def golomb_decode(n: int, k: int, coded: bytes) -> np.ndarray:
    """The values that golomb_encode coded."""
    if n == 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(coded, np.uint8))
    ones = np.flatnonzero(bits)[:n]
    low = bits[ones[-1] + 1 : ones[-1] + 1 + n * k].reshape(n, k)
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    for j in range(k):
        gaps |= low[:, j].astype(np.uint64) << np.uint64(k - 1 - j)
    return np.cumsum(gaps, dtype=np.uint64)


def _normalised(column: pa.Array) -> Iterator[tuple[slice, list[bytes], list[bytes]]]:
    """(rows, their texts, their digests), a few megabytes of text at a time."""
    data, offsets = buffers(column)
    for start, end in steps(offsets):
        own = (offsets[start : end + 1] - offsets[start]).tolist()
        low = data[offsets[start] : offsets[end]].tobytes().lower()
        texts = [low[a:b] for a, b in zip(own[:-1], own[1:], strict=True)]
        yield slice(start, end), texts, [hashlib.sha256(t).digest() for t in texts]


def _fingerprint(sha: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in sha), "<i8")


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sha, fp) of every row."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, sha in _normalised(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.array(sha, pa.binary()), pa.array(_fingerprint(sha), pa.int64())], ["id", "sha", "fp"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        rows, f"id {kind}, sha binary, fp long"
    )


def _blocks(table: DataFrame, owners: int) -> DataFrame:
    """Each sender's coded share for each owner: (owner, sender, n, k, coded, own).

    own: a bitmap of the fingerprints that the sender itself holds more than once.
    """

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = TaskContext.get().partitionId()
        held = [np.asarray(b.column(0)) for b in batches]
        if not held:
            return
        values, counts = np.unique(np.concatenate(held).astype(np.uint64), return_counts=True)
        owner = ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        cuts = np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))
        out = []
        for o in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[o], cuts[o + 1])
            k, coded = golomb_encode(values[part])
            out.append((o, sender, int(cuts[o + 1] - cuts[o]), k, coded, np.packbits(counts[part] > 1).tobytes()))
        names = ["owner", "sender", "n", "k", "coded", "own"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return table.select("fp").mapInArrow(rows, "owner int, sender int, n int, k int, coded binary, own binary")


def _bitmaps(blocks: DataFrame) -> DataFrame:
    """The owners' answers: (sender, owner, bitmap)."""

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        lists = [golomb_decode(r["n"], r["k"], r["coded"]) for r in rows]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        shared = values[counts > 1]
        maps = []
        for r, values in zip(rows, lists, strict=True):
            own = np.unpackbits(np.frombuffer(r["own"], np.uint8), count=len(values)).astype(bool)
            maps.append(np.packbits(own | np.isin(values, shared, assume_unique=True)).tobytes())
        return pa.table(
            {
                "sender": pa.array([r["sender"] for r in rows], pa.int32()),
                "owner": pa.array([r["owner"] for r in rows], pa.int32()),
                "bitmap": pa.array(maps, pa.binary()),
            }
        )

    return blocks.groupBy("owner").applyInArrow(answer, "sender int, owner int, bitmap binary")


def suspects(table: DataFrame) -> DataFrame:
    """Distinct fingerprints that occur more than once in the table (id, sha, fp), which must be stored."""
    spark = table.sparkSession
    rows = table.count()
    senders, owners = (max(partitions(spark), math.ceil(rows / n)) for n in (ROWS_PER_SENDER, ROWS_PER_OWNER))
    # many small files join to fewer senders, without a shuffle
    blocks = stored(_blocks(table.coalesce(senders), owners))
    # stored, so that no task needs two Python workers at once
    answers = stored(_bitmaps(blocks.repartition(owners, "owner")))

    @tidy
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values = golomb_decode(r["n"], r["k"], r["coded"])
                hit = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=len(values)).astype(bool)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(values[hit].astype(np.int64), pa.int64())], ["fp"])

    return blocks.join(answers, ["sender", "owner"]).select("n", "k", "coded", "bitmap").mapInArrow(marked, "fp long").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): every row's (id, sha, fp); of texts that occur twice or more (sha, keep_id, group_size)."""
    table = stored(fingerprints(docs, id_col, text_col))
    found = stored(suspects(table))
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts, sha in _normalised(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.array(texts, pa.binary()), pa.array(sha, pa.binary()), pa.array(_fingerprint(sha), pa.int64())],
                    ["id", "bytes", "sha", "fp"],
                )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        with_bytes, f"id {kind}, bytes binary, sha binary, fp long"
    )
    if small_enough(found.count(), 16):
        found = F.broadcast(found)
    else:  # only what may be a suspect is shuffled to the join
        texts = sifted(texts, "fp", found)
    groups = (
        texts.join(found, "fp", "left_semi")
        .groupBy("sha", "bytes")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("sha", "keep_id", "group_size")
    )
    return table, stored(groups)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, sha (binary).

    Texts are equal when identical after lower-casing A-Z only; a null text
    counts as empty. Of equal texts the row with the largest id stays (nulls
    are smaller than any id). Rows that repeat the same id and text are one
    group: one of them stays. Other columns of docs are not read.
    """
    table, groups = exact_groups(docs, id_col, text_col)
    rows = table.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("copies"))
    return (
        rows.join(groups, "sha", "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .withColumn("alone", F.col("group_size").isNull())
        .select(
            "id",
            F.when(F.col("alone"), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("alone") | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))).alias("kept"),
            "sha",
        )
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that exact_dedup drops.

    Null texts are empty ones. Of rows that are equal in id and text one stays, with
    all its columns: that whose columns as JSON come first.
    """
    _, groups = exact_groups(docs, id_col, text_col)
    names = docs.columns
    key = "__sha"
    while key in names:
        key += "_"
    at = names.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(key, BinaryType())])
    kinds = to_arrow_schema(schema)

    @tidy
    def with_sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, sha in _normalised(batch.column(at).cast(pa.string())):
                yield pa.RecordBatch.from_arrays([*batch[part].columns, pa.array(sha, pa.binary())], kinds.names)

    hashed = docs.mapInArrow(with_sha, schema)
    groups = groups.select(F.col("sha").alias(key), F.col("keep_id").alias(key + "id"), F.lit(True).alias(key + "in"))
    stays = F.col(key + "in").isNull() | F.col(id_col).eqNullSafe(F.col(key + "id"))
    if small_enough(groups.count(), 64):
        kept = hashed.join(F.broadcast(groups), key, "left").where(stays)
    else:  # only what may be in a group is shuffled
        maybe = key + "maybe"
        doubted = maybe_wanted(hashed, key, groups.select(key), maybe)
        sure = doubted.where(~F.col(maybe)).drop(maybe)
        kept = doubted.where(maybe).drop(maybe).join(groups, key, "left").where(stays).unionByName(sure, allowMissingColumns=True)
    # rows that repeat both id and text: they are in one group of (id, sha)
    twice = stored(
        kept.where(F.col(key + "in")).groupBy(id_col, key).agg(F.count(F.lit(1)).alias(key + "n")).where(F.col(key + "n") > 1)
    )
    if twice.isEmpty():
        return kept.select(*names)
    again = twice.select(F.col(key), F.lit(True).alias(key + "again"))
    if small_enough(twice.count(), 64):
        again = F.broadcast(again)
    kept = kept.join(again, key, "left")
    once = kept.where(F.col(key + "again").isNull()).select(*names)
    row = F.struct(*names)
    first = F.min_by(row, F.to_json(row)).alias(key + "row")
    one = kept.where(F.col(key + "again")).groupBy(F.col(key).alias(key + "g")).agg(first)
    return once.unionByName(one.select(*(F.col(key + "row").getField(n).alias(n) for n in names)))
