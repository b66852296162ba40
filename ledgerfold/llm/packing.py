"""Packing of token sequences into training sequences by harmonic classes.

A document's ids, with an end id, are cut into whole sequences of `capacity`
ids and a rest. A piece of length n belongs to class k = capacity // n, whose
bins hold k pieces of at most capacity / k ids each. A rest that would leave
more than PADDING of its slot empty is cut again: a piece that fills a slot of
class k + 1 exactly, and what remains. Bins of a class are filled with k pieces
by every worker on its own. The pieces that a worker has left over, fewer than
k of each class, are brought together by class, in groups of bounded size again
and again while they are many; what is then left, fewer than k of each class in
all, is packed by decreasing length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import buffers, gathered, steps, tidy
from .scratch import stored
from .tokens import BATCH_BYTES, encoded

#: The part of its slot that a piece may leave empty, and the length below which it may leave more.
PADDING, SHORT = 0.02, 24
#: Left-over pieces that are brought together in one group: several times what its classes can leave.
GROUP_ROWS = 50_000
#: The turn that sequence ids of the last left-overs have.
LAST = 15


def cut(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of so many ids, in order."""
    lengths = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if rest <= SHORT or slot - rest <= PADDING * slot:
            lengths.append(rest)
            break
        lengths.append(capacity // (k + 1))
        rest -= lengths[-1]
    return lengths


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, ids): every document's pieces."""
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in gathered(batches, BATCH_BYTES):
            data, offsets = buffers(batch.column(1))
            for a, b in steps(offsets, BATCH_BYTES):
                ids, order, at = encoded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], path)
                owner, start, length, crc, total, kept = [], [], [], [], [], []
                for i in range(b - a):
                    own = b"".join([ids[j] for j in order[at[i] : at[i + 1]].tolist()]) + end
                    done, n = 0, len(own) // 4
                    for size in cut(n, capacity):
                        part = own[4 * done : 4 * (done + size)]
                        owner.append(a + i)
                        start.append(done)
                        length.append(size)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                        kept.append(np.frombuffer(part, "<u4").astype(np.int32) if keep_ids else None)
                        done += size
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner, pa.int64())),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc, total)),
                        pa.array(kept, pa.list_(pa.int32())),
                    ],
                    ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        rows, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"
    )


def _filled(rows: DataFrame, capacity: int, turn: int) -> DataFrame:
    """rows with sequence_id and offset for those that fill a bin in their partition, null for the rest.

    Of sequence ids, the four highest digits in base 2 are the turn, the next 28 the partition.
    """
    if turn >= LAST:  # each turn leaves a part of the groups only
        raise ValueError("too many pieces are left over for the turns that sequence ids have room for; take larger groups")

    @tidy
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, bins = (turn << 59) | (TaskContext.get().partitionId() << 31), 0
        waiting: list[pa.RecordBatch] = []  # fewer rows than k of each class k

        def placed(part: pa.Table, sequence: np.ndarray | None, offset: np.ndarray | None) -> list[pa.RecordBatch]:
            nulls = pa.nulls(part.num_rows, pa.int64())
            part = part.append_column("sequence_id", nulls if sequence is None else pa.array(sequence))
            return part.append_column("offset", nulls if offset is None else pa.array(offset)).combine_chunks().to_batches()

        for batch in batches:
            both = pa.Table.from_batches([*waiting, batch])
            length = both.column("length").to_numpy()
            k = capacity // length
            order = np.argsort(k, kind="stable")
            k, length = k[order], length[order]
            first = np.flatnonzero(np.diff(k, prepend=-1))  # of each class
            count = np.diff(first, append=len(k))
            place = np.arange(len(k)) - np.repeat(first, count)  # within the class
            own = k[first] if len(first) else np.zeros(0, np.int64)
            whole = count // np.maximum(own, 1)  # bins of each class that are full
            full = place < np.repeat(whole * own, count)
            number = np.repeat(np.cumsum(whole) - whole, count) + place // np.maximum(k, 1)
            before = np.cumsum(length) - length
            start = np.arange(len(k)) - place % np.maximum(k, 1)
            offset = before - before[start] if len(k) else before
            yield from placed(both.take(pa.array(order[full])), base | (bins + number[full]), offset[full])
            bins += int(whole.sum())
            waiting = both.take(pa.array(order[~full])).combine_chunks().to_batches()
        if waiting:
            yield from placed(pa.Table.from_batches(waiting), None, None)

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(fill, f"{names}, sequence_id long, offset long")


def _last(rows: DataFrame, capacity: int) -> DataFrame:
    """First fit by decreasing length; for fewer pieces than the classes' bins hold."""
    schema = rows.schema

    @tidy
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for batch in batches for r in batch.to_pylist()]
        arrow = None
        room: list[int] = []
        for r in sorted(held, key=lambda r: -r["length"]):
            i = next((i for i, x in enumerate(room) if x >= r["length"]), len(room))
            if i == len(room):
                room.append(capacity)
            r["sequence_id"], r["offset"] = (LAST << 59) | i, capacity - room[i]
            room[i] -= r["length"]
        if held:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            yield pa.RecordBatch.from_pylist(held, arrow)

    return rows.coalesce(1).mapInArrow(fit, schema)


def packed(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset.

    Each id of each document lies in one piece; pieces of a sequence follow
    each other from offset 0. A null or empty text is a document of the end id
    alone. Rows that repeat an id are documents of their own, as are rows with a null
    id, which stays null. A text of any length is read whole and cut into
    pieces; an empty table gives none. ids is null unless
    keep_ids. Other columns are not read.
    """
    filled = stored(_filled(stored(pieces(docs, path, capacity, end_id, id_col, text_col, keep_ids)), capacity, 0))
    out, turn, groups = filled.where("sequence_id is not null"), 1, None
    while groups != 1:  # at most half as many groups each time
        left = filled.where("sequence_id is null").drop("sequence_id", "offset")
        wanted = math.ceil(left.count() / GROUP_ROWS)
        groups = max(1, wanted if groups is None else min(wanted, groups // 2))
        group = F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(groups))
        filled = stored(_filled(left.repartition(F.floor(F.lit(capacity) / F.col("length")), group), capacity, turn))
        out, turn = out.union(filled.where("sequence_id is not null")), turn + 1
    return out.union(_last(filled.where("sequence_id is null"), capacity))
