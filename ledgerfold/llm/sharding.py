"""Shards of rows that lie together on a Hilbert curve through several metadata columns.

Each column is quantised to bins of about equal numbers of rows, between cuts
taken from the counts of all its values. A row's bins are a point on a grid; its
place on the Hilbert curve through that grid is computed by a fold over bits with
a table of the curve's states. Rows are put in the order of the curve, equal
texts of a cell side by side, and the order is cut into runs of nearly equal bytes.
Points that are close on the curve are close in every column, so a shard's rows
lie in narrow ranges of all columns at once, and files can be skipped by any of them.

DataFrame functions only. No step needs the rows of a value or a group of equal
texts in one task: values are counted before a shuffle, and the order is dealt by ranges.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.spread import running_sums
from .scratch import small_enough, stored

#: Characters of a string value by which it is quantised, and what a row weighs besides its text.
LEADING, ROW_BYTES = 64, 16
#: The dimension that is a text's number of bytes, and the order of rows.
SIZE, ORDER = "<bytes>", ["curve", "text_md5", "id"]


def states(dims: int) -> list[list[tuple[int, int]]]:
    """The Hilbert curve through dims dimensions as a table: by state and the bits of one level (dimension k at bit k), (order, next state).

    A state is a corner at which a cube is entered and the direction in which it is left (Hamilton and Rau-Chaplin).
    """
    size, full = 1 << dims, (1 << dims) - 1
    right = lambda x, by: (x >> by % dims | x << (dims - by % dims)) & full
    gray = lambda x: x ^ x >> 1
    order = {gray(i): i for i in range(size)}
    ones = lambda x: (~x & x + 1).bit_length() - 1
    table = []
    for state in range(size * dims):
        corner, leaves = divmod(state, dims)
        row = []
        for bits in range(size):
            i = order[right(bits ^ corner, leaves + 1)]
            entry = gray((i - 1) // 2 * 2) if i else 0
            turn = ones(i - 1 if i % 2 == 0 else i) % dims if i else 0
            row.append((i, (corner ^ right(entry, dims - (leaves + 1) % dims)) * dims + (leaves + turn + 1) % dims))
        table.append(row)
    return table


def hilbert(bins: list[Column], bits: int) -> Column:
    """The place on the curve of a point whose coordinates are below 2 ** bits, as a long."""
    dims, table = len(bins), states(len(bins))
    held = (len(table) - 1).bit_length()
    if bits * dims + held > 62:
        raise ValueError(f"{dims} dimensions of {bits} bits don't fit a long")
    moves = F.array(*(F.lit(i << held | after).cast("long") for row in table for i, after in row))
    bit = lambda b, n, k: F.shiftleft(F.shiftright(b.cast("long"), n).bitwiseAND(F.lit(1)), k)
    levels = [functools.reduce(operator.add, (bit(b, n, k) for k, b in enumerate(bins))) for n in reversed(range(bits))]
    state = lambda at: at.bitwiseAND(F.lit((1 << held) - 1))

    def step(at: Column, here: Column) -> Column:
        return F.shiftleft(F.shiftright(at, held), held + dims) + F.get(moves, (F.shiftleft(state(at), dims) + here).cast("int"))

    return F.shiftright(F.aggregate(F.array(*levels), F.lit(0).cast("long"), step), held)


def cuts(rows: DataFrame, column: str, bins: int) -> list:
    """The first value of each bin but the lowest, fewer than bins: rows with a value are parted as evenly as whole values allow."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).count()
    upto = running_sums(counts.withColumn("all", F.lit(0)), "all", ["value"], {"upto": F.col("count")})
    number = F.expr(f"(2 * upto - count) * {bins} div (2 * upto_all)")  # of the bin in which the middle of the value's rows lies
    firsts = upto.groupBy(number.alias("bin")).agg(F.min("value").alias("value"))
    return sorted(r["value"] for r in firsts.where("bin > 0").collect())


def _described(docs: DataFrame, dims: list[str], id_col: str, text_col: str) -> DataFrame:
    """(row, id, size, text_crc32, text_md5, dim0, ...): each row of docs whole, and what its place depends on."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    kinds = dict(docs.dtypes)
    known = [F.substring(docs[d], 1, LEADING) if kinds.get(d) == "string" else F.octet_length(text) if d == SIZE else docs[d] for d in dims]
    return docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("row"),
        docs[id_col].alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("text_md5"),
        *(k.alias(f"dim{n}") for n, k in enumerate(known)),
    )


def _placed(rows: DataFrame, at: list[list], bits: int) -> DataFrame:
    """rows with curve, their place on the curve; at: the cuts of each dimension."""
    bins = [functools.reduce(operator.add, ((F.col(f"dim{n}") >= F.lit(c)).cast("int") for c in own), F.lit(0)) for n, own in enumerate(at)]
    return rows.withColumn("curve", hilbert([F.coalesce(b, F.lit(0)) for b in bins], bits)).drop(*(f"dim{n}" for n in range(len(at))))


def _cut(docs: DataFrame, shards: int, dims: list[str], id_col: str, text_col: str, bits: int) -> tuple[DataFrame, list[list]]:
    rows = stored(_described(docs, dims, id_col, text_col).drop("row"))
    at = [cuts(rows, f"dim{n}", 1 << bits) for n in range(len(dims))]
    sums = running_sums(_placed(rows, at, bits).withColumn("all", F.lit(0)), "all", ORDER, {"place": F.lit(1).cast("long"), "upto": F.col("size")})
    shard = F.expr(f"least({shards - 1}, (2 * upto - size) * {shards} div (2 * upto_all))").cast("int")  # the one in which the middle of the row lies
    cut = stored(sums.select("id", "size", "text_crc32", "text_md5", "curve", "place", shard.alias("shard")))
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first"))
    if small_enough(shards, 32):
        firsts = F.broadcast(firsts)
    slots = cut.join(firsts, "shard").select("id", "size", "text_crc32", "text_md5", "curve", "shard", (F.col("place") - F.col("first")).alias("slot"))
    return slots, at


def sharded(docs: DataFrame, shards: int, dims: list[str], id_col: str = "doc_id", text_col: str = "text", bits: int = 5) -> DataFrame:
    """(id, size, text_crc32, text_md5, curve, shard, slot): the place of every row in shards of nearly equal bytes.

    size: bytes of the text plus ROW_BYTES. dims: columns of docs, or SIZE for the
    text's bytes; of strings the first LEADING characters count. slot: place in
    the shard, from 0 without gaps. A shard's bytes differ from an equal share by
    less than the larger of the rows at its ends; where rows are fewer or longer than
    shards, some shards stay empty.

    Rows of a cell are ordered by their text's MD5, then id, so equal texts of a
    cell are side by side, in as few shards as their bytes allow; rows equal in
    all of that are the same row here. A null text is empty, a null id comes
    first, a null in a dimension lies in its lowest bin. An empty table gives no rows. Other
    columns, whatever their names, stay out. Texts are read once; what is
    sorted and shuffled are rows of a fixed width.
    """
    return _cut(docs, shards, dims, id_col, text_col, bits)[0]


def write_sharded(docs: DataFrame, path: str, shards: int, dims: list[str], id_col: str = "doc_id", text_col: str = "text", bits: int = 5) -> None:
    """Write docs as Parquet, all its columns and rows, to a folder shard=<n> of path for each of `sharded`'s shards, in the order of slots.

    Whole rows are moved once, a shard to a task: from the shards' first rows, of
    which there are at most `shards` (some thousands), each row knows its own.
    """
    slots, at = _cut(docs, shards, dims, id_col, text_col, bits)
    key = F.struct(*ORDER)
    firsts = sorted(slots.groupBy("shard").agg(F.min(key).alias("first")).collect())
    rows = _placed(_described(docs, dims, id_col, text_col), at, bits)
    number = F.lit(-1)
    if firsts:
        shape = rows.select(key.alias("key")).schema["key"].dataType
        spark = docs.sparkSession
        starts = F.broadcast(spark.createDataFrame([([r["first"] for r in firsts], [r["shard"] for r in firsts])], T.StructType([T.StructField("starts", T.ArrayType(shape)), T.StructField("numbers", T.ArrayType(T.IntegerType()))])))
        rows = rows.join(starts)
        number = F.get("numbers", F.size(F.filter("starts", lambda s: s <= key)) - 1)
    out = rows.select(number.alias("shard"), *ORDER, "row").repartitionById(shards, "shard").sortWithinPartitions("shard", *ORDER)
    names = [n for n in docs.columns if n.lower() != "shard"]
    if len(names) < len(docs.columns):
        raise ValueError("docs has a column named shard")
    out.select(*(F.col("row").getField(n).alias(n) for n in names), "shard").write.partitionBy("shard").parquet(path)
