"""The trie of conversations' turns: each distinct beginning of conversations is a node.

A node is known by a sum of 128-bit hashes, one for each turn with its place, so
that the nodes along a conversation are running sums over ranges of turns,
however long it is. Members, children and words are then aggregations by node.

Sums over subtrees are taken along heavy paths: of a node's children the one with
most members continues its path, the others begin paths of their own. Such a light
child has at most half of its parent's members, so that on the way to the root
there are at most log2(conversations) of them. A path ends at a leaf, and its
nodes are the last ones of the leaf's smallest member, down from the last that
is not the largest child: so no path is followed step by step. Totals of paths go up
to the paths that theirs are attached to, one level in a round; with the totals
of light paths at the nodes where they attach, subtrees are suffix sums along
each path, again over ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import running_sums
from .arrowtext import tidy
from .scratch import partitions, stored

#: White space stands between words; lanes of a node's sum and hexadecimal digits of each.
WORD, LANES, DIGITS = r"[^\x20\x09-\x0D]+", 4, 8
ROOT = "0" * (LANES * DIGITS)
#: What `trie` adds up over subtrees.
SUMS = ["n_leaves", "saved_tokens"]


def numbered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, said, words): turns with their place in their conversation from 1, a hash of role and text, and the text's words.

    Null turn numbers come first; turns with the same number stand by role, then by
    the hash. A null role or text is empty. Rows without conversation are left out.
    """
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    said = F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what).cast("binary"))
    turns = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.substring(who, 1, 64).alias("role"), said.alias("said"), F.regexp_count(what, F.lit(WORD)).cast("long").alias("words")
    )
    return running_sums(turns, "conv", ["turn", "role", "said"], {"place": F.lit(1).cast("long")}).select("conv", F.col("place").alias("at"), "said", "words")


def members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, words, ends): every conversation's nodes from the root on. turns: (conv, at, said, words), at from 1 without gaps."""
    hashed = F.md5(F.concat("said", F.lit(":"), F.col("at").cast("string")).cast("binary"))
    lane = lambda k: F.conv(F.substring(hashed, 1 + k * DIGITS, DIGITS), 16, 10).cast("long")
    own = turns.select("conv", "at", "words", *(lane(k).alias(f"own{k}") for k in range(LANES)))
    sums = running_sums(own, "conv", ["at"], {"turns": F.lit(1).cast("long")} | {f"sum{k}": F.col(f"own{k}") for k in range(LANES)})
    name = lambda of: F.concat(*(F.lpad(F.hex(F.pmod(of(k), F.lit(1 << 4 * DIGITS))), DIGITS, "0") for k in range(LANES)))
    below = sums.select(
        "conv",
        F.col("at").alias("depth"),
        name(lambda k: F.col(f"sum{k}")).alias("node"),
        name(lambda k: F.col(f"sum{k}") - F.col(f"own{k}")).alias("parent"),
        "words",
        (F.col("at") == F.col("turns_all")).alias("ends"),
    )
    said = turns.select("conv").distinct().withColumn("said", F.lit(True))
    none = F.lit(None).cast("string")
    top = convs.select("conv").distinct().join(said, "conv", "left")
    zero = F.lit(0).cast("long")
    return below.unionByName(top.select("conv", zero.alias("depth"), F.lit(ROOT).alias("node"), none.alias("parent"), zero.alias("words"), F.col("said").isNull().alias("ends")))


def joined_ids(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of each node's conv, ascending and joined by commas.

    Rows are dealt by ranges, so that a node with very many is spread; each range
    gives pieces of text, and what takes a digest reads these one by one.
    """
    dealt = ends.select("node", "conv").repartitionByRange(partitions(ends.sparkSession), "node", "conv").sortWithinPartitions("node", "conv")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            nodes = pc.run_end_encode(batch.column(0))
            convs, out, start = batch.column(1).to_pylist(), [], 0
            for node, end in zip(nodes.values.to_pylist(), nodes.run_ends.to_pylist(), strict=True):
                out.append((node, part, number, ",".join(map(str, convs[start:end]))))
                start, number = end, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["node", "part", "number", "ids"])

    @tidy
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if at != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (node, digest.hexdigest())], ["node", "ends_sha256"])

    texts = stored(dealt.mapInArrow(pieces, "node string, part long, number long, ids string"))
    return texts.repartition(partitions(ends.sparkSession), "node").sortWithinPartitions("node", "part", "number").mapInArrow(digests, "node string, ends_sha256 string")


def heavy_paths(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, path, depth, parent, heads): the path of every node, named by the conversation along which it runs. heads: whether the path begins there.

    rows: members. nodes: (node, conv_id, heavy), heavy being the child that continues the node's path.
    """
    leaves = nodes.where("heavy is null").select(F.col("conv_id").alias("conv"))
    along = rows.join(leaves, "conv", "left_semi").select("conv", "node", "depth", "parent")
    light = nodes.where(F.col("node") != ROOT).join(nodes.select(F.col("heavy").alias("node")).where("node is not null"), "node", "left_anti")
    tops = along.where("depth > 0").join(light.select("node"), "node", "left_semi").groupBy("conv").agg(F.max("depth").alias("top"))
    top = F.coalesce("top", F.lit(0))
    return along.join(tops, "conv", "left").where(F.col("depth") >= top).select("node", F.col("conv").alias("path"), "depth", "parent", (F.col("depth") == top).alias("heads"))


def subtree_sums(nodes: DataFrame, paths: DataFrame, sums: list[str]) -> DataFrame:
    """(node, *sums): each column of nodes added up over the node's subtree, along the paths."""
    valued = stored(paths.join(nodes.select("node", *sums), "node"))
    heads = valued.where("heads and parent is not null").select("path", F.col("parent").alias("node"))
    attached = stored(heads.join(valued.select("node", F.col("path").alias("upper")), "node"))
    total = lambda rows, *by: rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums))
    moved = stored(total(valued, "path"))
    totals = moved
    while not moved.isEmpty():  # as often as light edges follow each other on the way to a leaf
        moved = stored(total(moved.join(attached, "path").select(F.col("upper").alias("path"), *sums), "path"))
        totals = totals.unionByName(moved)
    light = total(total(totals, "path").join(attached, "path"), "node")
    joined = valued.join(light.withColumnsRenamed({c: f"light_{c}" for c in sums}), "node", "left").withColumn("up", -F.col("depth"))
    with_light = joined.withColumns({c: F.col(c) + F.coalesce(f"light_{c}", F.lit(0)) for c in sums}).select("node", "path", "up", *sums)
    suffix = running_sums(with_light.withColumnsRenamed({c: f"own_{c}" for c in sums}), "path", ["up"], {c: F.col(f"own_{c}") for c in sums})
    return suffix.select("node", *sums)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node: (node, conv_id, depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    turns: (conv, at, said, words) as `numbered` gives them; convs: (conv), every
    conversation, those without turns too. conv_id is the node's smallest member;
    saved_tokens are the words that a prefix cache saves in the subtree, at each node its
    last turn's words times all members but one; ends_sha256 is the digest of the
    decimal ids, ascending and joined by commas, of the members that end at the node.
    Of children with equally many members that with the largest hash is the heavy one. Without conversations there is no node, not even the root.
    """
    rows = stored(members(turns, convs))
    parent = F.min("parent")
    # beginnings with the same last hash and the same parent's sum are the same: so a sum stands for one beginning if it has one parent
    alone = F.when(parent.isNull() | (parent == F.max("parent")), parent).otherwise(F.raise_error(F.lit("two beginnings have the same sum of hashes")).cast("string"))
    found = stored(
        rows.groupBy("node").agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), alone.alias("parent"), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    )
    children = found.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", "node")).alias("most"))
    leaf = F.col("most").isNull()
    nodes = stored(
        found.join(children, "node", "left").select(
            "node", "conv_id", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("most.node").alias("heavy"),
            leaf.cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        )
    )
    sums = subtree_sums(nodes, heavy_paths(rows, nodes), SUMS)
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    digest: Column = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    out = nodes.drop(*SUMS).join(sums, "node").join(joined_ids(rows.where("ends")), "node", "left").join(above, "parent", "left")
    return out.select("node", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", *SUMS, digest.alias("ends_sha256"))
