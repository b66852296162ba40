"""Near-duplicate classes by HyperMinHash sketches.

1. Each text becomes its set of hashed word shingles. Texts with the same set
   are one node (a 128-bit digest of the set), so copies are handled once.
2. A node's sketch has REGISTERS buckets. Each keeps the least hash that fell
   into it as HyperMinHash does: the number of leading zeros (5 bits) and the
   next MANTISSA bits. Empty buckets borrow by a fixed permutation of buckets.
3. Bands of ROWS compressed registers are hashed to keys. Nodes with a key in
   common are candidates.
4. Rounds of leaders tie most nodes of a large group together with one comparison
   each: every node is held against one leader of its keys. In the first round a
   key's leader is drawn. Where step 5 would have much to compare, there is a
   second, among keys under which untied nodes meet; there, it is the node with
   most candidates, so that a group around one text finds it.
5. What is left open are keys under which nodes meet that aren't tied. There, all
   nodes but the largest tied part are held against all, in blocks of sketches
   against blocks of sketches. A block emits the nodes with a likely partner, not pairs.
6. Whatever is compared passes the collision-corrected estimate of the similarity
   first, unless a set is smaller than the sketch: registers that borrow from
   the same shingle don't differ one by one. A link is only made by comparing
   two full sets.

Bands find a pair of similarity 0.8 with probability 1 - (1 - 0.8^5)^32, all but
3 in a million; there is no cap on buckets, candidates or partners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import buffers, lower_ascii, mixed, steps, tidy, word_hashes
from .components import components
from .scratch import maybe_wanted, sifted, small_enough, stored

ROWS = 5
BANDS = 32
REGISTERS = ROWS * BANDS
MANTISSA = 11
#: Texts in a block that is held in memory, and in a block that streams past it; the same for sketches.
HELD, STREAMED = 256, 1024
SKETCHES_HELD, SKETCHES_STREAMED = 1024, 4096
#: Comparisons of sketches for each open node from which another round of leaders saves more than it costs.
WORTH = 500
#: Standard deviations by which an estimate may be below the threshold.
DEVIATIONS = 5

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _borrow_order() -> np.ndarray:
    """For each bucket, the order in which it looks for a bucket to borrow from."""
    i = np.arange(REGISTERS, dtype=np.uint64)
    return np.argsort(mixed((i[:, None] << np.uint64(20)) + i[None, :] + np.uint64(1)), axis=1)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word shingles (not distinct) and their offsets by text.

    A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    hashes, at = word_hashes(lower_ascii(data), offsets)
    n = np.diff(at)
    count = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(count)))
    text = np.repeat(np.arange(len(n)), count)
    first = at[:-1][text] + (np.arange(out_at[-1]) - out_at[:-1][text])
    length = np.minimum(n, words)[text]
    value = length.astype(np.uint64)
    for j in range(words):
        more = j < length
        value[more] = mixed(value[more] * np.uint64(0x9E3779B97F4A7C15) + hashes[first[more] + j])
    return value, out_at


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    data, offsets = buffers(column)
    for a, b in steps(offsets):
        value, at = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
        for i in range(b - a):
            own = np.sort(value[at[i] : at[i + 1]])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own


def digest(members: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None


def registers(sets: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """The compressed registers of each set, of which none is empty."""
    n = len(sets)
    value = mixed(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D)) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    bucket = ((value >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    least = np.full(n * REGISTERS, _EMPTY)
    np.minimum.at(least, owner * REGISTERS + bucket.astype(np.int64), value & np.uint64(0xFFFFFFFF))
    least = least.reshape(n, REGISTERS)
    filled, full = least.copy(), least != _EMPTY
    rows, cols = np.nonzero(~full)
    for turn in range(REGISTERS):
        if not len(rows):
            break
        source = order[cols, turn]
        found = full[rows, source]
        filled[rows[found], cols[found]] = least[rows[found], source[found]]
        rows, cols = rows[~found], cols[~found]
    width = np.frexp(filled.astype(np.float64))[1].astype(np.int64)  # bits in use; 0 for 0
    zeros = (32 - width).astype(np.uint64)
    mantissa = ((filled << (zeros + np.uint64(1))) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    return ((np.minimum(zeros, np.uint64(31)) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that a register agrees for two sets of these sizes though its least hashes differ.

    The least of x hashes a bucket has density x * exp(-x * t) at t in (0, 1). Two
    of them agree if they fall into the same cell; cells with i leading zeros
    are 2^-(i + 1 + MANTISSA) wide.
    """
    a, b = n_a / REGISTERS, n_b / REGISTERS
    i = np.arange(32)
    both = (a + b)[..., None]
    inside = np.exp(-both * 0.5 ** (i + 1)) - np.exp(-both * 0.5**i)
    return a * b / (a + b) * (inside * 0.5 ** (i + 1 + MANTISSA)).sum(axis=-1)


def estimated(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers and the sizes of both sets, corrected for chance collisions."""
    by_chance = chance(n_a, n_b)
    return np.maximum(0, (equal / REGISTERS - by_chance) / (1 - by_chance))


def _least(percent: int) -> float:
    """The estimate below which a pair can't be linked, but for DEVIATIONS standard deviations."""
    goal = percent / 100
    return goal - DEVIATIONS * math.sqrt(goal * (1 - goal) / REGISTERS)


def likely(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may be linked: by the sizes of both sets (exactly), then by the estimate."""
    out = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    doubted = np.flatnonzero(out & (np.minimum(n_a, n_b) >= REGISTERS))
    if len(doubted):
        out[doubted] = estimated(equal[doubted], n_a[doubted], n_b[doubted]) >= _least(percent)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, node, n, registers) of every row; node is null for a text without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _borrow_order()

        def out(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            some = [s for s in sets if len(s)]
            found = iter(registers(some, order)) if some else iter(())
            return pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([digest(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(found).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["id", "node", "n", "registers"],
            )

        for batch in batches:
            held, start, size = [], 0, 0
            for i, s in enumerate(shingle_sets(batch.column(1), words), 1):
                held.append(s)
                size += len(s)
                if size > 500_000 or i == batch.num_rows:
                    yield out(batch.column(0).slice(start, i - start), held)
                    held, start, size = [], i, 0

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        rows, f"id {kind}, node binary, n long, registers binary"
    )


def _bands(nodes: DataFrame) -> DataFrame:
    """(key, node): BANDS keys a node; a key's last five bits are its band."""

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
            key = np.zeros(regs.shape[:2], np.uint64)
            for r in range(ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r] + np.uint64(1))
            key = (key & ~np.uint64(31)) | np.arange(BANDS, dtype=np.uint64)
            node = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), node], ["key", "node"])

    return nodes.select("node", "registers").mapInArrow(rows, "key long, node binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, rank, lead) of keys that two nodes or more have; the leader has rank = lead.

    Ranks differ between eight classes of bands, so that a group gets several leaders.
    """
    keyed = _bands(nodes).withColumn("rank", F.xxhash64("node", F.col("key").bitwiseAND(7)))
    shared = keyed.groupBy("key").agg(F.min("rank").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return keyed.join(shared.drop("size"), "key")


def block_links(tasks: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between each group's held (role 0) and streamed (role 1) nodes, by their full sets.

    What is emitted connects what is linked: a node that is linked with several
    held ones gives one row for each group of them that wasn't connected before,
    so a cell gives no more rows than it has nodes. tasks: (grp binary, node, role int). A group is cut into cells of HELD by
    STREAMED nodes; a text is sent to each of its cells. docs: (id, text).
    """
    tasks = stored(tasks.distinct())
    # stored, so that Spark can split a large group where it can't broadcast the sizes
    sizes = stored(
        tasks.groupBy("grp").agg(
            F.ceil(F.sum(F.when(F.col("role") == 0, 1).otherwise(0)) / HELD).cast("int").alias("rows"),
            F.ceil(F.sum("role") / STREAMED).cast("int").alias("cols"),
        )
    )
    if small_enough(sizes.count(), 80):
        sizes = F.broadcast(sizes)
    held = F.col("role") == 0
    cells = (
        tasks.join(sizes, "grp")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.when(held, F.col("rows")).otherwise(F.col("cols"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(held, F.col("cols")).otherwise(F.col("rows")) - 1)))
        .select("grp", F.when(held, F.col("own")).otherwise(F.col("other")).alias("r"), F.when(held, F.col("other")).otherwise(F.col("own")).alias("c"), "role", "node")
        .join(nodes.select("node", F.col("id").alias("doc")), "node")
    )
    cells = stored(cells)
    texts = docs
    if small_enough(cells.count(), 80):
        cells = F.broadcast(cells)
    else:  # only what a cell asks for is shuffled
        texts = sifted(docs, "id", cells.select(F.col("doc").alias("id")).distinct())
    dealt = (
        texts.join(cells, texts["id"].eqNullSafe(cells["doc"]))
        .select("grp", "r", "c", "role", "node", "text")
        .repartition("grp", "r", "c")
        .sortWithinPartitions("grp", "r", "c", "role")
    )

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, index = None, None
        names, sets, tied = [], [], []

        def find(i: int) -> int:
            while tied[i] != i:
                tied[i] = tied[tied[i]]
                i = tied[i]
            return i

        for batch in batches:
            out_a, out_b = [], []
            keys = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            for (grp, r, c, role, node), members in zip(keys, shingle_sets(batch.column(5), words), strict=True):
                if (grp, r, c) != cell:
                    cell, index, names, sets, tied = (grp, r, c), None, [], [], []
                if digest(members) != node:  # another text under the same id
                    continue
                if role == 0:
                    if node not in names:
                        tied.append(len(names))
                        names.append(node)
                        sets.append(members)
                    continue
                if not names:
                    continue
                if index is None:
                    index = _postings(sets)
                both = _in_common(index, members)
                union = index[3] + len(members) - both
                near = {find(i) for i in np.flatnonzero(100 * both >= percent * union).tolist()}
                own = names.index(node) if node in names else None
                for i in near - {own if own is None else find(own)}:
                    out_a.append(min(names[i], node))
                    out_b.append(max(names[i], node))
                near |= set() if own is None else {find(own)}
                for i in near:  # from now on tied through this node
                    tied[i] = min(near)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    return dealt.mapInArrow(rows, "a binary, b binary")


def _postings(sets: list[np.ndarray]) -> tuple:
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    distinct, start = np.unique(value[order], return_index=True)
    return distinct, np.append(start, len(value)), owner[order], np.array([len(s) for s in sets])


def _in_common(index: tuple, members: np.ndarray) -> np.ndarray:
    """Size of the intersection of members with each set of the index."""
    distinct, start, owner, size = index
    at = np.searchsorted(distinct, members)
    at = at[at < len(distinct)] if len(at) and at[-1] >= len(distinct) else at
    at = at[distinct[at] == members[: len(at)]]
    length = start[at + 1] - start[at]
    total = int(length.sum())
    if not total:
        return np.zeros(len(size), np.int64)
    jump = np.repeat(start[at] - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return np.bincount(owner[jump + np.arange(total)], minlength=len(size))


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (leader, node) whose sketches don't rule out a link."""
    sketch = nodes.select("node", "registers", "n")
    both = pairs.join(sketch, "node").join(sketch.withColumnsRenamed({"node": "leader", "registers": "r_lead", "n": "n_lead"}), "leader")

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            n_a, n_b = (np.asarray(batch.column(i)) for i in (4, 5))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["leader", "node"]).filter(pa.array(likely((a == b).sum(axis=1), n_a, n_b, percent)))

    return both.select("leader", "node", "registers", "r_lead", "n", "n_lead").mapInArrow(rows, "leader binary, node binary")


def _led(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) among pairs (leader, node)."""
    pairs = stored(_likely(pairs, nodes, percent))
    leader = F.col("leader")
    tasks = pairs.select(leader.alias("grp"), leader.alias("node"), F.lit(0).alias("role")).union(
        pairs.select(leader.alias("grp"), "node", F.lit(1).alias("role"))
    )
    return stored(block_links(tasks, nodes, docs, words, percent))


def _joined(tied: DataFrame, links: DataFrame) -> DataFrame:
    """tied (node, root) after links (a, b) between its nodes: only what they connect is worked on."""
    root = lambda end: tied.select(F.col("node").alias(end), F.col("root").alias(end + "_root"))
    edges = links.join(root("a"), "a").join(root("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    top = components(edges).select(F.col("root").alias("top"), F.col("node").alias("root"))
    return stored(tied.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def _open(buckets: DataFrame, tied: DataFrame) -> DataFrame:
    """(key, node, part, size) of keys under which nodes meet that aren't tied; part tells what is tied apart."""
    parted = buckets.select("key", "node").join(tied, "node").select("key", "node", F.xxhash64("root").alias("part"))
    mixed_keys = parted.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    return stored(parted.join(mixed_keys.select("key", "size"), "key"))


def _central(met: DataFrame) -> DataFrame:
    """(leader, node): each node of open keys with that leader it shares most of them with, a key's leader being its node with most candidates."""
    degree = met.groupBy("node").agg(F.sum("size").alias("degree"))
    lead = met.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node", "part")).alias("lead"))
    return (
        met.join(lead, "key")
        .where(F.col("part") != F.col("lead.part"))
        .groupBy("node", F.col("lead.node").alias("leader"))
        .agg(F.count(F.lit(1)).alias("keys"), F.max("lead.degree").alias("degree"))
        .groupBy("node")
        .agg(F.max_by("leader", F.struct("keys", "degree", "leader")).alias("leader"))
        .select("leader", "node")
    )


def _main_parts(met: DataFrame) -> DataFrame:
    """(key, main, others, size) of open keys: the largest part of each, and how many nodes are in other ones and in all."""
    parts = met.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("size"))
    return stored(main.select("key", F.col("main.part").alias("main"), (F.col("size") - F.col("main.n")).alias("others"), "size"))


def sketch_blocks(met: DataFrame, main: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Tasks (grp, node, role) for block_links: the nodes of each open key that have a likely partner there which they aren't tied with.

    All but a key's largest part is held against all of the key, in cells of
    SKETCHES_HELD by SKETCHES_STREAMED sketches, so a key of any size is as many
    tasks as it needs. A pair is looked at under the first key that it shares.
    """
    cells = lambda c, n: F.ceil(F.col(c) / n).cast("int")
    main = main.select("key", "main", cells("others", SKETCHES_HELD).alias("rows"), cells("size", SKETCHES_STREAMED).alias("cols"))
    if small_enough(main.count(), 80):
        main = F.broadcast(main)
    known = met.select("key", "node", "part").join(main, "key")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shown = ("key", "r", "c", "role", "node", "part")
    held = known.where("part <> main").withColumn("role", F.lit(0)).withColumn("r", block("rows")).withColumn("c", every("cols")).select(*shown)
    streamed = known.withColumn("role", F.lit(1)).withColumn("c", block("cols")).withColumn("r", every("rows")).select(*shown)
    dealt = (
        held.union(streamed)
        .join(nodes.select("node", "n", "registers"), "node")
        .select(*shown, "n", "registers")
        .repartition("key", "r", "c")
        .sortWithinPartitions("key", "r", "c", "role")
    )

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        held: list[pa.RecordBatch] = []
        block: _Sketches | None = None

        def table(key: int, role: int, names: pa.Array) -> pa.RecordBatch:
            grp = pa.array([int(key).to_bytes(8, "big", signed=True)] * len(names), pa.binary())
            return pa.RecordBatch.from_arrays([grp, names, pa.array([role] * len(names), pa.int32())], ["grp", "node", "role"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part, now = batch.slice(a, b - a), tuple(marks[:3, a].tolist())
                if now != cell:
                    if block is not None:
                        yield table(cell[0], 0, block.names.filter(pa.array(block.hit)))
                    cell, held, block = now, [], None
                if marks[3, a] == 0:
                    held.append(part)
                elif held:
                    block = block or _Sketches(held, cell[0] & 31, percent)
                    yield table(cell[0], 1, part.column(4).filter(pa.array(block.met_by(part))))
        if block is not None:
            yield table(cell[0], 0, block.names.filter(pa.array(block.hit)))

    return dealt.mapInArrow(rows, "grp binary, node binary, role int").distinct()


class _Sketches:
    """The held sketches of one cell."""

    STEP = 8

    def __init__(self, parts: list[pa.RecordBatch], band: int, percent: int) -> None:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        self.band, self.percent = band, percent
        self.names, self.part, self.n, self.registers = self._read(whole)
        self.hit = np.zeros(len(self.n), bool)
        self.needed = math.ceil(_least(percent) * REGISTERS)

    @staticmethod
    def _read(rows: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        registers = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        return rows.column(4), np.asarray(rows.column(5)), np.asarray(rows.column(6)), registers

    def met_by(self, rows: pa.RecordBatch) -> np.ndarray:
        """Which of the rows have a likely partner here; the partners are marked as well."""
        _, part, n, registers = self._read(rows)
        out = np.zeros(len(n), bool)
        for a in range(0, len(n), self.STEP):
            own = slice(a, a + self.STEP)
            open_ = part[own, None] != self.part
            if not open_.any():
                continue
            same = registers[own, None] == self.registers
            equal = same.sum(axis=2, dtype=np.int16)
            small = np.minimum(n[own, None], self.n) < REGISTERS
            i, j = np.nonzero(open_ & ((equal >= self.needed) | small))
            good = likely(equal[i, j], n[own][i], self.n[j], self.percent)
            i, j = i[good], j[good]
            bands = same[i, j].reshape(-1, BANDS, ROWS).all(axis=2)
            here = bands[:, self.band] & ~bands[:, : self.band].any(axis=1)
            out[a + i[here]] = True
            self.hit[j[here]] = True
        return out


def _roots(nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) of all nodes (node, id, registers, n) that share a key with another: root is the same for all that links connect."""
    buckets = stored(_buckets(nodes))
    best = (
        buckets.where("rank <> lead")
        .groupBy("node", "lead")
        .agg(F.count(F.lit(1)).alias("keys"))
        .groupBy("node")
        .agg(F.max_by("lead", F.struct("keys", "lead")).alias("lead"))
    )
    leaders = buckets.where("rank = lead").select("lead", F.col("node").alias("leader")).distinct()
    alone = buckets.select("node").distinct().select("node", F.col("node").alias("root"))
    tied = _joined(stored(alone), _led(best.join(leaders, "lead").select("leader", "node"), nodes, docs, words, percent))
    met = _open(buckets, tied)
    main = _main_parts(met)
    pairs, open_ = main.agg(F.sum(F.col("others") * F.col("size")), F.sum("size")).first()
    if pairs and pairs > WORTH * open_:
        tied = _joined(tied, _led(_central(met), nodes, docs, words, percent))
        met = _open(met, tied)
        main = _main_parts(met)
    if main.isEmpty():
        return tied
    return _joined(tied, stored(block_links(sketch_blocks(met, main, nodes, percent), nodes, docs, words, percent)))


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Two texts are linked when 100 * |A and B| >= percent * |A or B| over their
    sets of distinct word shingles (A-Z lower-cased, words split at 0x20 and
    0x09-0x0D). A text of fewer words has one shingle, the whole sequence; null
    and empty texts have none and are linked with nothing. component_id is the
    smallest id reachable by links, itself included (a null id is only used
    where no other is reachable); kept is id = component_id. Rows that repeat
    an id each get a row. Other columns of docs are not read.
    """
    sketch = stored(sketches(docs, id_col, text_col, words))
    nodes = stored(
        sketch.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("registers").alias("registers"), F.first("n").alias("n"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    root = _roots(nodes, texts, words, percent)
    named = nodes.select("node", "id").join(root, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    by_node = named.join(least, "root").select("node", "component_id")
    return (
        sketch.select("id", "node", "n")
        .join(by_node, "node", "left")
        .select(
            "id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """docs, all columns, without the ids that near_classes drops. An id of several rows stays if one of them is kept."""
    found = near_classes(docs, id_col, text_col, words, percent)
    new = "__id"
    while new in docs.columns:
        new += "_"
    dropped = stored(found.groupBy(F.col("id").alias(new)).agg(F.max("kept").alias(new + "kept")).where(~F.col(new + "kept")).select(new))
    same = F.col(id_col).eqNullSafe(F.col(new))
    if small_enough(dropped.count(), 16):
        return docs.join(F.broadcast(dropped), same, "left_anti")
    doubted = maybe_wanted(docs, id_col, dropped.select(F.col(new).alias(id_col)), new + "maybe")  # only these are shuffled
    doubtful = F.col(new + "maybe")
    return doubted.where(~doubtful).union(doubted.where(doubtful).join(dropped, same, "left_anti")).drop(new + "maybe")
