"""Near-duplicate embeddings by an exact metric range join.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other. Pivots
cut the vectors into cells: a vector's home is its nearest pivot. If v has home
h and a partner w within r has home k, w is no farther from pivot k than from
pivot h, so by the triangle inequality in its sharper form for Euclidean space

    d(v, k)^2 - d(v, h)^2 <= 2 r d(h, k).

Where that holds, v is also sent to cell k (only for k > h: one of the two cells
is enough to find the pair). Cells then join independently, cut into blocks of
held by streamed vectors, so that a crowded cell is many tasks of bounded size. Vectors with equal components are one node
with a weight. A block emits link counts and enough links to connect what is
linked, not its pairs.

There is about one pivot for each HELD vectors, up to PIVOTS: a vector goes to
one cell at least for each block of partners that it may have, so more pivots up to there don't send it
to more tasks, and the more the vectors cluster the fewer tasks it goes to. On vectors
without any clusters in many dimensions no pivot separates much and the work
nears that of all blocks against all blocks; it stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import tidy
from .components import components
from .scratch import small_enough, stored

#: Vectors of a cell held by one task, of those that stream past them, and of those compared at a time.
HELD, STREAMED, STEP = 4096, 32_768, 512
#: Most pivots for each number of dimensions, and the bytes of all; both bound what is sent to every executor.
PIVOTS, PIVOT_BYTES = 4096, 16 * 1024 * 1024
#: How near to the limit a product of unit vectors is computed again from the vectors themselves.
DOUBT = 1e-12


@tidy
def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, node, dim, vec): node and vec are null where the vector can't be compared."""
    for batch in batches:
        column = batch.column(1)
        nodes, dims, vecs = [], [], []
        for value in column:
            values = value.values
            raw = None
            if values is not None and len(values) and values.null_count == 0:
                array = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(array).all() and array.any():
                    raw = (array + 0.0).tobytes()  # -0.0 is 0.0
            vecs.append(raw)
            nodes.append(xxhash.xxh3_128_digest(raw) if raw else None)
            dims.append(len(raw) // 8 if raw else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(nodes, pa.binary()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())],
            ["id", "node", "dim", "vec"],
        )


def _unit(vecs: list[bytes], dim: int) -> np.ndarray:
    x = _scaled(vecs, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scaled(vecs: list[bytes], dim: int) -> np.ndarray:
    """The vectors over powers of two, which changes no digit: squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(vecs), np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _near(x: np.ndarray, y: np.ndarray, least: float, vecs_x: list[bytes], vecs_y: list[bytes]) -> np.ndarray:
    """Which unit vectors of x and y have a cosine of at least `least`; doubtful ones by dot product over norms."""
    product = x @ y.T
    near = product >= least - DOUBT
    i, j = np.nonzero(near)
    doubtful = product[i, j] <= least + DOUBT
    i, j = i[doubtful], j[doubtful]
    if len(i):
        a, b = _scaled([vecs_x[k] for k in i.tolist()], x.shape[1]), _scaled([vecs_y[k] for k in j.tolist()], x.shape[1])
        dot = np.array([u @ v for u, v in zip(a, b, strict=True)])
        near[i, j] = dot / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)) >= least
    return near


def _local_roots(near: np.ndarray) -> np.ndarray:
    """The first node of each node's component in a symmetric matrix of links."""
    n = len(near)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i] = i
        front = np.array([i])
        while len(front):
            reached = np.flatnonzero(near[front].any(axis=0) & (root < 0))
            root[reached] = i
            front = reached
    return root


class _Block:
    """The held vectors of one cell block; of several blocks with the same ones only the first counts links between them."""

    def __init__(self, least: float, first: bool) -> None:
        self.least, self.first = least, first
        self.names: list[bytes] = []
        self.vecs: list[bytes] = []
        self.weights: list[int] = []
        self.ready = False

    def prepare(self, dim: int) -> list[tuple[bytes, int | None, bytes | None]]:
        """Compare the held vectors with each other."""
        self.ready = True
        self.x = _unit(self.vecs, dim)
        self.w = np.array(self.weights, np.int64)
        self.count = np.zeros(len(self.w), np.int64)
        near = np.empty((len(self.w), len(self.w)), bool)
        for a in range(0, len(self.w), STEP):
            near[a : a + STEP] = _near(self.x[a : a + STEP], self.x, self.least, self.vecs[a : a + STEP], self.vecs)
        near |= near.T
        np.fill_diagonal(near, False)
        self.count = near @ self.w
        some = np.flatnonzero(self.count)
        self.root = np.arange(len(self.w))
        if len(some):
            self.root[some] = some[_local_roots(near[np.ix_(some, some)])]
        if not self.first:
            self.count[:] = 0
            return []
        return [(self.names[i], None, self.names[self.root[i]]) for i in some.tolist() if self.root[i] != i]

    def meet(self, names: list[bytes], vecs: list[bytes], weights: np.ndarray, dim: int) -> list[tuple[bytes, int | None, bytes | None]]:
        """Compare streamed vectors with the held ones."""
        out: list[tuple[bytes, int | None, bytes | None]] = []
        for a in range(0, len(names), STEP):
            near = _near(_unit(vecs[a : a + STEP], dim), self.x, self.least, vecs[a : a + STEP], self.vecs)
            rows = np.flatnonzero(near.any(axis=1))
            if not len(rows):
                continue
            near = near[rows]
            self.count += weights[a : a + STEP][rows] @ near
            for i, hit, total in zip((rows + a).tolist(), near, (near @ self.w).tolist(), strict=True):
                out.append((names[i], total, None))
                out += [(names[i], None, self.names[j]) for j in np.unique(self.root[hit]).tolist()]
        return out

    def close(self) -> list[tuple[bytes, int | None, bytes | None]]:
        return [(self.names[i], int(self.count[i]), None) for i in np.flatnonzero(self.count).tolist()]


def _cells(pivots: dict[int, np.ndarray], radius: float):
    """A function for mapInArrow: (cell, home, node, dim, weight), one row a cell that a vector goes to.

    Vectors are taken STEP at a time; an output batch has at most STEP times the pivots' rows, none with a vector.
    """

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            names = pa.RecordBatch.from_arrays([batch.column(i) for i in (0, 1, 3)], ["node", "dim", "weight"])
            for dim in np.unique(dims).tolist():
                whole, p = np.flatnonzero(dims == dim), pivots.get(dim)
                for a in range(0, len(whole), STEP):
                    at = whole[a : a + STEP]
                    if p is None:
                        home, goes = np.zeros(len(at), np.int64), np.ones((len(at), 1), bool)
                    else:
                        d2 = 2 - 2 * (_unit([batch.column(2)[i].as_py() for i in at.tolist()], dim) @ p.T)
                        home = d2.argmin(axis=1)
                        near, which = np.unique(home, return_inverse=True)
                        apart = 2 * radius * np.sqrt(np.maximum(0, 2 - 2 * (p[near] @ p.T))) + 1e-9
                        d2 -= d2[np.arange(len(at)), home][:, None]
                        goes = np.arange(len(p)) >= home[:, None]
                        for k in range(len(at)):
                            goes[k] &= d2[k] <= apart[which[k]]
                    i, cell = np.nonzero(goes)
                    part = names.take(pa.array(at[i]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell.astype(np.int32)), pa.array(cell == home[i]), *part.columns], ["cell", "home", "node", "dim", "weight"]
                    )

    return rows


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95
) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Two vectors are linked when their cosine in double precision is at least
    `cosine`. Vectors that are null, zero, empty or hold null or non-finite
    components are linked with nothing, nor are vectors of different length.
    n_links counts other rows, copies too. component_id is the smallest id
    reachable by links, itself included (a null id is only used where no other is
    reachable); kept is id = component_id. Rows that repeat an id are vectors of
    their own, each with its row and counted as links of each other if near. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = stored(
        vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(
            _parsed, f"id {kind}, node binary, dim int, vec binary"
        )
    )
    nodes = stored(
        rows.where("node is not null")
        .groupBy("node", "dim", "vec")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    )
    count, longest = nodes.agg(F.count(F.lit(1)), F.max("dim")).first()
    most = max(2, min(PIVOTS, count // HELD, PIVOT_BYTES // (8 * (longest or 1))))
    chosen: dict[int, list[bytes]] = {}
    for r in nodes.select("dim", "vec").orderBy(F.xxhash64("node"), "node").limit(most).collect():
        chosen.setdefault(r["dim"], []).append(bytes(r["vec"]))
    pivots = {dim: _unit(vecs, dim) for dim, vecs in chosen.items()}
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))

    sent = stored(
        nodes.select("node", "dim", "vec", "weight").mapInArrow(
            _cells(pivots, radius), "cell int, home boolean, node binary, dim int, weight long"
        )
    )
    sizes = stored(
        sent.groupBy("dim", "cell").agg(
            F.ceil(F.count_if("home") / HELD).cast("int").alias("blocks"), F.ceil(F.count(F.lit(1)) / STREAMED).cast("int").alias("columns")
        ).where("blocks > 0")
    )
    if small_enough(sizes.count(), 40):
        sizes = F.broadcast(sizes)
    dealt = (
        sent.join(sizes, ["dim", "cell"])
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("last", F.when(F.col("home"), F.col("own")).otherwise(F.col("blocks") - 1))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .withColumn("role", F.when(F.col("home") & (F.col("block") == F.col("own")), 0).otherwise(1))
        .withColumn("streams", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("columns")).cast("int"))
        .withColumn("column", F.explode(F.when(F.col("role") == 0, F.sequence(F.lit(0), F.col("columns") - 1)).otherwise(F.array("streams"))))
        .join(nodes.select("node", "vec"), "node")
        .select("dim", "cell", "block", "column", "role", "node", "weight", "vec")
        .repartition("dim", "cell", "block", "column")
        .sortWithinPartitions("dim", "cell", "block", "column", "role")
    )

    @tidy
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, _Block(cosine, True)

        def table(out: list) -> pa.RecordBatch:
            node, links, other = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(node, pa.binary()), pa.array(links, pa.int64()), pa.array(other, pa.binary())], ["node", "links", "other"]
            )

        def closed() -> list:
            if key is None or not block.names:
                return []
            return ([] if block.ready else block.prepare(key[0])) + block.close()

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(5)])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(marks[:4, a].tolist())
                if now != key:
                    yield table(closed())
                    key, block = now, _Block(cosine, now[3] == 0)
                part = batch.slice(a, b - a)
                names, vecs = part.column(5).to_pylist(), part.column(7).to_pylist()
                weights = np.asarray(part.column(6))
                if marks[4, a] == 0:
                    block.names += names
                    block.vecs += vecs
                    block.weights += weights.tolist()
                elif block.names:
                    out = [] if block.ready else block.prepare(now[0])
                    yield table(out + block.meet(names, vecs, weights, now[0]))
        yield table(closed())

    found = stored(dealt.mapInArrow(compared, "node binary, links long, other binary"))
    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    root = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = stored(
        nodes.select("node", "id", "weight")
        .join(counts, "node", "left")
        .join(root, "node", "left")
        .select("node", "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    by_node = named.join(least, "root").select("node", "n_links", "component_id")
    return (
        rows.select("id", "node")
        .join(by_node, "node", "left")
        .select(
            "id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )
