"""The operation log: state from updates, change sets, hierarchy, determinism and suspension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity


def state(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each operation's newest record: one aggregation by key."""
    rest = [c for c in updates.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return updates.groupBy(*keys).agg(newest.alias("newest")).select(*keys, "newest.*")


def merged(log: DataFrame, response: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The log after a response's records replaced those of the same keys.

    order: columns of the response that say which of several records of a key is
    the last one; only that counts. Without it a response must hold a key once.
    """
    newest = response if order is None else state(response, keys, order).select(*response.columns)
    return log.join(response.select(*keys), keys, "left_anti").unionByName(newest.select(*log.columns))


def changed(log: DataFrame, response: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """(keys, status): keys whose status a response changes, each once. order as in `merged`."""
    old = log.select(*keys, F.col("status").alias("old_status"), F.lit(True).alias("known"))
    new = response.select(*keys, "status").distinct() if order is None else state(response, keys, order).select(*keys, "status")
    return new.join(old, keys, "left").where(F.col("known").isNull() | ~F.col("status").eqNullSafe(F.col("old_status"))).select(*keys, "status")


def changes(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Updates that changed their operation's status."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = updates.withColumn("was", F.lag("status").over(w)).withColumn("first", F.row_number().over(w) == 1)
    return rows.where(F.col("first") | ~F.col("status").eqNullSafe(F.col("was"))).drop("first")


def mint(operations: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """operations with number, from 1 within their parent in the given order."""
    return operations.withColumn("number", F.row_number().over(W.partitionBy(parent).orderBy(*order)))


def minted_last(inputs: DataFrame, group: str) -> DataFrame:
    """(group, number): a combinator takes its number when it is first polled, so after all its inputs."""
    return inputs.groupBy(group).agg((F.count(F.lit(1)) + 1).alias("number"))


def descend(levels: list[DataFrame], keys: list[str], parents: list[str | None]) -> DataFrame:
    """(level, key, positional, wire_id, parent_wire_id, depth) for a tree given as one table a level.

    levels[i] has its key, its parent's key and number; a join a level, of which
    each side is hashed by the parent's key.
    """
    above, out = None, None
    for depth, (rows, key, parent) in enumerate(zip(levels, keys, parents, strict=True)):
        if above is None:
            own = rows.select(F.col(key).alias("key"), F.col("number").cast("string").alias("positional"), F.lit(None).cast("string").alias("parent_positional"))
        else:
            up = above.select(F.col("key").alias("up"), F.col("positional").alias("parent_positional"))
            own = rows.join(up, F.col(parent) == F.col("up")).select(
                F.col(key).alias("key"), identity.child_id(F.col("parent_positional"), F.col("number")).alias("positional"), "parent_positional"
            )
        shown = own.select(
            F.lit(key).alias("level"),
            F.col("key").cast("string").alias("key"),
            "positional",
            identity.wire_id(F.col("positional")).alias("wire_id"),
            identity.wire_id(F.col("parent_positional")).alias("parent_wire_id"),
            F.lit(depth).alias("depth"),
        )
        above, out = own, shown if out is None else out.union(shown)
    return out


def descendants(tree: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, root, depth) of a tree (id, parent_id) of any depth, down to `depth` if given.

    Steps up the tree double with each round, so it ends after as many rounds
    as the depth has binary digits. Operations below a parent that the tree
    doesn't hold, or in a circle, have no root and are left out.
    """
    from ..sources.stored import stored

    none = F.col("parent_id").isNull()
    rows = stored(tree.select("id", F.coalesce("parent_id", "id").alias("up"), F.when(none, 0).otherwise(1).alias("steps"), none.alias("done")))
    reached, limit = 1, rows.count()
    while reached <= limit and not rows.where("not done").isEmpty():
        above = rows.select(F.col("id").alias("mid"), F.col("up").alias("further"), F.col("steps").alias("more"), F.col("done").alias("there"))
        moved = rows.where("not done").join(above, F.col("up") == F.col("mid"))
        moved = moved.select("id", F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("done"))
        rows = stored(rows.where("done").union(moved))
        reached *= 2
    found = rows.where("done").select("id", F.col("up").alias("root"), F.col("steps").alias("depth"))
    return found if depth is None else found.where(F.col("depth") <= depth)


def mismatches(log: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    """(key, problem): where a run claims another operation than the log holds.

    Both have key, op_type, sub_type and op_name; the log has status.
    """
    a, b = log.alias("a"), claimed.alias("b")
    at = lambda t, c: F.col(f"{t}.{c}")
    same = identity.same_identity(*(at(t, c) for t in "ab" for c in ("op_type", "sub_type", "op_name")))
    problem = (
        F.when(~identity.is_known(at("a", "status")), F.concat(F.lit("UnrecognizedStatus:"), at("a", "status")))
        .when(~same, "OperationMismatch")
    )
    return a.join(b, at("a", key) == at("b", key)).select(at("a", key).alias(key), problem.alias("problem")).where("problem is not null")


def virtual_conflicts(log: DataFrame, virtual: DataFrame, key: str) -> DataFrame:
    """Records at ids of children that keep none."""
    return log.join(virtual.select(key), key, "left_semi")


def replaying(claims: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """claims with is_replay: whether the log has a record at the id."""
    held = log.select(key, F.lit(True).alias("held")).distinct()
    return claims.join(held, key, "left").withColumn("is_replay", F.col("held").isNotNull()).drop("held")


def outcome(fatal: Column, panicked: Column, completed: Column, failed: Column) -> Column:
    """How an invocation ends: a fatal error before a panic before the handler's own end before waiting."""
    return F.when(fatal, "FATAL").when(panicked, "PANIC").when(completed & ~failed, "SUCCEEDED").when(completed, "FAILED").otherwise("PENDING")


def decoded(payloads: DataFrame, payload: str, schema: str, transient: Column | None = None) -> DataFrame:
    """payloads with value by schema, error and reinvoke.

    A payload that isn't such JSON is a recorded failure, not a stopped job. Where
    transient holds (the codec could not be reached), nothing is recorded and the
    invocation runs again.
    """
    again = F.lit(False) if transient is None else F.coalesce(transient, F.lit(False))
    value = F.from_json(payload, f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    rows = payloads.withColumn("value", value).withColumn("reinvoke", again)
    bad = F.col("value.__bad").isNotNull()
    return rows.withColumn("error", F.when(bad & ~again, "SerializationFailed")).withColumn("value", F.when(~bad & ~again, F.col("value").dropFields("__bad")))


def suspensions(events: DataFrame, execution: str, order: list[str], permits: Column, waits: Column) -> DataFrame:
    """events at which no permit is held and something waits, of each execution the first. permits and waits are changes."""
    w = W.partitionBy(execution).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = (
        events.withColumn("seq", F.row_number().over(w))
        .withColumn("permits", F.sum(permits).over(upto))
        .withColumn("waiting", F.sum(waits).over(upto))
        .where("permits <= 0 and waiting >= 1")
    )
    return rows.groupBy(execution).agg(F.min("seq").alias("suspended_at"))


def stops(operations: DataFrame, id_col: str, parent: str, end: str) -> DataFrame:
    """(id, stopped_at): when an operation is stopped: the earliest end of itself and all that it stands below; null for those that nothing stops.

    Steps up the tree double with each round and carry the least end on the way, so
    it takes as many rounds as the depth has binary digits. A parent that the table doesn't hold ends nothing.
    """
    from ..sources.stored import stored

    rows = stored(operations.select(F.col(id_col).alias("id"), F.col(parent).alias("up"), F.col(end).alias("stopped_at")))
    reached, limit = 1, rows.count()
    while reached <= 2 * limit and not rows.where("up is not null").isEmpty():
        above = rows.select(F.col("id").alias("mid"), F.col("up").alias("further"), F.col("stopped_at").alias("sooner"))
        moved = rows.where("up is not null").join(above, F.col("up") == F.col("mid"), "left")
        rows = stored(rows.where("up is null").union(moved.select("id", F.col("further").alias("up"), F.least("stopped_at", "sooner").alias("stopped_at"))))
        reached *= 2
    return rows.select(F.col("id").alias(id_col), "stopped_at")


def before_stops(writes: DataFrame, stopped: DataFrame, id_col: str, at: str) -> DataFrame:
    """writes without those that an operation would have made after it was stopped."""
    ends = stopped.where("stopped_at is not null").select(F.col(id_col).alias("__id"), "stopped_at")
    rows = writes.join(ends, F.col(id_col) == F.col("__id"), "left")
    return rows.where(F.col("stopped_at").isNull() | (F.col(at) <= F.col("stopped_at"))).select(*writes.columns)


def stopped_status(status: Column, started: Column, settled: Column, stopped_at: Column) -> Column:
    """How an operation stands when stops are known: as recorded if it settled by then, null if it hadn't started, else STOPPED."""
    return F.when(stopped_at.isNull() | (settled <= stopped_at), status).when(started <= stopped_at, "STOPPED")


def propagated(operations: DataFrame, id_col: str, parent: str) -> DataFrame:
    """(id, message): for each failed operation without an error of its own, that of its first failed child that has one, down the tree.

    operations: id, parent, number, status, message. A child has one if it or any
    failed operation below it does. Steps up, and then down, the tree double with
    each round; it ends when none reached another, so at any depth.
    """
    from ..sources.stored import stored

    rows = stored(operations.where("status = 'FAILED'").select(F.col(id_col).alias("id"), F.col(parent).alias("parent"), "number", "message"))
    own = rows.where("message is not null").select(F.col("id").alias("end"), F.col("message").alias("said"))
    # ids with a message at or below them
    has, reached = own.select("end"), own.count()
    jump = rows.where("parent is not null").select(F.col("id").alias("node"), F.col("parent").alias("up"))
    while True:
        grown = stored(has.union(jump.join(has, F.col("node") == F.col("end"), "left_semi").select("up")).distinct())
        before, reached, has = reached, grown.count(), grown
        if reached == before:
            break
        jump = stored(jump.join(jump.select(F.col("node").alias("mid"), F.col("up").alias("top")), F.col("up") == F.col("mid")).select("node", F.col("top").alias("up")))

    # from each operation without a message to the first child that has one, until that child's is its own
    first = rows.join(has, F.col("id") == F.col("end"), "left_semi").where("parent is not null").groupBy("parent").agg(F.min_by("id", "number").alias("at"))
    to = rows.where("message is null").select("id").join(first.withColumnRenamed("parent", "id"), "id")
    left = None
    while True:
        to = stored(to.join(own, F.col("at") == F.col("end"), "left").select("id", "at", "end", "said"))
        before, left = left, to.where("end is null").count()
        if left in (0, before):
            break
        hop = to.select(F.col("id").alias("mid"), F.col("at").alias("next"))
        to = to.join(hop, (F.col("at") == F.col("mid")) & F.col("end").isNull(), "left").select("id", F.coalesce("next", "at").alias("at"))
    found = rows.select("id", "message").join(to.select("id", "said"), "id", "left")
    return found.select(F.col("id").alias(id_col), F.coalesce("message", "said").alias("message"))
