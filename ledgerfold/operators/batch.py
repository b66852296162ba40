"""Batches: how and when a fan-out of items ends, and what it yields.

Items are rows. Settle order isn't something a log records, so it is taken from
the order columns given; they must be total within a batch.

Running counts are windows by batch, one shuffle for all batches, of which each
is sorted in one task. Where a batch may hold a large part of all items, `large`
takes them as scans over ranges of (batch, order) instead, with the same results.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity
from . import spread

# Why a batch ended.
ALL, ENOUGH, TOO_MANY = "ALL_COMPLETED", "MIN_SUCCESSFUL_REACHED", "FAILURE_TOLERANCE_EXCEEDED"
CUSTOM_OK, CUSTOM_FAILED = "CUSTOM_COMPLETION_SUCCEEDED", "CUSTOM_COMPLETION_FAILED"


@dataclass(frozen=True)
class Policy:
    """When a batch ends before all its items have settled. Without any limit the first failure ends it."""

    min_successful: int | None = None
    tolerated_failures: int | None = None
    tolerated_percentage: float | None = None

    def __post_init__(self) -> None:
        p = self.tolerated_percentage
        if p is not None and not (math.isfinite(p) and 0 <= p <= 100):
            raise ValueError(f"a tolerated percentage lies within 0 and 100, {p} doesn't")
        for n in (self.min_successful, self.tolerated_failures):
            if n is not None and n < 0:
                raise ValueError("a number of items is not negative")

    def exceeded(self, failed: Column, total: Column) -> Column:
        """Whether the failures are more than tolerated; percentages are compared without division."""
        count, share = self.tolerated_failures, self.tolerated_percentage
        if self.min_successful is None and count is None and share is None:
            count = 0
        out = F.lit(False)
        if count is not None:
            out = out | (failed > count)
        if share is not None:
            out = out | (failed * F.lit(100.0) > F.lit(float(share)) * total)
        return out

    def reason(self, ok: Column, failed: Column, total: Column) -> Column:
        """Why the batch ends at these counts; null if it goes on."""
        out = F.when(self.exceeded(failed, total), TOO_MANY).when(ok + failed >= total, ALL)
        return out if self.min_successful is None else out.when(ok >= self.min_successful, ENOUGH)


def numbered(items: DataFrame, batch: str, order: list[str | Column], large: bool = False) -> DataFrame:
    """items with idx, from 0 in the given order (of column names, if large)."""
    if large:
        return spread.running(items, batch, order, {"idx": ("sum", F.lit(1).cast("long"))}).withColumn("idx", F.col("idx") - 1)
    return items.withColumn("idx", F.row_number().over(W.partitionBy(batch).orderBy(*order)) - 1)


def running(items: DataFrame, batch: str, ok: str, settle: str = "idx", large: bool = False) -> DataFrame:
    """items with total, n_ok and n_failed as they stand when each item has settled."""
    if large:
        one = F.when(F.col(ok), 1).otherwise(0).cast("long")
        rows = spread.running_sums(items, batch, [settle], {"n_ok": one, "n_failed": 1 - one})
        return rows.withColumn("total", F.col("n_ok_all") + F.col("n_failed_all")).select(*items.columns, "total", "n_ok", "n_failed")
    so_far = W.partitionBy(batch).orderBy(settle).rowsBetween(W.unboundedPreceding, W.currentRow)
    one = F.when(F.col(ok), 1).otherwise(0)
    return (
        items.withColumn("total", F.count(F.lit(1)).over(W.partitionBy(batch)))
        .withColumn("n_ok", F.sum(one).over(so_far))
        .withColumn("n_failed", F.sum(1 - one).over(so_far))
    )


def with_empty(ended: DataFrame, batches: DataFrame | None, batch: str, **of_empty: Column) -> DataFrame:
    """ended with a row for each of the batches that has no item, of which no row of items tells; `of_empty` are its values."""
    if batches is None:
        return ended
    rows = batches.select(batch).distinct().join(ended.withColumn("__held", F.lit(True)), batch, "left")
    value = lambda c: F.when(F.col("__held"), F.col(c)).otherwise(of_empty[c]) if c in of_empty else F.col(c)
    return rows.select(*(value(c).alias(c) for c in ended.columns))


def _ended(items: DataFrame, batch: str, ok: str, policy: Policy, settle: str, large: bool) -> tuple[DataFrame, Column]:
    rows = running(items, batch, ok, settle, large).withColumn("reason", policy.reason(F.col("n_ok"), F.col("n_failed"), F.col("total")))
    return rows, F.min(F.when(F.col("reason").isNotNull(), F.struct(settle, "reason", "n_ok", "n_failed", "total")))


def completed(items: DataFrame, batch: str, ok: str, policy: Policy, settle: str = "idx", batches: DataFrame | None = None, large: bool = False) -> DataFrame:
    """(batch, reason, settled, n_ok, n_failed, total): the state at the settle that ended each batch.

    batches: all batches, so that those without items have their row too.
    """
    rows, end = _ended(items, batch, ok, policy, settle, large)
    ended = (
        rows.groupBy(batch)
        .agg(end.alias("end"))
        .select(batch, "end.reason", (F.col("end.n_ok") + F.col("end.n_failed")).alias("settled"), "end.n_ok", "end.n_failed", "end.total")
    )
    zero = F.lit(0)
    return with_empty(ended, batches, batch, reason=policy.reason(zero, zero, zero), settled=zero, n_ok=zero, n_failed=zero, total=zero)


def completed_spread(items: DataFrame, batch: str, ok: str, policy: Policy, order: list[str]) -> DataFrame:
    """What completed gives for items that settle in the given order, with a batch of any size dealt to many tasks."""
    one = F.when(F.col(ok), 1).otherwise(0)
    rows = spread.running_sums(items.select(batch, ok, *order), batch, order, {"n_ok": one, "n_failed": 1 - one})
    rows = rows.withColumn("total", F.col("n_ok_all") + F.col("n_failed_all"))
    rows = rows.withColumn("reason", policy.reason(F.col("n_ok"), F.col("n_failed"), F.col("total")))
    settled = (F.col("n_ok") + F.col("n_failed")).alias("settled")
    end = F.min(F.when(F.col("reason").isNotNull(), F.struct(settled, "reason", "n_ok", "n_failed", "total")))
    return rows.groupBy(batch).agg(end.alias("end")).select(batch, "end.reason", "end.settled", "end.n_ok", "end.n_failed", "end.total")


def with_end(items: DataFrame, batch: str, ok: str, policy: Policy, settle: str = "idx", large: bool = False) -> DataFrame:
    """items with reason and settled of their batch's end, by windows over one partitioning (if large, by a join with the ends)."""
    rows, end = _ended(items, batch, ok, policy, settle, large)
    if large:
        ends = rows.groupBy(F.col(batch).alias("__batch")).agg(end.alias("__end"))
        rows = items.join(ends, F.col(batch).eqNullSafe(F.col("__batch")))
    else:
        rows = rows.withColumn("__end", end.over(W.partitionBy(batch)))
    return rows.select(*items.columns, F.col("__end.reason").alias("reason"), (F.col("__end.n_ok") + F.col("__end.n_failed")).alias("settled"))


@dataclass(frozen=True)
class Stats:
    """A batch's counts at one moment, as a custom rule sees them."""

    total: Column
    succeeded: Column
    failed: Column

    @property
    def settled(self) -> Column:
        return self.succeeded + self.failed


def completed_by_counts(
    items: DataFrame, batch: str, ok: str, decide: Callable[[Stats], Column], settle: str = "idx", batches: DataFrame | None = None, large: bool = False
) -> DataFrame:
    """(batch, reason, settled, n_ok, n_failed, total): a custom monotone rule over counts, asked before the first start and after each settle.

    decide gives SUCCEEDED or FAILED to end the batch so, null to go on. A batch
    that it never ends ends with its last item; one without items is asked once.
    """
    rows = running(items, batch, ok, settle, large)
    zero = F.lit(0)
    said = decide(Stats(F.col("total"), F.col("n_ok"), F.col("n_failed")))
    end = F.min(F.when(said.isNotNull(), F.struct(settle, said.alias("said"), "n_ok", "n_failed")))
    found = rows.groupBy(batch).agg(end.alias("end"), F.max("n_ok").alias("all_ok"), F.max("n_failed").alias("all_failed"), F.max("total").alias("total"))
    found = found.withColumn("first", decide(Stats(F.col("total"), zero, zero)))
    at = lambda c, last: F.when(F.col("first").isNotNull(), zero).otherwise(F.coalesce(F.col(c), F.col(last)))
    reason = lambda said: F.when(said == "SUCCEEDED", CUSTOM_OK).when(said == "FAILED", CUSTOM_FAILED).otherwise(ALL)
    ended = found.select(
        batch, reason(F.coalesce("first", "end.said")).alias("reason"), at("end.n_ok", "all_ok").alias("n_ok"), at("end.n_failed", "all_failed").alias("n_failed"), "total"
    ).withColumn("settled", F.col("n_ok") + F.col("n_failed"))
    return with_empty(ended, batches, batch, reason=reason(decide(Stats(zero, zero, zero))), settled=zero, n_ok=zero, n_failed=zero, total=zero)


def resumed(items: DataFrame, batch: str, ok: str, policy: Policy, batches: DataFrame | None = None) -> DataFrame:
    """(batch, reason, n_ok, n_failed, total): all recorded outcomes applied, then one check. ok is null for an item without outcome; batches: see completed."""
    counts = items.groupBy(batch).agg(
        F.sum(F.when(F.col(ok), 1).otherwise(0)).alias("n_ok"),
        F.sum(F.when(~F.col(ok), 1).otherwise(0)).alias("n_failed"),
        F.count(F.lit(1)).alias("total"),
    )
    zero = F.lit(0)
    ended = counts.select(batch, policy.reason(F.col("n_ok"), F.col("n_failed"), F.col("total")).alias("reason"), "n_ok", "n_failed", "total")
    return with_empty(ended, batches, batch, reason=policy.reason(zero, zero, zero), n_ok=zero, n_failed=zero, total=zero)


def completed_by_rule(
    items: DataFrame, batch: str, states: dict[str, Column], done: Column, failed: bool = False, settle: str = "idx", batches: DataFrame | None = None, large: bool = False
) -> DataFrame:
    """(batch, reason, settled): a custom monotone rule, asked after each settle.

    states: running facts by name, as conditions on one item that must have held
    for some settled item; done: the rule over these names. batches: see completed; one without items has no facts.
    """
    if large:
        scans = {name: ("max", holds) for name, holds in states.items()} | {"n_settled": ("sum", F.lit(1).cast("long"))}
        rows = spread.running(items, batch, [settle], scans)
    else:
        so_far = W.partitionBy(batch).orderBy(settle).rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = items.withColumn("n_settled", F.row_number().over(W.partitionBy(batch).orderBy(settle)))
        for name, holds in states.items():
            rows = rows.withColumn(name, F.max(holds).over(so_far))
    found = rows.groupBy(batch).agg(F.min(F.when(done, F.col("n_settled"))).alias("at"), F.count(F.lit(1)).alias("total"))
    ended = found.select(
        batch,
        F.when(F.col("at").isNull(), ALL).otherwise(CUSTOM_FAILED if failed else CUSTOM_OK).alias("reason"),
        F.coalesce("at", "total").alias("settled"),
    )
    return with_empty(ended, batches, batch, reason=F.lit(ALL), settled=F.lit(0))


def item_status(items: DataFrame, ok: str, concurrent: bool) -> DataFrame:
    """items of with_end with status; those after the end are STARTED if they ran at once, else left out."""
    status = F.when(F.col("idx") >= F.col("settled"), "STARTED").when(F.col(ok), "SUCCEEDED").otherwise("FAILED")
    rows = items.withColumn("status", status).drop("settled")
    return rows if concurrent else rows.where("status <> 'STARTED'")


def views(items: DataFrame, batch: str, value: str, *same: str) -> DataFrame:
    """One row a batch from items with idx and status: counts, marks, values in item order, the first failed item, and columns that are the same in a batch."""
    ordered = lambda when, c: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("idx", F.col(c).alias("v"))))), lambda x: x["v"])
    good, bad = F.col("status") == "SUCCEEDED", F.col("status") == "FAILED"
    mark = F.when(good, "S").when(bad, "F").otherwise("-")
    return items.withColumn("mark", mark).groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(good).alias("success_count"),
        F.count_if(bad).alias("failure_count"),
        F.count_if(F.col("status") == "STARTED").alias("started_count"),
        (F.count_if(bad) > 0).alias("has_failure"),
        F.when(F.count_if(bad) > 0, "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.array_join(ordered(F.lit(True), "mark"), "").alias("item_statuses"),
        ordered(good, value).alias("results"),
        F.min(F.when(bad, F.col("idx"))).alias("first_failed"),
        *(F.first(c).alias(c) for c in same),
    )


def summary_record(kind: str, reason: Column, summary: Column | None = None) -> Column:
    """The record of an oversized batch from the columns of views; a summary is its last key and never read again."""
    parts = [
        F.lit(kind).alias("type"),
        F.col("total_count").alias("totalCount"),
        F.col("success_count").alias("successCount"),
        F.col("failure_count").alias("failureCount"),
        F.col("started_count").alias("startedCount"),
        reason.alias("completionReason"),
        F.col("status"),
        F.col("item_statuses").alias("itemStatuses"),
    ]
    return F.to_json(F.struct(*parts, *([] if summary is None else [summary.alias("summary")])))


def item_name(given: Column, idx: Column, kind: str = "map-item") -> Column:
    """The recorded name: the caller's unless null or empty."""
    return F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit(f"{kind}-"), idx.cast("string")))


def oversized(record: Column, limit: int) -> Column:
    """Whether a batch's record is too large to stand in the log, so that its items are replayed."""
    return F.octet_length(record) > limit


def branches(frames: dict[str, DataFrame]) -> DataFrame:
    """Branches of one output type as rows of (branch_idx, branch_name, columns)."""
    out = None
    for i, (name, df) in enumerate(frames.items()):
        own = df.select(F.lit(i).alias("branch_idx"), F.lit(name or f"parallel-branch-{i}").alias("branch_name"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def mixed_branches(frames: dict[str, DataFrame]) -> DataFrame:
    """Branches of any types as rows of (branch_idx, branch_name, payload), payload being JSON."""
    return branches({n: df.select(F.to_json(F.struct("*")).alias("payload")) for n, df in frames.items()})


def one_slot(items: DataFrame, batch: str, seconds: str) -> DataFrame:
    """items with started and settled if a batch's items run one after the other: running sums in item order."""
    before = W.partitionBy(batch).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    started = F.coalesce(F.sum(seconds).over(before), F.lit(0))
    return items.withColumn("started", started).withColumn("settled", F.col("started") + F.col(seconds))


def at_once(items: DataFrame, batch: str, started: str, settled: str) -> DataFrame:
    """(batch, most): the most items that recorded times show running at the same time; one that settles makes room for one that starts then."""
    ends = items.select(batch, F.explode(F.array(F.struct(F.col(started).alias("at"), F.lit(1).alias("change")), F.struct(F.col(settled).alias("at"), F.lit(-1).alias("change")))).alias("e"))
    w = W.partitionBy(batch).orderBy("at", "change").rowsBetween(W.unboundedPreceding, W.currentRow)
    return ends.select(batch, "e.*").withColumn("running", F.sum("change").over(w)).groupBy(batch).agg(F.max("running").alias("most"))


def item_records(items: DataFrame, batch: str, inner: int, flat: bool) -> DataFrame:
    """(op, parent) of what the log holds of items with idx that run `inner` operations each; flat items keep no record, their operations are the batch's."""
    own = F.col(batch).cast("string")
    rows = items.select(own.alias("batch"), identity.child_id(own, F.col("idx") + 1).alias("item"))
    number = F.explode(F.sequence(F.lit(1), F.lit(inner))).alias("number")
    within = rows.select("batch", "item", number).select(identity.child_id(F.col("item"), F.col("number")).alias("op"), (F.col("batch") if flat else F.col("item")).alias("parent"))
    return within if flat else within.union(rows.select("item", "batch"))


def mapped(items: DataFrame, batch: str, body: Callable[[Column, Column], Column], item: str, name: str = "value") -> DataFrame:
    """The rows of an array column with their index and body(item, index)."""
    return items.select(batch, F.posexplode(item).alias("idx", "item")).withColumn(name, body(F.col("item"), F.col("idx")))
