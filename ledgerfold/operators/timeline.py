"""Concurrent batches with recorded times: a sweep over starts and settles.

Items have a batch, an index, and when they started and settled (null: they
didn't). Each is enrolled before all else, starts, and settles: its moments. Of those
at the same time settles come first, for one that settles makes room for one
that starts then, and items go by index. A batch's counts at a moment are
running sums over ranges of (batch, moment), so a batch of any size is dealt to
many tasks, and no moment needs a look at the other items. `reported_by_policy`
takes windows by batch, unless batches are said to be large.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import spread
from .batch import ALL, CUSTOM_FAILED, CUSTOM_OK, TOO_MANY, Policy

#: What happens at a moment, in the order of moments at the same time: an item that settles as it starts does so last.
ENROLLED, SETTLES, STARTS, SETTLES_AT_ONCE = -1, 0, 1, 2
MOMENT = ["at", "what", "idx"]
#: The error of a batch that a rule ended as failed before any item had.
NO_ITEM_FAILED = "BatchCompletionFailed"


@dataclass(frozen=True)
class View:
    """Some of a batch's items at one moment by their status: how many there are, run, succeeded and failed."""

    total: Column
    running: Column
    succeeded: Column
    failed: Column

    @property
    def settled(self) -> Column:
        return self.succeeded + self.failed

    @property
    def waiting(self) -> Column:
        """How many have not started."""
        return self.total - self.running - self.settled


#: What a rule says of all items and of the subsets that it names: SUCCEEDED or FAILED to end the batch so, null to go on.
Rule = Callable[[View, dict[str, View]], Column]


def began(started: Column, settled: Column) -> Column:
    """When an item started; one of which only the settle is known, or known earlier, started then."""
    return F.least(F.coalesce(started, settled), F.coalesce(settled, started))


def _settles(started: Column, settled: Column) -> Column:
    return F.when(began(started, settled) == settled, SETTLES_AT_ONCE).otherwise(SETTLES)


def moments(items: DataFrame, batch: str, ok: str, started: str, settled: str, error: str | None = None, subsets: dict[str, Column] | None = None) -> tuple[DataFrame, View, dict[str, View]]:
    """(batch, at, what, idx, counts, first_failed) of every moment, and the views that a rule has there.

    A rule is asked before an item starts and after it has settled, so at a start
    the counts are without it. first_failed: of the failed items so far that of the least index, as struct(idx, error).
    """
    names = ["all", *(subsets or {})]
    begins = began(F.col(started), F.col(settled))
    none = F.lit(None).cast(items.schema[settled].dataType)
    moment = lambda at, what: F.struct(at.alias("at"), what.cast("int").alias("what"))
    each = F.array(
        moment(none, F.lit(ENROLLED)),
        F.when(begins.isNotNull(), moment(begins, F.lit(STARTS))),
        F.when(F.col(settled).isNotNull(), moment(F.col(settled), _settles(F.col(started), F.col(settled)))),
    )
    rows = items.select(
        batch,
        "idx",
        F.coalesce(F.col(ok), F.lit(False)).alias("__ok"),
        (F.lit(None).cast("string") if error is None else F.col(error).cast("string")).alias("__error"),
        *(F.coalesce(c, F.lit(False)).cast("long").alias(f"__in_{n}") for n, c in ({"all": F.lit(True)} | (subsets or {})).items()),
        F.explode(F.filter(each, lambda m: m.isNotNull())).alias("m"),
    ).select("*", "m.at", "m.what").drop("m")
    enrols, starts = F.col("what") == ENROLLED, F.col("what") == STARTS
    fails = ~enrols & ~starts & ~F.col("__ok")
    scans: dict[str, tuple[str, Column]] = {"first_failed": ("min", F.when(fails, F.struct("idx", F.col("__error").alias("error"))))}
    for n in names:
        own = F.col(f"__in_{n}")
        scans |= {
            f"{n}_total": ("sum", F.when(enrols, own).otherwise(0)),
            f"{n}_running": ("sum", F.when(starts, own).when(enrols, 0).otherwise(-own)),
            f"{n}_succeeded": ("sum", F.when(~enrols & ~starts & F.col("__ok"), own).otherwise(0)),
            f"{n}_failed": ("sum", F.when(fails, own).otherwise(0)),
        }
    swept = spread.running(rows, batch, MOMENT, scans)
    before = {f"{n}_running": F.col(f"{n}_running") - F.when(starts, F.col(f"__in_{n}")).otherwise(0) for n in names}
    swept = swept.where(~enrols).withColumns(before).drop("__ok", "__error", *(f"__in_{n}" for n in names))
    views = {n: View(*(F.col(f"{n}_{c}") for c in ("total", "running", "succeeded", "failed"))) for n in names}
    return swept, views.pop("all"), views


def _ends(swept: DataFrame, view: View, reason: Column, batch: str, batches: DataFrame, of_empty: Column) -> DataFrame:
    counts = [view.total.alias("total"), view.running.alias("n_running"), view.succeeded.alias("n_ok"), view.failed.alias("n_failed")]
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct(*MOMENT, "reason", *counts, "first_failed")))
    found = swept.withColumn("reason", reason).groupBy(batch).agg(first.alias("end"))
    rows = batches.select(F.col(batch), (F.col("items") == 0).alias("empty"), F.col("items")).join(found, batch, "left")
    zero = F.lit(0).cast("long")
    of = lambda c: F.when(F.col("empty"), zero).otherwise(F.col(f"end.{c}")).alias(c)
    ended = rows.withColumn("reason", F.when(F.col("empty"), of_empty).otherwise(F.col("end.reason")))
    bad = F.col("reason").isin(TOO_MANY, CUSTOM_FAILED)
    any_failed = F.coalesce(F.col("end.n_failed") > 0, F.lit(False))
    return ended.select(
        batch,
        "reason",
        F.when(F.col("reason").isNull(), "STARTED").when(bad | any_failed, "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.when(bad, F.coalesce("end.first_failed.error", F.when(F.col("end.first_failed").isNull(), NO_ITEM_FAILED))).alias("error"),
        F.col("items").alias("total"),
        of("n_running"),
        of("n_ok"),
        of("n_failed"),
        F.when(F.col("end").isNotNull(), F.struct(*(F.col(f"end.{c}").alias(c) for c in MOMENT))).alias("end"),
    )


def _batches(items: DataFrame, batch: str, batches: DataFrame | None) -> DataFrame:
    """(batch, items): how many items each batch has; of all batches where these are given."""
    held = items.groupBy(batch).agg(F.count(F.lit(1)).alias("items"))
    if batches is None:
        return held
    return batches.select(batch).distinct().join(held, batch, "left").select(batch, F.coalesce("items", F.lit(0)).alias("items"))


def ended_by_rule(
    items: DataFrame, batch: str, ok: str, started: str, settled: str, rule: Rule, subsets: dict[str, Column] | None = None, error: str | None = None, batches: DataFrame | None = None
) -> DataFrame:
    """(batch, reason, status, error, total, n_running, n_ok, n_failed, end): where the caller's rule ends each batch.

    The rule is asked before each start and after each settle, and once of a batch without items (batches: all of
    them). It sees how many items have which status, of all and of each
    subset, given as conditions on items: of a subset of one item, that item's
    status. The first answer counts. A batch that no answer ends ends with its last settle; while some item hasn't settled
    it has no reason and the status STARTED. A batch that the rule ends as failed has
    the error of its first failed item by index, or NO_ITEM_FAILED. end is the moment, as a struct of MOMENT.
    """
    swept, view, others = moments(items, batch, ok, started, settled, error, subsets)
    named = lambda said, rest: F.when(said == "SUCCEEDED", CUSTOM_OK).when(said == "FAILED", CUSTOM_FAILED).otherwise(rest)
    after_last = F.when((view.settled == view.total) & (F.col("what") != STARTS), ALL)
    zero = F.lit(0).cast("long")
    nothing = View(zero, zero, zero, zero)
    return _ends(swept, view, named(rule(view, others), after_last), batch, _batches(items, batch, batches), named(rule(nothing, dict.fromkeys(others, nothing)), F.lit(ALL)))


def ended_by_policy(
    items: DataFrame, batch: str, ok: str, started: str, settled: str, policy: Policy, error: str | None = None, batches: DataFrame | None = None
) -> DataFrame:
    """What ended_by_rule gives for a policy, which is asked after each settle only."""
    swept, view, _ = moments(items, batch, ok, started, settled, error)
    reason = F.when(F.col("what") != STARTS, policy.reason(view.succeeded, view.failed, view.total))
    zero = F.lit(0)
    return _ends(swept, view, reason, batch, _batches(items, batch, batches), policy.reason(zero, zero, zero))


def _held(rows: DataFrame, columns: list[str], ok: str, started: str, settled: str) -> DataFrame:
    """Of rows with their batch's __end and __reason the columns, reason and item_status of those that its result holds."""
    begins = began(F.col(started), F.col(settled))
    moment = lambda at, what: F.struct(at.alias("at"), what.cast("int").alias("what"), F.col("idx"))
    upto = lambda m: F.col("__end").isNull() | (m <= F.col("__end"))
    has_settled = F.col(settled).isNotNull() & upto(moment(F.col(settled), _settles(F.col(started), F.col(settled))))
    start = moment(begins, F.lit(STARTS))
    has_begun = begins.isNotNull() & (F.col("__end").isNull() | (start < F.col("__end")))  # ended as it was about to start: it didn't
    status = F.when(has_settled, F.when(F.col(ok), "SUCCEEDED").otherwise("FAILED")).when(has_begun, "STARTED")
    return rows.withColumn("item_status", status).where("item_status is not null").select(*columns, F.col("__reason").alias("reason"), "item_status")


def reported(items: DataFrame, ended: DataFrame, batch: str, ok: str, started: str, settled: str) -> DataFrame:
    """items that their batch's result holds, with its reason and item_status: SUCCEEDED or FAILED if they had settled when it ended, STARTED if they ran then.

    Items that had not started are left out. Of a batch that still runs all that has started is reported.
    """
    ends = ended.select(F.col(batch).alias("__batch"), F.col("end").alias("__end"), F.col("reason").alias("__reason"))
    return _held(items.join(ends, F.col(batch).eqNullSafe(F.col("__batch"))), items.columns, ok, started, settled)


def reported_by_policy(items: DataFrame, batch: str, ok: str, started: str, settled: str, policy: Policy, large: bool = False) -> DataFrame:
    """What reported gives where ended_by_policy ends each batch.

    A policy is asked after settles only, so that an item is one row and windows
    over one partitioning by batch find the end: one shuffle, of which each batch is sorted in
    one task. Where a batch may hold a large part of all items, `large` takes the sweep over ranges instead.
    """
    if large:
        return reported(items, ended_by_policy(items, batch, ok, started, settled, policy), batch, ok, started, settled)
    has_settled, good = F.col(settled).isNotNull(), F.coalesce(F.col(ok), F.lit(False))
    moment = [F.col(settled).alias("at"), _settles(F.col(started), F.col(settled)).cast("int").alias("what"), F.col("idx")]
    whole = W.partitionBy(batch)
    so_far = whole.orderBy(*moment).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = items.withColumns({
        "__total": F.count(F.lit(1)).over(whole),
        "__ok": F.sum(F.when(has_settled & good, 1).otherwise(0)).over(so_far),
        "__failed": F.sum(F.when(has_settled & ~good, 1).otherwise(0)).over(so_far),
    })
    reason = policy.reason(F.col("__ok"), F.col("__failed"), F.col("__total"))
    ends = has_settled & reason.isNotNull() & F.col(batch).isNotNull()  # as in a join: items without a batch are never ended
    rows = rows.withColumn("__end", F.min(F.when(ends, F.struct(*moment, reason.alias("reason")))).over(whole))
    rows = rows.withColumn("__reason", F.col("__end.reason")).withColumn("__end", F.when(F.col("__end").isNotNull(), F.struct(*(F.col(f"__end.{c}").alias(c) for c in MOMENT))))
    return _held(rows, items.columns, ok, started, settled)
