"""Lifecycle events, plugin hooks and replay-aware log lines as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identity
from . import spread

# Event of each written transition.
EVENTS = {"START": "operation_started", "SUCCEED": "operation_succeeded", "FAIL": "operation_failed", "RETRY": "operation_retry_scheduled", "REPLAY": "operation_replayed"}


# Fields of an event's record, in order.
FIELDS = ("executionArn", "requestId", "operationId", "operationName", "tenantId", "operationType", "operationSubType", "attempt", "isReplay", "delaySeconds", "error")


def event_record(event: Column, fields: dict[str, Column]) -> Column:
    """An event as JSON: its name and fields in their order; a delay only where a retry is scheduled, an error only there and at a failure. Nulls are left out."""
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"an event has no field {sorted(unknown)[0]}")
    retry = event == EVENTS["RETRY"]
    told = {"delaySeconds": retry, "error": retry | (event == EVENTS["FAIL"])}
    shown = [(F.when(told[name], fields[name]) if name in told else fields[name]).alias(name) for name in FIELDS if name in fields]
    return F.to_json(F.struct(event.alias("message"), *shown))


def emitted(updates: DataFrame, action: str, written: str) -> DataFrame:
    """updates with event and is_replay; only transitions that were written emit one, or recorded ends that were replayed."""
    event = F.lit(None).cast("string")
    for name, shown in EVENTS.items():
        event = F.when(F.col(action) == name, shown).otherwise(event)
    rows = updates.where(F.col(written) | (F.col(action) == "REPLAY"))
    return rows.withColumn("event", event).withColumn("is_replay", F.col(action) == "REPLAY").where("event is not null")


def execution_event(has_records: Column, suspended: Column) -> tuple[Column, Column]:
    """Events at the begin and the end of an invocation."""
    return F.when(has_records, "execution_resumed").otherwise("execution_started"), F.when(suspended, "execution_suspended")


def hooks(op: Column, status: Column, attempt: Column, updated: Column) -> Column:
    """Hooks that fire when a run meets an operation's record; null if none does.

    updated: whether this invocation was told of the record's change.
    """
    attempts = op.isin("step", "wait_for_condition")
    ended = F.when(updated, "end(false)").otherwise("end(true)")
    settled = status.isin("SUCCEEDED", "FAILED", "TIMED_OUT", "STOPPED", "CANCELLED")
    running = F.when(status == "STARTED", "start(true), attempt start").when(
        status == "READY", F.when(attempt > 1, "start(true), attempt start").otherwise("start(false), attempt start")
    )
    return (
        F.when(status.isNull() & attempts, "start(false), attempt start")
        .when(status.isNull(), "start(false)")
        .when(attempts, running)
        .when(status.isin("STARTED", "PENDING", "READY"), "start(true)")
        .when((op == "wait") & (status == "SUCCEEDED"), ended)
        .when(op.isin("invoke", "create_callback") & settled, ended)
    )


def operation_info(updates: DataFrame, keys: list[str], order: str, at: str) -> DataFrame:
    """What a plugin is told of each operation: (keys, status, is_terminal, attempts, first_at, last_at, ended_at) from its updates."""
    end = identity.is_terminal(F.col("status"))
    return updates.groupBy(*keys).agg(
        F.max_by("status", order).alias("status"),
        F.max_by(end, F.col(order)).alias("is_terminal"),
        F.count_if(F.col("status") == "STARTED").alias("attempts"),
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.min(F.when(end, F.col(at))).alias("ended_at"),
    )


def invocation_info(updates: DataFrame, execution: str, invocation: Column, order: str, at: str) -> DataFrame:
    """What a plugin is told of each invocation: (execution, invocation, is_first, updates, started_at, ended_at, is_replay).

    is_replay: whether the log had records of the execution when it began.
    """
    rows = updates.withColumn("invocation", invocation)
    found = rows.groupBy(execution, "invocation").agg(
        F.count(F.lit(1)).alias("updates"), F.min(order).alias("__order"), F.min(at).alias("started_at"), F.max(at).alias("ended_at")
    )
    n = F.row_number().over(W.partitionBy(execution).orderBy("__order"))
    return found.withColumn("is_first", n == 1).withColumn("is_replay", ~F.col("is_first")).drop("__order")


def log_line(is_replay: Column, fields: Column) -> Column:
    """A log record as JSON in the order of its fields; null where a replay already wrote it."""
    return F.when(~F.coalesce(is_replay, F.lit(False)), F.to_json(fields))


# Hooks of a run in the order in which one update makes them fire.
INVOCATION_START, OPERATION_START, ATTEMPT_START = "on_invocation_start", "on_operation_start", "on_attempt_start"
ATTEMPT_END, OPERATION_END, INVOCATION_END = "on_attempt_end", "on_operation_end", "on_invocation_end"


def hook_timeline(updates: DataFrame, execution: str, operation: str, invocation: str, order: str, action: str, attempts: Column) -> DataFrame:
    """(execution, number, invocation, hook, operation, attempt, is_replay, outcome): every hook of each execution, numbered in the order of firing.

    updates: what each invocation wrote, with action START, RETRY, SUCCEED or FAIL, in
    a total order within an execution, in which the numbers of invocations grow. An invocation is a span around its updates. An operation is a
    span from its first update in an invocation to its end; it has no end hook
    where the invocation ends first, and begins again, as a replay, in the
    next one that meets it. Where `attempts` holds, each try is a span within: from its START, or from where a
    later invocation takes the operation up, to its RETRY or end. What is written after an operation's end counts for nothing.

    Windows are by operation and by invocation; numbers are running sums over ranges of an execution.
    """
    own = W.partitionBy(execution, operation).orderBy(order)
    earlier = own.rowsBetween(W.unboundedPreceding, -1)
    ends = F.col("action").isin("SUCCEED", "FAIL")
    rows = updates.select(execution, operation, F.col(invocation).alias("invocation"), order, F.col(action).alias("action"), attempts.alias("__tries"))
    rows = rows.where(F.col("action").isin("START", "RETRY", "SUCCEED", "FAIL")).withColumn("__over", F.coalesce(F.max(ends).over(earlier), F.lit(False))).where("not __over")
    same = F.lag("invocation").over(own).eqNullSafe(F.col("invocation"))
    was = F.lag("action").over(own)
    met = F.lag("invocation").over(own).isNotNull()
    fresh = ~same  # the first update of the operation in this invocation
    tries = F.coalesce(F.col("__tries"), F.lit(False)) & (fresh | (was == "RETRY"))
    number = F.sum(F.col("__begins").cast("long")).over(own.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumns({"__fresh": fresh, "__met": met, "__begins": tries}).withColumn("attempt", number)
    by_run = W.partitionBy(execution, "invocation").orderBy(order)
    first, last = F.row_number().over(by_run) == 1, F.lead(order).over(by_run).isNull()
    begins = rows.groupBy(F.col(execution).alias("__execution")).agg(F.min("invocation").alias("__least"))
    rows = rows.withColumns({"__first": first, "__last": last}).join(begins, F.col(execution).eqNullSafe(F.col("__execution")))
    rows = rows.withColumn("__again", F.col("invocation") > F.col("__least"))

    none = F.lit(None)
    hook = lambda when, name, op, attempt, replay, outcome: F.when(
        when, F.struct(F.lit(name).alias("hook"), op.cast(updates.schema[operation].dataType).alias("op"), attempt.cast("long").alias("attempt"), replay.cast("boolean").alias("is_replay"), outcome.cast("string").alias("outcome"))
    )
    op, n, has = F.col(operation), F.col("attempt"), F.coalesce(F.col("__tries"), F.lit(False))
    outcome = F.when(ends, F.when(F.col("action") == "SUCCEED", "SUCCEEDED").otherwise("FAILED"))
    fired = F.array(
        hook(F.col("__first"), INVOCATION_START, none, none, F.col("__again"), none),
        hook(F.col("__fresh"), OPERATION_START, op, none, F.col("__met"), none),
        hook(F.col("__begins"), ATTEMPT_START, op, n, F.lit(False), none),
        hook(has & (F.col("action") != "START"), ATTEMPT_END, op, n, F.lit(False), F.coalesce(outcome, F.lit("RETRY"))),
        hook(ends, OPERATION_END, op, none, F.lit(False), outcome),
        hook(F.col("__last"), INVOCATION_END, none, none, F.col("__again"), none),
    )
    hooks_of = rows.select(execution, "invocation", order, F.posexplode(fired).alias("__place", "h")).where("h is not null")
    numbered = spread.running(hooks_of, execution, [order, "__place"], {"number": ("sum", F.lit(1).cast("long"))})
    return numbered.select(execution, "number", "invocation", "h.hook", F.col("h.op").alias(operation), "h.attempt", "h.is_replay", "h.outcome")


def misplaced(timeline: DataFrame, execution: str, operation: str) -> DataFrame:
    """(execution, invocation, operation, attempt) of spans in a hook timeline that don't lie in the span around them, or begin or end more than once; none if all nest."""
    at = lambda *hooks: F.when(F.col("hook").isin(*hooks), F.col("number"))
    keys = [execution, "invocation"]
    span = lambda rows, by, start, end: rows.groupBy(*by).agg(
        F.min(at(start)).alias("a"), F.max(at(end)).alias("b"), F.count(at(start)).alias("starts"), F.count(at(end)).alias("ends"), F.min("number").alias("low"), F.max("number").alias("high")
    )
    runs = span(timeline, keys, INVOCATION_START, INVOCATION_END)
    ops = span(timeline.where(F.col(operation).isNotNull()), [*keys, operation], OPERATION_START, OPERATION_END)
    tries = span(timeline.where(F.col("attempt").isNotNull()), [*keys, operation, "attempt"], ATTEMPT_START, ATTEMPT_END)
    bad = (F.col("starts") != 1) | (F.col("ends") > 1) | (F.col("low") != F.col("a")) | (F.col("b") != F.col("high"))
    none = F.lit(None)
    of = lambda rows, op, attempt, wrong: rows.where(wrong).select(*keys, op.alias(operation), attempt.cast("long").alias("attempt"))
    out = of(runs, none.cast(timeline.schema[operation].dataType), none, bad | (F.col("ends") != 1))
    return out.unionByName(of(ops, F.col(operation), none, bad)).unionByName(of(tries, F.col(operation), F.col("attempt"), bad))
