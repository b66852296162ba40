"""Steps, waits, invocations, children, retried blocks, polls and callbacks over a log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import errors, schedules
from ..functions.codecs import Codec
from ..functions.identity import is_known
from . import spread


def replay_action(status: Column, at_most_once: Column) -> Column:
    """What a step does with its record. A started attempt runs again unless it may run only once."""
    return (
        F.when(status.isNull(), "RUN")
        .when(status == "SUCCEEDED", "RETURN")
        .when(status == "FAILED", "RAISE")
        .when(status == "PENDING", "WAIT")
        .when((status == "STARTED") & at_most_once, "INTERRUPTED")
        .when(status.isin("STARTED", "READY", "CANCELLED", "TIMED_OUT", "STOPPED"), "RUN")
        .otherwise("UNRECOGNIZED")
    )


def stepped(inputs: DataFrame, log: DataFrame, key: str, body: Column, recorded: str = "result", codec: Codec | None = None) -> DataFrame:
    """inputs with value and is_replay: the recorded result where there is one, else body.

    With a codec, results are recorded as it writes them; a live value is what
    it reads back from what it wrote, so that both runs see the same.
    """
    held, live = F.col("was"), body
    if codec is not None:
        held, live = codec.read(held), codec.read(codec.write(body))
    done = log.where("status = 'SUCCEEDED'").select(key, F.col(recorded).alias("was"), F.lit(True).alias("done"))
    return (
        inputs.join(done, key, "left")
        .withColumn("is_replay", F.col("done").isNotNull())
        .withColumn("value", F.when(F.col("done"), held).otherwise(live))
        .drop("was", "done")
    )


def wait_outcome(status: Column) -> Column:
    """Only success resumes a wait; any other end is unexpected."""
    return F.when(status == "SUCCEEDED", "RESUMED").when(status == "STARTED", "WAITING").when(status.isNull(), "START").otherwise("UnexpectedStatus")


def due(start: Column, seconds: Column) -> Column:
    """When a wait that began at start is over."""
    return start + F.make_dt_interval(secs=schedules.asked_seconds(seconds))


def invoked(calls: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """calls with the called function's status, value and error: FunctionFailed for any end but success."""
    bad = F.col("status").isin("FAILED", "TIMED_OUT", "STOPPED", "CANCELLED")
    return calls.join(registry, key, "left").withColumn("error", F.when(bad, "FunctionFailed").when(~is_known(F.col("status")), "UnrecognizedStatus"))


def retried_blocks(attempts: DataFrame, block: str, attempt: str, ok: str, how: schedules.Backoff) -> DataFrame:
    """(block, status, attempts, waited): attempts in order up to the first success or the cap, with what was waited between them."""
    used = attempts.where(F.col(attempt) <= how.max_attempts)
    first = F.min(F.when(F.col(ok), F.col(attempt)))
    ends = used.groupBy(block).agg(first.alias("won"), F.max(attempt).alias("last"))
    delay = schedules.whole_seconds(schedules.base_delay(F.col(attempt), how))
    waits = (
        used.join(ends, block)
        .where(F.col(attempt) < F.coalesce("won", "last"))
        .groupBy(block)
        .agg(F.sum(delay).alias("waited"))
    )
    return ends.join(waits, block, "left").select(
        block,
        F.when(F.col("won").isNotNull(), "SUCCEEDED").when(F.col("last") >= how.max_attempts, "ChildFailed").otherwise("PENDING").alias("status"),
        F.coalesce("won", "last").alias("attempts"),
        F.coalesce("waited", F.lit(0)).alias("waited"),
    )


def _until(rows: DataFrame, key: str, attempt: str, end: Column, delay: Column, last: str | None = None) -> DataFrame:
    """(key, end, attempts, waited, last): attempts up to the first that ends, whole seconds between them and the last one's column of that name; end is null while none did."""
    w = W.partitionBy(key).orderBy(attempt)
    marked = rows.select(key, attempt, end.alias("end"), delay.alias("delay"), (F.lit(None) if last is None else F.col(last)).alias("held"))
    over = F.max(F.col("end").isNotNull()).over(w.rowsBetween(W.unboundedPreceding, -1))
    before = schedules.asked_seconds(F.lag("delay").over(w)).cast("long")
    used = marked.withColumn("over", over).withColumn("before", F.when(F.lag(attempt).over(w).isNotNull(), before)).where(~F.coalesce("over", F.lit(False)))
    return used.groupBy(key).agg(F.max("end").alias("end"), F.max(attempt).alias("attempts"), F.coalesce(F.sum("before"), F.lit(0)).alias("waited"), F.max_by("held", attempt).alias("last"))


def retried_by(attempts: DataFrame, block: str, attempt: str, ok: str, error: str, strategy: Callable[[Column, Column], Column]) -> DataFrame:
    """(block, status, attempts, waited) under the caller's strategy: of an attempt's error and number, struct(action, delay).

    The action STOP ends the block as FAILED; any other waits for the delay, in
    seconds (rounded up, at least 1), and tries again.
    """
    said = strategy(F.col(error), F.col(attempt))
    end = F.when(F.col(ok), "SUCCEEDED").when(said["action"] == "STOP", "FAILED")
    out = _until(attempts, block, attempt, end, said["delay"])
    return out.select(block, F.coalesce("end", F.lit("PENDING")).alias("status"), "attempts", "waited")


def polled_by(checks: DataFrame, key: str, attempt: str, state: str, strategy: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, outcome, checks, waited, state) under the caller's strategy: of a check's state and number, struct(action, delay).

    COMPLETE returns the state, EXHAUSTED fails, CONTINUE waits for the delay.
    """
    said = strategy(F.col(state), F.col(attempt))
    end = F.when(said["action"] == "COMPLETE", "COMPLETE").when(said["action"] == "EXHAUSTED", "MaxChecksExceeded")
    out = _until(checks, key, attempt, end, said["delay"], state)
    return out.select(key, F.coalesce("end", F.lit("CONTINUE")).alias("outcome"), F.col("attempts").alias("checks"), "waited", F.col("last").alias("state"))


def checked(runs: DataFrame, key: str, order: str, seen: str, lost: str, initial: Column, combine: str = "sum") -> DataFrame:
    """(key, attempt, state) of every recorded check, for checks whose state is the initial one combined with what each run saw.

    combine is the name of a scan (sum, min, max). A lost run recorded nothing: the
    check runs again, with the same attempt number and from the initial state. What a
    run saw may be null, which changes nothing. One scan with restarts over
    ranges of runs, so that a key with very many runs is many tasks; order must be total within a key.
    """
    gone = F.coalesce(F.col(lost), F.lit(False))
    rows = runs.select(key, order, F.col(seen).alias("__seen"), gone.alias("__lost"))
    values = {"state": (combine, F.when(~F.col("__lost"), F.col("__seen"))), "attempt": ("sum", (~F.col("__lost")).cast("long"))}
    scanned = spread.running(rows, key, [order], values, restart=F.col("__lost"), whole=("attempt",))
    return scanned.where("not __lost").select(key, "attempt", spread.KINDS[combine][1](initial, F.col("state")).alias("state"))


def checked_in_order(runs: DataFrame, key: str, order: str, seen: str, lost: str, initial: object, check: Callable[[object, object], object], state_type: str) -> DataFrame:
    """What checked gives, for any check(state, seen), a Python function, and states of a Spark type.

    A key's runs stream through one task in order, of which only the state is
    held: checks that don't combine can't be split.
    """
    shape = runs.select(key).withColumns({"attempt": F.lit(0).cast("long"), "state": F.lit(None).cast(state_type)}).schema
    fields = to_arrow_schema(shape)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, any_yet, state, attempt = None, False, initial, 0
        for batch in batches:
            out: list[tuple] = []
            for own, what, gone in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if own != now or not any_yet:
                    now, any_yet, state, attempt = own, True, initial, 0
                if gone:
                    state = initial
                else:
                    state, attempt = check(state, what), attempt + 1
                    out.append((own, attempt, state))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], fields.field(i).type) for i in range(3)], schema=fields)

    ordered = runs.select(key, order, seen, F.coalesce(F.col(lost), F.lit(False)).alias("lost")).repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInArrow(rows, shape)


def attempt_names(block: Column, attempt: Column) -> tuple[Column, Column]:
    """Names of an attempt's child and of the wait after it."""
    return F.concat(F.lit("attempt-"), attempt.cast("string")), F.concat(block, F.lit("-backoff-"), attempt.cast("string"))


def polled(checks: DataFrame, key: str, attempt: str, done: Column, how: schedules.Backoff) -> DataFrame:
    """(key, outcome, checks): the first check whose state is done, else the cap on checks, else still going.

    A condition that holds at the last check allowed is done.
    """
    ends = checks.where(F.col(attempt) <= how.max_attempts).groupBy(key).agg(F.min(F.when(done, F.col(attempt))).alias("hit"), F.max(attempt).alias("last"))
    return ends.select(
        key,
        F.when(F.col("hit").isNotNull(), "COMPLETE").when(F.col("last") >= how.max_attempts, "MaxChecksExceeded").otherwise("CONTINUE").alias("outcome"),
        F.coalesce("hit", "last").alias("checks"),
    )


def refreshes(waiting: DataFrame, key: str, first: Column, deadline: Column, until: Column) -> DataFrame:
    """(key, n, at): seconds at which an unchanged operation is looked up, as long as a second is left before the deadline.

    Without a deadline look-ups never end; of those, the ones up to the second
    `until` are given (as far as a run lasted, say).
    """
    last_at = F.coalesce(deadline - schedules.RESERVE, until)
    rows = waiting.withColumns({"__first": first, "__last": last_at}).where("__first <= __last")
    last = 1 + schedules.unchanged_within(F.col("__last") - F.col("__first"))
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), last.cast("int"))))
    rows = rows.withColumn("at", F.col("__first") + schedules.refresh_offset(F.col("n") - 1))
    return rows.where("at <= __last").select(key, "n", "at")


def callbacks(created: DataFrame, completions: DataFrame, key: str, timeout: int) -> DataFrame:
    """(key, created, outcome, after): each callback's first completion within timeout seconds of its creation.

    created and completions have key and at (seconds); creations equal in both are
    one. A timeout of 0 is none. A creation without key or time is never completed.

    Both stand in one order of key and time, in which the next completion is the
    least one from there to the key's end: no pairs are made, and a key with
    very many is dealt by ranges of time to many tasks.
    """
    both = created.select(key, "at").distinct().withColumn("__done", F.lit(False)).unionByName(completions.select(key, "at").withColumn("__done", F.lit(True)))
    known = F.col(key).isNotNull() & F.col("at").isNotNull()
    next_one = spread.running(both, key, ["at", "__done"], {"done_at": ("min", F.when(F.col("__done"), F.col("at")))}, backwards=True)
    done = F.when(known & (F.lit(timeout == 0) | (F.col("done_at") <= F.col("at") + timeout)), F.col("done_at"))
    first = next_one.where("not __done").select(key, "at", done.alias("done_at"))
    return first.select(
        key,
        F.col("at").alias("created"),
        F.when(F.col("done_at").isNotNull(), "SUCCEEDED").otherwise("TIMED_OUT").alias("outcome"),
        F.coalesce(F.col("done_at") - F.col("at"), F.lit(timeout)).alias("after"),
    )


def submitted(callbacks: DataFrame, callback_id: str, status: str, wire: str, submit: Callable[[Column], Column]) -> DataFrame:
    """callbacks with submit_error and failure, where each id was handed to the caller's submitter first.

    submit(id) is the submitter's error, or null if it took the id. A failed
    submission fails the wait, whatever the callback's record says; else its own end does.
    """
    error = submit(F.col(callback_id)).cast("string")
    rows = callbacks.withColumn("submit_error", error)
    return rows.withColumn("failure", F.when(F.col("submit_error").isNotNull(), "SubmitterFailed").otherwise(errors.callback_failure(F.col(status), F.col(wire))))


def missed_heartbeats(beats: DataFrame, key: str, at: str, seconds: int, created: DataFrame | None = None, until: Column | None = None) -> DataFrame:
    """(key, at, silent): heartbeats that no other followed within so many seconds, of each key the first.

    created has (key, at) of operations, from which the first beat is awaited as
    well. until is the time up to which the log is known (a number, a scalar
    subquery or a column of beats and created, such as an operation's end): a
    key's last beat is silent up to it. Without it, the log ends with that beat.
    """
    if created is not None:
        beats = beats.unionByName(created.select(*beats.columns))
    after = F.lead(at).over(W.partitionBy(key).orderBy(at))
    rows = beats.withColumn("silent", (after if until is None else F.coalesce(after, until)) - F.col(at)).where(F.col("silent") > seconds)
    return rows.groupBy(key).agg(F.min(F.struct(at, "silent")).alias("x")).select(key, f"x.{at}", "x.silent")


def resolves_in_rebuild(status: Column) -> Column:
    """Whether an operation comes to an end when an oversized body is run again."""
    return status.isin("SUCCEEDED", "FAILED", "CANCELLED", "TIMED_OUT", "STOPPED")


def child_record(result: Column, limit: int) -> tuple[Column, Column]:
    """(result, replay_children) of a child: a result over the limit is left out and its children are replayed."""
    over = F.octet_length(result) > limit
    return F.when(~over, result), F.coalesce(over, F.lit(False))


def interrupted_attempt(status: Column, at_most_once: Column, attempt: Column, how: schedules.Backoff) -> Column:
    """struct(attempt, error, action, delay) for a step that a crash left started and that may run only once an attempt; else null."""
    decision = schedules.retry_decision(attempt + 1, how)
    return F.when(
        (status == "STARTED") & at_most_once,
        F.struct((attempt + 1).alias("attempt"), F.lit("StepInterruptedError").alias("error"), decision["action"].alias("action"), decision["delay"].alias("delay")),
    )
