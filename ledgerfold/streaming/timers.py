"""Timers, callbacks, heartbeats, retries and polls over a stream of log events.

Each is a state machine by key in event time. Input rows have key, kind and ts
(a timestamp); a watermark must be set on ts. Batch queries of the same
semantics are in operators.execution.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import schedules

OUT = "key string, outcome string, at_ms long"
#: Seconds for which a finished key is known, so that late rows of it are passed over: 90 days.
KEEP = 90 * 86400


def _ms(ts: pd.Series) -> list[int]:
    return (ts.astype("int64") // (1_000_000 if ts.dtype == "datetime64[ns]" else 1_000)).tolist()


def _shown(key: tuple, out: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
    if out:
        yield pd.DataFrame({"key": [str(key[0])] * len(out), "outcome": [o for o, _ in out], "at_ms": [a for _, a in out]})


class Wait(StatefulProcessor):
    """A `start` row begins a wait of so many seconds; when it is over, RESUMED goes out.

    A key waits once: later starts are passed over, for `keep` seconds after its end.
    """

    def __init__(self, seconds: int, keep: int = KEEP) -> None:
        self.seconds, self.keep = seconds, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at long, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        starts = [t for pdf in rows for t, k in zip(_ms(pdf["ts"]), pdf["kind"], strict=True) if k == "start"]
        if starts and not self.due.exists():
            at = min(starts) + 1000 * self.seconds
            self.due.update((at, False))
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, over = self.due.get()
        if over:
            self.due.clear()
            return iter(())
        self.due.update((at, True))
        self.handle.registerTimer(at + 1000 * self.keep)
        return _shown(key, [("RESUMED", at)])


class Callback(StatefulProcessor):
    """A `create` row opens a callback; `complete` or `fail` settles it, `heartbeat` keeps it alive.

    Without an end within timeout seconds it is TIMED_OUT, without a heartbeat
    for heartbeat seconds HEARTBEAT_TIMED_OUT; 0 turns either off. Rows of a key
    are taken in the order of ts within a micro-batch.
    """

    def __init__(self, timeout: int, heartbeat: int = 0) -> None:
        self.timeout, self.beat = timeout, heartbeat

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "created long, beat long")

    def _limit(self, created: int, beat: int) -> tuple[int, str] | None:
        ends = []
        if self.timeout:
            ends.append((created + 1000 * self.timeout, "TIMED_OUT"))
        if self.beat:
            ends.append((beat + 1000 * self.beat, "HEARTBEAT_TIMED_OUT"))
        return min(ends) if ends else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((t, k) for pdf in rows for t, k in zip(_ms(pdf["ts"]), pdf["kind"], strict=True))
        now = self.state.get() if self.state.exists() else None
        out = []
        for at, kind in events:
            limit = self._limit(*now) if now else None
            if limit and at > limit[0]:
                out.append((limit[1], limit[0]))
                now = None
            if kind == "create" and now is None:
                now = (at, at)
            elif now and kind in ("complete", "fail"):
                out.append(("SUCCEEDED" if kind == "complete" else "FAILED", at))
                now = None
            elif now and kind == "heartbeat":
                now = (now[0], at)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if now:
            self.state.update(now)
            limit = self._limit(*now)
            if limit:
                self.handle.registerTimer(limit[0])
        else:
            self.state.clear()
        return _shown(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return iter(())
        at, outcome = self._limit(*self.state.get())
        self.state.clear()
        return _shown(key, [(outcome, at)])


class Poll(StatefulProcessor):
    """A `check` row is one poll, which counts up the condition's state; `done` ends it, after so many checks it is MaxChecksExceeded.

    With `goal`, a state of that many checks in a row is enough. A `lost` row is
    a check whose outcome wasn't recorded: it keeps its number and the state
    starts again from 0. A finished key is forgotten after `keep` seconds.
    """

    def __init__(self, most: int, goal: int = 0, keep: int = KEEP) -> None:
        self.most, self.goal, self.keep = most, goal, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.checks = handle.getValueState("checks", "n int, state int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((t, k) for pdf in rows for t, k in zip(_ms(pdf["ts"]), pdf["kind"], strict=True))
        n, state = self.checks.get() if self.checks.exists() else (0, 0)
        out = []
        for at, kind in events:
            if n < 0 or kind not in ("check", "done", "lost"):
                continue
            if kind == "lost":
                state = 0
                continue
            n, state = n + 1, state + 1
            if kind == "done" or self.goal and state >= self.goal:
                out.append(("COMPLETE", at))
                n = -1
            elif n >= self.most:
                out.append(("MaxChecksExceeded", at))
                n = -1
        self.checks.update((n, state))
        if n < 0 and out:
            self.handle.registerTimer(out[-1][1] + 1000 * self.keep)
        return _shown(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.checks.clear()
        return iter(())


class Checks(StatefulProcessor):
    """A poll with the caller's state and check. Rows have key, kind, ts, number and seen, the last two being strings or numbers.

    A `check` row makes check(state, seen) the state and counts up; decide(state,
    n) then gives COMPLETE or EXHAUSTED to end the poll, else it goes on. A `lost` row puts
    the state back to the initial one. Rows are taken by ts, then number. Out go
    key, outcome, at_ms, checks and the state. A finished key is forgotten after `keep` seconds.

    An initial state, grouped by key, has n and state: polls that began elsewhere go on from there.
    """

    def __init__(self, initial: object, check: Callable[[object, object], object], decide: Callable[[object, int], str | None], state_type: str, keep: int = KEEP) -> None:
        self.initial, self.check, self.decide, self.state_type, self.keep = initial, check, decide, state_type, keep

    @property
    def out(self) -> str:
        return f"{OUT}, checks int, state {self.state_type}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"n int, done boolean, state {self.state_type}")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for n, state in zip(initialState["n"].tolist(), initialState["state"].tolist(), strict=True):
            self.held.update((int(n), False, state))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [(t, number, k, seen) for pdf in rows for t, number, k, seen in zip(_ms(pdf["ts"]), pdf["number"].tolist(), pdf["kind"].tolist(), pdf["seen"].tolist(), strict=True)]
        n, done, state = self.held.get() if self.held.exists() else (0, False, self.initial)
        out = []
        for at, _, kind, seen in sorted(parts, key=lambda p: p[:2]):
            if done or kind not in ("check", "lost"):
                continue
            if kind == "lost":
                state = self.initial
                continue
            n, state = n + 1, self.check(state, seen)
            said = self.decide(state, n)
            if said in ("COMPLETE", "EXHAUSTED"):
                done = True
                out.append((str(key[0]), "COMPLETE" if said == "COMPLETE" else "MaxChecksExceeded", at, n, state))
                self.handle.registerTimer(at + 1000 * self.keep)
        self.held.update((n, done, state))
        if out:
            yield pd.DataFrame(dict(zip(("key", "outcome", "at_ms", "checks", "state"), map(list, zip(*out, strict=True)), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())


class Retry(StatefulProcessor):
    """A `fail` row makes a step wait for its next attempt: READY after its delay, FAILED after so many attempts; `done` ends it.

    delays: seconds after each failed attempt but the last that is allowed. Rows that come
    while no attempt runs are ignored. A finished key is forgotten after `keep` seconds.
    """

    def __init__(self, delays: list[int], keep: int = KEEP) -> None:
        self.delays, self.keep = delays, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "failed int, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((t, k) for pdf in rows for t, k in zip(_ms(pdf["ts"]), pdf["kind"], strict=True))
        failed, due = self.state.get() if self.state.exists() else (0, -1)
        out = []
        for at, kind in events:
            if failed < 0 or due > at:
                continue
            if due >= 0:
                out.append(("READY", due))
                due = -1
            if kind == "done":
                out.append(("SUCCEEDED", at))
                failed = -1
            elif kind == "fail" and failed >= len(self.delays):
                out.append(("FAILED", at))
                failed = -1
            elif kind == "fail":
                due = at + 1000 * self.delays[failed]
                failed += 1
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if failed < 0:
            ended = out[-1][1] if out and out[-1][0] != "READY" else due
            self.handle.registerTimer(ended + 1000 * self.keep)
            due = ended  # from here on, when it ended
        elif due >= 0:
            self.handle.registerTimer(due)
        self.state.update((failed, due))
        return _shown(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failed, due = self.state.get()
        if failed < 0:
            self.state.clear()
            return iter(())
        self.state.update((failed, -1))
        return _shown(key, [("READY", due)] if due >= 0 else [])


class Refresh(StatefulProcessor):
    """A `wait` row begins a wait that is looked up again and again: LOOKED_UP at first seconds, then after growing delays.

    A `done` row ends it. It gives up after `horizon` seconds. `shared` brings
    look-ups of one moment together, whatever keys they are for.
    """

    def __init__(self, first: int, horizon: int) -> None:
        self.first, self.horizon = first, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "began long, n int, next long")

    def _upto(self, now: tuple, end: int) -> tuple[tuple | None, list[tuple[str, int]]]:
        """What is left of a wait at the moment `end`, and the look-ups before it."""
        began, n, at = now
        out = []
        while at < end and at <= began + 1000 * self.horizon:
            out.append(("LOOKED_UP", at))
            n += 1
            at += 1000 * (schedules.EXTENDED if n > schedules.BEFORE_EXTENDED else min(n, schedules.CEILING))
        return (began, n, at) if at <= began + 1000 * self.horizon else None, out

    def _keep(self, now: tuple | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if now:
            self.state.update(now)
            self.handle.registerTimer(now[2])
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((t, k) for pdf in rows for t, k in zip(_ms(pdf["ts"]), pdf["kind"], strict=True))
        now, out = self.state.get() if self.state.exists() else None, []
        for at, kind in events:
            if now:
                now, more = self._upto(now, at)
                out += more
            if kind == "done":
                now = None
            elif kind == "wait" and now is None:
                now = (at, 0, at + 1000 * self.first)
        self._keep(now)
        return _shown(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return iter(())
        now, out = self._upto(self.state.get(), timerValues.getCurrentWatermarkInMs() + 1)
        self._keep(now)
        return _shown(key, out)


def outcomes(stream: DataFrame, processor: StatefulProcessor) -> DataFrame:
    """(key, outcome, at_ms) of the processor over a stream with key, kind and ts."""
    return stream.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def checked(stream: DataFrame, processor: Checks, started: DataFrame | None = None) -> DataFrame:
    """(key, outcome, at_ms, checks, state) of the caller's checks over a stream. started: (key, n, state) of polls that began elsewhere."""
    return stream.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=processor.out,
        outputMode="Append",
        timeMode="EventTime",
        initialState=None if started is None else started.groupBy("key"),
    )


def shared(stream: DataFrame, processor: Refresh, requests: int = 1) -> DataFrame:
    """(at_ms, request, keys): the look-ups of one moment as one request, or as so many, each with the keys that it is for in order.

    Look-ups go on with their own event time to a second stateful operator that
    groups them over keys; a moment goes out when the watermark has passed it.
    """
    timed = _Timed(processor)
    out = stream.groupBy("key").transformWithStateInPandas(
        statefulProcessor=timed, outputStructType="key string, at timestamp", outputMode="Append", timeMode="EventTime", eventTimeColumnName="at"
    )
    request = F.pmod(F.xxhash64("key"), F.lit(requests)).cast("int")
    grouped = out.groupBy("at", request.alias("request")).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return grouped.select(F.unix_millis("at").alias("at_ms"), "request", "keys")


class _Timed(StatefulProcessor):
    """A processor's look-ups as (key, at) with at as a timestamp."""

    def __init__(self, inner: Refresh) -> None:
        self.inner = inner

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def _timed(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "at": pd.to_datetime(f["at_ms"], unit="ms")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self._timed(self.inner.handleInputRows(key, rows, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._timed(self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo))
