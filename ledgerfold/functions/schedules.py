"""Retry, polling and refresh schedules as expressions over the attempt number (from 1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Backoff:
    """Attempts allowed and seconds between them. rate: factor of exponential delays; None: linear by increment."""

    max_attempts: int = 3
    initial: float = 5.0
    max_delay: float = 300.0
    rate: float | None = 2.0
    increment: float = 1.0
    jitter: str = "full"


# Named strategies.
PRESETS = {
    "default": Backoff(6, 5.0, 60.0, 2.0, jitter="full"),
    "linear": Backoff(6, 1.0, 300.0, None, 1.0, "none"),
    "no_retry": Backoff(1),
    "exponential_fill": Backoff(3, 5.0, 300.0, 2.0, jitter="full"),
    "linear_fill": Backoff(6, 1.0, 300.0, None, 1.0, "full"),
    "polling": Backoff(60, 5.0, 300.0, 1.5, jitter="full"),
}


def base_delay(attempt: Column, how: Backoff) -> Column:
    """Seconds after an attempt, before jitter and rounding."""
    if how.rate is None:
        raw = F.lit(float(how.initial)) + F.lit(float(how.increment)) * (attempt - 1)
    else:
        raw = F.lit(float(how.initial)) * F.pow(F.lit(float(how.rate)), attempt - 1)
    return F.least(raw, F.lit(float(how.max_delay)))


def jitter_bounds(base: Column, jitter: str) -> tuple[Column, Column]:
    """Least and greatest delay that jitter (none, half or full) can make of base."""
    return {"none": base, "half": base / 2, "full": base * 0}[jitter], base


def jittered(base: Column, jitter: str, seed: int | None = None) -> Column:
    low, high = jitter_bounds(base, jitter)
    return base if jitter == "none" else low + (high - low) * F.rand(seed)


def whole_seconds(delay: Column) -> Column:
    """A computed delay: rounded half away from zero, at least 1; 1 if not finite."""
    odd = F.isnan(delay) | delay.isNull() | (F.abs(delay) == F.lit(float("inf")))
    return F.when(odd, 1).otherwise(F.greatest(F.lit(1), F.least(F.round(delay), F.lit(2147483647)))).cast("int")


def asked_seconds(delay: Column) -> Column:
    """A delay that a caller gave: rounded up, within 1 and the largest 32-bit integer."""
    return F.greatest(F.lit(1), F.least(F.ceil(delay), F.lit(2147483647))).cast("int")


def retry_decision(attempt: Column, how: Backoff, retryable: Column | None = None, pause_every: int = 0) -> Column:
    """struct(action, delay): STOP, PAUSE or RETRY after a failed attempt.

    The cap on attempts is tested first, then whether the error may be retried.
    """
    go = F.lit(True) if retryable is None else F.coalesce(retryable, F.lit(False))
    stop = (attempt >= how.max_attempts) | ~go
    pause = (attempt % pause_every == 0) if pause_every > 0 else F.lit(False)
    action = F.when(stop, "STOP").when(pause, "PAUSE").otherwise("RETRY")
    return F.struct(action.alias("action"), F.when(~stop, whole_seconds(base_delay(attempt, how))).alias("delay"))


def poll_decision(done: Column, attempt: Column, how: Backoff) -> Column:
    """struct(action, delay): COMPLETE if the condition holds, else EXHAUSTED at the cap, else CONTINUE."""
    action = F.when(done, "COMPLETE").when(attempt >= how.max_attempts, "EXHAUSTED").otherwise("CONTINUE")
    return F.struct(action.alias("action"), F.when(action == "CONTINUE", whole_seconds(base_delay(attempt, how))).alias("delay"))


# Refreshes of a waiting operation.
FIRST_REFRESH, CEILING, EXTENDED, BEFORE_EXTENDED, RESERVE = 1, 10, 60, 95, 1


def refresh_delay(unchanged: Column) -> Column:
    """Seconds to the next refresh after so many that changed nothing (from 1)."""
    return F.when(unchanged > BEFORE_EXTENDED, EXTENDED).otherwise(F.least(unchanged, F.lit(CEILING))).cast("int")


def refresh_offset(unchanged: Column) -> Column:
    """Seconds from the first refresh to the one after so many that changed nothing (from 0): the sum of their delays."""
    slow = F.least(unchanged, F.lit(BEFORE_EXTENDED)).cast("long")
    ramp = F.least(slow, F.lit(CEILING))
    return F.floor(ramp * (ramp + 1) / 2) + (slow - ramp) * CEILING + (unchanged - slow) * EXTENDED


def unchanged_within(seconds: Column) -> Column:
    """At least as many refreshes after the first as fit within so many seconds by refresh_offset."""
    extended = CEILING * (CEILING + 1) // 2 + (BEFORE_EXTENDED - CEILING) * CEILING
    return F.lit(BEFORE_EXTENDED) + F.greatest(F.lit(0), F.floor((seconds - extended) / EXTENDED))
