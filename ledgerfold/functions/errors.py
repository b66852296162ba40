"""Kinds of failures and how they are written in a log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error kinds, the type each writes where nothing more specific is known, and its reasons.
KINDS = {
    "Step": ("StepError", ("ExecutionFailed", "SerializationFailed", "Interrupted")),
    "Wait": ("WaitError", ("UnexpectedStatus",)),
    "Invoke": ("InvokeError", ("FunctionFailed", "SerializationFailed")),
    "Callback": ("CallbackError", ("TimedOut", "HeartbeatTimedOut", "ExternalFailure", "DeserializationFailed", "Internal", "SubmitterFailed")),
    "WaitForCondition": ("WaitForConditionError", ("CheckFailed", "MaxChecksExceeded", "SerializationFailed")),
    "ChildContext": ("ChildContextError", ("ChildFailed", "Internal", "BatchCompletionFailed", "NotCompleted")),
    "Combinator": ("PromiseCombinatorError", ("JoinFailed", "AllFailed", "FirstSettledFailed", "EmptyInput", "Internal")),
    "NonDeterministicExecution": ("NonDeterministicExecutionError", ("OperationMismatch", "UnrecognizedStatus")),
}


def scope(retryable: Column) -> Column:
    """How far an error of the log's service reaches: the invocation, which runs again, or the whole execution."""
    return F.when(retryable, "INVOCATION").otherwise("EXECUTION")


def wire_type(kind: Column, given: Column | None = None) -> Column:
    """The type an error is written under: its own, else its kind's, else Error."""
    out = F.lit("Error")
    for name, (wire, _) in KINDS.items():
        out = F.when(kind == name, wire).otherwise(out)
    return out if given is None else F.coalesce(given, out)


def reasons(kind: Column) -> Column:
    """The reasons that an error of this kind may have."""
    out = F.lit(None).cast("array<string>")
    for name, (_, own) in KINDS.items():
        out = F.when(kind == name, F.array(*map(F.lit, own))).otherwise(out)
    return out


def kind_of(wire: Column) -> Column:
    """The kind that a written type stands for; null for any other type."""
    out = F.lit(None).cast("string")
    for name, (own, _) in KINDS.items():
        out = F.when(wire == own, name).otherwise(out)
    return F.when(wire.startswith("CombinatorError."), "Combinator").otherwise(out)


def combinator_type(reason: Column, index: Column | None = None) -> Column:
    """CombinatorError.<reason>, for JoinFailed with the failed input's index."""
    plain = F.concat(F.lit("CombinatorError."), reason)
    return plain if index is None else F.when(reason == "JoinFailed", F.concat(plain, F.lit("."), index.cast("string"))).otherwise(plain)


def combinator_reason(wire: Column) -> Column:
    """struct(reason, index) read back from combinator_type."""
    return F.struct(
        F.regexp_extract(wire, r"^CombinatorError\.([A-Za-z]+)", 1).alias("reason"),
        F.nullif(F.regexp_extract(wire, r"\.JoinFailed\.([0-9]+)$", 1), F.lit("")).cast("int").alias("index"),
    )


def callback_failure(status: Column, wire: Column) -> Column:
    """Reason for a callback that did not succeed."""
    return (
        F.when((status == "TIMED_OUT") & (wire == "Callback.Heartbeat"), "HeartbeatTimedOut")
        .when(status == "TIMED_OUT", "TimedOut")
        .when(status.isin("FAILED", "CANCELLED", "STOPPED"), "ExternalFailure")
    )
