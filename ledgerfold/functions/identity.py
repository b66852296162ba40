"""Identity of operations: positional and hashed ids, types, names and statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses of an operation record.
SETTLED = ("SUCCEEDED", "FAILED", "CANCELLED", "TIMED_OUT", "STOPPED")
OPEN = ("STARTED", "PENDING", "READY")


def wire_id(positional: Column) -> Column:
    """The id that a positional id has in the log: its SHA-256 in hexadecimal."""
    return F.sha2(positional.cast("binary"), 256)


def child_id(parent: Column, number: Column) -> Column:
    """Positional id of the number-th operation (from 1) below parent; a null parent is the root."""
    return F.concat_ws("-", parent, number.cast("string"))


def is_terminal(status: Column) -> Column:
    """Whether an operation is over. Unknown statuses are, as nothing can be done with them."""
    return ~status.isin(*OPEN)


def is_known(status: Column) -> Column:
    return status.isin(*SETTLED, *OPEN)


def canonical_type(name: Column) -> Column:
    """ChainedInvoke and CHAINED_INVOKE are the same type."""
    return F.upper(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def same_identity(type_a: Column, sub_a: Column, name_a: Column, type_b: Column, sub_b: Column, name_b: Column) -> Column:
    """Whether a record (a) is of the operation that is claimed (b).

    Types compare in canonical form, sub-types without regard to case, names as
    they are with empty as null; both or neither must be given. A record without
    a type matches anything.
    """
    none = lambda c: F.nullif(c, F.lit(""))
    return type_a.isNull() | (
        canonical_type(type_a).eqNullSafe(canonical_type(type_b))
        & F.lower(sub_a).eqNullSafe(F.lower(sub_b))
        & none(name_a).eqNullSafe(none(name_b))
    )
