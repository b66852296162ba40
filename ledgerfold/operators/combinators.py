"""Combinators over inputs that settle in some order.

inputs: rows with a group, idx (input order), settle (total settle order), ok,
and value. Everything is one aggregation by group with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _in_order(when: Column, value: str) -> Column:
    return F.array_sort(F.collect_list(F.when(when, F.struct("idx", "ok", F.col(value).alias("value")))))


def try_join_all(inputs: DataFrame, group: str, value: str) -> DataFrame:
    """(group, ok, failed_index, values): all values in input order, or the index of the first failure to settle."""
    failed = F.min(F.when(~F.col("ok"), F.struct("settle", "idx")))
    return inputs.groupBy(group).agg(failed["idx"].alias("failed_index"), _in_order(F.lit(True), value).alias("all")).select(
        group,
        F.col("failed_index").isNull().alias("ok"),
        "failed_index",
        F.when(F.col("failed_index").isNull(), F.transform("all", lambda x: x["value"])).alias("values"),
    )


def join_all(inputs: DataFrame, group: str, value: str) -> DataFrame:
    """(group, outcomes): every input's (idx, ok, value) in input order."""
    return inputs.groupBy(group).agg(_in_order(F.lit(True), value).alias("outcomes"))


def select_ok(inputs: DataFrame, group: str, value: str) -> DataFrame:
    """(group, winner, value, losers): the first success to settle; without one, all failures by input index."""
    won = F.min(F.when(F.col("ok"), F.struct("settle", "idx", F.col(value).alias("value"))))
    return inputs.groupBy(group).agg(won.alias("won"), _in_order(~F.col("ok"), value).alias("bad")).select(
        group,
        F.col("won.idx").alias("winner"),
        F.col("won.value").alias("value"),
        F.when(F.col("won").isNull(), F.transform("bad", lambda x: x["idx"])).alias("losers"),
    )


def race(inputs: DataFrame, group: str, value: str) -> DataFrame:
    """(group, winner, ok, value): the first to settle, whatever its outcome."""
    first = F.min(F.struct("settle", "idx", "ok", F.col(value).alias("value")))
    return inputs.groupBy(group).agg(first.alias("first")).select(
        group, F.col("first.idx").alias("winner"), F.col("first.ok").alias("ok"), F.col("first.value").alias("value")
    )


def stopped(inputs: DataFrame, winners: DataFrame, group: str, eager: str | None = None) -> DataFrame:
    """Inputs that are stopped when the winner settles: those settling later, unless started on their own."""
    won = inputs.join(winners.select(group, F.col("winner").alias("idx")), [group, "idx"]).select(group, F.col("settle").alias("won_at"))
    rows = inputs.join(won, group).where(F.col("settle") > F.col("won_at"))
    return rows if eager is None else rows.where(~F.col(eager))


def empty_input(groups: DataFrame, inputs: DataFrame, group: str) -> DataFrame:
    """Groups without inputs: an error for select_ok and race, an empty list for the joins."""
    return groups.join(inputs.select(group).distinct(), group, "left_anti")


def winner_record(group_size: Column, winner: Column, limit: int) -> Column:
    """What is kept of a winner whose value is too large for the log: its index, so that a replay runs only that input."""
    return F.when(group_size > limit, F.to_json(F.struct(winner.alias("winner"))))
