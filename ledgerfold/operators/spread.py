"""Running sums and other scans in groups of which one may hold a large part of all rows.

A window over a group sorts it in one task. Here rows are dealt by ranges of
(group, order), so that a large group lies in many partitions; sums by
group and partition, of which there are few, give each partition what stands before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import stored


def running_sums(rows: DataFrame, group: str, order: list[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """rows with, by name, each value's sum over the rows of the group up to this one, and <name>_all over the whole group.

    order must be total within a group. parts: ranges to deal rows to, by
    default the session's number of shuffle partitions.
    """
    count = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = rows.withColumns({f"__{name}": value for name, value in sums.items()})
    dealt = stored(valued.repartitionByRange(count, group, *order).withColumn("__part", F.spark_partition_id()))
    own = dealt.groupBy(group, "__part").agg(*(F.sum(f"__{name}").alias(f"__{name}_own") for name in sums))
    earlier = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = own.select(
        F.col(group).alias("__group"),
        F.col("__part").alias("__at"),
        *(F.coalesce(F.sum(f"__{name}_own").over(earlier), F.lit(0)).alias(f"__{name}_before") for name in sums),
        *(F.sum(f"__{name}_own").over(W.partitionBy(group)).alias(f"{name}_all") for name in sums),
    )
    within = W.partitionBy(group, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = dealt.withColumns({f"__{name}": F.sum(f"__{name}").over(within) for name in sums})
    joined = local.join(before, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__at")))
    return joined.select(*rows.columns, *((F.col(f"__{name}") + F.col(f"__{name}_before")).alias(name) for name in sums), *(f"{name}_all" for name in sums))


#: Scans by name: the aggregate, and how two parts' values become one. Nulls are passed over.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def running(
    rows: DataFrame,
    group: str,
    order: list[str],
    values: dict[str, tuple[str, Column]],
    backwards: bool = False,
    restart: Column | None = None,
    whole: tuple[str, ...] = (),
    parts: int | None = None,
) -> DataFrame:
    """rows with, by name, (kind, value) taken over the rows of the group up to this one, its own included.

    kind is one of KINDS; a value is null as long as all values so far are.
    backwards: over the rows from this one to the group's end. restart: rows at which
    all scans but those named in `whole` begin anew, that row's own value being the
    first. order must be total within a group as far as it matters; parts as in `running_sums`.

    What stands before a range is that of the ranges before it, back to the last one
    that has a restart: of that one, what follows its last restart.
    """
    count = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = {name: f"__run_{name}" for name in values}
    again = F.lit(False) if restart is None else F.coalesce(restart, F.lit(False))
    valued = rows.withColumns({here[n]: value for n, (_, value) in values.items()} | {"__run_again": again})
    dealt = stored(valued.repartitionByRange(count, group, *order).withColumn("__run_part", F.spark_partition_id()))
    in_order = [F.col(c).desc() if backwards else F.col(c) for c in order]
    upto = lambda *by: W.partitionBy(group, "__run_part", *by).orderBy(*in_order).rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = dealt.withColumn("__run_segment", F.lit(0) if restart is None else F.sum(F.col("__run_again").cast("long")).over(upto()))

    total = {n: KINDS[kind][0](here[n]) for n, (kind, _) in values.items()}
    segments = cut.groupBy(group, "__run_part", "__run_segment").agg(*(total[n].alias(here[n]) for n in values))
    own = segments.groupBy(group, "__run_part").agg(
        (F.max("__run_segment") > 0).cast("long").alias("__run_cuts"),
        *((total[n] if n in whole else F.max_by(here[n], "__run_segment")).alias(here[n]) for n in values),
    )
    by_part = W.partitionBy(group).orderBy(F.col("__run_part").desc() if backwards else "__run_part")
    so_far = by_part.rowsBetween(W.unboundedPreceding, W.currentRow)
    stretch = W.partitionBy(group, "__run_stretch").orderBy(F.col("__run_part").desc() if backwards else "__run_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = own.withColumn("__run_stretch", F.sum("__run_cuts").over(so_far))
    own = own.withColumns({here[n]: total[n].over(so_far if n in whole else stretch) for n in values})
    before = own.select(
        F.col(group).alias("__run_group"), F.col("__run_part").alias("__run_at"), *(F.lag(here[n]).over(by_part).alias(f"{here[n]}_before") for n in values)
    )

    local = cut.withColumns({here[n]: total[n].over(upto() if n in whole else upto("__run_segment")) for n in values})
    joined = local.join(before, F.col(group).eqNullSafe(F.col("__run_group")) & (F.col("__run_part") == F.col("__run_at")))
    first = F.col("__run_segment") == 0
    carried = {n: KINDS[kind][1](F.when(F.lit(n in whole) | first, F.col(f"{here[n]}_before")), F.col(here[n])) for n, (kind, _) in values.items()}
    return joined.select(*rows.columns, *(c.alias(n) for n, c in carried.items()))
