"""Scans over groups of which one may be large: against windows and plain Python, and in time that grows with the rows."""

import bisect
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.operators import execution, spread


def _rows(spark, n=1500):
    rng = random.Random(n)
    rows = [(rng.choice([1, 1, 1, 2, None, rng.randrange(60)]), i, rng.choice([None, rng.randrange(-50, 50)]), rng.random() < 0.02) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g long, o long, v long, again boolean")


def _same(got, want):
    assert sorted(map(repr, map(tuple, got.select(want.columns).collect()))) == sorted(map(repr, map(tuple, want.collect())))


@pytest.mark.parametrize("backwards", [False, True])
def test_scans_are_windows(spark, backwards):
    _, df = _rows(spark)
    values = {name: (name, F.col("v")) for name in spread.KINDS}
    order = F.col("o").desc() if backwards else F.col("o")
    w = W.partitionBy("g").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumns({name: agg("v").over(w) for name, (agg, _) in spread.KINDS.items()})
    _same(spread.running(df, "g", ["o"], values, backwards=backwards, parts=13), want)


@pytest.mark.parametrize("backwards", [False, True])
def test_scans_begin_anew(spark, backwards):
    rows, df = _rows(spark)
    got = spread.running(df, "g", ["o"], {"s": ("sum", F.col("v")), "low": ("min", F.col("v")), "n": ("sum", F.lit(1))}, backwards=backwards, restart=F.col("again"), whole=("n",), parts=11)
    want, state = [], defaultdict(lambda: ([], 0))
    for g, o, v, again in sorted(rows, key=lambda r: -r[1] if backwards else r[1]):
        seen, n = state[g]
        seen = ([] if again else seen) + ([v] if v is not None else [])
        state[g] = seen, n + 1
        want.append((g, o, v, again, sum(seen) if seen else None, min(seen) if seen else None, n + 1))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_callbacks_of_odd_rows(spark):
    rng = random.Random(3)
    made = [(rng.choice([1, 1, 2, None]), rng.choice([rng.randrange(300), None])) for _ in range(400)]
    done = [(rng.choice([1, 1, 2, 3, None]), rng.choice([rng.randrange(300), None])) for _ in range(60)]
    for timeout in (0, 20):
        got = execution.callbacks(spark.createDataFrame(made, "k long, at long"), spark.createDataFrame(done, "k long, at long"), "k", timeout)
        want = []
        for k, at in set(made):
            after = min((d - at for o, d in done if None not in (k, at, d) and o == k and d >= at), default=None)
            fine = after is not None and (timeout == 0 or after <= timeout)
            want.append((k, at, "SUCCEEDED" if fine else "TIMED_OUT", after if fine else timeout))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    none = spark.createDataFrame([], "k long, at long")
    assert execution.callbacks(none, none, "k", 5).collect() == []


def test_a_key_with_very_many_callbacks(spark):
    n = 1_000_000
    made = spark.range(n).selectExpr("1 AS k", "id * 7 AS at")
    done = spark.range(n // 10).selectExpr("1 AS k", "id * 70 + 3 AS at")
    began = time.time()
    got = execution.callbacks(made, done, "k", 30)
    rows = got.select("created", "outcome", "after").toPandas().sort_values("created")
    assert len(rows) == n and time.time() - began < 120
    at = [i * 70 + 3 for i in range(n // 10)]
    for created, outcome, after in rows.iloc[:: n // 500].itertuples(index=False):
        k = bisect.bisect_left(at, created)
        wait = at[k] - created if k < len(at) else None
        assert (outcome, after) == (("SUCCEEDED", wait) if wait is not None and wait <= 30 else ("TIMED_OUT", 30))


def test_a_key_with_very_many_checks(spark):
    n = 300_000
    runs = spark.range(n).selectExpr("1 AS k", "id AS o", "id % 10 AS v", "id % 1000 = 999 AS lost")
    began = time.time()
    got = execution.checked(runs, "k", "o", "v", "lost", F.lit(5).cast("long")).toPandas().sort_values("attempt")
    assert time.time() - began < 90
    state, want = 5, []
    for i in range(n):
        if i % 1000 == 999:
            state = 5
        else:
            state += i % 10
            want.append(state)
    assert got["state"].tolist() == want and got["attempt"].tolist() == list(range(1, len(want) + 1))
    for name, fold in (("min", min), ("max", max)):
        few = execution.checked(runs.where("o < 40"), "k", "o", "v", "lost", F.lit(5).cast("long"), name).toPandas().sort_values("attempt")
        assert few["state"].tolist() == [fold([5, *(j % 10 for j in range(i + 1))]) for i in range(40)]


def test_large_batches_end_as_others_do(spark):
    from ledgerfold.operators import batch

    rng = random.Random(11)
    rows = [(1 if rng.random() < 0.4 else rng.choice([None, *range(2, 40)]), rng.randrange(10**9), rng.random() < 0.8) for _ in range(800)]
    raw = spark.createDataFrame(rows, "b long, at long, ok boolean")
    every = spark.range(45).withColumnRenamed("id", "b")
    policy = batch.Policy(min_successful=9, tolerated_percentage=40.0)
    items = {large: batch.numbered(raw, "b", ["at"], large=large) for large in (False, True)}
    shown = lambda df: sorted(repr(tuple(int(v) if isinstance(v, bool) else v for v in r)) for r in df.select(sorted(df.columns)).collect())
    decide = lambda s: F.when(s.failed >= 4, "FAILED").when(s.succeeded * 2 > s.total, "SUCCEEDED")
    facts = {"a": (F.col("idx") == 2) & F.col("ok"), "b_failed": ~F.col("ok")}
    of = {
        large: [
            shown(x)
            for x in (
                batch.completed(items[large], "b", "ok", policy, batches=every, large=large),
                batch.with_end(items[large], "b", "ok", policy, large=large),
                batch.completed_by_counts(items[large], "b", "ok", decide, batches=every, large=large),
                batch.completed_by_rule(items[large], "b", facts, F.col("a") & F.col("b_failed"), batches=every, large=large),
            )
        ]
        for large in (False, True)
    }
    assert of[True] == of[False] and all(of[True])
