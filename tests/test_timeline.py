"""Rules over items at every moment, early ends and stops below losers, against plain simulation."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import batch, log, timeline

SHAPE = "b long, idx int, ok boolean, started long, settled long, err string"


def _items(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for b in range(n):
        for idx in range(rng.randrange(0, 9)):
            started = rng.choice([None, *range(6)])
            settled = None if started is None or rng.random() < 0.2 else started + rng.choice([0, 0, 1, 2, 5])
            rows.append((b, idx, rng.random() < 0.7, started, settled, f"e{idx}"))
    return rows


def _simulated(rows, batches, decide, at_starts):
    """By batch (reason, n_running, n_ok, n_failed, error, moment, statuses): every item's status held and looked at, at every moment."""
    of = defaultdict(list)
    for r in rows:
        of[r[0]].append(r)
    out = {}
    for b in batches:
        items = {r[1]: r for r in of[b]}
        moments = [(r[3], 1, r[1]) for r in items.values() if r[3] is not None]
        moments += [(r[4], 2 if r[4] == r[3] else 0, r[1]) for r in items.values() if r[4] is not None]
        status = dict.fromkeys(items)
        reason, moment = (decide(status, len(items), True), None) if not items else (None, None)
        if not items:
            reason = reason or "ALL_COMPLETED"
        for at, what, idx in sorted(moments):
            if what != 1:
                status[idx] = "SUCCEEDED" if items[idx][2] else "FAILED"
            if what != 1 or at_starts:
                reason = decide(status, len(items), what != 1)
            if reason is None and what != 1 and all(s in ("SUCCEEDED", "FAILED") for s in status.values()):
                reason = "ALL_COMPLETED"
            if reason:
                moment = (at, what, idx)
                break
            if what == 1:
                status[idx] = "STARTED"
        failed = [i for i, s in status.items() if s == "FAILED"]
        error = None
        if reason in ("CUSTOM_COMPLETION_FAILED", "FAILURE_TOLERANCE_EXCEEDED"):
            error = items[min(failed)][5] if failed else "BatchCompletionFailed"
        count = lambda s, status=status: sum(x == s for x in status.values())
        out[b] = (reason, count("STARTED"), count("SUCCEEDED"), count("FAILED"), error, moment, {i: s for i, s in status.items() if s})
    return out


def _check(spark, rows, batches, ended, want):
    got = {r.b: r for r in ended.collect()}
    assert set(got) == set(want)
    for b, (reason, running, ok, failed, error, moment, _) in want.items():
        r = got[b]
        assert r.reason == reason and r.total == sum(x[0] == b for x in rows), (b, r)
        if reason is None:
            assert r.status == "STARTED"
            continue
        assert (r.n_running, r.n_ok, r.n_failed, r.error, tuple(r.end) if r.end else None) == (running, ok, failed, error, moment), (b, r, want[b])
        assert r.status == ("FAILED" if failed or error else "SUCCEEDED")


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_see_every_item_at_every_moment(spark, seed):
    rows, batches = _items(seed), range(62)
    df, every = spark.createDataFrame(rows, SHAPE), spark.range(62).withColumnRenamed("id", "b")

    def decide(status, total, _):
        if total >= 8 or status.get(0) == "FAILED" or sum(s == "FAILED" for s in status.values()) >= 3:
            return "CUSTOM_COMPLETION_FAILED"
        if status.get(1) == "SUCCEEDED" and sum(s is not None for s in status.values()) >= 3:
            return "CUSTOM_COMPLETION_SUCCEEDED"
        return None

    def rule(items, of):
        fails = (items.total >= 8) | (of["zero"].failed > 0) | (items.failed >= 3)
        return F.when(fails, "FAILED").when((of["one"].succeeded > 0) & (items.total - items.waiting >= 3), "SUCCEEDED")

    subsets = {"zero": F.col("idx") == 0, "one": F.col("idx") == 1}
    ended = timeline.ended_by_rule(df, "b", "ok", "started", "settled", rule, subsets, "err", every)
    want = _simulated(rows, batches, decide, True)
    assert {w[0] for w in want.values()} >= {None, "ALL_COMPLETED", "CUSTOM_COMPLETION_FAILED", "CUSTOM_COMPLETION_SUCCEEDED"}
    _check(spark, rows, batches, ended, want)
    shown = defaultdict(dict)
    for r in timeline.reported(df, ended, "b", "ok", "started", "settled").collect():
        shown[r.b][r.idx] = r.item_status
    assert dict(shown) == {b: w[6] for b, w in want.items() if w[6]}


def test_policies_are_asked_after_settles_only(spark):
    rows, policy = _items(5), batch.Policy(min_successful=2, tolerated_failures=1)

    def decide(status, total, _):
        ok, failed = (sum(s == x for s in status.values()) for x in ("SUCCEEDED", "FAILED"))
        return "FAILURE_TOLERANCE_EXCEEDED" if failed > 1 else "ALL_COMPLETED" if ok + failed >= total else "MIN_SUCCESSFUL_REACHED" if ok >= 2 else None

    df, every = spark.createDataFrame(rows, SHAPE), spark.range(62).withColumnRenamed("id", "b")
    ended = timeline.ended_by_policy(df, "b", "ok", "started", "settled", policy, "err", every)
    want = _simulated(rows, range(62), decide, False)
    _check(spark, rows, range(62), ended, want)


@pytest.mark.parametrize("policy", [batch.Policy(min_successful=2, tolerated_failures=1), batch.Policy(), batch.Policy(tolerated_percentage=25.0), batch.Policy(min_successful=0)])
def test_windows_report_what_the_sweep_reports(spark, policy):
    rows = _items(7) + [(None, i, ok, 0, s, "e") for i, (ok, s) in enumerate([(True, 1), (False, 1), (False, 2), (True, None)])]
    rows += [(90, 0, None, 1, 1, "e"), (90, 1, None, None, 1, "e"), (90, 2, True, 3, 1, "e"), (90, 3, True, 1, 2, "e"), (91, 0, False, 5, 5, "e"), (91, 1, True, 5, 5, "e"), (91, 2, True, 4, None, "e")]
    df = spark.createDataFrame(rows, SHAPE)
    ended = timeline.ended_by_policy(df, "b", "ok", "started", "settled", policy)
    want = sorted(map(repr, map(tuple, timeline.reported(df, ended, "b", "ok", "started", "settled").collect())))
    for large in (False, True):
        assert sorted(map(repr, map(tuple, timeline.reported_by_policy(df, "b", "ok", "started", "settled", policy, large).collect()))) == want


def test_early_ends_take_one_shuffle(spark):
    from ledgerfold.plans import catalog

    plan = catalog.QUERIES["batch_early_end"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange") == 1


def test_a_rule_may_end_a_batch_before_its_first_start(spark):
    df = spark.createDataFrame([(1, 0, True, 5, 6, None), (1, 1, True, 5, 7, None)], SHAPE)
    (r,) = timeline.ended_by_rule(df, "b", "ok", "started", "settled", lambda items, _: F.when(items.total > 1, "FAILED")).collect()
    assert (r.reason, r.status, r.error, r.n_running, r.n_ok, tuple(r.end)) == ("CUSTOM_COMPLETION_FAILED", "FAILED", "BatchCompletionFailed", 0, 0, (5, timeline.STARTS, 0))


def test_stops_reach_all_that_stands_below(spark):
    rng = random.Random(6)
    tree = [(0, None, None)] + [(i, rng.choice([i - 1, rng.randrange(i)]), rng.choice([None] * 9 + [rng.randrange(1000)])) for i in range(1, 400)] + [(1000, 999, 5), (1001, 1000, None)]
    parent, own = {i: p for i, p, _ in tree}, {i: e for i, _, e in tree}
    want = {}
    for i in parent:
        ends, at = [], i
        while at is not None and at in parent:
            ends.append(own[at])
            at = parent[at]
        want[i] = min((e for e in ends if e is not None), default=None)
    df = spark.createDataFrame(tree, "id long, parent_id long, e long")
    stops = log.stops(df, "id", "parent_id", "e")
    assert {r.id: r.stopped_at for r in stops.collect()} == want
    writes = [(i, rng.randrange(1000)) for i in parent for _ in range(3)]
    kept = log.before_stops(spark.createDataFrame(writes, "id long, at long"), stops, "id", "at")
    assert sorted(map(tuple, kept.collect())) == sorted((i, t) for i, t in writes if want[i] is None or t <= want[i])


def test_a_response_that_holds_a_key_twice(spark):
    held = spark.createDataFrame([("a", "STARTED", 0), ("b", "STARTED", 0)], "id string, status string, seq long")
    said = spark.createDataFrame([("a", "READY", 1), ("a", "SUCCEEDED", 2), ("c", "FAILED", 4), ("c", "STARTED", 3)], "id string, status string, seq long")
    assert sorted(map(tuple, log.merged(held, said, ["id"], ["seq"]).collect())) == [("a", "SUCCEEDED", 2), ("b", "STARTED", 0), ("c", "FAILED", 4)]
    assert sorted(map(tuple, log.changed(held, said, ["id"], ["seq"]).collect())) == [("a", "SUCCEEDED"), ("c", "FAILED")]
