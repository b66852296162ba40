"""Hooks of a run against a plain replay of its updates."""

import random
from collections import defaultdict

from ledgerfold.operators import lifecycle


def _fired(updates):
    """(execution, number, invocation, hook, op, attempt, is_replay, outcome) by walking through each execution's updates."""
    out = []
    by = defaultdict(list)
    for u in updates:
        by[u[0]].append(u)
    for execution, own in by.items():
        done, attempts, met, touched = set(), defaultdict(int), set(), {}
        live, over = [], set()
        for u in sorted(own, key=lambda u: u[3]):
            if u[1] not in over:
                live.append(u)
                if u[4] in ("SUCCEED", "FAIL"):
                    over.add(u[1])
        hooks = []
        for i, (_, op, run, _, action) in enumerate(live):
            first, last = i == 0 or live[i - 1][2] != run, i + 1 == len(live) or live[i + 1][2] != run
            replay = run > live[0][2]
            if first:
                hooks.append((run, "on_invocation_start", None, None, replay, None))
                done, touched = set(), {}
            if op not in touched:
                hooks.append((run, "on_operation_start", op, None, op in met, None))
            if op < 3 and touched.get(op) in (None, "RETRY"):
                attempts[op] += 1
                hooks.append((run, "on_attempt_start", op, attempts[op], False, None))
            outcome = {"SUCCEED": "SUCCEEDED", "FAIL": "FAILED"}.get(action)
            if op < 3 and action != "START":
                hooks.append((run, "on_attempt_end", op, attempts[op], False, outcome or "RETRY"))
            if outcome:
                hooks.append((run, "on_operation_end", op, None, False, outcome))
            if last:
                hooks.append((run, "on_invocation_end", None, None, replay, None))
            touched[op] = action
            met.add(op)
        out += [(execution, n, *h) for n, h in enumerate(hooks, 1)]
    return sorted(map(repr, out))


def test_hooks_of_runs(spark):
    rng = random.Random(4)
    updates, run = [], 0
    for execution in range(12):
        run = 0
        for order in range(rng.randrange(1, 50)):
            run += rng.random() < 0.2
            updates.append((execution, rng.randrange(5), run, order, rng.choice(["START", "START", "RETRY", "RETRY", "SUCCEED", "FAIL"])))
    df = spark.createDataFrame([(*u, 0) for u in updates], "e long, op long, run int, o int, action string, number int")
    got = lifecycle.hook_timeline(df, "e", "op", "run", "o", "action", df.op < 3)
    rows = [(r.e, r.number, r.invocation, r.hook, r.op, r.attempt, r.is_replay, r.outcome) for r in got.collect()]
    assert sorted(map(repr, rows)) == _fired(updates)
    assert lifecycle.misplaced(got, "e", "op").collect() == []
    broken = got.where("not (e = 3 and op < 3 and hook = 'on_operation_start')")
    assert lifecycle.misplaced(broken, "e", "op").count() >= 1
    assert lifecycle.hook_timeline(df.limit(0), "e", "op", "run", "o", "action", df.op < 3).collect() == []
