"""Expressions and operators against literal cases."""

import json

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.functions import codecs, errors, identity, schedules
from ledgerfold.operators import batch, combinators, execution, lifecycle, log, packing, spread
from ledgerfold.options import Options
from ledgerfold.sources import paged


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def items(spark, *batches):
    """batches: strings of s (success) and f (failure), settled in order."""
    return spark.createDataFrame([(b, i, c == "s") for b, marks in enumerate(batches) for i, c in enumerate(marks)], "b long, idx int, ok boolean")


@pytest.mark.parametrize(
    "policy, marks, want",
    [
        ({}, "ss", ("ALL_COMPLETED", 2)),
        ({}, "sfs", ("FAILURE_TOLERANCE_EXCEEDED", 2)),
        ({"tolerated_failures": 1}, "sfs", ("ALL_COMPLETED", 3)),
        ({"tolerated_failures": 3}, "fff", ("ALL_COMPLETED", 3)),
        ({"tolerated_percentage": 25.0}, "ffss", ("FAILURE_TOLERANCE_EXCEEDED", 2)),
        ({"tolerated_percentage": 25.0}, "sssf", ("ALL_COMPLETED", 4)),
        ({"tolerated_percentage": 100.0}, "fff", ("ALL_COMPLETED", 3)),
        ({"min_successful": 2}, "ssss", ("MIN_SUCCESSFUL_REACHED", 2)),
        ({"min_successful": 2}, "ss", ("ALL_COMPLETED", 2)),
        ({"min_successful": 3}, "sfs", ("ALL_COMPLETED", 3)),
        ({"min_successful": 0}, "fs", ("MIN_SUCCESSFUL_REACHED", 1)),
        ({"min_successful": 1, "tolerated_failures": 0}, "fs", ("FAILURE_TOLERANCE_EXCEEDED", 1)),
    ],
)
def test_completion(spark, policy, marks, want):
    r = batch.completed(items(spark, marks), "b", "ok", batch.Policy(**policy)).first()
    assert (r.reason, r.settled) == want


@pytest.mark.parametrize("p", [-0.1, 100.1, float("nan"), float("inf")])
def test_percentages_are_checked(p):
    with pytest.raises(ValueError):
        batch.Policy(tolerated_percentage=p)


def test_percentage_boundary_is_strict(spark):
    p = batch.Policy(tolerated_percentage=14.0)
    assert one(spark, p.exceeded(F.lit(7), F.lit(50))) is False
    assert one(spark, p.exceeded(F.lit(8), F.lit(50))) is True


def test_resume_does_not_depend_on_order(spark):
    for marks in ("ssff", "ffss", "sfsf"):
        r = batch.resumed(items(spark, marks), "b", "ok", batch.Policy(min_successful=1, tolerated_failures=1)).first()
        assert r.reason == "FAILURE_TOLERANCE_EXCEEDED"


def test_statuses_after_an_early_end(spark):
    rows = items(spark, "ssss")
    ended = batch.with_end(rows, "b", "ok", batch.Policy(min_successful=2))
    both = batch.views(batch.item_status(ended, "ok", True), "b", "idx", "reason").first()
    assert (both.item_statuses, both.started_count, both.results, both.reason) == ("SS--", 2, [0, 1], "MIN_SUCCESSFUL_REACHED")
    assert batch.item_status(ended, "ok", False).count() == 2


def test_batches_without_items(spark):
    rows, every = items(spark, "sf", "ss"), spark.createDataFrame([(0,), (1,), (7,), (7,)], "b long")
    of = lambda df: {r.b: (r.reason, r.n_ok, r.n_failed, r.total) for r in df.collect()}
    empty = ("ALL_COMPLETED", 0, 0, 0)
    assert of(batch.completed(rows, "b", "ok", batch.Policy(min_successful=2), batches=every)) == {0: ("ALL_COMPLETED", 1, 1, 2), 1: ("ALL_COMPLETED", 2, 0, 2), 7: empty}
    assert of(batch.resumed(rows, "b", "ok", batch.Policy(), batches=every))[7] == empty
    assert set(of(batch.completed(rows, "b", "ok", batch.Policy()))) == {0, 1}


def test_rules_over_counts(spark):
    """Two have succeeded and none has failed; asked before the first start, after each settle, once without items."""
    rows, every = items(spark, "ssf", "sfs", "fss", "s"), spark.createDataFrame([(i,) for i in range(5)], "b long")
    decide = lambda s: F.when((s.succeeded >= 2) & (s.failed == 0), "SUCCEEDED").when(s.failed > 0, "FAILED")
    got = {r.b: (r.reason, r.settled) for r in batch.completed_by_counts(rows, "b", "ok", decide, batches=every).collect()}
    good, bad = "CUSTOM_COMPLETION_SUCCEEDED", "CUSTOM_COMPLETION_FAILED"
    assert got == {0: (good, 2), 1: (bad, 2), 2: (bad, 1), 3: ("ALL_COMPLETED", 1), 4: ("ALL_COMPLETED", 0)}
    at_once = batch.completed_by_counts(rows, "b", "ok", lambda s: F.when(s.settled * 2 >= s.total - 1, "FAILED"), batches=every)
    assert {r.b: (r.reason, r.settled) for r in at_once.collect()} == {0: (bad, 1), 1: (bad, 1), 2: (bad, 1), 3: (bad, 0), 4: (bad, 0)}


def test_recorded_times_show_the_slots_in_use(spark):
    rows = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 0, 1), (1, 2, 1, 2), (1, 3, 2, 11), (2, 0, 3, 3)], "b long, idx int, s long, e long")
    assert {r.b: r.most for r in batch.at_once(rows, "b", "s", "e").collect()} == {1: 2, 2: 0}
    alone = batch.one_slot(spark.createDataFrame([(1, 0, 5), (1, 1, 2)], "b long, idx int, t long"), "b", "t").orderBy("idx").collect()
    assert [(r.started, r.settled) for r in alone] == [(0, 5), (5, 7)]


def test_flat_items_keep_no_record(spark):
    of = lambda flat: {tuple(r) for r in batch.item_records(items(spark, "s"), "b", 2, flat).collect()}
    assert of(False) == {("0-1", "0"), ("0-1-1", "0-1"), ("0-1-2", "0-1")} and of(True) == {("0-1-1", "0"), ("0-1-2", "0")}


def test_a_large_group_is_dealt_to_many_tasks(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 7 > 0, 2).alias("g"), F.col("id"), (F.col("id") % 5).alias("v"))
    got = spread.running_sums(rows, "g", ["id"], {"s": F.col("v"), "n": F.lit(1)}, parts=9)
    w = W.partitionBy("g").orderBy("id")
    want = rows.withColumns({"s": F.sum("v").over(w), "n": F.row_number().over(w), "s_all": F.sum("v").over(W.partitionBy("g")), "n_all": F.count(F.lit(1)).over(W.partitionBy("g"))})
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.select(got.columns).collect())))
    some = items(spark, "sfss", "f", "ss")
    policy = batch.Policy(min_successful=2, tolerated_failures=1)
    of = lambda df: sorted(tuple(r) for r in df.collect())
    assert of(batch.completed_spread(some, "b", "ok", policy, ["idx"])) == of(batch.completed(some, "b", "ok", policy))


def test_names(spark):
    assert one(spark, batch.item_name(F.lit(""), F.lit(3))) == "map-item-3"
    assert one(spark, batch.item_name(F.lit(None), F.lit(0), "parallel-branch")) == "parallel-branch-0"
    assert one(spark, batch.item_name(F.lit("own"), F.lit(0))) == "own"


def settled(spark, rows):
    return spark.createDataFrame(rows, "g long, idx int, settle int, ok boolean, v string")


def test_combinators(spark):
    rows = settled(spark, [(1, 0, 2, True, "a"), (1, 1, 1, False, "b"), (1, 2, 3, False, "c"), (2, 0, 2, False, "d"), (2, 1, 1, False, "e")])
    by = lambda df: {r.g: r for r in df.collect()}
    joined = by(combinators.try_join_all(rows, "g", "v"))
    assert (joined[1].ok, joined[1].failed_index, joined[1]["values"]) == (False, 1, None)
    won = by(combinators.select_ok(rows, "g", "v"))
    assert (won[1].winner, won[1].value, won[1].losers) == (0, "a", None) and won[2].losers == [0, 1]
    first = by(combinators.race(rows, "g", "v"))
    assert (first[1].winner, first[1].ok, first[2].value) == (1, False, "e")
    assert {(r.g, r.idx) for r in combinators.stopped(rows, combinators.race(rows, "g", "v"), "g").collect()} == {(1, 0), (1, 2), (2, 0)}
    assert [o.idx for o in by(combinators.join_all(rows, "g", "v"))[1].outcomes] == [0, 1, 2]


def test_delays(spark):
    how = schedules.Backoff(5, 2.0, 300.0, 3.0, jitter="none")
    assert [one(spark, schedules.whole_seconds(schedules.base_delay(F.lit(a), how))) for a in (1, 2, 5, 9)] == [2, 6, 162, 300]
    assert one(spark, schedules.whole_seconds(F.lit(2.5))) == 3 and one(spark, schedules.whole_seconds(F.lit(0.2))) == 1
    assert one(spark, schedules.whole_seconds(F.lit(float("nan")))) == 1 and one(spark, schedules.whole_seconds(F.lit(float("inf")))) == 1
    assert one(spark, schedules.asked_seconds(F.lit(1.01))) == 2 and one(spark, schedules.asked_seconds(F.lit(1e12))) == 2147483647


def test_decisions(spark):
    how = schedules.Backoff(3, 1.0, jitter="none")
    assert one(spark, schedules.retry_decision(F.lit(3), how))["action"] == "STOP"
    assert one(spark, schedules.retry_decision(F.lit(1), how, F.lit(False)))["action"] == "STOP"
    assert tuple(one(spark, schedules.retry_decision(F.lit(2), how, pause_every=2))) == ("PAUSE", 2)
    assert one(spark, schedules.poll_decision(F.lit(True), F.lit(3), how))["action"] == "COMPLETE"
    assert one(spark, schedules.poll_decision(F.lit(False), F.lit(3), how))["action"] == "EXHAUSTED"


@pytest.mark.parametrize("n, want", [(1, 1), (9, 9), (10, 10), (95, 10), (96, 60)])
def test_refresh_delay(spark, n, want):
    assert one(spark, schedules.refresh_delay(F.lit(n))) == want


@pytest.mark.parametrize(
    "a, b, same",
    [
        (("CHAINED_INVOKE", None, None), ("ChainedInvoke", None, ""), True),
        (("STEP", "Step", "x"), ("Step", "STEP", "x"), True),
        (("STEP", "Step", "x"), ("STEP", "Step", "X"), False),
        (("STEP", "Step", None), ("STEP", None, None), False),
        (("STEP", None, None), ("WAIT", None, None), False),
        ((None, "a", "b"), ("WAIT", None, None), True),
    ],
)
def test_identity(spark, a, b, same):
    cols = [F.lit(x).cast("string") for x in (*a, *b)]
    assert one(spark, identity.same_identity(*cols)) is same


def test_terminal(spark):
    assert [one(spark, identity.is_terminal(F.lit(s))) for s in ("STARTED", "READY", "STOPPED", "NEW")] == [False, False, True, True]


def test_json_length(spark):
    text = 'a"\\\n\t\x08\x0c\x01\x1fé😀'
    assert one(spark, codecs.json_escaped_length(F.lit(text))) == len(json.dumps(text, ensure_ascii=False).encode()) - 2
    assert one(spark, codecs.json_escaped_length(F.lit(None).cast("string"))) == 0


def test_envelopes(spark):
    inline = one(spark, codecs.inline_envelope(F.lit('{"a":1}')))
    assert json.loads(inline)["value"] == {"a": 1}
    file = one(spark, codecs.file_envelope(F.lit('p/"q'), F.lit('{"a":1}')))
    assert json.loads(file)["file"] == 'p/"q' and json.loads(file)["preview"] == {"a": 1}
    assert one(spark, codecs.envelope_kind(F.lit(file))) == "file"
    big = F.repeat(F.lit("x"), 300_000)
    assert one(spark, codecs.envelope_kind(codecs.stored_payload(F.concat(F.lit('"'), big, F.lit('"')), F.lit("p")))) == "file"


@pytest.mark.parametrize("text, want", [("a b/é~", "a%20b%2F%C3%A9~"), ("..", "%2E."), (".", "%2E"), ("", "")])
def test_percent_encoding(spark, text, want):
    assert one(spark, codecs.percent_encoded(F.lit(text))) == want


@pytest.mark.parametrize("path, inside", [("a/b", True), ("/a", False), ("a/../b", False), ("..", False), ("a/..b", True), ("", False), ("a\\b", False)])
def test_containment(spark, path, inside):
    assert one(spark, codecs.path_is_contained(F.lit(path))) is inside


def test_preview():
    text = '{"ticket":7,"lane":"north","ship":{"captain":"Ada Q.","decks":3},"cargo":[{"kg":1.50},{"kg":2}]}'
    how = codecs.Preview(include=("ticket", "decks"), mask=("captain",))
    assert how.of(text) == '{"ticket":7,"ship":{"captain":"***","decks":3}}'
    assert codecs.Preview(show_all=True, exclude=("ship.captain", "cargo")).of(text) == '{"ticket":7,"lane":"north","ship":{"decks":3}}'
    assert codecs.Preview(include=("cargo.kg",)).of(text) == '{"cargo":{"kg":2}}'
    assert codecs.Preview(include=("n",)).of('[{"n":340282366920938463463374607431768211455},{"m":1}]') == '{"n":340282366920938463463374607431768211455}'
    assert codecs.Preview(show_all=True).of('{"a.b":1,"__proto__":2}') is None
    assert how.of("not json") is None and how.of(None) is None and how.of("5") is None
    assert codecs.Preview(show_all=True, limit=20).of('{"a":1,"bbbbbbbbbbbbbbbb":2,"c":3}') == '{"a":1}'


def test_errors(spark):
    for kind, (wire, _) in errors.KINDS.items():
        assert one(spark, errors.wire_type(F.lit(kind))) == wire and one(spark, errors.kind_of(F.lit(wire))) == kind
    assert one(spark, errors.wire_type(F.lit("other"))) == "Error"
    back = one(spark, errors.combinator_reason(errors.combinator_type(F.lit("JoinFailed"), F.lit(4))))
    assert (back["reason"], back["index"]) == ("JoinFailed", 4)


def test_packing_by_size(spark):
    rows = spark.createDataFrame([("e", i, s) for i, s in enumerate([10, 10, 95, 5, 5, 200, 1])] + [("f", 0, 5)], "e string, n int, size long")
    got = packing.by_size(rows, "e", ["n"], "size", 3, 100).orderBy("e", "n").collect()
    assert [r.request for r in got] == [0, 0, 1, 1, 2, 3, 4, 0]
    few = packing.by_size(rows, "e", ["n"], "size", 2, 10**6).orderBy("e", "n").collect()
    assert [r.request for r in few] == [0, 0, 1, 1, 2, 2, 3, 0]


def test_log_state_and_changes(spark):
    rows = spark.createDataFrame([("a", 1, "STARTED"), ("a", 3, "FAILED"), ("a", 2, "STARTED"), ("b", 1, None), ("b", 2, None)], "id string, seq int, status string")
    assert {(r.id, r.seq, r.status) for r in log.state(rows, ["id"], ["seq"]).collect()} == {("a", 3, "FAILED"), ("b", 2, None)}
    assert {(r.id, r.seq) for r in log.changes(rows, ["id"], ["seq"]).collect()} == {("a", 1), ("a", 3), ("b", 1)}


def test_refreshes_stop_before_the_deadline(spark):
    rows = spark.createDataFrame([(1,)], "k long")
    at = [r["at"] for r in execution.refreshes(rows, "k", F.lit(1), F.lit(5), F.lit(99)).orderBy("n").collect()]
    assert at == [1, 2, 4]


def test_refreshes_go_on_to_a_late_deadline(spark):
    limits = {1: 5, 2: 2400, 3: 2500, 4: 10_000, 5: 100_000, 6: 0, 7: 20_001}
    rows = spark.createDataFrame([(k, k % 3 + 1, None if k == 7 else v) for k, v in limits.items()], "k long, f int, d int")
    want = set()
    for k, limit in limits.items():
        n, at = 1, k % 3 + 1
        while at + 1 <= limit:
            want.add((k, n, at))
            at += 60 if n > 95 else min(n, 10)
            n += 1
    got = execution.refreshes(rows, "k", F.col("f"), F.col("d"), F.lit(20_000)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and sum(r.k == 7 for r in got) > 300


def test_callbacks(spark):
    made = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "k long, at long")
    done = spark.createDataFrame([(1, 9), (1, 3), (2, 99)], "k long, at long")
    got = {r.k: (r.outcome, r.after) for r in execution.callbacks(made.withColumnRenamed("k", "k"), done, "k", 10).collect()}
    assert got == {1: ("SUCCEEDED", 3), 2: ("TIMED_OUT", 10), 3: ("TIMED_OUT", 10)}


def test_a_last_heartbeat_is_missed(spark):
    of = lambda *rows: spark.createDataFrame(list(rows), "k long, at long")
    beats = of((1, 0), (1, 5), (2, 0), (3, 0), (3, 20), (3, 100), (4, 95), (5, 40))
    log = beats.union(of((9, 100)))
    made = of((4, 90), (5, 0), (6, 30), (7, 95))
    end = log.agg(F.max("at")).scalar()
    got = {tuple(r) for r in execution.missed_heartbeats(beats, "k", "at", 10, until=end).collect()}
    assert got == {(1, 5, 95), (2, 0, 100), (3, 0, 20), (5, 40, 60)}
    got = {tuple(r) for r in execution.missed_heartbeats(beats, "k", "at", 10, made, F.lit(100)).collect()}
    assert got == {(1, 5, 95), (2, 0, 100), (3, 0, 20), (5, 0, 40), (6, 30, 70)}


def test_heartbeat_timeouts_see_who_stops_for_good(spark, tmp_path):
    from ledgerfold.plans import catalog

    day = [(1, "click", 1), (1, "click", 2), (2, "click", 1), (3, "click", 9), (4, "signup", 3), (5, "click", 1), (5, "click", 5), (6, "view", 10)]
    rows = [(i, u, kind, f"2024-01-{d:02} 00:00:00") for i, (u, kind, d) in enumerate(day)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.user_id, r.silent // 86400) for r in catalog.QUERIES["heartbeat_timeouts"](spark, str(tmp_path)).collect()}
    assert got == {(1, 8), (2, 9), (4, 7), (5, 4)}


def test_errors_rise_by_any_number_of_levels(spark):
    # a chain of 45; a first child whose error lies deeper than its brother's; one without any; one that didn't fail
    rows = [(f"c{i}", f"c{i - 1}" if i else None, 1, "FAILED", "deep" if i == 44 else None) for i in range(45)]
    rows += [("p", None, 1, "FAILED", None), ("a", "p", 1, "FAILED", None), ("a1", "a", 1, "FAILED", None), ("a2", "a1", 1, "FAILED", "first"), ("b", "p", 2, "FAILED", "second")]
    rows += [("q", None, 1, "FAILED", None), ("q1", "q", 1, "FAILED", None), ("q2", "q", 2, "FAILED", "third"), ("q0", "q", 0, "SUCCEEDED", "no")]
    rows += [("x", "y", 2, "FAILED", None), ("y", "x", 1, "FAILED", None), ("z", "x", 9, "FAILED", "round")]
    ops = spark.createDataFrame(rows, "id string, parent string, number long, status string, message string")
    got = {r.id: r.message for r in log.propagated(ops, "id", "parent").collect()}
    assert {got[f"c{i}"] for i in range(45)} == {"deep"}
    assert [got[k] for k in ("p", "a", "b", "q", "q1")] == ["first", "first", "second", "third", None] and "q0" not in got and len(got) == 56


def test_trees_of_any_depth(spark):
    rows = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(70)] + [("d", "c3"), ("r", None), ("lost", "nowhere"), ("below", "lost"), ("x", "y"), ("y", "x"), ("z", "x")]
    tree = spark.createDataFrame(rows, "id string, parent_id string")
    got = {r.id: (r.root, r.depth) for r in log.descendants(tree).collect()}
    assert got == {f"c{i}": ("c0", i) for i in range(70)} | {"d": ("c0", 4), "r": ("r", 0)}
    assert {r.id for r in log.descendants(tree, 2).collect()} == {"c0", "c1", "c2", "r"}
    assert log.descendants(tree.limit(0)).count() == 0


def test_pages_are_followed_from_the_first(spark):
    op = lambda i, v: (i, v)
    rows = [("e", None, "m1", [op("a", 1), op("b", 1)]), ("e", "m1", "m2", [op("b", 2)]), ("e", "m1", "m2", [op("b", 2)]), ("e", "m2", None, [op("c", 3)]), ("e", "m9", None, [op("z", 9)]), ("f", "m1", None, [op("q", 9)]), ("g", None, "gone", [])]
    pages = spark.createDataFrame(rows, "arn string, marker string, next_marker string, ops array<struct<id: string, v: int>>")
    found = paged.followed(pages, "arn", "marker", "next_marker")
    assert sorted((r.arn, r.number) for r in found.collect()) == [("e", 0), ("e", 1), ("e", 2), ("g", 0)]
    assert {(r.arn, r.id, r.v) for r in paged.state_of(found, "arn", "ops", "id").collect()} == {("e", "a", 1), ("e", "b", 2), ("e", "c", 3)}


def test_strategies_of_the_caller(spark):
    rows = spark.createDataFrame([(1, 1, False, "a"), (1, 2, False, "b"), (1, 3, True, None), (1, 4, True, None), (2, 1, False, "stop"), (2, 2, True, None), (3, 1, False, "a")], "k long, n int, ok boolean, e string")
    how = lambda e, n: F.struct(F.when(e == "stop", "STOP").otherwise("RETRY").alias("action"), (n * 1.2).alias("delay"))
    got = {r.k: (r.status, r.attempts, r.waited) for r in execution.retried_by(rows, "k", "n", "ok", "e", how).collect()}
    assert got == {1: ("SUCCEEDED", 3, 2 + 3), 2: ("FAILED", 1, 0), 3: ("PENDING", 1, 0)}


def test_a_lost_check_starts_again_from_the_initial_state(spark):
    rows = spark.createDataFrame([(1, i, v, lost) for i, (v, lost) in enumerate([(1, False), (2, False), (9, True), (3, False), (4, False)])] + [(2, 0, 5, True)], "k long, o int, v int, lost boolean")
    got = execution.checked(rows, "k", "o", "v", "lost", F.lit(10))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 11), (1, 2, 13), (1, 3, 13), (1, 4, 17)]
    by_hand = execution.checked_in_order(rows, "k", "o", "v", "lost", 10, lambda state, seen: state + seen, "long")
    assert sorted(map(tuple, by_hand.collect())) == sorted(map(tuple, got.collect()))
    joined = execution.checked_in_order(rows, "k", "o", "v", "lost", "", lambda state, seen: f"{seen}({state})", "string")
    assert sorted(map(tuple, joined.collect())) == [(1, 1, "1()"), (1, 2, "2(1())"), (1, 3, "3()"), (1, 4, "4(3())")]


def test_codecs(spark):
    assert one(spark, codecs.PASSTHROUGH.read(codecs.PASSTHROUGH.write(F.lit(" a\"b ")))) == ' a"b '
    as_json = codecs.json_codec("n long, s string")
    back = one(spark, as_json.read(as_json.write(F.struct(F.lit(2**53 + 1).alias("n"), F.lit("é").alias("s")))))
    assert (back.n, back.s) == (2**53 + 1, "é")
    bad = spark.createDataFrame([("{", False), ("{", True), ('{"k":1}', False)], "p string, again boolean")
    assert [(r.value and r.value.k, r.error, r.reinvoke) for r in log.decoded(bad, "p", "k int", F.col("again")).collect()] == [(None, "SerializationFailed", False), (None, None, True), (1, None, False)]
    how = codecs.Preview(include=("id", "deep.k"), mask=("secret",), exclude=("out",))
    fields = {"id": F.lit(1), "deep.k": F.lit("v"), "deep.out": F.lit(2), "secret.part": F.lit("s"), "constructor": F.lit(1), "other": F.lit(3)}
    assert one(spark, codecs.preview_of(fields, how)) == '{"id":1,"deep":{"k":"v"},"secret":{"part":"***"}}'


def test_options(spark):
    with pytest.raises(ValueError):
        Options(depth=-1)
    with pytest.raises(ValueError):
        Options(write_delay=-0.5)
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent_id string")
    assert {r.id for r in Options(depth=1).visible(tree).collect()} == {"a", "b"}
    rows = spark.createDataFrame([("e", 0.0), ("e", 0.4), ("e", 2.0)], "e string, at double")
    assert [r.window for r in Options(write_delay=0.5).windows(rows, "e", "at").orderBy("at").collect()] == [1, 1, 2]


def test_hooks(spark):
    h = lambda op, s, a=1, u=False: one(spark, lifecycle.hooks(F.lit(op), F.lit(s).cast("string"), F.lit(a), F.lit(u)))
    assert h("step", "READY") == "start(false), attempt start" and h("step", "PENDING") is None
    assert h("wait", "SUCCEEDED", u=True) == "end(false)" and h("wait", "FAILED") is None
    assert h("invoke", "STOPPED") == "end(true)" and h("map", "SUCCEEDED") is None


def test_trigger_is_the_first_row_that_ends_the_batch(spark):
    rows = items(spark, "sfssfsfs", "ffff", "ssssssss")
    policy = batch.Policy(min_successful=4, tolerated_failures=2)
    w = W.partitionBy("b").orderBy("idx")
    run = batch.running(rows, "b", "ok").withColumn("r", policy.reason(F.col("n_ok"), F.col("n_failed"), F.col("total")))
    first = {r.b: r.n for r in run.withColumn("n", F.row_number().over(w)).where("r is not null").groupBy("b").agg(F.min("n").alias("n")).collect()}
    assert {r.b: r.settled for r in batch.completed(rows, "b", "ok", policy).collect()} == first


def test_a_failed_submission_fails_the_wait(spark):
    rows = spark.createDataFrame([(1, "SUCCEEDED", None), (2, "SUCCEEDED", None), (3, "TIMED_OUT", "Callback.Heartbeat"), (4, None, None)], "id long, status string, wire string")
    got = execution.submitted(rows, "id", "status", "wire", lambda id: F.when(id == 2, "gone"))
    assert {r.id: (r.submit_error, r.failure) for r in got.collect()} == {1: (None, None), 2: ("gone", "SubmitterFailed"), 3: (None, "HeartbeatTimedOut"), 4: (None, None)}
