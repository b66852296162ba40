"""State machines over file streams, fed batch by batch."""

import datetime as dt

import pytest

from ledgerfold.plans.stream_queries import ROCKS
from ledgerfold.streaming import plugins, sink, timers

START = dt.datetime(2024, 1, 1)


def ms(seconds):
    return int((START + dt.timedelta(seconds=seconds)).replace(tzinfo=dt.UTC).timestamp() * 1000)


def fed(spark, tmp_path, processor, batches):
    """Outcomes after each batch of (key, kind, seconds) came as a file."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "key string, kind string, ts timestamp"
    (tmp_path / "in").mkdir()
    rows = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in").withWatermark("ts", "0 seconds")
    out = timers.outcomes(rows, processor)
    started = (
        out.writeStream.foreachBatch(sink.checkpointed(f"file://{tmp_path}/out")).option("checkpointLocation", f"file://{tmp_path}/log").start()
    )
    try:
        for i, batch in enumerate(batches):
            df = spark.createDataFrame([(k, kind, START + dt.timedelta(seconds=s)) for k, kind, s in batch], schema)
            df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            started.processAllAvailable()
    finally:
        started.stop()
    return {(r.key, r.outcome, r.at_ms) for r in sink.written(spark, f"file://{tmp_path}/out").collect()}


def test_callbacks_and_heartbeats(spark, tmp_path):
    got = fed(
        spark,
        tmp_path,
        timers.Callback(timeout=100, heartbeat=30),
        [
            [("a", "create", 0), ("b", "create", 0), ("c", "create", 0), ("d", "create", 0)],
            [("a", "complete", 10), ("b", "heartbeat", 20), ("d", "heartbeat", 25)],
            [("b", "fail", 45), ("d", "heartbeat", 50)],
            [("z", "noise", 300)],
            [("z", "noise", 301)],
        ],
    )
    assert got == {
        ("a", "SUCCEEDED", ms(10)),
        ("b", "FAILED", ms(45)),
        ("c", "HEARTBEAT_TIMED_OUT", ms(30)),
        ("d", "HEARTBEAT_TIMED_OUT", ms(80)),
    }


def test_waits_fire_once(spark, tmp_path):
    got = fed(spark, tmp_path, timers.Wait(60), [[("a", "start", 5), ("a", "start", 6), ("b", "start", 100)], [("z", "noise", 400)], [("z", "noise", 401)]])
    assert got == {("a", "RESUMED", ms(65)), ("b", "RESUMED", ms(160))}


def test_polls_stop_at_the_cap(spark, tmp_path):
    got = fed(
        spark,
        tmp_path,
        timers.Poll(3),
        [[("a", "check", 1), ("b", "check", 1)], [("a", "check", 2), ("b", "done", 3)], [("a", "check", 4), ("b", "check", 5)]],
    )
    assert got == {("a", "MaxChecksExceeded", ms(4)), ("b", "COMPLETE", ms(3))}


def test_a_lost_poll_starts_again(spark, tmp_path):
    got = fed(
        spark,
        tmp_path,
        timers.Poll(4, goal=3),
        [[("a", "check", 1), ("a", "check", 2), ("b", "check", 1)], [("a", "lost", 3), ("a", "check", 4)], [("a", "check", 5), ("b", "check", 6), ("b", "check", 7)]],
    )
    assert got == {("a", "MaxChecksExceeded", ms(5)), ("b", "COMPLETE", ms(7))}


def test_failed_steps_become_ready_again(spark, tmp_path):
    got = fed(
        spark,
        tmp_path,
        timers.Retry([10, 100]),
        [[("a", "fail", 0), ("a", "fail", 5), ("b", "fail", 1), ("c", "done", 2)], [("a", "fail", 30)], [("z", "noise", 400)], [("a", "fail", 401), ("b", "done", 402)]],
    )
    assert got == {
        ("a", "READY", ms(10)),
        ("a", "READY", ms(130)),
        ("a", "FAILED", ms(401)),
        ("b", "READY", ms(11)),
        ("b", "SUCCEEDED", ms(402)),
        ("c", "SUCCEEDED", ms(2)),
    }


def test_waiting_operations_are_looked_up(spark, tmp_path):
    got = fed(spark, tmp_path, timers.Refresh(1, 20), [[("a", "wait", 0), ("b", "wait", 0)], [("a", "done", 6)], [("z", "noise", 400)], [("z", "noise", 401)]])
    assert got == {("a", "LOOKED_UP", ms(s)) for s in (1, 2, 4)} | {("b", "LOOKED_UP", ms(s)) for s in (1, 2, 4, 7, 11, 16)}


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    write = sink.checkpointed(f"file://{tmp_path}/out")
    write(spark.range(3), 0)
    write(spark.range(3), 0)
    write(spark.range(2), 1)
    assert sink.written(spark, f"file://{tmp_path}/out").count() == 5


def test_exclusive_plugins(spark):
    registry = plugins.Registry(spark)
    registry.add(plugins.Recorder(), "log")
    with pytest.raises(ValueError):
        registry.add(plugins.Recorder(), "log")
    registry.add(plugins.Recorder())
    registry.close()
    assert not registry.listeners


def run_parts(spark, tmp_path, name, batches, build, columns="key string, kind string, ts timestamp", each=None):
    """Rows out of a stream built by build over (key, kind, seconds, ...) that is stopped after each batch and started again from its checkpoint; and the state rows it held in the end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source = tmp_path / f"in-{name}"
    source.mkdir()
    held = None
    for batch in batches:
        rows = [(r[0], r[1], START + dt.timedelta(seconds=r[2]), *r[3:]) for r in batch]
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = spark.readStream.schema(columns).parquet(f"file://{source}").withWatermark("ts", "0 seconds")
        started = (
            build(stream).writeStream.foreachBatch(sink.checkpointed(f"file://{tmp_path}/out-{name}"))
            .option("checkpointLocation", f"file://{tmp_path}/log-{name}").trigger(availableNow=True).start()
        )
        started.awaitTermination()
        held = [o["numRowsTotal"] for o in started.lastProgress["stateOperators"]]
    return sorted(map(tuple, sink.written(spark, f"file://{tmp_path}/out-{name}").drop("batch").collect())), held


@pytest.mark.parametrize(
    ("name", "make"),
    [("callback", lambda: timers.Callback(timeout=100, heartbeat=30)), ("retry", lambda: timers.Retry([10, 100], keep=1000)), ("wait", lambda: timers.Wait(60))],
)
def test_a_stream_that_stops_and_goes_on_is_one_stream(spark, tmp_path, name, make):
    kinds = {"callback": ["create", "heartbeat", "complete", "create"], "retry": ["fail", "fail", "done", "fail"], "wait": ["start", "start", "noise", "start"]}[name]
    parts = [[(f"k{(7 * i + s) % 5}", kinds[(i + s) % 4], 40 * i + s) for s in range(0, 40, 6)] for i in range(3)] + [[("z", "noise", 2000)]]
    build = lambda stream: timers.outcomes(stream, make())
    stopped, _ = run_parts(spark, tmp_path, "parts", parts, build)
    whole, _ = run_parts(spark, tmp_path, "whole", [sum(parts[:3], []), *parts[3:]], build)
    assert stopped == whole and len(whole) > 3


def test_finished_keys_are_forgotten(spark, tmp_path):
    ends = [[("z", "noise", 5000)], [("z", "noise", 5001)], [("z", "noise", 5002)]]
    polls, held = run_parts(spark, tmp_path, "poll", [[(f"k{i}", "check", i) for i in range(20)], [(f"k{i}", "done", 30 + i) for i in range(20)], *ends], lambda s: timers.outcomes(s.where("kind <> 'noise' or key = 'z'"), timers.Poll(5, keep=100)))
    assert len(polls) == 20 and held == [1]  # z alone, which never ends
    retries, held = run_parts(spark, tmp_path, "retry", [[(f"k{i}", "fail", i) for i in range(20)], [(f"k{i}", "done", 100 + i) for i in range(20)], *ends], lambda s: timers.outcomes(s, timers.Retry([10], keep=100)))
    assert len(retries) == 40 and held == [1]


def test_checks_are_the_callers(spark, tmp_path):
    how = timers.Checks("", lambda state, seen: state + seen, lambda state, n: "COMPLETE" if state.endswith("abc") else "EXHAUSTED" if n >= 5 else None, "string", keep=50)
    rows = [
        [("x", "check", 1, 1, "a"), ("x", "check", 1, 2, "b"), ("y", "check", 1, 1, "a")],
        [("x", "check", 3, 3, "c"), ("y", "lost", 2, 2, None), ("y", "check", 3, 3, "abc"), ("x", "check", 4, 4, "d")],
        [("w", "check", 5, 1, "c"), ("v", "check", 5, 1, "q")],
        [("v", "noise", 900, 9, "")],
        [("v", "noise", 901, 9, "")],
    ]
    began = spark.createDataFrame([("w", 2, "ab"), ("v", 4, "?")], "key string, n int, state string")
    got, held = run_parts(spark, tmp_path, "checks", rows, lambda s: timers.checked(s, how, began), "key string, kind string, ts timestamp, number long, seen string")
    assert got == [("v", "MaxChecksExceeded", ms(5), 5, "?q"), ("w", "COMPLETE", ms(5), 3, "abc"), ("x", "COMPLETE", ms(3), 3, "abc"), ("y", "COMPLETE", ms(3), 2, "abc")]
    assert held[0] <= 1


def test_look_ups_of_one_moment_are_one_request(spark, tmp_path):
    parts = [[("a", "wait", 0), ("b", "wait", 0), ("c", "wait", 1)], [("a", "done", 3)], [("z", "noise", 400)], [("z", "noise", 401)], [("z", "noise", 402)]]
    got, _ = run_parts(spark, tmp_path, "shared", parts, lambda s: timers.shared(s, timers.Refresh(1, 10)))
    at = {}
    for key, began, until in (("a", 0, 3), ("b", 0, 99), ("c", 1, 99)):
        for s in (1, 2, 4, 7):
            if began + s < until:
                at.setdefault(began + s, []).append(key)
    assert got == sorted((ms(s), 0, keys) for s, keys in at.items())
