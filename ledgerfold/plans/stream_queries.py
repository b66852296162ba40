"""Streams of events, run to their end, with batch queries of the same meaning beside them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schedules
from ..sources.stored import own_folder
from ..streaming import sink, timers
from .registry import query

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str, kinds: dict[str, str], *more: Column, to: str = "millisecond") -> DataFrame:
    """events as a file stream of (key, kind, ts) and more columns; kinds: by event type; to: what times are rounded down to."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/events.parque[t]")
    kind = F.lit(None).cast("string")
    for name, shown in kinds.items():
        kind = F.when(F.col("event_type") == name, shown).otherwise(kind)
    shown = rows.select(F.col("user_id").cast("string").alias("key"), kind.alias("kind"), F.date_trunc(to, F.col("ts").cast("timestamp")).alias("ts"), *more)
    return shown.where("kind is not null").withWatermark("ts", "0 seconds")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def run_to_end(stream: DataFrame) -> DataFrame:
    """All that a stream has to say now, each micro-batch written once."""
    return sink.written(stream.sparkSession, run(stream))


def run(stream: DataFrame) -> str:
    """The folder to which a stream's micro-batches of what there is now were written."""
    spark = stream.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    spark.conf.set(provider, ROCKS)  # a stream keeps the settings it starts with
    try:
        started = (
            stream.writeStream.foreachBatch(sink.checkpointed(f"{folder}/out"))
            .option("checkpointLocation", f"{folder}/log")
            .trigger(availableNow=True)
            .start()
        )
        started.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return f"{folder}/out"


@query("SELECT CAST(user_id AS VARCHAR) AS key, 'RESUMED' AS outcome, epoch_us(min(ts)) // 1000 + 3600000 AS at_ms FROM events WHERE event_type = 'view' GROUP BY user_id HAVING min(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE event_type = 'view')")
def stream_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir, {"view": "start"})
    return run_to_end(timers.outcomes(rows, timers.Wait(3600))).drop("batch")


#: A user's events of some kinds in order, numbered.
EVENTS_SQL = """e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, CASE event_type {kinds} END AS kind FROM events),
    s AS (SELECT user_id, ms, kind, row_number() OVER (PARTITION BY user_id ORDER BY ms, kind) AS n FROM e WHERE kind IS NOT NULL),
    top AS (SELECT max(ms) AS ms FROM s)"""


@query(
    f"""
    WITH RECURSIVE {EVENTS_SQL.format(kinds="WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'heartbeat'")},
    r(user_id, n, created, beat, outcome, out_at) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM s UNION ALL
        SELECT user_id, n, CASE WHEN kind = 'create' AND open IS NULL THEN ms WHEN kind = 'complete' THEN NULL ELSE open END,
            CASE WHEN kind = 'create' AND open IS NULL THEN ms WHEN kind = 'heartbeat' AND open IS NOT NULL THEN ms WHEN open IS NOT NULL AND kind <> 'complete' THEN beat END,
            CASE WHEN late AND by_beat THEN 'HEARTBEAT_TIMED_OUT' WHEN late THEN 'TIMED_OUT' WHEN kind = 'complete' AND open IS NOT NULL THEN 'SUCCEEDED' END,
            CASE WHEN late THEN due WHEN kind = 'complete' AND open IS NOT NULL THEN ms END
        FROM (SELECT *, CASE WHEN late THEN NULL ELSE created END AS open FROM (SELECT *, coalesce(ms > due, false) AS late FROM (
            SELECT s.*, r.created, r.beat, least(r.created + 345600000, r.beat + 172800000) AS due, r.beat + 172800000 <= r.created + 345600000 AS by_beat FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)))),
    last AS (SELECT user_id, arg_max(created, n) FILTER (true) AS created, max(n) AS n FROM r GROUP BY user_id),
    left_open AS (SELECT r.user_id, r.created, r.beat FROM r JOIN last USING (user_id, n) WHERE r.created IS NOT NULL)
    SELECT CAST(user_id AS VARCHAR) AS key, outcome, out_at AS at_ms FROM r WHERE outcome IS NOT NULL UNION ALL
    SELECT CAST(user_id AS VARCHAR), CASE WHEN beat + 172800000 <= created + 345600000 THEN 'HEARTBEAT_TIMED_OUT' ELSE 'TIMED_OUT' END, least(created + 345600000, beat + 172800000)
        FROM left_open, top WHERE least(created + 345600000, beat + 172800000) <= top.ms
    """
)
def stream_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir, {"signup": "create", "purchase": "complete", "click": "heartbeat"})
    return run_to_end(timers.outcomes(rows, timers.Callback(86400 * 4, 86400 * 2))).drop("batch")


@query(
    """
    WITH c AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, CASE event_type WHEN 'view' THEN 0 ELSE 1 END) AS n FROM events WHERE event_type IN ('view', 'purchase')),
    e AS (SELECT user_id, min(n) FILTER (event_type = 'purchase') AS done, max(n) AS last FROM c GROUP BY 1),
    f AS (SELECT user_id, CASE WHEN done <= 3 THEN done WHEN last >= 3 THEN 3 END AS n, coalesce(done <= 3, false) AS ok FROM e)
    SELECT CAST(user_id AS VARCHAR) AS key, CASE WHEN ok THEN 'COMPLETE' ELSE 'MaxChecksExceeded' END AS outcome, epoch_us(ts) // 1000 AS at_ms FROM f JOIN c USING (user_id, n)
    """
)
def stream_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir, {"view": "check", "purchase": "done"})
    return run_to_end(timers.outcomes(rows, timers.Poll(3))).drop("batch")


@query(
    f"""
    WITH RECURSIVE {EVENTS_SQL.format(kinds="WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'done'")},
    r(user_id, n, failed, due, ready_at, outcome, out_at) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, -1::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM s UNION ALL
        SELECT user_id, n, CASE WHEN idle THEN failed WHEN kind = 'done' OR failed >= 3 THEN -1 ELSE failed + 1 END,
            CASE WHEN idle THEN due WHEN kind = 'done' OR failed >= 3 THEN -1 ELSE ms + CASE failed WHEN 0 THEN 3600000 WHEN 1 THEN 7200000 ELSE 86400000 END END,
            CASE WHEN NOT idle AND due >= 0 THEN due END, CASE WHEN idle THEN NULL WHEN kind = 'done' THEN 'SUCCEEDED' WHEN failed >= 3 THEN 'FAILED' END, CASE WHEN NOT idle THEN ms END
        FROM (SELECT s.*, r.failed, r.due, r.failed < 0 OR r.due > s.ms AS idle FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1))
    SELECT CAST(user_id AS VARCHAR) AS key, 'READY' AS outcome, ready_at AS at_ms FROM r WHERE ready_at IS NOT NULL UNION ALL
    SELECT CAST(user_id AS VARCHAR), outcome, out_at FROM r WHERE outcome IS NOT NULL UNION ALL
    SELECT CAST(user_id AS VARCHAR), 'READY', due FROM (SELECT user_id, arg_max(due, n) AS due FROM r GROUP BY user_id), top WHERE due BETWEEN 0 AND top.ms
    """
)
def stream_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir, {"error": "fail", "purchase": "done"})
    return run_to_end(timers.outcomes(rows, timers.Retry([3600, 7200, 86400]))).drop("batch")


#: Users' look-ups as rows (key, at_ms) of looked_up.
LOOKED_UP_SQL = f"""{EVENTS_SQL.format(kinds="WHEN 'signup' THEN 'wait' WHEN 'purchase' THEN 'done'")},
    offsets AS MATERIALIZED (SELECT k, 1000 + coalesce(sum(1000 * CASE WHEN k > 95 THEN 60 ELSE least(k, 10) END) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM range(1, 200) t(k)),
    r(user_id, n, began, ended) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM s UNION ALL
        SELECT s.user_id, s.n, CASE WHEN kind = 'done' THEN NULL WHEN began IS NULL OR s.ms > gone THEN s.ms ELSE began END, CASE WHEN kind = 'done' OR s.ms > gone THEN began END
        FROM (SELECT *, began + (SELECT max(off) FROM offsets WHERE off <= 600000) AS gone FROM r) r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1),
    waits AS (SELECT user_id, began, min(n) AS n FROM r WHERE began IS NOT NULL GROUP BY ALL),
    ends AS (SELECT w.user_id, w.began, min(s.ms) AS done FROM waits w LEFT JOIN s ON s.user_id = w.user_id AND s.kind = 'done' AND s.n > w.n GROUP BY ALL),
    looked_up AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(began + off AS BIGINT) AS at_ms, top.ms AS upto FROM ends, offsets, top
        WHERE off <= 600000 AND began + off < coalesce(done, began + off + 1) AND began + off <= top.ms)"""


@query(f"WITH RECURSIVE {LOOKED_UP_SQL} SELECT key, 'LOOKED_UP' AS outcome, at_ms FROM looked_up")
def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir, {"signup": "wait", "purchase": "done"})
    return run_to_end(timers.outcomes(rows, timers.Refresh(schedules.FIRST_REFRESH, 600))).drop("batch")


@query(
    f"""
    WITH RECURSIVE {EVENTS_SQL.format(kinds="WHEN 'view' THEN 'check' WHEN 'error' THEN 'lost'")},
    r(user_id, n, checks, state, outcome, out_at) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, 0, NULL::VARCHAR, NULL::BIGINT FROM s UNION ALL
        SELECT s.user_id, s.n, CASE WHEN kind = 'lost' THEN checks ELSE checks + 1 END, CASE WHEN kind = 'lost' THEN 0 ELSE state + 1 END,
            CASE WHEN kind = 'check' AND state + 1 >= 4 THEN 'COMPLETE' WHEN kind = 'check' AND checks + 1 >= 9 THEN 'MaxChecksExceeded' END, s.ms
        FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1 WHERE outcome IS NULL)
    SELECT CAST(user_id AS VARCHAR) AS key, outcome, out_at AS at_ms FROM r WHERE outcome IS NOT NULL
    """
)
def stream_poll_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls for four views in a row without an error, which loses a check and its state."""
    rows = event_stream(spark, sf_dir, {"view": "check", "error": "lost"})
    return run_to_end(timers.outcomes(rows, timers.Poll(9, goal=4))).drop("batch")


@query("SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, (epoch_us(ts), event_type)) AS kind, max(epoch_us(ts)) // 1000 AS at_ms FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates written batch by batch, merged to each user's newest record."""
    kinds = {k: k for k in ("view", "click", "signup", "purchase", "error")}
    rows = event_stream(spark, sf_dir, kinds).select("key", "kind", F.unix_micros("ts").alias("at_us"))
    folder = run(rows)
    return sink.state(spark, folder, ["key"], ["at_us", "kind"]).select("key", "kind", F.floor(F.col("at_us") / 1000).cast("long").alias("at_ms"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, 'fail' AS kind, epoch_us(ts) // 1000 AS at_ms FROM events WHERE event_type = 'error'")
def stream_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir, {"error": "fail"})
    return run_to_end(rows.select("key", "kind", F.unix_millis("ts").alias("at_ms"))).drop("batch")


@query(
    f"""
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id, event_type = 'error' AS lost, event_id % 10 AS seen, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
    r(user_id, n, checks, state, outcome, ms) AS (SELECT DISTINCT user_id, 0::BIGINT, 0, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM e UNION ALL
        SELECT e.user_id, e.n, CASE WHEN lost THEN checks ELSE checks + 1 END, CASE WHEN lost THEN 0 ELSE state + seen END,
            CASE WHEN NOT lost AND state + seen >= 25 THEN 'COMPLETE' WHEN NOT lost AND checks + 1 >= 7 THEN 'MaxChecksExceeded' END, e.ms
        FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1 WHERE outcome IS NULL)
    SELECT CAST(user_id AS VARCHAR) AS key, outcome, ms AS at_ms, checks, state FROM r WHERE outcome IS NOT NULL
    """
)
def stream_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of poll_state over a stream: they add up what they see, an error loses one; the check and its end are the caller's functions."""
    rows = event_stream(spark, sf_dir, {"error": "lost", "view": "check", "click": "check", "signup": "check", "purchase": "check"}, F.col("event_id").alias("number"), (F.col("event_id") % 10).alias("seen"))
    how = timers.Checks(0, lambda state, seen: state + seen, lambda state, n: "COMPLETE" if state >= 25 else "EXHAUSTED" if n >= 7 else None, "long")
    return run_to_end(timers.checked(rows, how)).drop("batch")


@query(f"WITH RECURSIVE {LOOKED_UP_SQL.replace('epoch_us(ts) // 1000', 'epoch_us(ts) // 60000000 * 60000')} SELECT at_ms, string_agg(key, ',' ORDER BY key) AS keys FROM looked_up WHERE at_ms < upto GROUP BY at_ms")
def stream_shared_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look-ups of stream_refresh, one request for all users that are due at the same moment; events are taken by the minute."""
    rows = event_stream(spark, sf_dir, {"signup": "wait", "purchase": "done"}, to="minute")
    out = run_to_end(timers.shared(rows, timers.Refresh(schedules.FIRST_REFRESH, 600)))
    return out.select("at_ms", F.array_join("keys", ",").alias("keys"))
