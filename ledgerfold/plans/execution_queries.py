"""Steps, waits, invocations, retries, polls and callbacks over orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schedules
from ..operators import execution
from .registry import query, table

ORDER_STATUS = """CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 13 = 1 THEN 'PENDING' WHEN o_orderkey % 13 = 2 THEN 'READY' WHEN o_orderkey % 13 = 3 THEN 'TIMED_OUT'
    WHEN o_orderkey % 13 = 4 THEN 'ARCHIVED' WHEN o_orderkey % 13 = 5 THEN 'STOPPED' WHEN o_orderkey % 13 = 6 THEN 'CANCELLED' WHEN o_orderstatus = 'F' THEN 'SUCCEEDED' WHEN o_orderstatus = 'O' THEN 'STARTED' ELSE 'FAILED' END"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("status", F.expr(ORDER_STATUS))


@query(
    f"""
    WITH o AS (SELECT *, {ORDER_STATUS} AS status, o_orderkey % 2 = 0 AS once FROM orders)
    SELECT o_orderkey, status, once, CASE WHEN status IS NULL THEN 'RUN' WHEN status = 'SUCCEEDED' THEN 'RETURN' WHEN status = 'FAILED' THEN 'RAISE' WHEN status = 'PENDING' THEN 'WAIT'
        WHEN status = 'STARTED' AND once THEN 'INTERRUPTED' WHEN status = 'ARCHIVED' THEN 'UNRECOGNIZED' ELSE 'RUN' END AS action FROM o
    """
)
def replay_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).withColumn("once", F.col("o_orderkey") % 2 == 0)
    return rows.select("o_orderkey", "status", "once", execution.replay_action(F.col("status"), F.col("once")).alias("action"))


@query(
    """
    SELECT o_orderkey, o_orderstatus = 'F' AS is_replay, CASE WHEN o_orderstatus = 'F' THEN 'recorded ' || o_custkey ELSE 'computed ' || (o_orderkey * 2) END AS value FROM orders
    """
)
def step_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    log = rows.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("STARTED").alias("status"), F.concat(F.lit("recorded "), "o_custkey").alias("result"))
    body = F.concat(F.lit("computed "), (F.col("o_orderkey") * 2).cast("string"))
    return execution.stepped(rows.select("o_orderkey"), log, "o_orderkey", body).select("o_orderkey", "is_replay", "value")


@query(
    f"""
    WITH o AS (SELECT *, {ORDER_STATUS} AS status, (o_orderkey % 50) / 4.0::DOUBLE AS asked FROM orders)
    SELECT o_orderkey, CAST(greatest(1, ceil(asked)) AS INT) AS seconds,
        CASE WHEN status IS NULL THEN 'START' WHEN status = 'SUCCEEDED' THEN 'RESUMED' WHEN status = 'STARTED' THEN 'WAITING' ELSE 'UnexpectedStatus' END AS outcome,
        datediff('second', o_orderdate, o_orderdate + to_seconds(CAST(greatest(1, ceil(asked)) AS INT))) AS due_after FROM o
    """
)
def wait_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = (F.col("o_orderkey") % 50).cast("double") / 4.0
    rows = orders(spark, sf_dir).withColumn("due", execution.due(F.col("o_orderdate"), asked))
    return rows.select(
        "o_orderkey",
        schedules.asked_seconds(asked).alias("seconds"),
        execution.wait_outcome(F.col("status")).alias("outcome"),
        F.expr("timestampdiff(SECOND, o_orderdate, due)").alias("due_after"),
    )


@query(
    f"""
    WITH r AS (SELECT o_custkey AS fn, arg_max({ORDER_STATUS.replace("o_orderkey %", "(o_orderkey + 1) %")}, o_orderkey) FILTER (({ORDER_STATUS.replace("o_orderkey %", "(o_orderkey + 1) %")}) IS NOT NULL) AS status FROM orders GROUP BY o_custkey)
    SELECT c_custkey, status, CASE WHEN status IN ('FAILED', 'TIMED_OUT', 'STOPPED', 'CANCELLED') THEN 'FunctionFailed' WHEN status = 'ARCHIVED' THEN 'UnrecognizedStatus' END AS error
    FROM customer LEFT JOIN r ON c_custkey = fn
    """
)
def invoke_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("status", F.expr(ORDER_STATUS.replace("o_orderkey %", "(o_orderkey + 1) %")))
    registry = rows.where("status is not null").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("status", "o_orderkey").alias("status"))
    return execution.invoked(table(spark, sf_dir, "customer").select("c_custkey"), registry, "c_custkey").select("c_custkey", "status", "error")


def _delays(a: tuple[str, str, int], b: tuple[str, str, int]) -> str:
    """SQL: each order's attempt and the delay before jitter after it, where two strategies take turns."""
    pick = lambda i: f"CASE WHEN o_orderkey % 2 = 0 THEN {a[i]} ELSE {b[i]} END"
    return f"""WITH o AS (SELECT o_orderkey, o_orderkey // 2 % 8 + 1 AS a FROM orders), d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '{a[0]}' ELSE '{b[0]}' END AS strategy, a, {pick(1)} AS base, {pick(2)} AS most FROM o)
    SELECT o_orderkey, strategy, CAST(a AS INT) AS attempt, base, CAST(greatest(1, round(base)) AS INT) AS seconds, a >= most AS stops FROM d"""


def _schedule(spark: SparkSession, sf_dir: str, strategies: dict[str, schedules.Backoff]) -> DataFrame:
    """Orders as failed attempts, each under one of the strategies in turn."""
    n, count = F.col("o_orderkey"), len(strategies)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor(n / count) % 8 + 1).cast("int").alias("attempt"))
    chosen = F.lit(None)
    for i, (name, how) in enumerate(strategies.items()):
        base = schedules.base_delay(F.col("attempt"), how)
        one = F.struct(F.lit(name).alias("strategy"), base.alias("base"), schedules.whole_seconds(base).alias("seconds"), (F.col("attempt") >= how.max_attempts).alias("stops"))
        chosen = F.when(n % count == i, one).otherwise(chosen)
    return rows.withColumn("s", chosen).select("o_orderkey", "s.strategy", "attempt", "s.base", "s.seconds", "s.stops")


@query(_delays(("x3", "least(2.0::DOUBLE * pow(3.0::DOUBLE, a - 1), 300.0::DOUBLE)", 5), ("x1.5", "least(0.5::DOUBLE * pow(1.5::DOUBLE, a - 1), 60.0::DOUBLE)", 6)))
def retry_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schedule(spark, sf_dir, {"x3": schedules.Backoff(5, 2.0, 300.0, 3.0, jitter="none"), "x1.5": schedules.Backoff(6, 0.5, 60.0, 1.5, jitter="none")})


@query(_delays(("by1", "least(1.0::DOUBLE + 1.0::DOUBLE * (a - 1), 300.0::DOUBLE)", 6), ("by2.5", "least(1.0::DOUBLE + 2.5::DOUBLE * (a - 1), 10.0::DOUBLE)", 4)))
def retry_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _schedule(spark, sf_dir, {"by1": schedules.Backoff(6, 1.0, 300.0, None, 1.0, "none"), "by2.5": schedules.Backoff(4, 1.0, 10.0, None, 2.5, "none")})


@query(
    """
    WITH p(n, preset, most, initial, cap, rate, inc, jitter) AS (VALUES (0, 'default', 6, 5.0, 60.0, 2.0, 1.0, 'full'), (1, 'linear', 6, 1.0, 300.0, NULL, 1.0, 'none'), (2, 'no_retry', 1, 5.0, 300.0, 2.0, 1.0, 'full'),
        (3, 'exponential_fill', 3, 5.0, 300.0, 2.0, 1.0, 'full'), (4, 'linear_fill', 6, 1.0, 300.0, NULL, 1.0, 'full'), (5, 'polling', 60, 5.0, 300.0, 1.5, 1.0, 'full')),
    o AS (SELECT o_orderkey, o_orderkey // 6 % 6 + 1 AS a, o_orderkey % 6 AS n FROM orders),
    b AS (SELECT o_orderkey, preset, CAST(a AS INT) AS attempt, jitter, a >= most AS stops, least(CASE WHEN rate IS NULL THEN initial::DOUBLE + inc::DOUBLE * (a - 1) ELSE initial::DOUBLE * pow(rate::DOUBLE, a - 1) END, cap::DOUBLE) AS high FROM o JOIN p USING (n))
    SELECT o_orderkey, preset, attempt, stops, CASE jitter WHEN 'none' THEN high ELSE 0.0 END AS low, high FROM b
    """
)
def retry_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as failed attempts, each under one of the presets in turn, with the bounds of its delay."""
    n, count = F.col("o_orderkey"), len(schedules.PRESETS)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor(n / count) % 6 + 1).cast("int").alias("attempt"))
    chosen = F.lit(None)
    for i, (name, how) in enumerate(schedules.PRESETS.items()):
        low, high = schedules.jitter_bounds(schedules.base_delay(F.col("attempt"), how), how.jitter)
        one = F.struct(F.lit(name).alias("preset"), (F.col("attempt") >= how.max_attempts).alias("stops"), low.cast("double").alias("low"), high.cast("double").alias("high"))
        chosen = F.when(n % count == i, one).otherwise(chosen)
    return rows.withColumn("s", chosen).select("o_orderkey", "s.preset", "attempt", "s.stops", "s.low", "s.high")


@query(
    """
    WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 7 + 1 AS INT) AS attempt, o_orderstatus <> 'P' AS retryable FROM orders)
    SELECT o_orderkey, attempt, retryable, CASE WHEN attempt >= 6 OR NOT retryable THEN 'STOP' WHEN attempt % 2 = 0 THEN 'PAUSE' ELSE 'RETRY' END AS action,
        CASE WHEN attempt < 6 AND retryable THEN CAST(round(least(5.0::DOUBLE * pow(2.0::DOUBLE, attempt - 1), 60.0::DOUBLE)) AS INT) END AS delay FROM o
    """
)
def retry_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).cast("int").alias("attempt"), (F.col("o_orderstatus") != "P").alias("retryable"))
    decision = schedules.retry_decision(F.col("attempt"), schedules.PRESETS["default"], F.col("retryable"), pause_every=2)
    return rows.withColumn("d", decision).select("o_orderkey", "attempt", "retryable", "d.action", "d.delay")


@query("SELECT o_orderkey, least(5.0::DOUBLE * pow(2.0::DOUBLE, o_orderkey % 5), 60.0::DOUBLE) AS base, true AS inside FROM orders")
def retry_jitter_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's delay with whether full and half jitter keep their bounds."""
    how = schedules.PRESETS["default"]
    base = schedules.base_delay(F.col("o_orderkey") % 5 + 1, how)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", base.alias("base"))
    kinds = {k: schedules.jittered(F.col("base"), k, 11) for k in ("half", "full")}
    rows = rows.select("*", *(c.alias(k) for k, c in kinds.items()))
    inside = (F.col("half").between(F.col("base") / 2, F.col("base"))) & F.col("full").between(F.lit(0), F.col("base"))
    return rows.select("o_orderkey", "base", inside.alias("inside"))


@query(
    """
    WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type FROM events),
    d AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' ELSE CASE WHEN event_type = 'error' AND n >= 2 OR n >= 6 THEN 'FAILED' END END AS done, CASE event_type WHEN 'view' THEN 1.2 ELSE n * 2.0 END AS delay FROM a),
    e AS (SELECT user_id, min(n) FILTER (done IS NOT NULL) AS hit, max(n) AS last FROM d GROUP BY 1)
    SELECT d.user_id, coalesce(max(done) FILTER (n = hit), 'PENDING') AS status, coalesce(any_value(hit), any_value(last)) AS attempts,
        CAST(coalesce(sum(greatest(1, ceil(delay))) FILTER (n < coalesce(hit, last)), 0) AS BIGINT) AS waited
    FROM d JOIN e USING (user_id) GROUP BY d.user_id
    """
)
def retry_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's strategy: errors are retried once, anything else five times, views soon and others with growing delay."""
    from .batch_queries import event_items

    def strategy(error, attempt):
        stop = (error == "error") & (attempt >= 2) | (attempt >= 6)
        return F.struct(F.when(stop, "STOP").otherwise("RETRY").alias("action"), F.when(error == "view", 1.2).otherwise(attempt * 2.0).alias("delay"))

    rows = event_items(spark, sf_dir).select("user_id", (F.col("idx") + 1).cast("long").alias("n"), (F.col("event_type") == "purchase").alias("ok"), "event_type")
    return execution.retried_by(rows, "user_id", "n", "ok", "event_type", strategy)


@query(
    """
    WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type = 'purchase' AS ok FROM events),
    u AS (SELECT * FROM a WHERE n <= 4), e AS (SELECT user_id, min(n) FILTER (ok) AS won, max(n) AS last FROM u GROUP BY 1),
    w AS (SELECT u.user_id, sum(CAST(round(least(2.0::DOUBLE * pow(3.0::DOUBLE, n - 1), 300.0::DOUBLE)) AS BIGINT)) AS waited FROM u JOIN e USING (user_id) WHERE n < coalesce(won, last) GROUP BY 1)
    SELECT user_id, CASE WHEN won IS NOT NULL THEN 'SUCCEEDED' WHEN last >= 4 THEN 'ChildFailed' ELSE 'PENDING' END AS status, coalesce(won, last) AS attempts, CAST(coalesce(waited, 0) AS BIGINT) AS waited,
        'attempt-' || coalesce(won, last) AS last_child, 'block-backoff-' || coalesce(won, last) AS last_wait FROM e LEFT JOIN w USING (user_id)
    """
)
def with_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .batch_queries import event_items

    rows = event_items(spark, sf_dir).select("user_id", (F.col("idx") + 1).alias("n"), (F.col("event_type") == "purchase").alias("ok"))
    out = execution.retried_blocks(rows, "user_id", "n", "ok", schedules.Backoff(4, 2.0, 300.0, 3.0, jitter="none"))
    child, wait = execution.attempt_names(F.lit("block"), F.col("attempts"))
    return out.select("user_id", "status", F.col("attempts").cast("long").alias("attempts"), F.col("waited").cast("long").alias("waited"), child.alias("last_child"), wait.alias("last_wait"))


@query(
    """
    WITH c AS (SELECT o_custkey, row_number() OVER w AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER w AS state FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT o_custkey, min(n) FILTER (state >= 1000000) AS hit, max(n) AS last FROM c WHERE n <= 8 GROUP BY 1)
    SELECT o_custkey, CASE WHEN hit IS NOT NULL THEN 'COMPLETE' WHEN last >= 8 THEN 'MaxChecksExceeded' ELSE 'CONTINUE' END AS outcome, coalesce(hit, last) AS checks FROM e
    """
)
def poll_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.row_number().over(w).alias("n"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("state"),
    )
    out = execution.polled(rows, "o_custkey", "n", F.col("state") >= 1000000, schedules.Backoff(8))
    return out.withColumn("checks", F.col("checks").cast("long"))


@query(
    """
    WITH w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey % 20 END AS first, CASE WHEN o_orderkey % 40 = 1 THEN 1200 WHEN o_orderkey % 4 > 0 THEN o_orderkey % 200 END AS deadline FROM orders),
    d AS (SELECT CAST(n AS INT) AS n, coalesce(sum(CASE WHEN n > 95 THEN 60 ELSE least(n, 10) END) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM range(1, 400) t(n))
    SELECT o_orderkey, n, CAST(first + after AS BIGINT) AS at_second FROM w JOIN d ON first + after <= coalesce(deadline - 1, 300)
    """
)
def refresh_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a waiting operation; those without a deadline up to second 300."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    first = F.when(k % 3 == 0, schedules.FIRST_REFRESH).otherwise(k % 20)
    deadline = F.when(k % 40 == 1, 1200).when(k % 4 > 0, k % 200)
    out = execution.refreshes(rows, "o_orderkey", first, deadline, F.lit(300))
    return out.select("o_orderkey", "n", F.col("at").cast("long").alias("at_second"))


@query(
    """
    WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS sec FROM events),
    p AS (SELECT c.user_id, c.sec, min(d.sec) FILTER (d.sec <= c.sec + 86400) AS done FROM (SELECT DISTINCT user_id, sec FROM e WHERE event_type = 'signup') c
        LEFT JOIN e d ON d.user_id = c.user_id AND d.event_type = 'purchase' AND d.sec >= c.sec GROUP BY ALL)
    SELECT user_id, sec AS created, CASE WHEN done IS NULL THEN 'TIMED_OUT' ELSE 'SUCCEEDED' END AS outcome, coalesce(done - sec, 86400) AS settled_after FROM p
    """
)
def callback_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_seconds(spark, sf_dir)
    of = lambda kind: rows.where(F.col("event_type") == kind).select("user_id", "at")
    return execution.callbacks(of("signup"), of("purchase"), "user_id", 86400).withColumnRenamed("after", "settled_after")


def event_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", at.alias("at"))


@query(
    """
    WITH e AS (SELECT DISTINCT user_id, event_type, epoch_us(ts) // 1000000 AS sec FROM events), last AS (SELECT max(sec) AS sec FROM e),
    b AS (SELECT user_id, sec FROM e WHERE event_type = 'click' UNION ALL SELECT user_id, sec FROM e WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM e WHERE event_type = 'click')),
    g AS (SELECT user_id, sec, coalesce(lead(sec) OVER (PARTITION BY user_id ORDER BY sec), (SELECT sec FROM last)) - sec AS silent FROM b)
    SELECT user_id, min(sec) AS second, arg_min(silent, sec) AS silent FROM g WHERE silent > 172800 GROUP BY user_id
    """
)
def heartbeat_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first click that two days of silence followed, up to the last event; of a user who never clicked, the signup."""
    rows = event_seconds(spark, sf_dir)
    of = lambda kind: rows.where(F.col("event_type") == kind).select("user_id", "at").distinct()
    beats, end = of("click"), rows.agg(F.max("at")).scalar()
    return execution.missed_heartbeats(beats, "user_id", "at", 172800, of("signup").join(beats, "user_id", "left_anti"), end).withColumnRenamed("at", "second")


@query(
    f"""
    WITH o AS (SELECT o_orderkey, {ORDER_STATUS} AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'Callback.Heartbeat' END AS wire, o_orderkey % 29 = 0 AS submit_failed FROM orders)
    SELECT o_orderkey, CASE WHEN submit_failed THEN 'SubmitterFailed' WHEN status = 'TIMED_OUT' AND wire IS NOT NULL THEN 'HeartbeatTimedOut' WHEN status = 'TIMED_OUT' THEN 'TimedOut'
        WHEN status IN ('FAILED', 'CANCELLED', 'STOPPED') THEN 'ExternalFailure' END AS failure FROM o
    """
)
def wait_for_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as callbacks whose ids go to a submitter that can't take every 29th."""
    k = F.col("o_orderkey")
    rows = orders(spark, sf_dir).withColumn("wire", F.when(k % 2 == 0, "Callback.Heartbeat"))
    out = execution.submitted(rows, "o_orderkey", "status", "wire", lambda id: F.when(id % 29 == 0, F.concat(F.lit("no route for "), id.cast("string"))))
    return out.select("o_orderkey", "failure")


@query(f"SELECT o_orderkey, ({ORDER_STATUS}) IN ('SUCCEEDED', 'FAILED', 'CANCELLED', 'TIMED_OUT', 'STOPPED') AS resolves FROM orders")
def rebuild_resolves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", execution.resolves_in_rebuild(F.col("status")).alias("resolves"))


@query(
    f"""
    WITH o AS (SELECT o_orderkey, {ORDER_STATUS} AS status, o_orderkey % 5 = 0 AS updated FROM orders), t AS (SELECT unnest(['step', 'wait', 'invoke', 'create_callback', 'run_in_child_context']) AS op)
    SELECT o_orderkey, op, CASE WHEN status IS NULL AND op = 'step' THEN 'start(false), attempt start' WHEN status IS NULL THEN 'start(false)'
        WHEN op = 'step' THEN CASE status WHEN 'STARTED' THEN 'start(true), attempt start' WHEN 'READY' THEN CASE WHEN o_orderkey % 3 > 0 THEN 'start(true), attempt start' ELSE 'start(false), attempt start' END END
        WHEN status IN ('STARTED', 'PENDING', 'READY') THEN 'start(true)'
        WHEN op = 'wait' AND status = 'SUCCEEDED' OR op IN ('invoke', 'create_callback') AND status IN ('SUCCEEDED', 'FAILED', 'TIMED_OUT', 'STOPPED', 'CANCELLED') THEN CASE WHEN updated THEN 'end(false)' ELSE 'end(true)' END
        END AS hooks FROM o, t
    """
)
def hook_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lifecycle import hooks

    ops = F.explode(F.array(*map(F.lit, ("step", "wait", "invoke", "create_callback", "run_in_child_context")))).alias("op")
    rows = orders(spark, sf_dir).select("o_orderkey", "status", (F.col("o_orderkey") % 5 == 0).alias("updated"), ops)
    return rows.select("o_orderkey", "op", hooks(F.col("op"), F.col("status"), F.col("o_orderkey") % 3 + 1, F.col("updated")).alias("hooks"))


@query(
    """
    WITH u AS (SELECT event_id, user_id, event_type, CASE event_type WHEN 'view' THEN 'START' WHEN 'purchase' THEN 'SUCCEED' WHEN 'error' THEN 'FAIL' WHEN 'click' THEN 'RETRY' WHEN 'signup' THEN 'REPLAY' END AS action, event_id % 11 > 0 AS written FROM events)
    SELECT event_id, CASE action WHEN 'START' THEN 'operation_started' WHEN 'SUCCEED' THEN 'operation_succeeded' WHEN 'FAIL' THEN 'operation_failed' WHEN 'RETRY' THEN 'operation_retry_scheduled' ELSE 'operation_replayed' END AS event,
        action = 'REPLAY' AS is_replay FROM u WHERE action IS NOT NULL AND (written OR action = 'REPLAY')
    """
)
def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lifecycle import emitted

    kind = F.col("event_type")
    action = F.when(kind == "view", "START").when(kind == "purchase", "SUCCEED").when(kind == "error", "FAIL").when(kind == "click", "RETRY").when(kind == "signup", "REPLAY")
    rows = table(spark, sf_dir, "events").select("event_id", action.alias("action"), (F.col("event_id") % 11 > 0).alias("written"))
    return emitted(rows, "action", "written").select("event_id", "event", "is_replay")


@query(
    """
    WITH i AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, event_type FROM events)
    SELECT user_id, n, CASE WHEN n = 1 THEN 'execution_started' ELSE 'execution_resumed' END AS begins, CASE WHEN event_type = 'view' THEN 'execution_suspended' END AS ends,
        n > 1 AND was = 'error' AS is_replay, CASE WHEN NOT (n > 1 AND was = 'error') THEN '{"user":' || user_id || ',"n":' || n || '}' END AS log_line FROM i
    """
)
def execution_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    from ..operators.lifecycle import execution_event, log_line

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(w).alias("n"), F.lag("event_type").over(w).alias("was"))
    begins, ends = execution_event(F.col("n") > 1, F.col("event_type") == "view")
    replay = (F.col("n") > 1) & (F.col("was") == "error")
    fields = F.struct(F.col("user_id").alias("user"), "n")
    return rows.select("user_id", F.col("n").cast("long").alias("n"), begins.alias("begins"), ends.alias("ends"), F.coalesce(replay, F.lit(False)).alias("is_replay"), log_line(replay, fields).alias("log_line"))


@query(
    f"""
    WITH o AS (SELECT o_orderkey, {ORDER_STATUS} AS status, o_orderkey % 2 = 0 AS once, CAST(o_orderkey % 7 AS INT) AS attempt FROM orders)
    SELECT o_orderkey, attempt + 1 AS next_attempt, 'StepInterruptedError' AS error, CASE WHEN attempt + 1 >= 6 THEN 'STOP' ELSE 'RETRY' END AS action,
        CASE WHEN attempt + 1 < 6 THEN CAST(round(least(5.0::DOUBLE * pow(2.0::DOUBLE, attempt), 60.0::DOUBLE)) AS INT) END AS delay FROM o WHERE status = 'STARTED' AND once
    """
)
def interrupted_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    what = execution.interrupted_attempt(F.col("status"), k % 2 == 0, (k % 7).cast("int"), schedules.PRESETS["default"])
    rows = orders(spark, sf_dir).withColumn("x", what).where("x is not null")
    return rows.select("o_orderkey", F.col("x.attempt").alias("next_attempt"), "x.error", "x.action", "x.delay")


@query(
    """
    WITH d AS (SELECT doc_id, repeat(text, 60) AS result FROM documents)
    SELECT doc_id, octet_length(encode(result)) > 262144 AS replay_children, CASE WHEN octet_length(encode(result)) <= 262144 THEN sha256(result) END AS recorded FROM d
    """
)
def child_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.codecs import INLINE_RESULT

    result, replay = execution.child_record(F.repeat("text", F.lit(60)), INLINE_RESULT)
    return table(spark, sf_dir, "documents").select("doc_id", replay.alias("replay_children"), F.sha2(result.cast("binary"), 256).alias("recorded"))


@query(
    """
    WITH a AS (SELECT user_id, event_type = 'error' AS lost, event_id % 10 AS seen, row_number() OVER w AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS losses FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY n) AS attempt, sum(seen) OVER (PARTITION BY user_id, losses ORDER BY n ROWS UNBOUNDED PRECEDING) AS state FROM a WHERE NOT lost),
    e AS (SELECT user_id, min(attempt) FILTER (state >= 25) AS hit, min(attempt) FILTER (attempt >= 7) AS spent, max(attempt) AS last FROM c GROUP BY 1),
    f AS (SELECT user_id, CASE WHEN hit <= coalesce(spent, hit) THEN 'COMPLETE' WHEN spent IS NOT NULL THEN 'MaxChecksExceeded' ELSE 'CONTINUE' END AS outcome, coalesce(least(hit, spent), last) AS checks FROM e)
    SELECT user_id, outcome, checks, CAST((checks - 1) * 5 AS BIGINT) AS waited, CAST(state AS BIGINT) AS state FROM f JOIN c USING (user_id) WHERE attempt = checks
    """
)
def poll_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that add up what they see; an error loses a check, which runs again from 0. The strategy is the caller's."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 10).alias("seen"), (F.col("event_type") == "error").alias("lost"))
    states = execution.checked(rows, "user_id", "event_id", "seen", "lost", F.lit(0).cast("long"))
    how = lambda state, attempt: F.struct(
        F.when(state >= 25, "COMPLETE").when(attempt >= 7, "EXHAUSTED").otherwise("CONTINUE").alias("action"), F.lit(4.5).alias("delay")
    )
    out = execution.polled_by(states, "user_id", "attempt", "state", how)
    return out.select("user_id", "outcome", "checks", "waited", "state")


@query(
    """
    WITH c AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt, o_orderstatus = 'F' AS done FROM orders)
    SELECT o_orderkey, attempt, CASE WHEN done THEN 'COMPLETE' WHEN attempt >= 5 THEN 'EXHAUSTED' ELSE 'CONTINUE' END AS action,
        CASE WHEN NOT done AND attempt < 5 THEN CAST(round(least(5.0::DOUBLE * pow(1.5::DOUBLE, attempt - 1), 300.0::DOUBLE)) AS INT) END AS delay FROM c
    """
)
def poll_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "orders").withColumn("attempt", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long"))
    decision = schedules.poll_decision(F.col("o_orderstatus") == "F", F.col("attempt"), schedules.Backoff(5, 5.0, 300.0, 1.5))
    return rows.withColumn("d", decision).select("o_orderkey", "attempt", "d.action", "d.delay")


@query(
    """
    SELECT o_orderkey, o_orderstatus = 'F' AS is_replay, CASE WHEN o_orderstatus = 'F' THEN 'kept ' || o_custkey ELSE lower(o_orderpriority) END AS value,
        o_orderpriority AS passed, '{"key":' || o_orderkey || ',"who":"' || o_custkey || '"}' AS sent FROM orders
    """
)
def codec_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with a caller's codec that loses case: a live value is read back from what is recorded. Inputs pass as they are or are only written."""
    from ..functions import codecs

    rows = table(spark, sf_dir, "orders")
    codec = codecs.Codec(lambda value: F.base64(F.lower(value).cast("binary")), lambda text: F.unbase64(text).cast("string"))
    held = F.base64(F.concat(F.lit("kept "), "o_custkey").cast("binary"))
    log = rows.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("STARTED").alias("status"), held.alias("result"))
    out = execution.stepped(rows.select("o_orderkey", "o_custkey", "o_orderpriority"), log, "o_orderkey", F.col("o_orderpriority"), codec=codec)
    one_way = codecs.Codec(F.to_json)
    passed = codecs.PASSTHROUGH.read(codecs.PASSTHROUGH.write(F.col("o_orderpriority")))
    sent = one_way.write(F.struct(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("who")))
    return out.select("o_orderkey", "is_replay", "value", passed.alias("passed"), sent.alias("sent"))


@query(
    """
    WITH u AS (SELECT *, CASE event_type WHEN 'view' THEN 'operation_started' WHEN 'purchase' THEN 'operation_succeeded' WHEN 'error' THEN 'operation_failed' WHEN 'click' THEN 'operation_retry_scheduled' ELSE 'operation_replayed' END AS m FROM events)
    SELECT event_id, '{"message":"' || m || '","executionArn":"user-' || user_id || '","operationId":"' || sha256(CAST(event_id % 8 AS VARCHAR)) || '"' || CASE WHEN event_id % 4 > 0 THEN ',"operationName":"slot ' || event_id % 8 || '"' ELSE '' END
        || ',"operationType":"Step","attempt":' || event_id % 5 + 1 || ',"isReplay":' || CASE m WHEN 'operation_replayed' THEN 'true' ELSE 'false' END
        || CASE WHEN m = 'operation_retry_scheduled' THEN ',"delaySeconds":' || event_id % 60 ELSE '' END || CASE WHEN m IN ('operation_retry_scheduled', 'operation_failed') THEN ',"error":"lost ' || event_id || '"' ELSE '' END || '}' AS record FROM u
    """
)
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import identity
    from ..operators import lifecycle

    kind, n = F.col("event_type"), F.col("event_id")
    action = F.when(kind == "view", "START").when(kind == "purchase", "SUCCEED").when(kind == "error", "FAIL").when(kind == "click", "RETRY").otherwise("REPLAY")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", action.alias("action"), F.lit(True).alias("written"))
    fields = {
        "executionArn": F.concat(F.lit("user-"), F.col("user_id").cast("string")),
        "operationId": identity.wire_id((n % 8).cast("string")),
        "operationName": F.when(n % 4 > 0, F.concat(F.lit("slot "), (n % 8).cast("string"))),
        "operationType": F.lit("Step"),
        "attempt": n % 5 + 1,
        "isReplay": F.col("is_replay"),
        "delaySeconds": n % 60,
        "error": F.concat(F.lit("lost "), n.cast("string")),
    }
    return lifecycle.emitted(rows, "action", "written").select("event_id", lifecycle.event_record(F.col("event"), fields).alias("record"))


@query(
    """
    WITH u AS (SELECT user_id, event_id, event_id % 6 AS op, epoch_us(ts) // 604800000000 AS invocation, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
        CASE event_type WHEN 'click' THEN 'RETRY' WHEN 'purchase' THEN 'SUCCEED' WHEN 'error' THEN 'FAIL' ELSE 'START' END AS action FROM events),
    v AS (SELECT *, count(*) FILTER (action IN ('SUCCEED', 'FAIL')) OVER (PARTITION BY user_id, op ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM u),
    w AS (SELECT *, lag(invocation) OVER o AS prior, lag(action) OVER o AS was FROM v WHERE over = 0 WINDOW o AS (PARTITION BY user_id, op ORDER BY n)),
    x AS (SELECT *, prior IS NULL OR prior <> invocation AS fresh, op < 4 AND (prior IS NULL OR prior <> invocation OR was = 'RETRY') AS tries FROM w),
    y AS (SELECT *, sum(CASE WHEN tries THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, op ORDER BY n) AS attempt, row_number() OVER r = 1 AS head, lead(n) OVER r IS NULL AS tail,
        invocation > min(invocation) OVER (PARTITION BY user_id) AS again, CASE action WHEN 'SUCCEED' THEN 'SUCCEEDED' WHEN 'FAIL' THEN 'FAILED' END AS outcome FROM x WINDOW r AS (PARTITION BY user_id, invocation ORDER BY n)),
    h AS (SELECT user_id, invocation, n, 0 AS place, 'on_invocation_start' AS hook, NULL AS op, NULL AS attempt, again AS is_replay, NULL AS outcome FROM y WHERE head
        UNION ALL SELECT user_id, invocation, n, 1, 'on_operation_start', op, NULL, prior IS NOT NULL, NULL FROM y WHERE fresh
        UNION ALL SELECT user_id, invocation, n, 2, 'on_attempt_start', op, attempt, false, NULL FROM y WHERE tries
        UNION ALL SELECT user_id, invocation, n, 3, 'on_attempt_end', op, attempt, false, coalesce(outcome, 'RETRY') FROM y WHERE op < 4 AND action <> 'START'
        UNION ALL SELECT user_id, invocation, n, 4, 'on_operation_end', op, NULL, false, outcome FROM y WHERE outcome IS NOT NULL
        UNION ALL SELECT user_id, invocation, n, 5, 'on_invocation_end', NULL, NULL, again, NULL FROM y WHERE tail)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY n, place) AS number, invocation, hook, op, CAST(attempt AS BIGINT) AS attempt, is_replay, outcome FROM h
    """
)
def hook_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as updates of six operations, a week being an invocation; two of the operations know no attempts."""
    from ..operators import lifecycle

    kind = F.col("event_type")
    action = F.when(kind == "click", "RETRY").when(kind == "purchase", "SUCCEED").when(kind == "error", "FAIL").otherwise("START")
    week = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 604800000000")
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 6).alias("op"), week.alias("invocation"), F.struct("ts", "event_id").alias("at"), action.alias("action"))
    return lifecycle.hook_timeline(rows, "user_id", "op", "invocation", "at", "action", F.col("op") < 4)
