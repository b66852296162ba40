"""Batches and combinators: users' events and orders' lines as items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import batch, combinators, timeline
from .registry import query, table

#: A total order of an order's lines.
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
LINE_POLICY = batch.Policy(min_successful=3, tolerated_failures=1)
LINES_SQL = f"""lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE)}) - 1 AS idx,
    l_returnflag <> 'R' AS ok FROM lineitem)"""
EVENTS_SQL = """items AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
    event_type <> 'error' AS ok, event_type FROM events),
    run AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS total,
        sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS n_ok, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS n_failed
        FROM items WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING))"""


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", (F.col("event_type") != "error").alias("ok"))
    return batch.numbered(events, "user_id", ["ts", "event_id"])


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("ok", F.col("l_returnflag") != "R")
    return batch.numbered(lines, "l_orderkey", LINE)


def _ended(case: str) -> str:
    return f"""
    WITH {EVENTS_SQL}, judged AS (SELECT *, {case} AS reason FROM run)
    SELECT user_id, arg_min(reason, idx) AS reason, min(idx) + 1 AS settled, arg_min(n_ok, idx) AS n_ok, arg_min(n_failed, idx) AS n_failed,
        any_value(total) AS total FROM judged WHERE reason IS NOT NULL GROUP BY user_id
    """


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


@query(
    _ended(
        """CASE WHEN n_failed * 100.0::DOUBLE > 25.0::DOUBLE * total THEN 'FAILURE_TOLERANCE_EXCEEDED' WHEN n_ok + n_failed >= total THEN 'ALL_COMPLETED'
        WHEN n_ok >= 5 THEN 'MIN_SUCCESSFUL_REACHED' END"""
    )
)
def batch_completion_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(batch.completed(event_items(spark, sf_dir), "user_id", "ok", batch.Policy(min_successful=5, tolerated_percentage=25.0)))


@query(
    _ended(
        """CASE WHEN n_failed * 100.0::DOUBLE > 25.0::DOUBLE * total THEN 'FAILURE_TOLERANCE_EXCEEDED' WHEN n_ok + n_failed >= total THEN 'ALL_COMPLETED'
        WHEN n_ok >= 5 THEN 'MIN_SUCCESSFUL_REACHED' END"""
    )
)
def batch_completion_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for batches of which one may hold a large part of all items."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return batch.completed_spread(events, "user_id", "ok", batch.Policy(min_successful=5, tolerated_percentage=25.0), ["ts", "event_id"])


@query(_ended("CASE WHEN n_failed > 0 THEN 'FAILURE_TOLERANCE_EXCEEDED' WHEN n_ok + n_failed >= total THEN 'ALL_COMPLETED' END"))
def batch_fail_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(batch.completed(event_items(spark, sf_dir), "user_id", "ok", batch.Policy()))


@query(_ended("CASE WHEN n_failed > 3 THEN 'FAILURE_TOLERANCE_EXCEEDED' WHEN n_ok + n_failed >= total THEN 'ALL_COMPLETED' END"))
def batch_tolerated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(batch.completed(event_items(spark, sf_dir), "user_id", "ok", batch.Policy(tolerated_failures=3)))


@query(_ended("CASE WHEN n_ok + n_failed >= total THEN 'ALL_COMPLETED' WHEN n_ok >= 20 THEN 'MIN_SUCCESSFUL_REACHED' END"))
def batch_min_successful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(batch.completed(event_items(spark, sf_dir), "user_id", "ok", batch.Policy(min_successful=20)))


@query(
    """
    WITH b AS (SELECT l_orderkey AS batch, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS n_failed FROM lineitem GROUP BY 1
        UNION ALL VALUES (-1, 50, 7), (-2, 50, 8), (-3, 4, 1))
    SELECT batch, total, n_failed, n_failed * 100.0::DOUBLE > 14.0::DOUBLE * total AS exceeds_14, n_failed * 100.0::DOUBLE > 25.0::DOUBLE * total AS exceeds_25 FROM b
    """
)
def batch_pct_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("n_failed")
    )
    edges = spark.sql("SELECT * FROM VALUES (-1L, 50L, 7L), (-2L, 50L, 8L), (-3L, 4L, 1L) AS t(batch, total, n_failed)")
    over = lambda p: batch.Policy(tolerated_percentage=p).exceeded(F.col("n_failed"), F.col("total"))
    return counts.unionByName(edges).select("batch", "total", "n_failed", over(14.0).alias("exceeds_14"), over(25.0).alias("exceeds_25"))


@query(
    f"""
    WITH {EVENTS_SQL}, f AS (SELECT user_id, idx, total, bool_or(idx = 0 AND ok) OVER w AS a, bool_or(idx = 1 AND ok) OVER w AS b, bool_or(idx = 2 AND ok) OVER w AS c
        FROM run WINDOW w AS (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT user_id, min(idx + 1) FILTER (a OR (b AND c)) AS hit, any_value(total) AS total FROM f GROUP BY user_id)
    SELECT user_id, CASE WHEN hit IS NULL THEN 'ALL_COMPLETED' ELSE 'CUSTOM_COMPLETION_SUCCEEDED' END AS reason, coalesce(hit, total) AS settled FROM e
    """
)
def batch_predicate_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = lambda i: (F.col("idx") == i) & F.col("ok")
    states = {"a": fine(0), "b": fine(1), "c": fine(2)}
    return _shown(batch.completed_by_rule(event_items(spark, sf_dir), "user_id", states, F.col("a") | (F.col("b") & F.col("c"))))


@query(
    """
    WITH c AS (SELECT user_id, count(*) FILTER (event_type NOT IN ('error', 'view')) AS n_ok, count(*) FILTER (event_type = 'error') AS n_failed, count(*) AS total FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN n_failed > 12 THEN 'FAILURE_TOLERANCE_EXCEEDED' WHEN n_ok + n_failed >= total THEN 'ALL_COMPLETED' WHEN n_ok >= 38 THEN 'MIN_SUCCESSFUL_REACHED' END AS reason,
        n_ok, n_failed, total FROM c
    """
)
def batch_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") != "view", F.col("event_type") != "error")
    items = table(spark, sf_dir, "events").select("user_id", outcome.alias("ok"))
    return batch.resumed(items, "user_id", "ok", batch.Policy(min_successful=38, tolerated_failures=12))


@query(
    f"""
    WITH {LINES_SQL}, run AS (SELECT l_orderkey, idx, count(*) OVER (PARTITION BY l_orderkey) AS total, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS n_ok, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS n_failed
        FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY idx ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT l_orderkey, arg_min(CASE WHEN n_failed > 1 THEN 'FAILURE_TOLERANCE_EXCEEDED' WHEN n_ok + n_failed >= total THEN 'ALL_COMPLETED' ELSE 'MIN_SUCCESSFUL_REACHED' END, idx) AS reason,
        arg_min(n_ok, idx) AS n_ok, arg_min(n_failed, idx) AS n_failed, any_value(total) AS total FROM run WHERE n_failed > 1 OR n_ok + n_failed >= total OR n_ok >= 3 GROUP BY 1)
    SELECT o_orderkey AS l_orderkey, coalesce(reason, 'ALL_COMPLETED') AS reason, CAST(coalesce(n_ok + n_failed, 0) AS BIGINT) AS settled, CAST(coalesce(n_ok, 0) AS BIGINT) AS n_ok, CAST(coalesce(n_failed, 0) AS BIGINT) AS n_failed, coalesce(total, 0) AS total
    FROM orders LEFT JOIN e ON l_orderkey = o_orderkey
    """
)
def batch_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as batches of their lines; those without lines complete at once."""
    batches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return _shown(batch.completed(line_items(spark, sf_dir), "l_orderkey", "ok", LINE_POLICY, batches=batches))


@query(
    f"""
    WITH {LINES_SQL}, run AS (SELECT l_orderkey, idx, count(*) OVER (PARTITION BY l_orderkey) AS total, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS n_ok, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS n_failed
        FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY idx ROWS UNBOUNDED PRECEDING) UNION ALL
        SELECT o_orderkey, -1, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey), 0, 0 FROM orders),
    e AS (SELECT l_orderkey, arg_min(CASE WHEN n_ok >= 3 THEN 'CUSTOM_COMPLETION_SUCCEEDED' WHEN total - n_failed < 3 THEN 'CUSTOM_COMPLETION_FAILED' END, idx) AS reason,
        arg_min(n_ok, idx) AS n_ok, arg_min(n_failed, idx) AS n_failed, any_value(total) AS total FROM run WHERE n_ok >= 3 OR total - n_failed < 3 GROUP BY 1)
    SELECT l_orderkey, reason, CAST(n_ok + n_failed AS BIGINT) AS settled, CAST(n_ok AS BIGINT) AS n_ok, CAST(n_failed AS BIGINT) AS n_failed, total FROM e
    """
)
def batch_predicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines have to succeed: a batch succeeds with the third, and fails as soon as too few are left."""
    batches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    decide = lambda s: F.when(s.succeeded >= 3, "SUCCEEDED").when(s.total - s.failed < 3, "FAILED")
    return _shown(batch.completed_by_counts(line_items(spark, sf_dir), "l_orderkey", "ok", decide, batches=batches))


LINES_ENDED = f"""{LINES_SQL}, run AS (SELECT l_orderkey, idx, ok, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS total,
        sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS n_ok, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS n_failed
        FROM lines WINDOW w AS (PARTITION BY l_orderkey ORDER BY idx ROWS UNBOUNDED PRECEDING)),
    judged AS (SELECT *, CASE WHEN n_failed > 1 THEN 'FAILURE_TOLERANCE_EXCEEDED' WHEN n_ok + n_failed >= total THEN 'ALL_COMPLETED' WHEN n_ok >= 3 THEN 'MIN_SUCCESSFUL_REACHED' END AS reason FROM run),
    ended AS (SELECT l_orderkey, min(idx) + 1 AS settled, arg_min(reason, idx) AS reason FROM judged WHERE reason IS NOT NULL GROUP BY 1),
    st AS (SELECT j.l_orderkey, j.idx, j.l_partkey, e.reason, CASE WHEN j.idx >= settled THEN 'STARTED' WHEN ok THEN 'SUCCEEDED' ELSE 'FAILED' END AS status FROM judged j JOIN ended e USING (l_orderkey))"""


@query(
    f"""
    WITH {LINES_ENDED}
    SELECT l_orderkey, count(*) AS total_count, count(*) FILTER (status = 'SUCCEEDED') AS success_count, count(*) FILTER (status = 'FAILED') AS failure_count,
        count(*) FILTER (status = 'STARTED') AS started_count, count(*) FILTER (status = 'FAILED') > 0 AS has_failure,
        CASE WHEN count(*) FILTER (status = 'FAILED') > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
        string_agg(CASE status WHEN 'SUCCEEDED' THEN 'S' WHEN 'FAILED' THEN 'F' ELSE '-' END, '' ORDER BY idx) AS item_statuses, any_value(reason) AS reason
    FROM st GROUP BY l_orderkey
    """
)
def batch_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_views(spark, sf_dir, True).drop("results", "first_failed")


def _line_views(spark: SparkSession, sf_dir: str, concurrent: bool) -> DataFrame:
    items = batch.with_end(line_items(spark, sf_dir), "l_orderkey", "ok", LINE_POLICY)
    return batch.views(batch.item_status(items, "ok", concurrent), "l_orderkey", "l_partkey", "reason")


@query(
    f"""
    WITH {LINES_ENDED}
    SELECT l_orderkey, any_value(reason) AS reason,
        CASE WHEN any_value(reason) <> 'FAILURE_TOLERANCE_EXCEEDED' THEN coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY idx) FILTER (status = 'SUCCEEDED'), '') END AS batch_values,
        CASE WHEN any_value(reason) = 'FAILURE_TOLERANCE_EXCEEDED' THEN min(idx) FILTER (status = 'FAILED') END AS failed_item, count(*) AS recorded
    FROM st WHERE status <> 'STARTED' GROUP BY l_orderkey
    """
)
def batch_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("reason") == batch.TOO_MANY
    return _line_views(spark, sf_dir, False).select(
        "l_orderkey",
        "reason",
        F.when(~failed, F.array_join(F.transform("results", lambda x: x.cast("string")), ",")).alias("batch_values"),
        F.when(failed, F.col("first_failed").cast("long")).alias("failed_item"),
        F.col("total_count").alias("recorded"),
    )


@query(
    f"""
    WITH {LINES_SQL}, p AS (SELECT l_orderkey, idx, CAST(l_orderkey AS VARCHAR) || '-' || CAST(idx + 1 AS VARCHAR) AS pos FROM lines)
    SELECT pos AS "positional", sha256(pos) AS wire_id, sha256(CAST(l_orderkey AS VARCHAR)) AS parent_id FROM p
    """
)
def batch_item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("l_orderkey").cast("string")
    rows = line_items(spark, sf_dir).select(own.alias("parent"), identity.child_id(own, F.col("idx") + 1).alias("positional"))
    return rows.select("positional", identity.wire_id(F.col("positional")).alias("wire_id"), identity.wire_id(F.col("parent")).alias("parent_id"))


@query(
    f"""
    WITH {LINES_SQL}
    SELECT l_orderkey, idx, coalesce(nullif(CASE l_linestatus WHEN 'O' THEN '' WHEN 'F' THEN l_returnflag END, ''), 'map-item-' || idx) AS item_name,
        coalesce(nullif(CASE l_linestatus WHEN 'F' THEN '' END, ''), 'parallel-branch-' || idx) AS branch_name FROM lines
    """
)
def batch_item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("l_linestatus") == "O", "").when(F.col("l_linestatus") == "F", F.col("l_returnflag"))
    empty = F.when(F.col("l_linestatus") == "F", "")
    return line_items(spark, sf_dir).select(
        "l_orderkey",
        F.col("idx").cast("long").alias("idx"),
        batch.item_name(given, F.col("idx")).alias("item_name"),
        batch.item_name(empty, F.col("idx"), "parallel-branch").alias("branch_name"),
    )


@query(
    f"""
    WITH {LINES_SQL}, p AS (SELECT CAST(l_orderkey AS VARCHAR) AS b, CAST(l_orderkey AS VARCHAR) || '-' || CAST(idx + 1 AS VARCHAR) AS item FROM lines),
    i AS (SELECT b, item, item || '-' || unnest(range(1, 3)) AS op FROM p)
    SELECT 'normal' AS mode, item AS op, b AS parent FROM p UNION ALL SELECT 'normal', op, item FROM i UNION ALL SELECT 'flat', op, b FROM i
    """
)
def batch_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = line_items(spark, sf_dir).select("l_orderkey", "idx")
    of = lambda mode, flat: batch.item_records(items, "l_orderkey", 2, flat).select(F.lit(mode).alias("mode"), "op", "parent")
    return of("normal", False).union(of("flat", True))


@query(
    f"""
    WITH {LINES_SQL}, r AS (SELECT l_orderkey, count(*) AS items, '[' || string_agg('"' || l_partkey || '"', ',' ORDER BY idx) || ']' AS record FROM lines GROUP BY 1)
    SELECT l_orderkey, items, length(record) AS record_bytes, length(record) > 24 AS replay_children FROM r
    """
)
def batch_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose results are too large for a record of 24 bytes."""
    items = line_items(spark, sf_dir).withColumns({"status": F.lit("SUCCEEDED"), "part": F.col("l_partkey").cast("string")})
    rows = batch.views(items, "l_orderkey", "part").withColumn("record", F.to_json("results"))
    return rows.select("l_orderkey", F.col("total_count").alias("items"), F.octet_length("record").cast("long").alias("record_bytes"), batch.oversized(F.col("record"), 24).alias("replay_children"))


#: Recorded times of lines: they start when shipped and take their quantity in days.
TIMES_SQL = f"""{LINES_SQL}, t AS (SELECT l_orderkey, idx, ok, epoch_us(l_shipdate) // 1000000 AS started, epoch_us(l_shipdate) // 1000000 + 86400 * CAST(l_quantity AS BIGINT) AS settled FROM lines)"""


def timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    started = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)")
    rows = line_items(spark, sf_dir).select("l_orderkey", "idx", "ok", "l_quantity", started.alias("started"))
    return rows.select("l_orderkey", "idx", "ok", "started", (F.col("started") + 86400 * F.col("l_quantity").cast("long")).alias("settled"))


@query(
    f"""
    WITH {TIMES_SQL}, e AS (SELECT l_orderkey, started AS sec, 1 AS change FROM t UNION ALL SELECT l_orderkey, settled, -1 FROM t),
    s AS (SELECT l_orderkey, sum(change) OVER (PARTITION BY l_orderkey ORDER BY sec, change ROWS UNBOUNDED PRECEDING) AS running FROM e)
    SELECT l_orderkey, CAST(max(running) AS BIGINT) AS most, max(running) <= 2 AS within_two FROM s GROUP BY 1
    """
)
def batch_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots that recorded times show in use, against a limit of two."""
    out = batch.at_once(timed_lines(spark, sf_dir), "l_orderkey", "started", "settled")
    return out.select("l_orderkey", F.col("most").cast("long").alias("most"), (F.col("most") <= 2).alias("within_two"))


@query(
    f"""
    WITH {LINES_SQL}, s AS (SELECT l_orderkey, idx, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY idx ROWS UNBOUNDED PRECEDING) AS settled, CAST(l_quantity AS BIGINT) AS q FROM lines)
    SELECT l_orderkey, idx, CAST(settled - q AS BIGINT) AS started, CAST(settled AS BIGINT) AS settled FROM s
    """
)
def batch_one_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = line_items(spark, sf_dir).select("l_orderkey", F.col("idx").cast("long").alias("idx"), F.col("l_quantity").cast("long").alias("seconds"))
    return batch.one_slot(items, "l_orderkey", "seconds").drop("seconds")


@query(
    """
    SELECT 0 AS branch_idx, 'customers' AS branch_name, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY c_nationkey
    UNION ALL SELECT 1, 'suppliers', s_nationkey, count(*) FROM supplier GROUP BY s_nationkey
    """
)
def parallel_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = lambda name, key: table(spark, sf_dir, name).groupBy(F.col(key).alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return batch.branches({"customers": by("customer", "c_nationkey"), "suppliers": by("supplier", "s_nationkey")})


@query(
    """
    SELECT 0 AS branch_idx, 'regions' AS branch_name, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS payload FROM region
    UNION ALL SELECT 1, 'parallel-branch-1', '{"brand":"' || p_brand || '","n":' || count(*) || '}' FROM part GROUP BY p_brand
    """
)
def parallel_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    return batch.mixed_branches({"regions": table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "": brands})


@query(
    """
    SELECT user_id, unnest(range(5)) AS idx, user_id * 10 + unnest(range(5)) AS value FROM (SELECT DISTINCT user_id FROM events)
    """
)
def map_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("steps", F.sequence(F.lit(0), F.lit(4)))
    rows = batch.mapped(users, "user_id", lambda item, idx: F.col("user_id") * 10 + item, "steps")
    return rows.select("user_id", F.col("idx").cast("long").alias("idx"), "value")


def settled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_items(spark, sf_dir).withColumn("settle", F.struct("l_shipdate", "idx"))


SETTLED_SQL = f"{LINES_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, idx) AS settle FROM lines)"


@query(
    f"""
    WITH {SETTLED_SQL}
    SELECT l_orderkey, count(*) FILTER (NOT ok) = 0 AS ok, arg_min(idx, settle) FILTER (NOT ok) AS failed_index,
        CASE WHEN count(*) FILTER (NOT ok) = 0 THEN string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY idx) END AS all_values FROM s GROUP BY l_orderkey
    """
)
def try_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = combinators.try_join_all(settled_lines(spark, sf_dir), "l_orderkey", "l_partkey")
    joined = F.array_join(F.transform("values", lambda x: x.cast("string")), ",")
    return out.select("l_orderkey", "ok", F.col("failed_index").cast("long").alias("failed_index"), joined.alias("all_values"))


@query(
    f"""
    WITH {SETTLED_SQL}
    SELECT l_orderkey, string_agg((CASE WHEN ok THEN 'ok:' ELSE 'error:' END) || CAST(l_partkey AS VARCHAR), ',' ORDER BY idx) AS outcomes FROM s GROUP BY l_orderkey
    """
)
def join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda x: F.concat(F.when(x["ok"], "ok:").otherwise("error:"), x["value"].cast("string"))
    out = combinators.join_all(settled_lines(spark, sf_dir), "l_orderkey", "l_partkey")
    return out.select("l_orderkey", F.array_join(F.transform("outcomes", one), ",").alias("outcomes"))


@query(
    f"""
    WITH {SETTLED_SQL}
    SELECT l_orderkey, arg_min(idx, settle) FILTER (ok) AS winner, arg_min(l_partkey, settle) FILTER (ok) AS value,
        CASE WHEN count(*) FILTER (ok) = 0 THEN string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) END AS losers FROM s GROUP BY l_orderkey
    """
)
def select_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = combinators.select_ok(settled_lines(spark, sf_dir), "l_orderkey", "l_partkey")
    losers = F.array_join(F.transform("losers", lambda x: x.cast("string")), ",")
    return out.select("l_orderkey", F.col("winner").cast("long").alias("winner"), "value", losers.alias("losers"))


@query(f"WITH {SETTLED_SQL} SELECT l_orderkey, arg_min(idx, settle) AS winner, arg_min(ok, settle) AS ok, arg_min(l_partkey, settle) AS value FROM s GROUP BY l_orderkey")
def race(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = combinators.race(settled_lines(spark, sf_dir), "l_orderkey", "l_partkey")
    return out.withColumn("winner", F.col("winner").cast("long"))


@query(
    f"""
    WITH {SETTLED_SQL}
    SELECT l_orderkey, idx FROM s WHERE settle > 1 AND l_linestatus = 'O'
    """
)
def race_losers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled_lines(spark, sf_dir).withColumn("spawned", F.col("l_linestatus") != "O")
    won = combinators.race(rows, "l_orderkey", "l_partkey")
    return combinators.stopped(rows, won, "l_orderkey", "spawned").select("l_orderkey", F.col("idx").cast("long").alias("idx"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def combinator_empty_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return combinators.empty_input(orders, table(spark, sf_dir, "lineitem"), "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey")


@query(
    f"""
    WITH {SETTLED_SQL}, w AS (SELECT l_orderkey, arg_min(idx, settle) AS winner, CAST(sum(l_quantity) AS BIGINT) AS size FROM s GROUP BY l_orderkey)
    SELECT l_orderkey, CASE WHEN size > 150 THEN '{{"winner":' || winner || '}}' END AS record FROM w
    """
)
def winner_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled_lines(spark, sf_dir)
    sizes = rows.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("size"))
    won = combinators.race(rows, "l_orderkey", "l_partkey").join(sizes, "l_orderkey")
    return won.select("l_orderkey", combinators.winner_record(F.col("size"), F.col("winner"), 150).alias("record"))


@query(
    f"""
    WITH {TIMES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY settled, idx) AS place FROM t),
    run AS (SELECT l_orderkey, place, count(*) OVER (PARTITION BY l_orderkey) AS total, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w AS n_ok, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS n_failed
        FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY place ROWS UNBOUNDED PRECEDING))
    SELECT l_orderkey, arg_min(CASE WHEN n_failed > 1 THEN 'FAILURE_TOLERANCE_EXCEEDED' WHEN n_ok + n_failed >= total THEN 'ALL_COMPLETED' ELSE 'MIN_SUCCESSFUL_REACHED' END, place) AS reason,
        min(place) AS settled, CAST(arg_min(n_ok, place) AS BIGINT) AS n_ok, CAST(arg_min(n_failed, place) AS BIGINT) AS n_failed, any_value(total) AS total
    FROM run WHERE n_failed > 1 OR n_ok + n_failed >= total OR n_ok >= 3 GROUP BY 1
    """
)
def batch_concurrent_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy over the order in which recorded times let lines settle."""
    rows = timed_lines(spark, sf_dir).withColumn("settle", F.struct("settled", "idx"))
    return _shown(batch.completed(rows, "l_orderkey", "ok", LINE_POLICY, "settle"))


@query(
    f"""
    WITH {LINES_ENDED}, v AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (status = 'SUCCEEDED') AS good, count(*) FILTER (status = 'FAILED') AS bad, count(*) FILTER (status = 'STARTED') AS open,
        string_agg(CASE status WHEN 'SUCCEEDED' THEN 'S' WHEN 'FAILED' THEN 'F' ELSE '-' END, '' ORDER BY idx) AS marks, any_value(reason) AS reason FROM st GROUP BY l_orderkey)
    SELECT l_orderkey, '{{"type":"MapResult","totalCount":' || n || ',"successCount":' || good || ',"failureCount":' || bad || ',"startedCount":' || open || ',"completionReason":"' || reason
        || '","status":"' || CASE WHEN bad > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END || '","itemStatuses":"' || marks || '","summary":"' || good || ' of ' || n || '"}}' AS record FROM v
    """
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("success_count").cast("string"), F.lit(" of "), F.col("total_count").cast("string"))
    return _line_views(spark, sf_dir, True).select("l_orderkey", batch.summary_record("MapResult", F.col("reason"), text).alias("record"))


@query("SELECT l_orderkey, count(*) + 1 AS number, sha256(CAST(count(*) + 1 AS VARCHAR)) AS wire_id FROM lineitem GROUP BY l_orderkey")
def combinator_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import log

    out = log.minted_last(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return out.withColumn("wire_id", identity.wire_id(F.col("number").cast("string")))


#: Lines with recorded times: days at which they started and settled. Lines of the first weeks settle at once, some never do.
SWEPT = {
    "started": "datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) - l_partkey % 7",
    "settled": "CASE WHEN l_suppkey % 41 > 0 THEN datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + l_partkey % 3 * (l_suppkey % 60) - l_partkey % 7 END",
}
SWEPT_SQL = f"""{LINES_SQL}, timed AS (SELECT l_orderkey AS o, idx, ok, {SWEPT["started"]} AS started, {SWEPT["settled"]} AS settled, 'line ' || l_partkey AS err, l_quantity > 25 AS big FROM lines),
    m AS (SELECT o, idx, ok, err, big, started AS tm, 1 AS what FROM timed UNION ALL SELECT o, idx, ok, err, big, settled, CASE WHEN settled = started THEN 2 ELSE 0 END FROM timed WHERE settled IS NOT NULL),
    n AS (SELECT o, count(*) AS total, count(*) FILTER (big) AS big_total FROM timed GROUP BY o),
    s AS (SELECT m.*, total, big_total, sum(CASE WHEN what = 1 THEN 1 ELSE -1 END) OVER w - CASE WHEN what = 1 THEN 1 ELSE 0 END AS n_running,
        sum(CASE WHEN what <> 1 AND ok THEN 1 ELSE 0 END) OVER w AS n_ok, sum(CASE WHEN what <> 1 AND NOT ok THEN 1 ELSE 0 END) OVER w AS n_failed,
        sum(CASE WHEN what <> 1 AND ok AND big THEN 1 ELSE 0 END) OVER w AS big_ok, sum(CASE WHEN what <> 1 AND idx = 0 AND NOT ok THEN 1 ELSE 0 END) OVER w AS head_failed,
        min(CASE WHEN what <> 1 AND NOT ok THEN idx END) OVER w AS bad_idx
        FROM m JOIN n USING (o) WINDOW w AS (PARTITION BY o ORDER BY tm, what, idx ROWS UNBOUNDED PRECEDING))"""


def swept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    started = day - F.col("l_partkey") % 7
    settled = F.when(F.col("l_suppkey") % 41 > 0, day + F.col("l_partkey") % 3 * (F.col("l_suppkey") % 60) - F.col("l_partkey") % 7)
    error = F.concat(F.lit("line "), F.col("l_partkey").cast("string"))
    return line_items(spark, sf_dir).select("l_orderkey", "idx", "ok", started.alias("started"), settled.alias("settled"), error.alias("err"), (F.col("l_quantity") > 25).alias("big"))


@query(
    f"""
    WITH {SWEPT_SQL}, j AS (SELECT *, CASE WHEN total >= 9 OR head_failed > 0 OR n_failed >= 3 THEN 'CUSTOM_COMPLETION_FAILED' WHEN big_total > 0 AND big_ok = big_total AND 2 * (n_ok + n_failed) >= total THEN 'CUSTOM_COMPLETION_SUCCEEDED'
            WHEN what <> 1 AND n_ok + n_failed = total THEN 'ALL_COMPLETED' END AS reason FROM s),
    e AS (SELECT o, arg_min({{'reason': reason, 'n_running': n_running, 'n_ok': n_ok, 'n_failed': n_failed, 'bad': bad_idx, 'what': what, 'tm': tm}}, {{'tm': tm, 'what': what, 'idx': idx}}) AS e FROM j WHERE reason IS NOT NULL GROUP BY o)
    SELECT o_orderkey, CASE WHEN total IS NULL THEN 'ALL_COMPLETED' ELSE e.reason END AS reason,
        CASE WHEN total IS NULL THEN 'SUCCEEDED' WHEN e.reason IS NULL THEN 'STARTED' WHEN e.reason = 'CUSTOM_COMPLETION_FAILED' OR e.n_failed > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
        CASE WHEN e.reason = 'CUSTOM_COMPLETION_FAILED' THEN coalesce(t.err, 'BatchCompletionFailed') END AS error, coalesce(total, 0) AS total,
        CAST(CASE WHEN total IS NULL THEN 0 ELSE e.n_running END AS BIGINT) AS n_running, CAST(CASE WHEN total IS NULL THEN 0 ELSE e.n_ok END AS BIGINT) AS n_ok,
        CAST(CASE WHEN total IS NULL THEN 0 ELSE e.n_failed END AS BIGINT) AS n_failed, CAST(e.tm AS BIGINT) AS ended_on, e.what = 1 AS before_a_start
    FROM orders LEFT JOIN n ON n.o = o_orderkey LEFT JOIN e ON e.o = o_orderkey LEFT JOIN timed t ON t.o = o_orderkey AND t.idx = e.bad
    """
)
def batch_predicate_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule over items: no order of nine lines or more is begun, one fails with its first line or with three; it is done when all its big lines are and half have settled."""

    def rule(items, of):
        fails = (items.total >= 9) | (of["head"].failed > 0) | (items.failed >= 3)
        done = (of["big"].total > 0) & (of["big"].succeeded == of["big"].total) & (2 * items.settled >= items.total)
        return F.when(fails, "FAILED").when(done, "SUCCEEDED")

    every = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    subsets = {"big": F.col("big"), "head": F.col("idx") == 0}
    out = timeline.ended_by_rule(swept_lines(spark, sf_dir), "l_orderkey", "ok", "started", "settled", rule, subsets, "err", every)
    return out.select(F.col("l_orderkey").alias("o_orderkey"), "reason", "status", "error", "total", "n_running", "n_ok", "n_failed", F.col("end.at").alias("ended_on"), (F.col("end.what") == timeline.STARTS).alias("before_a_start"))


@query(
    f"""
    WITH {SWEPT_SQL}, j AS (SELECT *, CASE WHEN what <> 1 THEN CASE WHEN n_failed > 1 THEN 'FAILURE_TOLERANCE_EXCEEDED' WHEN n_ok + n_failed >= total THEN 'ALL_COMPLETED' WHEN n_ok >= 3 THEN 'MIN_SUCCESSFUL_REACHED' END END AS reason FROM s),
    e AS (SELECT o, arg_min(reason, {{'tm': tm, 'what': what, 'idx': idx}}) AS reason, min({{'tm': tm, 'what': what, 'idx': idx}}) AS e FROM j WHERE reason IS NOT NULL GROUP BY o),
    r AS (SELECT t.*, e.reason, CASE WHEN settled IS NOT NULL AND (e.e IS NULL OR {{'tm': settled, 'what': CASE WHEN settled = started THEN 2 ELSE 0 END, 'idx': idx}} <= e.e) THEN CASE WHEN ok THEN 'SUCCEEDED' ELSE 'FAILED' END
        WHEN e.e IS NULL OR {{'tm': started, 'what': 1, 'idx': idx}} < e.e THEN 'STARTED' END AS item_status FROM timed t LEFT JOIN e USING (o))
    SELECT o AS l_orderkey, idx, reason, item_status FROM r WHERE item_status IS NOT NULL
    """
)
def batch_early_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines an order's result holds when it ends early: settled ones, those still running, none that hadn't begun."""
    lines = swept_lines(spark, sf_dir)
    out = timeline.reported_by_policy(lines, "l_orderkey", "ok", "started", "settled", LINE_POLICY)
    return out.select("l_orderkey", F.col("idx").cast("long").alias("idx"), "reason", "item_status")
