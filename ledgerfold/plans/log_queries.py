"""The operation log: events and orders as updates, the customers' tree as a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, identity
from ..operators import log
from ..sources.stored import stored
from .registry import query, table

STATUS = {"view": "STARTED", "click": "PENDING", "signup": "READY", "purchase": "SUCCEEDED", "error": "FAILED"}
STATUS_SQL = "CASE event_type WHEN 'view' THEN 'STARTED' WHEN 'click' THEN 'PENDING' WHEN 'signup' THEN 'READY' WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'FAILED' END"
#: An execution is a user, an operation one of eight slots of it.
UPDATES_SQL = f"u AS (SELECT user_id, event_id % 8 AS op, event_id AS seq, {STATUS_SQL} AS status, props FROM events)"


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.lit("FAILED")
    for kind, s in STATUS.items():
        status = F.when(F.col("event_type") == kind, s).otherwise(status)
    return table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 8).alias("op"), F.col("event_id").alias("seq"), status.alias("status"), "props")


@query(f"WITH {UPDATES_SQL} SELECT user_id, op, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(props, seq) AS props FROM u GROUP BY user_id, op")
def log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.state(updates(spark, sf_dir), ["user_id", "op"], ["seq"])


@query(
    f"""
    WITH {UPDATES_SQL}, w AS (SELECT *, lag(status) OVER o AS was, row_number() OVER o AS n FROM u WINDOW o AS (PARTITION BY user_id, op ORDER BY seq))
    SELECT user_id, op, seq, was, status FROM w WHERE n = 1 OR status IS DISTINCT FROM was
    """
)
def log_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.changes(updates(spark, sf_dir), ["user_id", "op"], ["seq"]).select("user_id", "op", "seq", "was", "status")


HALVES_SQL = f"""{UPDATES_SQL}, m AS (SELECT max(seq) // 2 AS mid FROM u),
    a AS (SELECT user_id, op, arg_max(status, seq) AS status FROM u, m WHERE seq <= mid GROUP BY ALL),
    b AS (SELECT user_id, op, arg_max(status, seq) AS status FROM u, m WHERE seq > mid AND op < 5 GROUP BY ALL)"""


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = updates(spark, sf_dir)
    mid = rows.agg(F.expr("max(seq) div 2")).first()[0]
    keep = ["user_id", "op", "status"]
    early = log.state(rows.where(F.col("seq") <= mid), ["user_id", "op"], ["seq"]).select(*keep)
    late = log.state(rows.where((F.col("seq") > mid) & (F.col("op") < 5)), ["user_id", "op"], ["seq"]).select(*keep)
    return early, late


@query(f"WITH {HALVES_SQL} SELECT user_id, op, coalesce(b.status, a.status) AS status FROM a FULL JOIN b USING (user_id, op)")
def log_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.merged(*halves(spark, sf_dir), ["user_id", "op"])


@query(f"WITH {HALVES_SQL} SELECT user_id, op, b.status FROM b LEFT JOIN a USING (user_id, op) WHERE a.status IS DISTINCT FROM b.status")
def log_changed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.changed(*halves(spark, sf_dir), ["user_id", "op"])


@query(
    """
    WITH r AS (SELECT r_regionkey AS k, CAST(row_number() OVER (ORDER BY r_regionkey) AS VARCHAR) AS pos FROM region),
    n AS (SELECT n_nationkey AS k, pos || '-' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS pos, pos AS up FROM nation JOIN r ON n_regionkey = k),
    c AS (SELECT c_custkey AS k, n.pos || '-' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos, n.pos AS up FROM customer JOIN n ON c_nationkey = k),
    o AS (SELECT o_orderkey AS k, c.pos || '-' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, c.pos AS up FROM orders JOIN c ON o_custkey = k),
    all_rows AS (SELECT 'r_regionkey' AS level, CAST(k AS VARCHAR) AS key, pos, NULL AS up, 0 AS depth FROM r UNION ALL SELECT 'n_nationkey', CAST(k AS VARCHAR), pos, up, 1 FROM n
        UNION ALL SELECT 'c_custkey', CAST(k AS VARCHAR), pos, up, 2 FROM c UNION ALL SELECT 'o_orderkey', CAST(k AS VARCHAR), pos, up, 3 FROM o)
    SELECT level, key, pos AS "positional", sha256(pos) AS wire_id, sha256(up) AS parent_wire_id, depth FROM all_rows
    """
)
def op_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_tree_rows(spark, sf_dir)


def op_tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["r_regionkey", "n_nationkey", "c_custkey", "o_orderkey"]
    parents = [None, "n_regionkey", "c_nationkey", "o_custkey"]
    names = ["region", "nation", "customer", "orders"]
    regions = table(spark, sf_dir, "region").withColumn("root", F.lit(0))
    levels = [log.mint(regions, "root", ["r_regionkey"])]
    levels += [log.mint(table(spark, sf_dir, n), p, [k]) for n, p, k in zip(names[1:], parents[1:], keys[1:], strict=True)]
    return log.descend(levels, keys, parents)


@query(
    """
    WITH RECURSIVE t AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
    d(id, root, depth) AS (SELECT id, id, 0 FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, d.root, d.depth + 1 FROM t JOIN d ON t.parent_id = d.id WHERE d.depth < 2)
    SELECT root, depth, count(*) AS operations FROM d GROUP BY ALL
    """
)
def op_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, k, p, a, b: table(spark, sf_dir, n).select(F.concat(F.lit(a), F.col(k)).alias("id"), (F.concat(F.lit(b), F.col(p)) if p else F.lit(None).cast("string")).alias("parent_id"))
    tree = (
        t("region", "r_regionkey", None, "r", "")
        .union(t("nation", "n_nationkey", "n_regionkey", "n", "r"))
        .union(t("customer", "c_custkey", "c_nationkey", "c", "n"))
        .union(t("orders", "o_orderkey", "o_custkey", "o", "c"))
    )
    return log.descendants(tree, 2).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("operations"))


TYPES_SQL = """a AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'ChainedInvoke' WHEN 'F' THEN 'STEP' END AS op_type,
        CASE WHEN o_orderkey % 3 = 0 THEN 'Step' WHEN o_orderkey % 3 = 1 THEN 'Map' END AS sub_type, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS op_name,
        CASE WHEN o_orderkey % 97 = 0 THEN 'ARCHIVED' ELSE 'SUCCEEDED' END AS status FROM orders),
    b AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'CHAINED_INVOKE' WHEN 'F' THEN CASE WHEN o_orderkey % 50 = 0 THEN 'WAIT' ELSE 'Step' END ELSE 'WAIT' END AS op_type,
        CASE WHEN o_orderkey % 3 = 0 THEN 'STEP' WHEN o_orderkey % 3 = 1 AND o_orderkey % 7 > 0 THEN 'map' END AS sub_type,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS op_name FROM orders)"""


@query(
    f"""
    WITH {TYPES_SQL}, j AS (SELECT a.k AS o_orderkey, CASE WHEN a.status NOT IN ('SUCCEEDED') THEN 'UnrecognizedStatus:' || a.status
        WHEN a.op_type IS NOT NULL AND (upper(regexp_replace(a.op_type, '([a-z])([A-Z])', '\\1_\\2', 'g')) IS DISTINCT FROM upper(regexp_replace(b.op_type, '([a-z])([A-Z])', '\\1_\\2', 'g'))
            OR lower(a.sub_type) IS DISTINCT FROM lower(b.sub_type) OR nullif(a.op_name, '') IS DISTINCT FROM nullif(b.op_name, '')) THEN 'OperationMismatch' END AS problem
        FROM a JOIN b USING (k))
    SELECT o_orderkey, problem FROM j WHERE problem IS NOT NULL
    """
)
def determinism_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    held = orders.select(
        "o_orderkey",
        F.when(status == "O", "ChainedInvoke").when(status == "F", "STEP").alias("op_type"),
        F.when(k % 3 == 0, "Step").when(k % 3 == 1, "Map").alias("sub_type"),
        F.when(k % 5 == 0, "").otherwise(priority).alias("op_name"),
        F.when(k % 97 == 0, "ARCHIVED").otherwise("SUCCEEDED").alias("status"),
    )
    claimed = orders.select(
        "o_orderkey",
        F.when(status == "O", "CHAINED_INVOKE").when((status == "F") & (k % 50 != 0), "Step").otherwise("WAIT").alias("op_type"),
        F.when(k % 3 == 0, "STEP").when((k % 3 == 1) & (k % 7 > 0), "map").alias("sub_type"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 11 == 0, F.lower(priority)).otherwise(priority).alias("op_name"),
    )
    return log.mismatches(held, claimed, "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def virtual_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    virtual = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return log.virtual_conflicts(held, virtual, "o_orderkey")


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AS is_replay FROM orders")
def replay_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "orders").select("o_orderkey")
    held = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return log.replaying(claims, held, "o_orderkey")


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 'FATAL' WHEN o_orderkey % 17 = 0 THEN 'PANIC' WHEN o_orderstatus = 'F' AND o_orderkey % 5 > 0 THEN 'SUCCEEDED'
        WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'PENDING' END AS outcome,
        CASE WHEN o_orderkey % 31 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'INVOCATION' ELSE 'EXECUTION' END END AS scope FROM orders
    """
)
def invocation_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    outcome = log.outcome(k % 31 == 0, k % 17 == 0, F.col("o_orderstatus") == "F", k % 5 == 0)
    scope = F.when(outcome == "FATAL", errors.scope(k % 2 == 0))
    return table(spark, sf_dir, "orders").select("o_orderkey", outcome.alias("outcome"), scope.alias("scope"))


@query(
    """
    WITH s AS (SELECT user_id, row_number() OVER o AS seq, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 0 END) OVER o AS permits,
        sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER o AS waiting FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, min(seq) AS suspended_at FROM s WHERE permits <= 0 AND waiting >= 1 GROUP BY user_id
    """
)
def suspension_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    permits = F.when(kind.isin("view", "click"), 1).when(kind.isin("purchase", "error"), -1).otherwise(0)
    out = log.suspensions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], permits, F.when(kind == "signup", 1).otherwise(0))
    return out.withColumn("suspended_at", F.col("suspended_at").cast("long"))


@query(
    f"""
    WITH {UPDATES_SQL}, s AS (SELECT user_id, op, arg_max(status, seq) AS status FROM u GROUP BY ALL)
    SELECT user_id, op, status, status NOT IN ('STARTED', 'PENDING', 'READY') AS terminal FROM s UNION ALL SELECT -1, 0, 'ARCHIVED', true
    """
)
def terminal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = log.state(updates(spark, sf_dir), ["user_id", "op"], ["seq"]).select("user_id", "op", "status")
    odd = spark.sql("SELECT -1L AS user_id, 0L AS op, 'ARCHIVED' AS status")
    return now.unionByName(odd).withColumn("terminal", identity.is_terminal(F.col("status")))


@query(
    """
    WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 = 0 AS bad, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders),
    c AS (SELECT o_custkey, arg_min('order ' || o_orderkey, number) AS message FROM o WHERE bad GROUP BY o_custkey),
    n AS (SELECT c_nationkey, arg_min(message, c_custkey) AS message FROM customer JOIN c ON c_custkey = o_custkey GROUP BY c_nationkey)
    SELECT 'c' || c_custkey AS id, message FROM customer LEFT JOIN c ON c_custkey = o_custkey UNION ALL SELECT 'n' || n_nationkey, message FROM nation LEFT JOIN n ON n_nationkey = c_nationkey
    UNION ALL SELECT 'o' || o_orderkey, 'order ' || o_orderkey FROM o WHERE bad
    """
)
def error_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0")
    rows = (
        orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("parent"), F.col("o_orderkey").alias("number"), F.lit("FAILED").alias("status"), F.concat(F.lit("order "), "o_orderkey").alias("message"))
        .union(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.col("c_custkey"), F.lit("FAILED"), none))
        .union(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), none, F.col("n_nationkey").cast("long"), F.lit("FAILED"), none))
    )
    return log.propagated(stored(rows), "id", "parent")


@query(
    f"""
    WITH u AS (SELECT user_id, event_id % 8 AS op, event_id AS seq, {STATUS_SQL} AS status, epoch_us(ts) // 1000000 AS sec FROM events)
    SELECT user_id, op, arg_max(status, seq) AS status, arg_max(status, seq) IN ('SUCCEEDED', 'FAILED') AS is_terminal, count(*) FILTER (status = 'STARTED') AS attempts, min(sec) AS first_at, max(sec) AS last_at,
        min(sec) FILTER (status IN ('SUCCEEDED', 'FAILED')) AS ended_at FROM u GROUP BY ALL
    """
)
def operation_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import lifecycle

    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = table(spark, sf_dir, "events").select("event_id", at.alias("at")).join(updates(spark, sf_dir), F.col("event_id") == F.col("seq"))
    return lifecycle.operation_info(rows, ["user_id", "op"], "seq", "at")


@query(
    """
    WITH u AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS sec, event_id // 500 AS invocation FROM events),
    g AS (SELECT user_id, invocation, count(*) AS updates, min(sec) AS started_at, max(sec) AS ended_at FROM u GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY invocation) = 1 AS is_first, row_number() OVER (PARTITION BY user_id ORDER BY invocation) > 1 AS is_replay FROM g
    """
)
def invocation_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each invocation writes what has event ids of one block of 500."""
    from ..operators import lifecycle

    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", at.alias("at"))
    return lifecycle.invocation_info(rows, "user_id", F.expr("event_id div 500"), "event_id", "at")


#: Nations stop on a day or never; a customer races its orders, of which the first to settle stops the others unless they run on their own.
STOPS_SQL = """w AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 86400000000 AS began, epoch_us(o_orderdate) // 86400000000 + o_orderkey % 90 AS settled, o_orderstatus = 'P' AS own FROM orders),
    first AS (SELECT o_custkey, min({'at': settled, 'o': o_orderkey}) AS f FROM w GROUP BY o_custkey),
    t AS (SELECT 'n' || n_nationkey AS id, NULL AS parent_id, CASE WHEN n_nationkey % 3 = 0 THEN 8766 + n_nationkey * 50 END AS ends FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, NULL FROM customer
        UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CASE WHEN NOT own AND {'at': settled, 'o': o_orderkey} > f THEN f.at END FROM w JOIN first USING (o_custkey)),
    d(id, stopped_at) AS (SELECT id, ends FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, least(t.ends, d.stopped_at) FROM t JOIN d ON t.parent_id = d.id)"""


def race_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(id, parent_id, ends) of nations, customers and orders, and orders with when they began and settled."""
    named = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    o = table(spark, sf_dir, "orders").select(
        named("o", "o_orderkey").alias("id"), named("c", "o_custkey").alias("parent_id"), "o_orderkey", day.alias("began"), (day + F.col("o_orderkey") % 90).alias("settled"), "o_orderstatus"
    )
    won = o.groupBy("parent_id").agg(F.min(F.struct("settled", "o_orderkey")).alias("won"))
    loses = (F.col("o_orderstatus") != "P") & (F.struct("settled", "o_orderkey") > F.col("won"))
    inputs = o.join(won, "parent_id").select("id", "parent_id", F.when(loses, F.col("won.settled")).alias("ends"))
    none = F.lit(None)
    nations = table(spark, sf_dir, "nation").select(named("n", "n_nationkey").alias("id"), none.cast("string").alias("parent_id"), F.when(F.col("n_nationkey") % 3 == 0, 8766 + F.col("n_nationkey") * 50).cast("long").alias("ends"))
    customers = table(spark, sf_dir, "customer").select(named("c", "c_custkey").alias("id"), named("n", "c_nationkey").alias("parent_id"), none.cast("long").alias("ends"))
    return nations.union(customers).union(inputs), o


@query(f"WITH RECURSIVE {STOPS_SQL} SELECT id, stopped_at, CASE WHEN stopped_at IS NULL OR settled <= stopped_at THEN 'SUCCEEDED' WHEN began <= stopped_at THEN 'STOPPED' END AS status FROM d JOIN w ON id = 'o' || o_orderkey")
def stopped_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, o = race_tree(spark, sf_dir)
    found = log.stops(tree, "id", "parent_id", "ends").join(o.select("id", "began", "settled"), "id")
    return found.select("id", "stopped_at", log.stopped_status(F.lit("SUCCEEDED"), F.col("began"), F.col("settled"), F.col("stopped_at")).alias("status"))


@query(
    f"""
    WITH RECURSIVE {STOPS_SQL}, l AS (SELECT l_orderkey, l_linenumber, l_partkey, epoch_us(l_shipdate) // 86400000000 AS at_day FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, at_day FROM l LEFT JOIN d ON id = 'o' || l_orderkey WHERE stopped_at IS NULL OR at_day <= stopped_at
    """
)
def stopped_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as writes of orders: those beyond the stop of their order, or of anything above it, are never made."""
    tree, _ = race_tree(spark, sf_dir)
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    writes = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), "l_orderkey", "l_linenumber", "l_partkey", day.alias("at_day"))
    return log.before_stops(writes, log.stops(tree, "id", "parent_id", "ends"), "id", "at_day").drop("id")


@query(
    """
    WITH RECURSIVE k AS (SELECT event_type AS writer, row_number() OVER (ORDER BY event_type) AS n, count(*) AS written, count(DISTINCT user_id) AS changed FROM events GROUP BY event_type),
    c(number, writer, follows, token, written, changed) AS (SELECT n, writer, '', sha256(':' || writer), written, changed FROM k WHERE n = 1
        UNION ALL SELECT k.n, k.writer, c.token, sha256(c.token || ':' || k.writer), k.written, k.changed FROM c JOIN k ON k.n = c.number + 1)
    SELECT CAST(number AS INT) AS number, writer, follows, token, written, changed FROM c
    """
)
def write_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written kind by kind in a chain of tokens; each write is run twice, and a stranger tries to follow each token too."""
    import uuid

    from ..sources import manifest
    from ..sources.stored import own_folder

    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    token = ""
    for kind in sorted(r["event_type"] for r in events.select("event_type").distinct().collect()):
        rows = events.where(F.col("event_type") == kind)
        after = manifest.append(folder, token, rows, ["user_id"], kind)
        manifest.append(folder, token, rows, ["user_id"], kind)
        try:
            manifest.append(folder, token, rows, ["user_id"], "a stranger")
            raise AssertionError("two writes follow one token")
        except manifest.TokenWithdrawn:
            token = after
    chain = manifest.entries(spark, folder)
    counted = lambda column, name: (
        spark.read.parquet(f"{folder}/writes/*/{column}").groupBy(F.regexp_extract(F.input_file_name(), "writes/([^/]*)/", 1).alias("write")).agg(F.count(F.lit(1)).alias(name))
    )
    named = chain.withColumn("write", F.regexp_extract("rows", "writes/([^/]*)/", 1))
    return named.join(counted("rows", "written"), "write").join(counted("changed", "changed_ids"), "write").select("number", "writer", "follows", "token", "written", F.col("changed_ids").alias("changed"))


@query("SELECT user_id, arg_max(event_id, (event_type, event_id)) AS event_id, max(event_type) AS event_type FROM events GROUP BY user_id")
def write_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest record after writes in a chain, read from a snapshot of the first ones and what came after."""
    import uuid

    from ..sources import manifest
    from ..sources.stored import own_folder

    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    token = ""
    for n, kind in enumerate(sorted(r["event_type"] for r in events.select("event_type").distinct().collect())):
        token = manifest.append(folder, token, events.where(F.col("event_type") == kind), ["user_id"], kind)
        if n == 2:
            manifest.compact(spark, folder, ["user_id"], ["event_id"])
    return manifest.state(spark, folder, ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")
