"""Payload codecs, write requests, errors, envelopes and paged state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, errors, identity
from ..operators import packing
from ..sources import paged
from .registry import query, table


@query(
    """
    WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
    SELECT user_id, event_id, (n - 1) // 25 AS request FROM n
    """
)
def request_packing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.by_count(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"], 25)


SIZE_SQL = """octet_length(encode(text)) + length(regexp_replace(text, '[^"\\\\\\x08\\t\\n\\f\\r]', '', 'g')) + 5 * length(regexp_replace(text, '[^\\x01-\\x07\\x0B\\x0E-\\x1F]', '', 'g')) + octet_length(encode(role)) + 256"""


@query(
    f"""
    WITH RECURSIVE u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {SIZE_SQL} AS bytes FROM conversations),
    r(conv_id, n, bytes, request, held, num) AS (SELECT conv_id, n, bytes, 0, bytes, 1 FROM u WHERE n = 1 UNION ALL
        SELECT u.conv_id, u.n, u.bytes, CASE WHEN num >= 3 OR held + u.bytes > 2500 THEN request + 1 ELSE request END,
            CASE WHEN num >= 3 OR held + u.bytes > 2500 THEN u.bytes ELSE held + u.bytes END, CASE WHEN num >= 3 OR held + u.bytes > 2500 THEN 1 ELSE num + 1 END
        FROM r JOIN u ON u.conv_id = r.conv_id AND u.n = r.n + 1)
    SELECT conv_id, n, CAST(bytes AS BIGINT) AS bytes, CAST(request AS BIGINT) AS request FROM r
    """
)
def request_packing_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long")
    size = codecs.update_size(F.col("text"), F.col("role")).cast("long")
    rows = table(spark, sf_dir, "conversations").select("conv_id", n.alias("n"), size.alias("bytes"))
    return packing.by_size(rows, "conv_id", ["n"], "bytes", 3, 2500)


@query(
    """
    WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS sec FROM events),
    g AS (SELECT *, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS gap FROM e)
    SELECT user_id, event_id, CAST(sum(CASE WHEN gap IS NULL OR gap > 36000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS write_window FROM g
    """
)
def write_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .execution_queries import event_seconds

    rows = event_seconds(spark, sf_dir).select("user_id", "event_id", "at")
    out = packing.windows(rows, "user_id", "at", F.col("at") - F.col("was") > 36000)
    return out.select("user_id", "event_id", F.col("window").cast("long").alias("write_window"))


@query(
    """
    WITH f AS (SELECT user_id, min(event_id) AS bad FROM events WHERE event_type = 'error' AND event_id % 4 = 0 GROUP BY 1)
    SELECT user_id, event_id FROM events LEFT JOIN f USING (user_id) WHERE bad IS NULL OR event_id < bad
    """
)
def failure_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("event_type") == "error") & (F.col("event_id") % 4 == 0)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", failed.alias("failed"))
    return packing.sent(rows, "user_id", "event_id", "failed").select("user_id", "event_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("value"))
    return rows.select("event_id", "value.k", F.to_json("value").alias("again"))


@query(
    """
    WITH e AS (SELECT event_id, '{"__ledgerfold":{"version":1,"kind":"inline"},"value":' || props || '}' AS inline FROM events)
    SELECT event_id, inline AS payload, json_extract_string(inline, '$.__ledgerfold.kind') AS kind FROM e
    """
)
def payload_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", codecs.inline_envelope(F.col("props")).alias("payload"))
    return rows.withColumn("kind", codecs.envelope_kind(F.col("payload")))


@query(
    """
    WITH d AS (SELECT doc_id, 56 + 2 + 40 * n_chars AS bytes,
        'exec/' || sha256(CAST(doc_id AS VARCHAR)) AS path FROM documents)
    SELECT doc_id, bytes > 261120 AS overflowed,
        CASE WHEN bytes > 261120 THEN '{"__ledgerfold":{"version":1,"kind":"file"},"file":"' || path || '","preview":{"id":' || doc_id || '}}' END AS envelope FROM d
    """
)
def payload_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of 40 times a document's length; those whose inline envelope is beyond the limit become files."""
    own = F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit("}"))
    path = F.concat(F.lit("exec/"), codecs.hashed_segment(F.col("doc_id").cast("string")))
    value = F.concat(F.lit('"'), F.repeat(F.lit("x"), (40 * F.col("n_chars")).cast("int")), F.lit('"'))
    rows = table(spark, sf_dir, "documents").select("doc_id", codecs.stored_payload(value, path, own).alias("payload"))
    overflowed = codecs.envelope_kind(F.col("payload")) == "file"
    return rows.select("doc_id", overflowed.alias("overflowed"), F.when(overflowed, F.col("payload")).alias("envelope"))


@query(
    """
    WITH p AS (SELECT page_id, url FROM pages), s AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN '/' || url WHEN 1 THEN 'a/../' || page_id WHEN 2 THEN '..' ELSE 'a/b.' || page_id END AS path FROM p)
    SELECT page_id, CASE WHEN page_id % 5 = 2 THEN '%2E.' ELSE replace(replace(replace(replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23') END AS segment,
        page_id % 5 > 2 AS contained FROM s
    """
)
def path_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = F.when(k % 5 == 0, F.concat(F.lit("/"), "url")).when(k % 5 == 1, F.concat(F.lit("a/../"), k)).when(k % 5 == 2, "..").otherwise(F.concat(F.lit("a/b."), k))
    segment = codecs.percent_encoded(F.when(k % 5 == 2, "..").otherwise(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", segment.alias("segment"), codecs.path_is_contained(path).alias("contained"))


@query("SELECT event_id, '{\"id\":' || event_id || ',\"user\":{\"name\":\"***\",\"k\":' || json_extract_string(props, '$.k') || '}}' AS preview FROM events")
def preview_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preview of payloads with a fixed schema: of these fields, only some are shown."""
    fields = {"id": F.col("event_id"), "user.name": F.col("event_type"), "user.k": F.from_json("props", "k int")["k"], "user.secret": F.col("ts").cast("string"), "value": F.col("value")}
    how = codecs.Preview(include=("id", "user.k"), mask=("name",), exclude=("user.secret",))
    return table(spark, sf_dir, "events").select("event_id", codecs.preview_of(fields, how).alias("preview"))


@query("SELECT event_id, '{\"id\":' || event_id || ',\"user\":{\"email\":\"***\"},\"k\":' || json_extract_string(props, '$.k') || '}' AS preview FROM events")
def preview_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preview of payloads of any schema, by walking the JSON."""
    payload = F.concat(F.lit('{"id":'), "event_id", F.lit(',"user":{"email":"a@example.com","name":"Bo"},"list":['), "props", F.lit('],"total":5}'))
    how = codecs.Preview(include=("id", "user.id"), mask=("email",))
    shown = codecs.preview_json(codecs.Preview(include=("id", "list.k"), mask=how.mask))(payload)
    flat = F.regexp_replace(shown, r',"list":\{"k":([0-9-]+)\}', ',"k":$1')
    return table(spark, sf_dir, "events").select("event_id", flat.alias("preview"))


@query(
    """
    WITH k AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'Step' WHEN 1 THEN 'Wait' WHEN 2 THEN 'Invoke' WHEN 3 THEN 'Callback' WHEN 4 THEN 'WaitForCondition' WHEN 5 THEN 'ChildContext' WHEN 6 THEN 'Combinator'
        WHEN 7 THEN 'NonDeterministicExecution' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 'MyError' END AS own FROM orders),
    w AS (SELECT *, coalesce(own, CASE kind WHEN 'Step' THEN 'StepError' WHEN 'Wait' THEN 'WaitError' WHEN 'Invoke' THEN 'InvokeError' WHEN 'Callback' THEN 'CallbackError' WHEN 'WaitForCondition' THEN 'WaitForConditionError'
        WHEN 'ChildContext' THEN 'ChildContextError' WHEN 'Combinator' THEN 'PromiseCombinatorError' WHEN 'NonDeterministicExecution' THEN 'NonDeterministicExecutionError' ELSE 'Error' END) AS wire FROM k)
    SELECT o_orderkey, wire, CASE WHEN own IS NULL THEN kind END AS kind_again FROM w
    """
)
def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.lit(None).cast("string")
    for i, name in enumerate(errors.KINDS):
        kind = F.when(k % 9 == i, name).otherwise(kind)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), F.when(k % 4 == 0, "MyError").alias("own"))
    rows = rows.withColumn("wire", errors.wire_type(F.col("kind"), F.col("own")))
    return rows.select("o_orderkey", "wire", errors.kind_of(F.col("wire")).alias("kind_again"))


@query(
    """
    WITH k(kind, wire, reasons) AS (VALUES ('Step', 'StepError', 'ExecutionFailed,SerializationFailed,Interrupted'), ('Wait', 'WaitError', 'UnexpectedStatus'), ('Invoke', 'InvokeError', 'FunctionFailed,SerializationFailed'),
        ('Callback', 'CallbackError', 'TimedOut,HeartbeatTimedOut,ExternalFailure,DeserializationFailed,Internal,SubmitterFailed'), ('WaitForCondition', 'WaitForConditionError', 'CheckFailed,MaxChecksExceeded,SerializationFailed'),
        ('ChildContext', 'ChildContextError', 'ChildFailed,Internal,BatchCompletionFailed,NotCompleted'), ('Combinator', 'PromiseCombinatorError', 'JoinFailed,AllFailed,FirstSettledFailed,EmptyInput,Internal'),
        ('NonDeterministicExecution', 'NonDeterministicExecutionError', 'OperationMismatch,UnrecognizedStatus')),
    o AS (SELECT o_orderkey, ['Step', 'Wait', 'Invoke', 'Callback', 'WaitForCondition', 'ChildContext', 'Combinator', 'NonDeterministicExecution'][o_orderkey % 8 + 1] AS kind FROM orders)
    SELECT o_orderkey, kind, wire, unnest(string_split(reasons, ',')) AS reason FROM o JOIN k USING (kind)
    """
)
def error_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons that each failed order's error may have, by its kind."""
    kind = F.element_at(F.array(*map(F.lit, errors.KINDS)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))
    return rows.select("o_orderkey", "kind", errors.wire_type(F.col("kind")).alias("wire"), F.explode(errors.reasons(F.col("kind"))).alias("reason"))


@query(
    """
    WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'EmptyInput' WHEN 1 THEN 'FirstSettledFailed' WHEN 2 THEN 'AllFailed' ELSE 'JoinFailed' END AS reason FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, 'CombinatorError.' || reason || CASE WHEN reason = 'JoinFailed' THEN '.' || l_linenumber ELSE '' END AS wire, reason, CASE WHEN reason = 'JoinFailed' THEN l_linenumber END AS idx FROM l
    """
)
def combinator_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    reason = F.when(n % 4 == 0, "EmptyInput").when(n % 4 == 1, "FirstSettledFailed").when(n % 4 == 2, "AllFailed").otherwise("JoinFailed")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", errors.combinator_type(reason, n).alias("wire"))
    back = errors.combinator_reason(F.col("wire"))
    return rows.select("*", back["reason"].alias("reason"), back["index"].alias("idx"))


@query(
    """
    WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status, o_custkey FROM orders)
    SELECT o_orderkey, '{"Status":"' || status || '"' || CASE status WHEN 'SUCCEEDED' THEN ',"Result":"' || CASE WHEN o_orderkey % 4000 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END || '"' WHEN 'FAILED' THEN ',"Error":"lost"' ELSE '' END || '}' AS envelope FROM o
    """
)
def result_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("FAILED")
    # some results are a byte too long for a response
    result = F.when(F.col("o_orderkey") % 4000 == 0, F.repeat(F.lit("r"), F.lit(codecs.RESPONSE + 1))).otherwise(F.col("o_custkey").cast("string"))
    envelope = codecs.response_envelope(status, result, F.lit("lost"))
    return table(spark, sf_dir, "orders").select("o_orderkey", envelope.alias("envelope"))


@query("SELECT o_orderkey AS op, sha256(CAST(o_orderkey AS VARCHAR)) AS wire_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'STARTED' ELSE 'ARCHIVED' END AS status, o_orderstatus IN ('F', 'O') AS known FROM orders")
def bootstrap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations out of the JSON envelopes that invocations begin with."""
    status = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "O", "STARTED").otherwise("ARCHIVED")
    one = F.struct(F.col("o_orderkey").cast("string").alias("Id"), F.lit("STEP").alias("Type"), status.alias("Status"))
    envelopes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.col("o_custkey").alias("Arn"), F.collect_list(one).alias("Operations"))).alias("envelope"))
    rows = paged.operations(envelopes.select(F.struct(F.lit("page").alias("k"), F.col("envelope").alias("v"))["v"].alias("envelope")), "envelope")
    return rows.select(
        F.col("id").cast("long").alias("op"), identity.wire_id(F.col("id")).alias("wire_id"), "status", identity.is_known(F.col("status")).alias("known")
    )


@query(
    """
    WITH n AS (SELECT o_custkey, o_orderkey, o_orderstatus, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS page FROM orders),
    kept AS (SELECT * FROM n WHERE NOT (o_custkey % 5 = 0 AND page >= 3))
    SELECT o_custkey, 'op' || o_orderkey % 7 AS op, arg_max('order ' || o_orderkey, o_orderkey) AS result, arg_max(o_orderstatus, o_orderkey) AS status, CAST(max(page) AS INT) AS page FROM kept GROUP BY ALL
    """
)
def paged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as pages of three records behind markers, of which some chains break off; later pages replace records."""
    from pyspark.sql import Window as W

    order = W.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("page", F.floor((F.row_number().over(order) - 1) / 3).cast("int"))
    record = F.struct(F.concat(F.lit("op"), F.col("o_orderkey") % 7).alias("op"), F.concat(F.lit("order "), "o_orderkey").alias("result"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("k"))
    pages = rows.groupBy("o_custkey", "page").agg(F.array_sort(F.collect_list(record)).alias("held"))
    # of a page's records of one operation the last counts
    newest = F.filter("held", lambda x: ~F.exists("held", lambda y: (y["op"] == x["op"]) & (y["k"] > x["k"])))
    name = lambda n: F.when(n > 0, F.concat(F.lit("m"), n.cast("string")))
    more = (F.col("page") < F.max("page").over(W.partitionBy("o_custkey"))) & ~((F.col("o_custkey") % 5 == 0) & (F.col("page") == 2))
    pages = pages.select("o_custkey", newest.alias("operations"), name(F.col("page")).alias("marker"), F.when(more, name(F.col("page") + 1)).alias("next_marker"))
    found = paged.followed(pages, "o_custkey", "marker", "next_marker")
    return paged.state_of(found, "o_custkey", "operations", "op").select("o_custkey", "op", "result", "status", F.col("page_number").cast("int").alias("page"))


@query(
    """
    WITH t AS (SELECT user_id, min(event_id) AS gone FROM events WHERE event_type = 'error' AND event_id % 3 = 0 GROUP BY 1)
    SELECT user_id, event_id FROM events LEFT JOIN t USING (user_id) WHERE gone IS NULL OR event_id <= gone
    """
)
def token_withdrawal(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.when(~((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)), F.lit("t"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", token.alias("token"))
    return packing.admitted(rows, "user_id", "event_id", "token").select("user_id", "event_id")


@query(
    """
    SELECT event_id, CASE WHEN event_id % 10 > 0 AND event_id % 7 > 0 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k, CASE WHEN event_id % 10 = 0 AND event_id % 7 > 0 THEN 'SerializationFailed' END AS error, event_id % 7 = 0 AS reinvoke FROM events
    """
)
def payload_decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.log import decoded

    payload = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    return decoded(rows, "payload", "k int", F.col("event_id") % 7 == 0).select("event_id", "value.k", "error", "reinvoke")


@query(
    """
    SELECT doc_id, sha256('"' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '"') AS value_sha, CAST(NULL AS VARCHAR) AS problem FROM documents
    """
)
def payload_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text goes to a file of payloads and comes back by its reference."""
    import uuid

    from ..sources import payloads
    from ..sources.stored import own_folder

    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    quoted = F.to_json(F.array("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring(quoted, F.lit(2), F.length(quoted) - 2).alias("value"))
    kept = payloads.written(rows, "value", folder, F.concat(F.lit("run/"), codecs.hashed_segment(F.col("doc_id").cast("string"))), always=True)
    return payloads.read(kept, folder).select("doc_id", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha"), "problem")


@query(
    """
    SELECT doc_id, 2 + 1000 * (doc_id % 300) AS value_bytes, 58 + 1000 * (doc_id % 300) > 261120 AS in_file, CAST(NULL AS VARCHAR) AS problem FROM documents
    """
)
def payload_store_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of up to 299,002 bytes: only those whose inline envelope is too large go to files; all come back."""
    import uuid

    from ..sources import payloads
    from ..sources.stored import own_folder

    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    value = F.concat(F.lit('"'), F.repeat(F.lit("y"), (1000 * (F.col("doc_id") % 300)).cast("int")), F.lit('"'))
    rows = table(spark, sf_dir, "documents").select("doc_id", value.alias("value"))
    kept = payloads.written(rows, "value", folder, F.concat(F.lit("run/"), codecs.hashed_segment(F.col("doc_id").cast("string"))))
    kept = kept.withColumn("in_file", codecs.envelope_kind(F.col("payload")) == "file")
    return payloads.read(kept, folder).select("doc_id", F.octet_length("value").cast("long").alias("value_bytes"), "in_file", "problem")


@query(
    """
    WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
    SELECT CAST(o_custkey AS VARCHAR) AS arn, CASE WHEN count(*) > 4 THEN 'm1' END AS next_marker, '{"customer":' || o_custkey || '}' AS input, least(count(*), 4) AS held, CAST(min(o_orderkey) AS VARCHAR) AS first_op FROM n GROUP BY o_custkey
    """
)
def bootstrap_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes with an execution's input, the first four of its operations and, if there are more, where they go on."""
    one = F.struct(F.col("o_orderkey").cast("string").alias("Id"), F.lit("STEP").alias("Type"), F.lit("STARTED").alias("Status"), F.col("o_orderkey").alias("n"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("all"))
    first = F.slice(F.array_sort("all", lambda x, y: F.when(x["n"] < y["n"], -1).otherwise(1)), 1, 4)
    envelope = F.struct(
        F.col("o_custkey").cast("string").alias("Arn"),
        F.when(F.size("all") > 4, "m1").alias("NextMarker"),
        F.concat(F.lit('{"customer":'), F.col("o_custkey").cast("string"), F.lit("}")).alias("Input"),
        first.alias("Operations"),
    )
    pages = paged.bootstrap(rows.select(F.to_json(envelope).alias("envelope")), "envelope")
    return pages.select("arn", "next_marker", "input", F.size("operations").cast("long").alias("held"), F.col("operations")[0]["Id"].alias("first_op"))


@query(
    """
    SELECT doc_id, doc_id % 5 = 1 AS external, doc_id % 5 = 1 AS opaque,
        CASE WHEN doc_id % 5 IN (0, 4) THEN sha256('"' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '"') END AS value_sha,
        CASE WHEN doc_id % 5 IN (2, 3) THEN 'ForeignReference' END AS problem FROM documents
    """
)
def payload_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a file of its operation; some payloads are forged: sent from outside, another operation's reference, or a name that nobody wrote."""
    import uuid

    from ..sources import payloads
    from ..sources.stored import own_folder, stored

    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    quoted, n = F.to_json(F.array("text")), F.col("doc_id")
    path = lambda n: F.concat(F.lit("run/"), codecs.hashed_segment(n.cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("run").alias("execution"), n.cast("string").alias("operation"), F.substring(quoted, F.lit(2), F.length(quoted) - 2).alias("value"))
    kept = stored(payloads.written_by(rows, "value", folder, path(n), "execution", "operation", always=True))
    other = codecs.file_envelope(path(n - n % 5))
    forged = F.when((n % 5).isin(1, 2), other).when(n % 5 == 3, codecs.file_envelope(F.concat(F.lit("run/none-"), n.cast("string")))).otherwise(F.col("payload"))
    sent = kept.withColumn("payload", forged).withColumn("external", n % 5 == 1)
    found = payloads.read_by_origin(sent, folder, "execution", "operation", "external")
    opaque = F.coalesce(F.col("value") == F.col("payload"), F.lit(False))
    return found.select("doc_id", "external", opaque.alias("opaque"), F.when(~opaque, F.sha2(F.col("value").cast("binary"), 256)).alias("value_sha"), "problem")
