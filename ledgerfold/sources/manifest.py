"""Writes in a chain of tokens, in a folder that all executors share.

Each write names the token that it follows and makes the next one. Its rows and
the ids that it changes are Parquet files; it counts once its entry stands in the
folder's log, which is named by the token it follows and put there by a rename
that never overwrites: of two writers with the same token one is refused. An
entry tells where its rows are, so files of a write that failed or was refused are never read.
The log has one small file a write; a snapshot takes the place of all before it.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log
from . import paged

#: What an entry tells: the token it follows (none: the first), its own, who wrote it, and its files.
ENTRY = "follows string, token string, writer string, rows string, changed string"


class TokenWithdrawn(RuntimeError):
    """Another write has followed the token already."""


def next_token(follows: str, writer: str) -> str:
    """The token of a write: the same for the same write run again."""
    return hashlib.sha256(f"{follows}:{writer}".encode()).hexdigest()


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file whole, unless it is there."""
    jvm = spark._jvm.org.apache.hadoop.fs
    to, made = jvm.Path(path), jvm.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(made, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        none = spark._sc._gateway.new_array(jvm.Options.Rename, 0)
        jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(made, to, none)
        return True
    except Exception:
        if not fs.exists(to):
            raise
        fs.delete(made, False)
        return False


def _get(spark: SparkSession, path: str) -> dict | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def append(folder: str, follows: str, rows: DataFrame, keys: list[str], writer: str) -> str:
    """Write rows after the token `follows` ('' for the first write) and return the new token.

    writer names the write: run again with the same name after the same token it
    changes nothing. Another write after that token raises TokenWithdrawn.
    keys: the columns that name an operation; those of rows, each once, are the write's changed ids.
    """
    spark = rows.sparkSession
    entry, token = f"{folder}/log/{follows or 'first'}.json", next_token(follows, writer)
    there = _get(spark, entry)
    if there is None:
        own = f"{folder}/writes/{token}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{own}/rows")
        spark.read.parquet(f"{own}/rows").select(*keys).distinct().write.parquet(f"{own}/changed")
        if _put(spark, entry, json.dumps({"follows": follows, "token": token, "writer": writer, "rows": f"{own}/rows", "changed": f"{own}/changed"})):
            return token
        there = _get(spark, entry)
    if there["token"] != token:
        raise TokenWithdrawn(f"{there['writer']} has followed {follows or 'the first token'}")
    return token


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(number, follows, token, writer, rows, changed) of the writes in the chain, from 1; none of a folder without any."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/log")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"number int, {ENTRY}")
    found = spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(f"{folder}/log")
    pages = found.withColumns({"chain": F.lit("all"), "marker": F.nullif("follows", F.lit("")), "next_marker": F.col("token")})
    chain = paged.followed(pages, "chain", "marker", "next_marker")
    return chain.select((F.col("number") + 1).cast("int").alias("number"), "follows", "token", "writer", "rows", "changed")


def head(spark: SparkSession, folder: str, start: str = "") -> str:
    """The token that the next write has to follow; start: one from which to look."""
    token = start
    while (there := _get(spark, f"{folder}/log/{token or 'first'}.json")) is not None:
        token = there["token"]
    return token


def state(spark: SparkSession, folder: str, keys: list[str], order: list[str], schema: str | None = None, upto: int | None = None) -> DataFrame:
    """Each operation's newest record: of the last write that has one, by order within it. Read from the last snapshot and what came after.

    schema: of rows, for a folder without writes. upto: the number of the last write that counts, by default of all.
    """
    after = _get(spark, f"{folder}/snapshot.json") or {"number": 0, "rows": None}
    writes = [(r["number"], r["rows"]) for r in entries(spark, folder).where(F.col("number") > after["number"]).select("number", "rows").collect() if upto is None or r["number"] <= upto]
    out = None if after["rows"] is None else spark.read.parquet(after["rows"]).withColumn("__write", F.lit(after["number"]))
    if writes:
        whole = spark.read.parquet(*(path for _, path in writes)).withColumn("__path", F.regexp_extract(F.input_file_name(), "writes/([^/]*)/rows", 1))
        names = spark.createDataFrame([(n, path.split("/writes/")[1].split("/")[0]) for n, path in writes], "__write int, __path string")
        later = whole.join(F.broadcast(names), "__path").drop("__path")
        out = later if out is None else out.unionByName(later)
    if out is None:
        if schema is None:
            raise ValueError(f"nothing was written to {folder}")
        return spark.createDataFrame([], schema)
    return log.state(out, keys, ["__write", *order]).drop("__write")


def compact(spark: SparkSession, folder: str, keys: list[str], order: list[str]) -> int:
    """Write a snapshot of the state after all writes so far and return the number of the last. Later reads start from it."""
    last = entries(spark, folder).agg(F.max("number")).first()[0] or 0
    if last:
        path = f"{folder}/snapshots/{last}-{uuid.uuid4().hex}"
        state(spark, folder, keys, order, upto=last).write.parquet(path)
        jvm = spark._jvm.org.apache.hadoop.fs
        fs = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        made = f"{folder}/snapshot-{uuid.uuid4().hex}.json"
        _put(spark, made, json.dumps({"number": last, "rows": path}))
        options = spark._sc._gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.OVERWRITE
        jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(jvm.Path(made), jvm.Path(f"{folder}/snapshot.json"), options)
    return last
