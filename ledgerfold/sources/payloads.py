"""Large payloads in files of their own, with references in the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs


#: Bytes of a value in one row of a file: readers take thousands of rows at once, so that no row may be long, whatever a value's length.
PIECE = 8192


def written(rows: DataFrame, value: str, folder: str, path: Column, preview: Column | None = None, always: bool = False) -> DataFrame:
    """rows with payload instead of value: inline, or a reference where the value was written to the folder.

    path: relative, unique for each value; values are written once, as Parquet of (path, piece, pieces, value), a row for each PIECE bytes.
    """
    marked = rows.withColumn("__path", path).withColumn("__inline", codecs.inline_envelope(F.col(value)))
    large = F.lit(True) if always else F.octet_length("__inline") > codecs.OVERFLOW
    whole = marked.where(large).where(F.col(value).isNotNull()).select(F.col("__path").alias("path"), F.col(value).cast("binary").alias("whole"))
    pieces = F.greatest(F.lit(1), F.ceil(F.octet_length("whole") / PIECE).cast("int"))
    cut = whole.withColumn("pieces", pieces).select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    own = F.substring("whole", F.col("piece") * PIECE + 1, F.lit(PIECE))
    cut.select("path", "piece", "pieces", own.alias("value")).write.mode("append").parquet(folder)
    payload = F.when(large, codecs.file_envelope(F.col("__path"), preview)).otherwise(F.col("__inline"))
    return marked.withColumn("payload", payload).drop("__path", "__inline", value)


def _held(spark: SparkSession, folder: str) -> DataFrame:
    """(__held_path, held) of each value whose pieces are all there; pieces that a write run again repeats count once, other ones for the same path make it lost."""
    rows = spark.read.schema("path string, piece int, pieces int, value binary").parquet(folder).where("value is not null")
    piece = F.struct(F.coalesce("piece", F.lit(0)).alias("piece"), "value")
    found = rows.groupBy("path").agg(F.array_sort(F.collect_list(piece)).alias("all"), F.coalesce(F.max("pieces"), F.lit(1)).alias("pieces"))
    once = F.filter("all", lambda x, i: (i == 0) | (x != F.get("all", i - 1)))
    found = found.select("path", "pieces", once.alias("once")).where(F.size("once") == F.col("pieces"))
    return found.select(F.col("path").alias("__held_path"), F.array_join(F.transform("once", lambda x: x["value"].cast("string")), "").alias("held"))


def read(rows: DataFrame, folder: str, payload: str = "payload") -> DataFrame:
    """rows with value, the JSON that stands in the payload or in its file, and problem where it can't be had.

    A reference that leaves the folder is refused; one without a file is lost. Only
    rows with a reference are brought together with files, payloads stay where they are.
    """
    head = f"$.{codecs.HEADER}"
    start = codecs._header("inline") + '"value":'
    kind = F.get_json_object(payload, f"{head}.kind")
    file = F.get_json_object(payload, "$.file")
    # what begins as an inline envelope is none of a file, so that long payloads aren't parsed for it
    named = F.coalesce(~F.startswith(payload, F.lit(start)) & (kind == "file") & codecs.path_is_contained(file), F.lit(False))
    inline = F.substring(payload, F.lit(len(start) + 1), F.length(payload) - len(start) - 1)
    others = rows.where(~named).withColumn("__kind", kind).select(
        *(F.col(c) for c in rows.columns),
        F.when(F.col("__kind") == "inline", inline).alias("value"),
        F.when(F.col("__kind").isNull(), "NotAnEnvelope").when(F.col("__kind") == "file", "OutsideFolder").alias("problem"),
    )
    # values are far larger than their files: they are never broadcast
    joined = rows.where(named).withColumn("__file", file).join(_held(rows.sparkSession, folder).hint("merge"), F.col("__file") == F.col("__held_path"), "left")
    return others.union(joined.select(*(F.col(c) for c in rows.columns), F.col("held").alias("value"), F.when(F.col("held").isNull(), "FileLost").alias("problem")))


def written_by(rows: DataFrame, value: str, folder: str, path: Column, execution: str, operation: str, always: bool = False) -> DataFrame:
    """What written does, and beside the values a manifest of who wrote which: (execution, operation, path, sha)."""
    kept = written(rows.withColumn("__value", F.col(value)), value, f"{folder}/values", path, always=always)
    own = kept.where(codecs.envelope_kind(F.col("payload")) == "file")
    sha = F.sha2(F.col("__value").cast("binary"), 256)
    own.select(F.col(execution).alias("execution"), F.col(operation).alias("operation"), F.get_json_object("payload", "$.file").alias("path"), sha.alias("sha")).write.mode("append").parquet(f"{folder}/manifest")
    return kept.drop("__value")


def read_by_origin(rows: DataFrame, folder: str, execution: str, operation: str, external: str, payload: str = "payload") -> DataFrame:
    """rows with value and problem, where only what this library wrote for an operation can name a file.

    external: whether a payload came from outside (a callback's completion): it is
    the value as it stands, whatever it looks like. In a record, a reference is
    honoured if the manifest has it for the same execution and operation (else
    ForeignReference) and the file still holds what was written (else FileChanged).
    """
    outside = F.coalesce(F.col(external), F.lit(False))
    manifest = rows.sparkSession.read.schema("execution string, operation string, path string, sha string").parquet(f"{folder}/manifest").distinct()
    named = F.when(~outside & (codecs.envelope_kind(F.col(payload)) == "file"), F.get_json_object(payload, "$.file"))
    known = manifest.select(F.col("execution").alias("__e"), F.col("operation").alias("__o"), F.col("path").alias("__p"), F.col("sha").alias("__sha"))
    marked = rows.withColumn("__named", named)
    same = (F.col(execution).cast("string") == F.col("__e")) & (F.col(operation).cast("string") == F.col("__o")) & (F.col("__named") == F.col("__p"))
    marked = marked.join(known, same, "left").withColumn("__foreign", F.col("__named").isNotNull() & F.col("__p").isNull())
    trusted = marked.withColumn("__payload", F.when(~outside & ~F.col("__foreign"), F.col(payload)))
    found = read(trusted, f"{folder}/values", "__payload")
    changed = F.col("__named").isNotNull() & F.col("value").isNotNull() & (F.sha2(F.col("value").cast("binary"), 256) != F.col("__sha"))
    problem = F.when(F.col("__foreign"), "ForeignReference").when(changed, "FileChanged").when(~outside, F.col("problem"))
    value = F.when(outside, F.col(payload)).when(~changed, F.col("value"))
    return found.select(*(F.col(c) for c in rows.columns), value.alias("value"), problem.alias("problem"))
