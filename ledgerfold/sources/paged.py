"""Operations as an executor gets them: JSON envelopes, and state in pages behind markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import log

RECORD = "struct<Id:string,ParentId:string,Type:string,SubType:string,Name:string,Status:string,Result:string,Attempt:int>"


def operations(envelopes: DataFrame, column: str) -> DataFrame:
    """(arn, id, parent_id, op_type, sub_type, op_name, status, result, attempt) of each envelope's operations; statuses pass as they stand."""
    parsed = envelopes.select(F.from_json(column, f"Arn string, Operations array<{RECORD}>").alias("e"))
    rows = parsed.select(F.col("e.Arn").alias("arn"), F.explode("e.Operations").alias("o"))
    names = {"Id": "id", "ParentId": "parent_id", "Type": "op_type", "SubType": "sub_type", "Name": "op_name", "Status": "status", "Result": "result", "Attempt": "attempt"}
    return rows.select("arn", *(F.col(f"o.{a}").alias(b) for a, b in names.items()))


def bootstrap(envelopes: DataFrame, column: str) -> DataFrame:
    """(arn, marker, next_marker, operations, input) of each envelope: the first page of its execution's state, which `followed` can go on from."""
    schema = f"Arn string, NextMarker string, Input string, Operations array<{RECORD}>"
    parsed = envelopes.select(F.from_json(column, schema).alias("e"))
    none = F.lit(None).cast("string")
    held = F.coalesce("e.Operations", F.from_json(F.lit("[]"), f"array<{RECORD}>"))
    return parsed.select(F.col("e.Arn").alias("arn"), none.alias("marker"), F.nullif("e.NextMarker", F.lit("")).alias("next_marker"), held.alias("operations"), F.col("e.Input").alias("input"))


def followed(pages: DataFrame, execution: str, marker: str, next_marker: str) -> DataFrame:
    """pages with number: those that following each page's next marker reaches, from the first (without a marker) on.

    Pages that no chain leads to are left out, a page is taken once. However long
    a chain is, the rounds are as many as its length has binary digits.
    """
    name = lambda m: F.struct(F.col(execution).alias("execution"), F.coalesce(m, F.lit("")).alias("marker"))
    once = pages.dropDuplicates([execution, marker])
    before = once.where(F.col(next_marker).isNotNull()).select(name(F.col(next_marker)).alias("id"), name(F.col(marker)).alias("from"))
    tree = once.select(name(F.col(marker)).alias("id"), F.col(marker).isNull().alias("first")).join(before, "id", "left")
    tree = tree.where(F.col("first") | F.col("from").isNotNull()).select("id", F.when(~F.col("first"), F.col("from")).alias("parent_id"))
    found = log.descendants(tree.groupBy("id").agg(F.min("parent_id").alias("parent_id"))).select("id", F.col("depth").alias("number"))
    return once.withColumn("id", name(F.col(marker))).join(found, "id").drop("id")


def state_of(pages: DataFrame, execution: str, operations_col: str, key: str) -> DataFrame:
    """The state that numbered pages of operations (an array of structs) give, with page_number: of a record that several pages hold, the last page's."""
    rows = pages.select(execution, F.col("number").alias("page_number"), F.explode(operations_col).alias("o")).select(execution, "page_number", "o.*")
    return log.state(rows, [execution, key], ["page_number"])
