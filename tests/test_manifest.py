"""Writes in a chain of tokens, and payloads by who wrote them."""

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions import codecs
from ledgerfold.sources import manifest, payloads
from ledgerfold.streaming import sink


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, status string, seq long")


def test_of_two_writers_with_one_token_one_is_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    one = manifest.append(folder, "", _rows(spark, ("a", "STARTED", 1), ("b", "STARTED", 1), ("a", "READY", 2)), ["id"], "one")
    with pytest.raises(manifest.TokenWithdrawn):
        manifest.append(folder, "", _rows(spark, ("a", "FAILED", 9)), ["id"], "two")
    assert manifest.append(folder, "", _rows(spark, ("x", "FAILED", 9)), ["id"], "one") == one  # run again: nothing changes
    two = manifest.append(folder, one, _rows(spark, ("b", "SUCCEEDED", 3)), ["id"], "two")
    assert manifest.head(spark, folder) == manifest.head(spark, folder, one) == two
    chain = manifest.entries(spark, folder).orderBy("number").collect()
    assert [(r.number, r.follows, r.token, r.writer) for r in chain] == [(1, "", one, "one"), (2, one, two, "two")]
    assert sorted(r.id for r in spark.read.parquet(chain[0].changed).collect()) == ["a", "b"]
    state = lambda: sorted(map(tuple, manifest.state(spark, folder, ["id"], ["seq"]).select("id", "status", "seq").collect()))
    assert state() == [("a", "READY", 2), ("b", "SUCCEEDED", 3)]


def test_snapshots_take_the_place_of_what_was_before(spark, tmp_path):
    folder, token = f"file://{tmp_path}/log", ""
    for n in range(4):
        token = manifest.append(folder, token, _rows(spark, ("a", f"s{n}", 9 - n), (f"k{n}", "new", 0)), ["id"], str(n))
        if n == 2:
            whole = manifest.entries(spark, folder).select("rows").collect()
            assert manifest.compact(spark, folder, ["id"], ["seq"]) == 3
            for r in whole:  # reads don't need them any more
                at = spark._jvm.org.apache.hadoop.fs.Path(r.rows)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    state = manifest.state(spark, folder, ["id"], ["seq"])
    assert sorted(map(tuple, state.select("id", "status").collect())) == [("a", "s3"), *((f"k{n}", "new") for n in range(4))]
    assert manifest.compact(spark, folder, ["id"], ["seq"]) == 4 and manifest.state(spark, folder, ["id"], ["seq"]).count() == 5


def test_a_folder_without_writes(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert manifest.entries(spark, folder).collect() == [] and manifest.head(spark, folder) == ""
    assert manifest.state(spark, folder, ["id"], ["seq"], "id string, status string, seq long").columns == ["id", "status", "seq"]
    assert manifest.compact(spark, folder, ["id"], ["seq"]) == 0
    assert sink.written(spark, folder, "key string").columns == ["key", "batch"]


def test_a_stream_writes_a_chain(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    write = sink.chained(folder, ["id"])
    write(_rows(spark, ("a", "STARTED", 1)), 0)
    write(_rows(spark, ("a", "READY", 2), ("b", "STARTED", 2)), 1)
    again = sink.chained(folder, ["id"])  # after a restart the last batch comes again
    again(_rows(spark, ("a", "LOST", 7)), 1)
    again(_rows(spark, ("b", "FAILED", 3)), 2)
    assert [r.writer for r in manifest.entries(spark, folder).orderBy("number").collect()] == ["batch 0", "batch 1", "batch 2"]
    assert sorted(map(tuple, manifest.state(spark, folder, ["id"], ["seq"]).collect())) == [("a", "READY", 2), ("b", "FAILED", 3)]


def test_only_own_references_are_honoured(spark, tmp_path):
    folder = f"file://{tmp_path}/payloads"
    rows = spark.createDataFrame([("e1", "o1", '"one"'), ("e1", "o2", '"two"'), ("e2", "o1", '"three"')], "e string, o string, value string")
    kept = payloads.written_by(rows, "value", folder, F.concat("e", F.lit("/"), "o"), "e", "o", always=True)
    theirs = {(r.e, r.o): r.payload for r in kept.collect()}
    inline = '{"k":1}'
    sent = [
        ("e1", "o1", theirs["e1", "o1"], False, '"one"', None),
        ("e1", "o2", theirs["e1", "o1"], False, None, "ForeignReference"),
        ("e2", "o1", theirs["e1", "o1"], False, None, "ForeignReference"),
        ("e1", "o1", theirs["e1", "o1"], True, theirs["e1", "o1"], None),
        ("e9", "o9", inline, True, inline, None),
        ("e9", "o9", inline, None, None, "NotAnEnvelope"),
        ("e1", "o1", None, False, None, "NotAnEnvelope"),
    ]
    df = spark.createDataFrame([s[:4] for s in sent], "e string, o string, payload string, outside boolean")
    got = payloads.read_by_origin(df, folder, "e", "o", "outside")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, sent))
    spark.createDataFrame([("e2/o1", '"forged"')], "path string, value string").write.mode("overwrite").parquet(f"{folder}/values")
    (r,) = payloads.read_by_origin(df.limit(0).unionByName(spark.createDataFrame([("e2", "o1", theirs["e2", "o1"], False)], df.schema)), folder, "e", "o", "outside").collect()
    assert (r.value, r.problem) == (None, "FileChanged")
    assert codecs.HEADER in theirs["e1", "o1"]


def test_long_values_lie_in_short_rows_and_come_back_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/payloads"
    value = lambda n: '"' + "aéß漢😀"[n % 5 :] * n + '"'
    long = {f"p{n}": value(n) for n in (9000, 8191, 20_001, 30_003, 40_007)} | {"empty": "", "one": '"x"'}
    rows = spark.createDataFrame(list(long.items()), "id string, value string")
    kept = payloads.written(rows, "value", folder, F.concat(F.lit("run/"), "id"), always=True)
    assert spark.read.parquet(folder).agg(F.max(F.octet_length("value"))).first()[0] <= 8192
    assert {r.id: (r.value, r.problem) for r in payloads.read(kept, folder).collect()} == {k: (v, None) for k, v in long.items()}
    payloads.written(rows.where("id <> 'p9000'"), "value", folder, F.concat(F.lit("run/"), "id"), always=True)  # a write run again
    assert {r.id: r.value for r in payloads.read(kept, folder).collect()} == long
    other = spark.createDataFrame([("p9000", value(9001)), ("one", '"y"')], "id string, value string")
    payloads.written(other, "value", folder, F.concat(F.lit("run/"), "id"), always=True)
    lost = {r.id for r in payloads.read(kept, folder).collect() if (r.value, r.problem) == (None, "FileLost")}
    assert lost == {"p9000", "one"}


def test_a_value_without_one_of_its_pieces_is_lost(spark, tmp_path):
    folder = f"file://{tmp_path}/payloads"
    rows = spark.createDataFrame([("a", '"' + "x" * 50_000 + '"')], "id string, value string")
    kept = payloads.written(rows, "value", folder, F.col("id"), always=True)
    spark.read.parquet(folder).where("piece <> 3").write.parquet(f"{folder}-cut")
    (r,) = payloads.read(kept, f"{folder}-cut").collect()
    assert (r.value, r.problem) == (None, "FileLost")


def test_inline_payloads_stay_where_they_are(spark, tmp_path):
    folder = f"file://{tmp_path}/payloads"
    rows = spark.range(80, numPartitions=8).select("id", F.concat(F.lit('"'), F.repeat(F.lit("y"), (F.col("id") % 2 * 300_000).cast("int")), F.lit('"')).alias("value"))
    kept = payloads.written(rows, "value", folder, F.concat(F.lit("run/"), F.col("id").cast("string")))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more files
    try:
        got = payloads.read(kept, folder).withColumn("at", F.spark_partition_id()).select("id", F.length("value").alias("n"), "problem", "at").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted((r.id, r.n, r.problem) for r in got) == [(i, 2 + i % 2 * 300_000, None) for i in range(80)]
    assert len({r.at for r in got if r.id % 2 == 0}) == 8
