"""A transport over folders of JSON pages, read and written as a format of Spark."""

import json
import os
import shutil
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerfold.operators import log
from ledgerfold.sources import transport

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test


class Folder(transport.Transport):
    """Executions are folders, their pages files; staged updates are files until they are moved to the log."""

    def __init__(self, root):
        self.root = str(root)

    def executions(self):
        return sorted(os.listdir(f"{self.root}/pages"))

    def page(self, execution, marker):
        with open(f"{self.root}/asked", "a") as asked:
            asked.write(f"{execution}\n")
        with open(f"{self.root}/pages/{execution}/{marker or 'first'}.json") as f:
            held = json.load(f)
        return held["operations"], held.get("next")

    def stage(self, write, task, number, updates):
        os.makedirs(f"{self.root}/staged/{write}/{task}", exist_ok=True)
        with open(f"{self.root}/staged/{write}/{task}/{number}.json", "w") as f:
            json.dump(updates, f)
        if any(u["status"] == "BROKEN" for u in updates):
            raise OSError("the line went dead")

    def commit(self, write, tasks):
        for task in set(os.listdir(f"{self.root}/staged/{write}")) - set(tasks):
            self.discard(write, task)
        os.rename(f"{self.root}/staged/{write}", f"{self.root}/log/{write}")

    def discard(self, write, task=None):
        shutil.rmtree(f"{self.root}/staged/{write}" + (f"/{task}" if task else ""), ignore_errors=True)

    def written(self):
        return sorted((u["id"], u["status"]) for d, _, names in os.walk(f"{self.root}/log") for n in names for u in json.load(open(f"{d}/{n}")))


@pytest.fixture
def folder(tmp_path):
    os.chmod(tmp_path, 0o777)
    for name in ("pages", "staged", "log"):
        os.makedirs(tmp_path / name)
    for e in range(6):
        os.makedirs(tmp_path / f"pages/run-{e}")
        for n in range(e + 1):
            at, end = "first" if n == 0 else f"m{n}", n == e
            ops = [{"id": f"o{k}", "op_type": "STEP", "status": "SUCCEEDED" if n else "STARTED", "attempt": n} for k in range(3)]
            (tmp_path / f"pages/run-{e}/{at}.json").write_text(json.dumps({"operations": ops} | ({} if end else {"next": f"m{n + 1}"})))
    return Folder(tmp_path)


def test_pages_are_read_and_filters_reach_the_service(spark, folder, tmp_path):
    transport.register(spark, "folder_pages", folder)
    df = spark.read.format("folder_pages").load()
    assert df.count() == sum(3 * (e + 1) for e in range(6))
    newest = log.state(df, ["arn", "id"], ["page"]).where("arn = 'run-2'")
    (tmp_path / "asked").unlink()
    assert sorted((r.id, r.page, r.status, r.parent_id) for r in newest.collect()) == [(f"o{k}", 2, "SUCCEEDED", None) for k in range(3)]
    assert set((tmp_path / "asked").read_text().split()) == {"run-2"}
    assert df.where(F.col("arn").isin("run-0", "run-1") & (F.col("status") == "STARTED")).count() == 6


def test_a_circle_of_markers_is_an_error(spark, folder, tmp_path):
    (tmp_path / "pages/run-5/m5.json").write_text(json.dumps({"operations": [], "next": "m1"}))
    transport.register(spark, "folder_circle", folder)
    with pytest.raises(Exception, match="lead back"):
        spark.read.format("folder_circle").load().where("arn = 'run-5'").collect()


def test_updates_count_all_or_none(spark, folder, tmp_path):
    transport.register(spark, "folder_log", folder)
    shape = spark.read.format("folder_log").load().schema
    rows = lambda *status: spark.createDataFrame([("run-0", 0, f"u{i}", None, "STEP", None, None, s, None, 1) for i, s in enumerate(status)], shape)
    rows(*["SUCCEEDED"] * 6).repartition(3).write.format("folder_log").mode("append").save()
    whole = [(f"u{i}", "SUCCEEDED") for i in range(6)]
    assert folder.written() == whole
    for parts in (1, 3):  # where several tasks run, one that is killed may stage late: it never counts
        with pytest.raises(Exception, match="line went dead"):
            rows(*["FAILED"] * 5, "BROKEN").repartition(parts).write.format("folder_log").mode("append").save()
        assert folder.written() == whole
        assert parts > 1 or os.listdir(tmp_path / "staged") == []
    with pytest.raises(Exception, match="can't be replaced"):
        rows("FAILED").write.format("folder_log").mode("overwrite").save()
