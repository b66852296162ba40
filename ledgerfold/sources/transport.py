"""A service of the caller's own as a Spark source and sink of operations.

A Transport says which executions there are, gives their state page by page and
takes updates in two phases. `register` makes a format of it, so that operations
are read and written by spark.read and df.write: a partition an execution, a record
batch a page, so a task holds one page; filters on the execution's name reach the
transport, which is asked for these only. A write counts once all its tasks have
staged their updates; what a failed task or write staged is discarded, and never
counts even if a killed task stages some of it later.
"""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: What is read: each operation with its execution and the number of its page, from 0.
OPERATION = {"id": "string", "parent_id": "string", "op_type": "string", "sub_type": "string", "op_name": "string", "status": "string", "result": "string", "attempt": "int"}
SHAPE = "arn string, page int, " + ", ".join(f"{name} {kind}" for name, kind in OPERATION.items())
FILTERS = "spark.sql.python.filterPushdown.enabled"


class Transport(ABC):
    """What a service must offer. It is pickled and called from tasks on any executor."""

    @abstractmethod
    def executions(self) -> Sequence[str]:
        """The names of all executions."""

    @abstractmethod
    def page(self, execution: str, marker: str | None) -> tuple[list[dict], str | None]:
        """A page of the execution's operations, as dicts by the names of OPERATION, and the next page's marker; None is the first page's, and of the last page's next."""

    def stage(self, write: str, task: str, number: int, updates: list[dict]) -> None:
        """Take a batch of updates of a task of a write, so that they don't count yet. No other attempt has the task's name."""
        raise NotImplementedError(f"{type(self).__name__} can't be written to")

    def commit(self, write: str, tasks: Sequence[str]) -> None:
        """Make what these tasks staged count, all of it or none, and forget what others staged for the write."""
        raise NotImplementedError

    def discard(self, write: str, task: str | None = None) -> None:
        """Forget what the task, or any task, staged for the write, if anything was."""
        raise NotImplementedError


@dataclass
class _Execution(InputPartition):
    name: str


@dataclass
class _Staged(WriterCommitMessage):
    task: str


class _Reader(DataSourceReader):
    def __init__(self, transport: Transport, schema: StructType) -> None:
        self.transport, self.schema, self.wanted = transport, schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is None or f.attribute != ("arn",):
                yield f
            else:
                self.wanted = names if self.wanted is None else self.wanted & names

    def partitions(self) -> list[InputPartition]:
        names = self.transport.executions()
        return [_Execution(n) for n in names if self.wanted is None or n in self.wanted]

    def read(self, partition: _Execution) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        marker, number = None, 0
        seen = set()
        while number == 0 or marker is not None:
            if marker in seen:
                raise ValueError(f"the pages of {partition.name} lead back to {marker}")
            seen.add(marker)
            rows, marker = self.transport.page(partition.name, marker)
            columns = {"arn": [partition.name] * len(rows), "page": [number] * len(rows)} | {c: [r.get(c) for r in rows] for c in OPERATION}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
            number += 1


class _Writer(DataSourceArrowWriter):
    def __init__(self, transport: Transport) -> None:
        self.transport, self.name = transport, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = uuid.uuid4().hex
        try:
            for number, batch in enumerate(iterator):
                self.transport.stage(self.name, task, number, batch.to_pylist())
        except BaseException:
            self.transport.discard(self.name, task)  # the driver hears nothing of this attempt
            raise
        return _Staged(task)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.transport.commit(self.name, [m.task for m in messages if m is not None])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.transport.discard(self.name)  # what tasks staged that were killed, too


def register(spark: SparkSession, name: str, transport: Transport) -> None:
    """Make the format `name` of a transport: spark.read.format(name).load(), df.write.format(name).mode("append").save()."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SHAPE

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(transport, schema)

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
            if overwrite:
                raise ValueError("updates are appended, what was written can't be replaced")
            return _Writer(transport)

    spark.conf.set(FILTERS, "true")
    spark.dataSource.register(Source)
