"""Listeners that stand beside a stream, as plugins do beside an execution."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Recorder(StreamingQueryListener):
    """Keeps the order of a stream's life: STARTED, a BATCH with its number and rows, ENDED."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, int, int]] = []

    def onQueryStarted(self, event) -> None:
        self.seen.append(("STARTED", -1, 0))

    def onQueryProgress(self, event) -> None:
        self.seen.append(("BATCH", event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.seen.append(("ENDED", -1, 0))


class Registry:
    """Plugins of a session; of an exclusive group only one may be registered."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.groups: dict[str, StreamingQueryListener] = {}
        self.listeners: list[StreamingQueryListener] = []

    def add(self, listener: StreamingQueryListener, group: str | None = None) -> StreamingQueryListener:
        if group is not None and group in self.groups:
            raise ValueError(f"the group {group} has a plugin already")
        if group is not None:
            self.groups[group] = listener
        self.listeners.append(listener)
        self.spark.streams.addListener(listener)
        return listener

    def close(self) -> None:
        for listener in self.listeners:
            self.spark.streams.removeListener(listener)
        self.listeners, self.groups = [], {}
