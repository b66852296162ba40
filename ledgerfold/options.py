"""What a caller may set for an execution's log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import log, packing


@dataclass(frozen=True)
class Options:
    """checkpoint_dir: shared folder of intermediate tables; write_delay: seconds for which updates are gathered into one write; depth: levels of child operations that plugins see (all if None)."""

    checkpoint_dir: str | None = None
    write_delay: float = 0.0
    depth: int | None = None

    def __post_init__(self) -> None:
        if self.write_delay < 0:
            raise ValueError("updates can't be written before they come")
        if self.depth is not None and self.depth < 0:
            raise ValueError("a number of levels is not negative")

    def applied(self, spark: SparkSession) -> SparkSession:
        """The session with these settings."""
        if self.checkpoint_dir is not None:
            spark.conf.set("spark.checkpoint.dir", self.checkpoint_dir)
        return spark

    def visible(self, tree: DataFrame) -> DataFrame:
        """(id, root, depth) of the operations that plugins see, of a tree (id, parent_id)."""
        return log.descendants(tree, self.depth)

    def windows(self, updates: DataFrame, execution: str, at: str) -> DataFrame:
        """updates with the write window that each falls into, from 1; `at` in seconds."""
        return packing.windows(updates, execution, at, F.col(at) - F.col("was") > self.write_delay)
