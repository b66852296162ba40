"""All queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from . import batch_queries, execution_queries, log_queries, payload_queries, stream_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
