"""Counters of standing queries, from what their batches observe on the way."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from feedlens.operators import stats


class Totals(StreamingQueryListener):
    """Adds up the metrics that stats.counted() leaves in the progress of each batch, by query.

    A batch that is repeated after a failure reports once, when it has ended.
    """

    def __init__(self, spark: SparkSession, name: str = "io"):
        self.spark, self.name = spark, name
        self.found: dict[str, dict[int, tuple[int, int]]] = {}
        self.dropped: dict[str, dict[int, int]] = {}
        self.lock = threading.Lock()

    def __enter__(self) -> Totals:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        with self.lock:
            self.dropped.setdefault(str(event.progress.id), {})[event.progress.batchId] = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
            if seen is not None:
                self.found.setdefault(str(event.progress.id), {})[event.progress.batchId] = (seen["total"], seen["filtered"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query_id: str) -> dict[str, int]:
        """Lines seen and lines filtered out by a query so far."""
        with self.lock:
            batches = list(self.found.get(str(query_id), {}).values())
        return {"total": sum(t for t, _ in batches), "filtered": sum(f for _, f in batches)}

    def late(self, query_id: str) -> int:
        """Rows of a query with a watermark that came too late to count."""
        with self.lock:
            return sum(self.dropped.get(str(query_id), {}).values())

    def report(self, query_id: str, stalls: int = 0) -> str:
        seen = self.of(query_id)
        return stats.report(seen["total"], seen["filtered"], stalls)
