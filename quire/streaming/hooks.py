"""Progress callbacks of streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class ProgressHook(StreamingQueryListener):
    """Calls `on_progress(query name or id, batch id, rows read)` after every batch."""

    def __init__(self, on_progress: Callable[[str, int, int], None]):
        self.on_progress = on_progress

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.on_progress(p.name or str(p.id), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def watch(spark: SparkSession, on_progress: Callable[[str, int, int], None]) -> ProgressHook:
    hook = ProgressHook(on_progress)
    spark.streams.addListener(hook)
    return hook
