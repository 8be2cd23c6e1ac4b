"""Progress of streaming queries as rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS = "query_id string, batch_id bigint, at string, input_rows bigint, batch_ms bigint, state string, detail string"


class ProgressLog(StreamingQueryListener):
    """Keeps the latest ``size`` progress events of this session as rows; ``flush`` moves them to a table that keeps all."""

    def __init__(self, size: int = 10_000) -> None:
        self.size = size
        self.rows: list[tuple] = []

    def _add(self, row: tuple) -> None:
        self.rows.append(row)
        del self.rows[:-self.size]

    def onQueryStarted(self, event) -> None:
        self._add((str(event.id), None, event.timestamp, None, None, "running", None))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add((str(p.id), p.batchId, p.timestamp, p.numInputRows, p.batchDuration, "progress",
                   json.dumps(dict(p.durationMs))))

    def onQueryIdle(self, event) -> None:
        self._add((str(event.id), None, event.timestamp, 0, None, "idle", None))

    def onQueryTerminated(self, event) -> None:
        self._add((str(event.id), None, None, None, None, "failed" if event.exception else "succeeded",
                   event.exception))

    def flush(self, spark: SparkSession, path: str) -> int:
        """Append the rows held so far to a table and forget them; returns how many there were."""
        taken = len(self.rows)
        if taken:
            spark.createDataFrame(self.rows[:taken], PROGRESS).coalesce(1).write.mode("append").parquet(path)
            del self.rows[:taken]
        return taken

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, PROGRESS)
