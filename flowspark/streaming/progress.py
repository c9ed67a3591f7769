"""Progress metrics of streaming queries."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from flowspark.operators.metrics import STREAMING_METRICS, metric_schema

# Duration key reported for each metric; the two offset steps are one key today.
DURATIONS = {
    "Trigger execution": "triggerExecution",
    "Query planning": "queryPlanning",
    "Get batch": "getBatch",
    "Get end offset": "latestOffset",
    "Set offset range": "setOffsetRange",
    "WAL commit": "walCommit",
    "Add batch": "addBatch",
    "Run continuous": "runContinuous",
}


def progress_row(progress) -> tuple:
    """The 13 values of one micro-batch; durations not reported are 0."""
    p = json.loads(progress.json) if hasattr(progress, "json") else progress
    durations = p.get("durationMs", {})
    values = {
        "Batch id": int(p["batchId"]), "Timestamp": p["timestamp"],
        "Input rows": int(p.get("numInputRows", 0)),
        "Input rows per second": float(p.get("inputRowsPerSecond", 0.0)),
        "Processed rows per second": float(p.get("processedRowsPerSecond", 0.0)),
    }
    values |= {name: int(durations.get(key, 0)) for name, key in DURATIONS.items()}
    return tuple(values[n] for n in STREAMING_METRICS)


def _frame(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), metric_schema(STREAMING_METRICS))


def progress_metrics(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """One row per micro-batch that the query itself still remembers: by default the last 100. For all
    batches, :func:`recorded` from before the start."""
    latest = {row[0]: row for row in map(progress_row, query.recentProgress)}
    return _frame(spark, [latest[b] for b in sorted(latest)])


class ProgressListener(StreamingQueryListener):
    """Keeps the progress of one query (by id), or of all queries of the session: every batch, of any
    number. A restarted query has the same id but another run; batches of different runs are kept
    apart. The last report of a batch stands for it."""

    def __init__(self, query_id: str | None = None):
        self.query_id = query_id
        self.rows = {}  # (query id, run id, batch) -> values

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        if self.query_id in (None, str(p.id)):
            self.rows[str(p.id), str(p.runId), p.batchId] = progress_row(p)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def catch_up(self, query: StreamingQuery, seconds: float = 30) -> None:
        """Wait for the report of a finished query's last batch: reports come on a thread of their own."""
        last, end = query.lastProgress, time.monotonic() + seconds
        if last is None:
            return
        last = json.loads(last.json) if hasattr(last, "json") else last
        key = (str(last["id"]), str(last["runId"]), int(last["batchId"]))
        while key not in self.rows and time.monotonic() < end:
            time.sleep(0.05)

    def metrics(self, spark: SparkSession, query: StreamingQuery | None = None) -> DataFrame:
        """A row per batch; of one query, or of all queries seen."""
        rows = self.rows.items()
        return _frame(spark, [v for (q, _, _), v in rows if query is None or q == str(query.id)])


@contextmanager
def recorded(spark: SparkSession):
    """A listener for the queries started inside."""
    listener = ProgressListener()
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)
