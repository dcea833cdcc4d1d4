"""Progress of streaming runs as rows of a table, one a batch."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

ROW = ("query_id string, run_id string, batch long, at string, input_rows long, rows_per_second double, batch_ms long,"
       " state_rows long, counters map<string,long>")


class ProgressTable(StreamingQueryListener):
    """Writes a row for every batch that did work: when, how many rows, how fast, and what the stream's `observe` counted.

    A batch has a folder of its own under `path`, by query and number, so one that runs again after a restart replaces its row.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self._ended = spark, path, {}
        self.failure: BaseException | None = None

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self._of(event.runId)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        if "addBatch" not in p.durationMs:
            return  # it only looked for data
        counters = {f"{name}.{k}": int(v) for name, row in p.observedMetrics.items() for k, v in row.asDict().items() if v is not None}
        rate = p.processedRowsPerSecond
        row = (str(p.id), str(p.runId), p.batchId, p.timestamp, p.numInputRows, float(rate) if rate is not None else None, p.batchDuration,
               sum(s.numRowsTotal for s in p.stateOperators), counters)
        try:
            out = f"{self.path}/query={p.id}/number={p.batchId}"
            self.spark.createDataFrame([row], ROW).coalesce(1).write.mode("overwrite").parquet(out)
        except Exception as e:  # a listener's errors reach nobody: ended() raises it
            self.failure = e

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self._of(event.runId).set()

    def _of(self, run_id: object) -> threading.Event:
        return self._ended.setdefault(str(run_id), threading.Event())

    def ended(self, run_id: object, seconds: float = 120) -> None:
        """Wait until all rows of a run that is over are written."""
        if not self._of(run_id).wait(seconds):
            raise TimeoutError(f"no end of run {run_id} was heard of")
        if self.failure is not None:
            raise self.failure


@contextmanager
def progress_table(spark: SparkSession, path: str) -> Iterator[ProgressTable]:
    """Record the runs started within."""
    table = ProgressTable(spark, path)
    spark.streams.addListener(table)
    try:
        yield table
    finally:
        spark.streams.removeListener(table)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(path)
