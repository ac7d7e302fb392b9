"""What a stream has done, as rows, and a stop between batches."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = "query string, batch long, at string, input_rows long, seconds double"


class Progress(StreamingQueryListener):
    """A row for each batch of the session's streams that ended, and streams that end after the batch in hand."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.stopping = spark, [], {}
        self.ended = threading.Condition()
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        return None

    def onQueryIdle(self, event) -> None:
        self._end(str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = json.loads(p.json).get("durationMs", {}).get("triggerExecution", 0) / 1000
        with self.ended:
            self.rows.append((p.name or str(p.id), p.batchId, p.timestamp, p.numInputRows, took))
        self._end(str(p.id))

    def onQueryTerminated(self, event) -> None:
        with self.ended:
            self.stopping.pop(str(event.id), None)
            self.ended.notify_all()

    def _end(self, query: str) -> None:
        """A batch has ended; its stream is stopped from another thread, as the stop waits for this one's events."""
        with self.ended:
            stop = self.stopping.pop(query, None)
        if stop is not None:
            threading.Thread(target=stop, daemon=True).start()

    def stop_after_batch(self, query: StreamingQuery) -> None:
        """The stream ends once the batch in hand, or the next one, is committed."""
        with self.ended:
            self.stopping[str(query.id)] = query.stop

    def table(self) -> DataFrame:
        """``PROGRESS`` so far; a row a batch."""
        with self.ended:
            return self.spark.createDataFrame(list(self.rows), PROGRESS)

    def close(self) -> None:
        self.spark.streams.removeListener(self)


def counting(path: str, *by: str, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes ``<by>, n`` of each batch below ``path``, a repeated batch in its old place, and then does ``then``."""

    def step(batch: DataFrame, number: int) -> None:
        batch.groupBy(*by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if then is not None:
            then(batch, number)

    return step


def totals(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """``<by>, n, batches`` over all batches that ``counting`` wrote."""
    return spark.read.parquet(path).groupBy(*by).agg(F.sum("n").alias("n"), F.count_distinct("batch").alias("batches"))
