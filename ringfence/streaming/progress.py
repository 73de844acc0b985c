"""Progress accounting of running streams: rows, batch times and dropped late rows as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ringfence.session import new_path

PROGRESS = (
    "query string, batch_id long, at string, rows long, batch_seconds double, rows_per_second double, "
    "dropped_late long, state_rows long"
)
HELD = 500


class ProgressLog(StreamingQueryListener):
    """Listens to all queries of a session and writes a row per micro-batch.

    Rows are held back up to ``held`` of them, or until :meth:`table` is asked for. ``dropped_late`` counts the rows past the
    watermark as the stateful operators of the query report them: combined ones where the operator gets rows combined.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, held: int = HELD):
        self.spark, self.path, self.held, self.rows = spark, path or new_path(spark, "progress"), held, []
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seconds = p.batchDuration / 1000
        self.rows.append((
            p.name or str(p.id), p.batchId, p.timestamp, p.numInputRows, seconds, p.numInputRows / seconds if seconds else None,
            sum(s.numRowsDroppedByWatermark for s in p.stateOperators), sum(s.numRowsTotal for s in p.stateOperators)))
        if len(self.rows) >= self.held:
            self.flush()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        """All micro-batches so far, as ``latency_summary`` takes them (``batch_seconds`` by ``query``)."""
        self.flush()
        return self.spark.read.schema(PROGRESS).option("pathGlobFilter", "*.parquet").parquet(self.path)

    def close(self) -> None:
        self.spark.streams.removeListener(self)
        self.flush()
