"""Heartbeats of streams as a table: what each source last did, and when it last succeeded and failed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

NOTE = "source string, event string, batch long, rows long, at timestamp, error string"


class Heartbeats(StreamingQueryListener):
    """Notes starts, batches, ends and failures of named streams, and appends them to a table of Parquet files.

    A note is a small row for each trigger; they are written in one file when a stream ends, or by flush()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.names, self.notes = spark, path, {}, []

    def _note(self, run: str, event: str, batch: int | None = None, rows: int | None = None, error: str | None = None) -> None:
        self.notes.append((self.names.get(run), event, batch, rows, dt.datetime.now(dt.timezone.utc), error))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.names[str(event.runId)] = event.name or str(event.id)
        self._note(str(event.runId), "started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._note(str(event.progress.runId), "success", event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._note(str(event.runId), "idle")

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._note(str(event.runId), "failure" if event.exception else "ended", error=event.exception[:4000] if event.exception else None)

    def flush(self) -> None:
        """Waits for the notes of what has happened, and writes them."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        notes, self.notes = self.notes, []
        if notes:
            self.spark.createDataFrame(notes, NOTE).coalesce(1).write.mode("append").parquet(self.path)

    def __enter__(self) -> Heartbeats:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *failed) -> None:
        self.flush()
        self.spark.streams.removeListener(self)


def last_heartbeats(notes: DataFrame) -> DataFrame:
    """source, batches and rows taken, last_success, last_failure, last_error, and healthy: no failure after the last success."""
    ok, bad = F.col("event") == "success", F.col("event") == "failure"
    out = notes.groupBy("source").agg(F.count_if(ok).alias("batches"), F.coalesce(F.sum(F.when(ok, F.col("rows"))), F.lit(0)).alias("rows"), F.max(F.when(ok, F.col("at"))).alias("last_success"), F.max(F.when(bad, F.col("at"))).alias("last_failure"), F.max_by(F.when(bad, F.col("error")), F.when(bad, F.col("at"))).alias("last_error"))
    return out.withColumn("healthy", F.col("last_failure").isNull() | F.coalesce(F.col("last_success") > F.col("last_failure"), F.lit(False)))
