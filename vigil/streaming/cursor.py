"""A stream whose offset is the cursor of a source that is polled, and a sink whose batches count only when they are whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Span(InputPartition):
    """Records after one cursor up to another."""

    def __init__(self, after: int, upto: int):
        self.after, self.upto = after, upto


class CursorReader(DataSourceStreamReader):
    """newest() gives the newest cursor; fetch(after, upto) the records between two, the same ones whenever it's asked again.

    The offset is the cursor, so Spark's checkpoint holds it; a batch that failed is read again between the same two cursors. A batch is
    split into spans of `span` cursors, which executors fetch; nothing but cursors passes the driver."""

    def __init__(self, newest: Callable[[], int], fetch: Callable[[int, int], Iterator[pa.RecordBatch]], span: int):
        self.newest, self.fetch, self.span = newest, fetch, span

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"cursor": int(self.newest())}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        a, b = start["cursor"], end["cursor"]
        return [Span(x, min(x + self.span, b)) for x in range(a, b, self.span)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from self.fetch(partition.after, partition.upto)


def cursor_stream(spark: SparkSession, name: str, schema: str, newest: Callable[[], int], fetch: Callable[[int, int], Iterator[pa.RecordBatch]], span: int) -> DataFrame:
    """A stream of the records of a polled source; name is the format under which it is registered."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> CursorReader:  # noqa: N802
            return CursorReader(newest, fetch, span)

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


def ledgered(path: str, after_records: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch's records, then its row in the ledger. Both replace what a failed try has left.

    after_records is called between the two (tests let it fail)."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/records/batch={number}")
        if after_records:
            after_records(number)
        rows = batch.sparkSession.read.parquet(f"{path}/records/batch={number}")
        rows.agg(F.count("*").alias("rows"), F.min("cursor").alias("first"), F.max("cursor").alias("last")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")

    return run


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """Records of the batches that stand in the ledger."""
    return spark.read.parquet(f"{path}/records").join(ledger(spark, path).select("batch"), "batch", "left_semi")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/ledger")


def take(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that the source has now, in one batch; a batch that failed before is taken first."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
