"""Queries that really append to, merge into, poll and watch: stored tables, a cursor's ledger, heartbeats."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import bindings as B
from vigil.plans.ingest import PARSED, raw_of
from vigil.plans.registry import query
from vigil.plans.streams import events_of, scratch
from vigil.sources import files as R
from vigil.sources.stored import StoredTable
from vigil.streaming import cursor as C
from vigil.streaming import stream as G
from vigil.streaming.heartbeat import Heartbeats, last_heartbeats

@query(f"""{PARSED}, good AS (SELECT * FROM checked WHERE error IS NULL), r AS (SELECT 1 AS run, count(*) FILTER (WHERE event_id % 3 = 0) AS rows, count(*) FILTER (WHERE event_id % 3 = 0) AS inserted, count(DISTINCT channel_id % 8) FILTER (WHERE event_id % 3 = 0) AS parts FROM good
UNION ALL SELECT 2, count(*), count(*) FILTER (WHERE event_id % 3 <> 0), count(DISTINCT channel_id % 8) FILTER (WHERE event_id % 3 <> 0) FROM good UNION ALL SELECT 3, count(*), 0, 0 FROM good)
SELECT CAST(run AS BIGINT) AS run, rows, inserted, rows - inserted AS skipped, parts, (SELECT count(*) FROM good) AS held, (SELECT CAST(sum(event_id) AS BIGINT) FROM good) AS ids FROM r""")
def stored_append(spark: SparkSession, d: str) -> DataFrame:
    """A third of the events is appended, then all, then all again, which writes no part"""
    good = R.parse_events(raw_of(spark, d)).where("error is null").drop("error")
    table = StoredTable(spark, f"{scratch(spark)}/table", good.schema, "row_hash", F.pmod("channel_id", F.lit(8)))
    runs = [table.append(batch) for batch in (good.where("event_id % 3 = 0"), good, good)]
    out = spark.createDataFrame([(i, r["rows"], r["inserted"], r["skipped"], r["parts"]) for i, r in enumerate(runs, 1)], "run long, rows long, inserted long, skipped long, parts long")
    return out.crossJoin(F.broadcast(table.read().agg(F.count("*").alias("held"), F.sum("event_id").alias("ids"))))


@query("SELECT channel_id, CASE WHEN channel_id % 4 = 0 THEN 'NEW' ELSE sensor_type END AS sensor_type FROM channels UNION ALL SELECT channel_id + 1000000, 'NEW' FROM channels WHERE channel_id % 4 = 0")
def stored_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A stored catalogue after a batch was merged into it twice; the second run writes no part"""
    old = B.channels(spark, d).select("channel_id", "sensor_type")
    some = old.where("channel_id % 4 = 0")
    new = some.select("channel_id", F.lit("OLDER").alias("sensor_type"), F.lit(1).alias("at")).union(some.select("channel_id", F.lit("NEW"), F.lit(2))).union(some.select(F.col("channel_id") + 1000000, F.lit("NEW"), F.lit(1)))
    table = StoredTable(spark, f"{scratch(spark)}/table", old.schema, "channel_id", F.pmod("channel_id", F.lit(8)))
    table.append(old)
    table.upsert(new, "at")
    again = table.upsert(new, "at")
    if again["parts"]:
        raise ValueError(f"a second run wrote {again}")
    return table.read()


@query("SELECT count(*) AS records, count(DISTINCT event_id) AS ids, min(event_id) AS first, max(event_id) AS last, CAST(3 AS BIGINT) AS batches, CAST(1 AS BIGINT) AS failures FROM journal")
def stream_cursor_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Events polled by cursor in three batches; the second fails half-way once and is taken again, so each record counts once"""
    at = scratch(spark)
    path, last = f"{d}/events.parquet", B.table(spark, d, "events").agg(F.max("event_id")).head()[0]

    def fetch(after: int, upto: int) -> Iterator[pa.RecordBatch]:
        found = pa.dataset.dataset(path).to_table(columns=["event_id", "event_type"], filter=(pa.dataset.field("event_id") > after) & (pa.dataset.field("event_id") <= upto))
        yield from found.rename_columns(["cursor", "value"]).cast(pa.schema([("cursor", pa.int64()), ("value", pa.string())])).to_batches()

    def fails(number: int) -> None:
        raise ValueError(f"batch {number} fails")

    failures = 0
    for i, (upto, hook) in enumerate(((last // 3, None), (2 * last // 3, fails), (2 * last // 3, None), (last, None))):
        stream = C.cursor_stream(spark, f"events_by_cursor_{i}", "cursor long, value string", lambda upto=upto: upto, fetch, max(1, last // 16))
        try:
            C.take(stream, C.ledgered(f"{at}/out", hook), f"{at}/checkpoint")
        except StreamingQueryException:
            failures += 1
    found = C.accepted(spark, f"{at}/out").agg(F.count("*").alias("records"), F.count_distinct("cursor").alias("ids"), F.min("cursor").alias("first"), F.max("cursor").alias("last"))
    batches = C.ledger(spark, f"{at}/out").agg(F.count("*").alias("batches"))
    return found.crossJoin(F.broadcast(batches)).withColumn("failures", F.lit(failures).cast("long"))


@query("SELECT 'telemetry' AS source, count(*) AS rows, true AS healthy, true AS succeeded, false AS failed FROM journal UNION ALL SELECT 'weather', CAST(0 AS BIGINT), false, false, true")
def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """What a stream that works and one whose sink fails have left in the table of heartbeats"""
    at = scratch(spark)

    def fails(batch: DataFrame, number: int) -> None:
        raise ValueError("no sink")

    with Heartbeats(spark, f"{at}/beats"):
        G.run_batches(events_of(spark, d), lambda batch, number: batch.write.mode("overwrite").format("noop").save(), f"{at}/good", "append", "telemetry")
        try:
            G.run_batches(events_of(spark, d), fails, f"{at}/bad", "append", "weather")
        except StreamingQueryException:
            pass
    found = last_heartbeats(spark.read.parquet(f"{at}/beats"))
    return found.select("source", "rows", "healthy", F.col("last_success").isNotNull().alias("succeeded"), F.col("last_failure").isNotNull().alias("failed"))
