"""Streaming queries that take all events there are and stop; each equals its batch twin."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import bindings as B
from vigil.operators.states import LINK
from vigil.plans.registry import query
from vigil.plans.temporal import CELLS
from vigil.streaming import stream as R


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp() if spark.sparkContext.master.startswith("local") else None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def events_of(spark: SparkSession, d: str) -> DataFrame:
    """The driver's events as a stream of files; a table of one file is found by its name in its folder."""
    static = B.table(spark, d, "events")
    raw = spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet*")
    return raw.select("event_id", F.col("user_id").alias("channel_id"), F.col("ts").cast("timestamp").alias("event_time"), (F.col("event_type") == "error").alias("alarm"), F.col("value").alias("value_numeric"), F.col("event_type").alias("value_state"))


def complete(stream: DataFrame) -> DataFrame:
    """The last result of a stream in complete mode."""
    spark, at = stream.sparkSession, scratch(stream.sparkSession)
    R.run_batches(stream, lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out"), f"{at}/checkpoint", "complete")
    return spark.read.parquet(f"{at}/out")


def appended(stream: DataFrame) -> DataFrame:
    spark, at = stream.sparkSession, scratch(stream.sparkSession)
    R.run_to_end(stream, f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


@query("SELECT CAST(event_time AS DATE) AS day, count(*) AS observations, count(*) FILTER (WHERE alarm) AS alarms FROM journal GROUP BY 1")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """R12, R01"""
    return complete(R.daily_counts(events_of(spark, d)))


@query("SELECT channel_id, CAST(day + CAST(k AS INTEGER) + 1 AS DATE) AS day_after, CAST(sum(n) AS BIGINT) AS n FROM (SELECT channel_id, CAST(event_time AS DATE) AS day, count(*) AS n FROM journal GROUP BY 1, 2), (SELECT unnest(range(0, 7)) AS k) GROUP BY 1, 2")
def stream_sliding_activity(spark: SparkSession, d: str) -> DataFrame:
    """R13"""
    return complete(R.sliding_activity(events_of(spark, d)))


@query("SELECT event_id AS ref, channel_id, 'observed_alarm' AS kind FROM journal WHERE alarm")
def stream_alarm_notices(spark: SparkSession, d: str) -> DataFrame:
    """R02, R05"""
    return appended(R.alarm_notices(events_of(spark, d), "60 days").select("ref", "channel_id", "kind"))


@query("SELECT event_id, channel_id, object_id FROM journal JOIN channels USING (channel_id)")
def stream_enriched(spark: SparkSession, d: str) -> DataFrame:
    """R04, R08"""
    return appended(R.with_channels(R.not_from_future(events_of(spark, d)), B.channels(spark, d)).select("event_id", "channel_id", "object_id"))


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Stateful operators in pandas need this store of state; the session's own is set again behind them."""
    key = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, held) if held else spark.conf.unset(key)


def changes_of(spark: SparkSession, d: str) -> DataFrame:
    """Hours are cells; purchases of 100 or more cross; faults of 12 hours are sustained; two days without events are a silence."""
    classes = {"fault": LINK.fault, "ok": LINK.ok, "unknown": LINK.unknown}
    with stateful(spark):
        return appended(R.channel_changes(events_of(spark, d), classes, "purchase", 100.0, 43200.0, 2, "h"))


#: Cells without each channel's newest, which a stream holds open.
CLOSED = CELLS + ", closed AS (SELECT * FROM cells QUALIFY t < max(t) OVER (PARTITION BY channel_id))"


@query(f"{CLOSED}, pt AS (SELECT channel_id, t, link_state AS state FROM closed WHERE link_state IS NOT NULL QUALIFY lag(link_state) OVER (PARTITION BY channel_id ORDER BY t) IS DISTINCT FROM link_state), nr AS (SELECT *, lag(state) OVER w AS before, lead(state) OVER w AS after, lead(t) OVER w AS next_t FROM pt WINDOW w AS (PARTITION BY channel_id ORDER BY t)) SELECT channel_id, CAST(t AS TIMESTAMP) AS start, CAST(next_t AS TIMESTAMP) AS \"end\", coalesce(before = 'O', false) AS strict, CASE WHEN after = 'O' THEN CAST(date_diff('second', t, next_t) >= 43200 AS INTEGER) END AS sustained FROM nr WHERE state = 'F' AND next_t IS NOT NULL")
def stream_link_faults(spark: SparkSession, d: str) -> DataFrame:
    """Faults open, close and last by the state machine of each channel"""
    out = changes_of(spark, d).where("kind = 'fault'")
    return out.select("channel_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "strict", "sustained")


@query(", nd AS (SELECT DISTINCT channel_id, CAST(event_time AS DATE) AS day FROM journal), nx AS (SELECT channel_id, day, lead(day) OVER (PARTITION BY channel_id ORDER BY day) AS n FROM nd) SELECT channel_id, CAST(day + 1 AS DATE) AS start, CAST(n - 1 AS DATE) AS \"end\" FROM nx WHERE n - day - 1 >= 2")
def stream_silences(spark: SparkSession, d: str) -> DataFrame:
    """Silences, closed only by a real reading"""
    return changes_of(spark, d).where("kind = 'silence'").select("channel_id", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


@query(", hc AS (SELECT channel_id, date_trunc('hour', event_time) AS t, min(value_numeric) FILTER (WHERE value_state = 'purchase') AS low, max(value_numeric) FILTER (WHERE value_state = 'purchase') AS high FROM journal GROUP BY 1, 2), cl AS (SELECT * FROM hc QUALIFY t < max(t) OVER (PARTITION BY channel_id)), cp AS (SELECT *, lag(high) OVER (PARTITION BY channel_id ORDER BY t) AS before FROM cl WHERE high IS NOT NULL) SELECT channel_id, CAST(t AS TIMESTAMP) AS t FROM cp WHERE low >= 100 AND before < 100")
def stream_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Crossings, with the last cell of readings carried from file to file"""
    return changes_of(spark, d).where("kind = 'crossing'").select("channel_id", F.col("start").cast("timestamp_ntz").alias("t"))


@query(", m AS (SELECT event_id % 1000 AS external_id, event_time AS seen, sha256(value_state) AS h FROM journal), f AS (SELECT *, first_value(h) OVER w AS first_hash, row_number() OVER w AS r FROM m WINDOW w AS (PARTITION BY external_id ORDER BY seen, h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT external_id, CASE WHEN r = 1 THEN 'new' WHEN h = first_hash THEN 'retry' ELSE 'conflict' END AS verdict, count(*) AS n FROM f GROUP BY 1, 2")
def stream_payload_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The first payload of an id stays; the same again is a retry, another one a conflict"""
    messages = events_of(spark, d).select((F.col("event_id") % 1000).cast("string").alias("external_id"), F.col("event_time").alias("seen"), F.col("value_state").alias("payload"))
    with stateful(spark):
        found = appended(R.payload_verdicts(messages))
    return found.groupBy(F.col("external_id").cast("long").alias("external_id"), "verdict").agg(F.count("*").alias("n"))


ARRIVED = """, ar AS (SELECT *, event_time + CASE WHEN event_id % 17 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END AS seen, date_trunc('hour', event_time) AS t FROM journal),
wk AS (SELECT *, CASE WHEN seen < TIMESTAMP '2024-01-11' THEN 1 WHEN seen < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END AS run FROM ar),
ends AS (SELECT run, max(max(seen)) OVER (ORDER BY run) - INTERVAL 1 MINUTE AS w FROM wk GROUP BY run),
tops AS (SELECT channel_id, run, max(t) AS top FROM wk GROUP BY 1, 2),
lt AS (SELECT wk.event_id, wk.channel_id, wk.event_time, bool_or(tops.top > wk.t OR (tops.top = wk.t AND wk.t + INTERVAL 3 HOUR <= ends.w)) AS late FROM wk LEFT JOIN tops ON tops.channel_id = wk.channel_id AND tops.run < wk.run LEFT JOIN ends ON ends.run = wk.run - 1 GROUP BY 1, 2, 3),
ok AS (SELECT wk.* FROM wk JOIN lt USING (event_id) WHERE NOT coalesce(lt.late, false)),
hc AS (SELECT channel_id, t, min(value_numeric) FILTER (WHERE value_state = 'purchase') AS low, max(value_numeric) FILTER (WHERE value_state = 'purchase') AS high, bool_or(value_state = 'error') AS f, bool_or(value_state IN ('view', 'click', 'purchase')) AS o, bool_or(value_state = 'signup') AS u FROM ok GROUP BY 1, 2),
cl AS (SELECT *, CASE WHEN (f AND o) OR u THEN 'A' WHEN f THEN 'F' WHEN o THEN 'O' END AS state FROM hc QUALIFY t < max(t) OVER (PARTITION BY channel_id) OR t + INTERVAL 3 HOUR <= (SELECT max(w) FROM ends)),
cp AS (SELECT channel_id, t, low, lag(high) OVER (PARTITION BY channel_id ORDER BY t) AS before FROM cl WHERE high IS NOT NULL),
pt AS (SELECT channel_id, t, state FROM cl WHERE state IS NOT NULL QUALIFY lag(state) OVER (PARTITION BY channel_id ORDER BY t) IS DISTINCT FROM state),
nr AS (SELECT *, lead(t) OVER (PARTITION BY channel_id ORDER BY t) AS next_t FROM pt),
dd AS (SELECT DISTINCT channel_id, CAST(event_time AS DATE) AS day FROM ok), nx AS (SELECT *, lead(day) OVER (PARTITION BY channel_id ORDER BY day) AS n FROM dd)
SELECT 'late' AS kind, channel_id, event_time AS start, CAST(NULL AS TIMESTAMP) AS "end", event_id FROM lt WHERE late
UNION ALL SELECT 'crossing', channel_id, t, t, NULL FROM cp WHERE low >= 100 AND before < 100
UNION ALL SELECT 'fault', channel_id, t, next_t, NULL FROM nr WHERE state = 'F' AND next_t IS NOT NULL
UNION ALL SELECT 'silence', channel_id, CAST(day + 1 AS TIMESTAMP), CAST(n - 1 AS TIMESTAMP), NULL FROM nx WHERE n - day - 1 >= 2
UNION ALL SELECT 'open_silence', channel_id, CAST(day + 1 AS TIMESTAMP), NULL, NULL FROM nx WHERE n IS NULL AND CAST(day + 3 AS TIMESTAMP) <= (SELECT max(w) FROM ends)"""


@query(ARRIVED)
def stream_late_and_lasting(spark: SparkSession, d: str) -> DataFrame:
    """Events in order of arrival, in three runs of one stream; every 17th comes three days late. Cells are closed by timers two
    hours after they end; late events are told of, as are silences that no reading has ended yet"""
    at = scratch(spark)
    lag = F.when(F.col("event_id") % 17 == 0, F.expr("interval 3 days")).otherwise(F.expr("interval 0 days"))
    arrived = B.table(spark, d, "events").withColumn("seen", (F.col("ts") + lag).cast("timestamp"))
    for run, (start, end) in enumerate((("1970-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2999-01-01"))):
        arrived.where((F.col("seen") >= start) & (F.col("seen") < end)).write.parquet(f"{at}/in/run={run}")
        stream = spark.readStream.schema(arrived.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        rows = stream.select("event_id", F.col("user_id").alias("channel_id"), F.col("ts").cast("timestamp").alias("event_time"), "seen", F.col("value").alias("value_numeric"), F.col("event_type").alias("value_state"))
        classes = {"fault": LINK.fault, "ok": LINK.ok, "unknown": LINK.unknown}
        changes = R.channel_changes(rows, classes, "purchase", 100.0, 43200.0, 2, "h", timedelta(hours=2))
        with stateful(spark):
            R.run_to_end(changes, f"{at}/out", f"{at}/checkpoint")
    found = spark.read.parquet(f"{at}/out")
    ended = found.where("kind IN ('silence', 'undone')").select("channel_id", "start")
    open_ = found.where("kind = 'lasting'").join(ended, ["channel_id", "start"], "left_anti").withColumn("kind", F.lit("open_silence"))
    both = found.where("kind NOT IN ('lasting', 'undone')").unionByName(open_)
    return both.select("kind", "channel_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "event_id")


#: Kinds of messages (fixed names of the interface) that stand in the events.
KINDS = {"purchase": "telemetry", "view": "equipment", "click": "ods", "signup": "work_status", "error": "weather"}


@query(", k AS (SELECT CASE value_state WHEN 'purchase' THEN 'telemetry' WHEN 'view' THEN 'equipment' WHEN 'click' THEN 'ods' WHEN 'signup' THEN 'work_status' ELSE 'weather' END AS kind, event_id, channel_id FROM journal) SELECT kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, count(DISTINCT channel_id) AS channels FROM k GROUP BY 1")
def stream_routed(spark: SparkSession, d: str) -> DataFrame:
    """Messages go to the sink of their kind; a batch is read once, and writing it again replaces it"""
    at = scratch(spark)
    kind = F.coalesce(*(F.when(F.col("value_state") == state, k) for state, k in KINDS.items()))
    sinks = {k: (lambda rows, n, k=k: rows.write.mode("overwrite").parquet(f"{at}/{k}/batch={n}")) for k in KINDS.values()}
    R.run_batches(events_of(spark, d).select("event_id", "channel_id", kind.alias("kind")), R.routed(sinks), f"{at}/checkpoint", "append")
    parts = [spark.read.parquet(f"{at}/{k}").withColumn("kind", F.lit(k)) for k in KINDS.values()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.count_distinct("channel_id").alias("channels"))


@query("SELECT value_state AS source, CAST(max(epoch(TIMESTAMP '2024-01-31') - floor(epoch(event_time))) AS BIGINT) AS lag_s, max(epoch(TIMESTAMP '2024-01-31') - floor(epoch(event_time))) <= 300 AS in_time FROM journal GROUP BY 1")
def source_lags(spark: SparkSession, d: str) -> DataFrame:
    """The largest lag of each source at the end of January"""
    rows = B.journal(spark, d).withColumnRenamed("value_state", "source")
    return R.source_lag(rows, F.lit("2024-01-31 00:00:00").cast("timestamp"), "source")
