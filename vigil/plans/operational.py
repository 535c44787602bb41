"""Operational queries: boards, alarms, searches, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.functions import scalars as S
from vigil.operators import bindings as B
from vigil.operators import boards as O
from vigil.plans.registry import query

LATEST = "latest AS (SELECT * FROM journal QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY event_time DESC NULLS LAST, event_id DESC) = 1)"
SCORES = "scores AS (SELECT event_id AS id, channel_id, CAST(event_time AS DATE) AS as_of_date, round(value_numeric / 500.0, 6) AS score FROM journal WHERE value_state = 'purchase')"


def scores_of(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in score ledger: purchases, value / 500 as the score of their day."""
    return B.journal(spark, d).where("value_state = 'purchase'").select(F.col("event_id").alias("id"), "channel_id", F.to_date("event_time").alias("as_of_date"), F.round(F.col("value_numeric") / 500.0, 6).alias("score"))


@query(f", {LATEST} SELECT event_id, channel_id, event_time, alarm, value_state FROM latest")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    """W01"""
    return O.latest_events(B.journal(spark, d)).select("event_id", "channel_id", "event_time", "alarm", "value_state")


@query(f", {LATEST} SELECT event_id, channel_id, event_time, sensor_type, object_id, object_name FROM latest JOIN channels USING (channel_id) LEFT JOIN objects USING (object_id) WHERE alarm")
def active_alarms(spark: SparkSession, d: str) -> DataFrame:
    """W03, J02"""
    return O.active_alarms(B.journal(spark, d), B.channels(spark, d), B.objects(spark, d)).select("event_id", "channel_id", "event_time", "sensor_type", "object_id", "object_name")


@query(f", {LATEST} SELECT event_id, channel_id, event_time, row_number() OVER (ORDER BY event_time DESC NULLS LAST, event_id DESC) AS position FROM latest JOIN channels USING (channel_id) WHERE alarm ORDER BY event_time DESC NULLS LAST, event_id DESC LIMIT 20")
def newest_alarms(spark: SparkSession, d: str) -> DataFrame:
    """The 20 newest"""
    return O.active_alarms(B.journal(spark, d), B.channels(spark, d), B.objects(spark, d), 20).select("event_id", "channel_id", "event_time", "position")


@query("SELECT event_id, j.channel_id, event_time, sensor_type, sensor_name, c.object_id, object_name FROM journal j LEFT JOIN channels c USING (channel_id) LEFT JOIN objects o ON o.object_id = c.object_id")
def enriched_events(spark: SparkSession, d: str) -> DataFrame:
    """J01"""
    return O.enriched(B.journal(spark, d), B.channels(spark, d), B.objects(spark, d)).select("event_id", "channel_id", "event_time", "sensor_type", "sensor_name", "object_id", "object_name")


BOARD = f", {LATEST}, board AS (SELECT object_id, object_name, count(*) AS sensors, count(l.event_time) AS sensors_with_data, count(*) FILTER (WHERE l.alarm) AS alarm_sensors, max(l.event_time) AS last_event FROM objects JOIN channels c USING (object_id) LEFT JOIN latest l ON l.channel_id = c.channel_id GROUP BY 1, 2), b AS (SELECT *, CASE WHEN alarm_sensors > 0 THEN 'alarm' WHEN sensors_with_data > 0 THEN 'normal' ELSE 'unknown' END AS status FROM board)"


@query(f"{BOARD} SELECT * FROM b")
def object_board(spark: SparkSession, d: str) -> DataFrame:
    """A01, J03"""
    return O.object_board(B.journal(spark, d), B.channels(spark, d), B.objects(spark, d))


@query(f"{BOARD} SELECT status, count(*) AS objects, CAST(sum(alarm_sensors) AS BIGINT) AS alarm_sensors, max(last_event) AS last_event FROM b GROUP BY status")
def board_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A28"""
    return O.object_board(B.journal(spark, d), B.channels(spark, d), B.objects(spark, d)).groupBy("status").agg(F.count("*").alias("objects"), F.sum("alarm_sensors").alias("alarm_sensors"), F.max("last_event").alias("last_event"))


@query(f"{BOARD} SELECT object_id, object_name, status, CASE status WHEN 'alarm' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END AS priority FROM b")
def board_order(spark: SparkSession, d: str) -> DataFrame:
    """Sorted by priority of the status, then by name"""
    b = O.object_board(B.journal(spark, d), B.channels(spark, d), B.objects(spark, d))
    priority = F.when(F.col("status") == "alarm", 0).when(F.col("status") == "unknown", 1).otherwise(2)
    return b.select("object_id", "object_name", "status", priority.alias("priority")).orderBy("priority", "object_name", "object_id")


@query("SELECT CAST(event_time AS DATE) AS day, count(*) AS observations, count(*) FILTER (WHERE alarm) AS alarms FROM journal GROUP BY 1")
def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """A02"""
    return O.daily_counts(B.journal(spark, d))


@query("SELECT object_id, status, count(*) AS requests, max(created_at) FILTER (WHERE status = 'F') AS last_completed FROM requests JOIN channels USING (channel_id) GROUP BY 1, 2")
def repair_summary(spark: SparkSession, d: str) -> DataFrame:
    """A03"""
    return O.repair_summary(B.requests(spark, d), B.channels(spark, d))


@query("SELECT channel_id, count(*) AS readings FROM journal WHERE value_state = 'purchase' AND value_numeric IS NOT NULL GROUP BY 1 ORDER BY readings DESC, channel_id LIMIT 25")
def most_numeric_channels(spark: SparkSession, d: str) -> DataFrame:
    """A05"""
    return B.journal(spark, d).where("value_state = 'purchase' and value_numeric is not null").groupBy("channel_id").agg(F.count("*").alias("readings")).orderBy(F.desc("readings"), "channel_id").limit(25)


@query("SELECT event_id, event_time, alarm, value_numeric, row_number() OVER (ORDER BY event_time NULLS FIRST, event_id) AS position FROM (SELECT * FROM journal WHERE channel_id = 7 ORDER BY event_time DESC NULLS LAST, event_id DESC LIMIT 100)")
def channel_history(spark: SparkSession, d: str) -> DataFrame:
    """T02"""
    return O.history(B.journal(spark, d), 7, 100).select("event_id", "event_time", "alarm", "value_numeric", "position")


@query(", last_rows AS (SELECT * FROM journal QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY event_time DESC NULLS LAST, event_id DESC) <= 50) SELECT channel_id, count(*) FILTER (WHERE value_state = 'purchase') AS numeric_rows, count(*) FILTER (WHERE alarm) AS alarm_rows FROM last_rows GROUP BY 1")
def history_counters(spark: SparkSession, d: str) -> DataFrame:
    """A06 for every channel: over its last 50 events"""
    by = Window.partitionBy("channel_id").orderBy(F.desc_nulls_last("event_time"), F.desc("event_id"))
    last = B.journal(spark, d).withColumn("n", F.row_number().over(by)).where("n <= 50")
    return last.groupBy("channel_id").agg(F.count_if(F.col("value_state") == "purchase").alias("numeric_rows"), F.count_if(F.col("alarm")).alias("alarm_rows"))


@query("SELECT state, count(*) AS n FROM (SELECT unnest(['all', 'alarm', 'normal', 'unknown']) AS state) s JOIN (SELECT CASE WHEN value_state = 'signup' THEN NULL ELSE alarm END AS alarm FROM journal) j ON state = 'all' OR (state = 'alarm' AND alarm) OR (state = 'normal' AND NOT alarm) OR (state = 'unknown' AND alarm IS NULL) GROUP BY 1")
def alarm_states(spark: SparkSession, d: str) -> DataFrame:
    """P02, with sign-ups as events of unknown alarm"""
    j = B.journal(spark, d).withColumn("alarm", F.when(F.col("value_state") != "signup", F.col("alarm")))
    counts = j.agg(*(F.count_if(O.alarm_filter(s)).alias(s) for s in ("all", "alarm", "normal", "unknown")))
    return counts.unpivot([], ["all", "alarm", "normal", "unknown"], "state", "n")


@query("SELECT event_id, channel_id, event_time, value_state FROM journal WHERE event_time >= TIMESTAMP '2024-01-05 00:00:00' AND event_time <= TIMESTAMP '2024-01-12 12:00:00' AND NOT alarm")
def time_range(spark: SparkSession, d: str) -> DataFrame:
    """P03, P06"""
    t = F.col("event_time")
    return B.journal(spark, d).where((t >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")) & (t <= F.lit("2024-01-12 12:00:00").cast("timestamp_ntz")) & O.alarm_filter("normal")).select("event_id", "channel_id", "event_time", "value_state")


@query("SELECT event_id, channel_id, object_id FROM journal JOIN channels USING (channel_id) JOIN objects USING (object_id) WHERE object_name ILIKE '%ion_1%' OR sensor_name ILIKE '%ion_1%'")
def name_search(spark: SparkSession, d: str) -> DataFrame:
    """P04, F08"""
    return O.enriched(B.journal(spark, d), B.channels(spark, d), B.objects(spark, d), "inner").where(O.name_or_id("ion_1", ["object_name", "sensor_name"], "channel_id")).select("event_id", "channel_id", "object_id")


@query("SELECT event_id, channel_id FROM journal JOIN channels USING (channel_id) WHERE sensor_name ILIKE '%12%' OR channel_id = 12")
def id_search(spark: SparkSession, d: str) -> DataFrame:
    """P04 with a number"""
    return B.journal(spark, d).join(B.channels(spark, d), "channel_id").where(O.name_or_id("12", ["sensor_name"], "channel_id")).select("event_id", "channel_id")


@query("SELECT event_id, value_state FROM journal WHERE value_state ILIKE '%rch%' OR CAST(event_id AS VARCHAR) ILIKE '%rch%'")
def value_search(spark: SparkSession, d: str) -> DataFrame:
    """P05"""
    return B.journal(spark, d).where(O.value_search("rch")).select("event_id", "value_state")


@query("SELECT event_id, event_time, row_number() OVER (ORDER BY event_time DESC NULLS LAST, event_id DESC) AS position, (SELECT count(*) FROM journal) > 150 AS has_more FROM (SELECT * FROM journal ORDER BY event_time DESC NULLS LAST, event_id DESC LIMIT 50 OFFSET 100)")
def event_page(spark: SparkSession, d: str) -> DataFrame:
    """T01, T11"""
    return O.page(B.journal(spark, d), 100, 50, F.desc_nulls_last("event_time"), F.desc("event_id")).select("event_id", "event_time", "position", "has_more")


@query("SELECT request_id, status, created_at FROM requests WHERE request_id > 500 ORDER BY request_id LIMIT 100")
def request_page(spark: SparkSession, d: str) -> DataFrame:
    """T08, T09"""
    return O.keyset_page(B.requests(spark, d), "request_id", 500, 100).select("request_id", "status", "created_at")


@query("SELECT request_id, channel_id, status, object_name, priority FROM requests JOIN channels USING (channel_id) JOIN objects USING (object_id) WHERE status <> 'F'")
def open_requests(spark: SparkSession, d: str) -> DataFrame:
    """J06"""
    return O.enriched(B.requests(spark, d).where("status <> 'F'"), B.channels(spark, d), B.objects(spark, d), "inner").select("request_id", "channel_id", "status", "object_name", "priority")


@query("SELECT *, previous_status IS NULL OR previous_status = status OR previous_status IN ('O', 'P') AS allowed FROM (SELECT request_id, channel_id, status, priority, created_at, lag(status) OVER w AS previous_status, lag(created_at) OVER w AS previous_at FROM requests WINDOW w AS (PARTITION BY channel_id ORDER BY created_at, request_id))")
def request_history(spark: SparkSession, d: str) -> DataFrame:
    """L29, R07 (transition rules)"""
    return O.request_history(B.requests(spark, d)).select("request_id", "channel_id", "status", "priority", "created_at", "previous_status", "previous_at", "allowed")


@query("SELECT event_id AS notice_id, j.channel_id FROM journal j WHERE alarm AND NOT EXISTS (SELECT 1 FROM requests r WHERE r.channel_id = j.channel_id AND r.created_at <= j.event_time AND r.status = 'P')")
def unread_notices(spark: SparkSession, d: str) -> DataFrame:
    """Alarm notices of channels without a pending request before them"""
    j = B.journal(spark, d).where("alarm")
    first = B.requests(spark, d).where("status = 'P'").groupBy("channel_id").agg(F.min("created_at").alias("since"))
    read = j.join(first, "channel_id").where("since <= event_time").select(F.col("event_id").alias("notice_id"))
    notices = j.select(F.col("event_id").alias("notice_id"), F.lit("observed_alarm").alias("kind"), F.col("event_id").alias("ref"))
    return O.unread(notices, read, j.select("event_id", "channel_id")).select("notice_id", "channel_id")


@query(f", {LATEST}, {SCORES}, ls AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY as_of_date DESC, id DESC) = 1) SELECT c.channel_id, l.event_time, l.alarm, l.value_state, ls.as_of_date, ls.score, row_number() OVER (ORDER BY coalesce(l.alarm, false) DESC, coalesce(ls.score, -1) DESC, l.event_time DESC NULLS LAST, c.channel_id) AS position FROM channels c LEFT JOIN latest l ON l.channel_id = c.channel_id LEFT JOIN ls ON ls.channel_id = c.channel_id WHERE c.object_id = 3")
def sensor_board(spark: SparkSession, d: str) -> DataFrame:
    """L25, W02, T03, J04"""
    return O.sensor_board(B.journal(spark, d), B.channels(spark, d), scores_of(spark, d), 3).select("channel_id", "event_time", "alarm", "value_state", "as_of_date", "score", "position")


@query(f", {SCORES}, newest AS (SELECT max(as_of_date) AS day FROM scores), best AS (SELECT * FROM scores WHERE as_of_date = (SELECT day FROM newest) QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY id DESC) = 1) SELECT c.channel_id, c.object_id, s.score, o.object_id IS NOT NULL AS bound, s.score IS NOT NULL AS available, CASE WHEN o.object_id IS NULL THEN 'NOT_BOUND' WHEN s.score IS NULL THEN 'NO_SCORE' ELSE 'OK' END AS availability_reason FROM channels c LEFT JOIN objects o ON o.object_id = c.object_id AND o.parent_id < 4 LEFT JOIN best s ON s.channel_id = c.channel_id")
def forecast_board(spark: SparkSession, d: str) -> DataFrame:
    """Objects of the last region count as not bound"""
    scores = scores_of(spark, d)
    newest = scores.agg(F.max("as_of_date").alias("as_of_date"))
    best = O.latest_per_key(scores.join(newest, "as_of_date", "left_semi"), "channel_id", F.desc("id")).select("channel_id", "score")
    bound = B.objects(spark, d).where("parent_id < 4").select(F.col("object_id").alias("o"))
    rows = B.channels(spark, d).join(bound, F.col("object_id") == F.col("o"), "left").join(best, "channel_id", "left")
    reason = F.when(F.col("o").isNull(), "NOT_BOUND").when(F.col("score").isNull(), "NO_SCORE").otherwise("OK")
    return rows.select("channel_id", "object_id", "score", F.col("o").isNotNull().alias("bound"), F.col("score").isNotNull().alias("available"), reason.alias("availability_reason"))


@query("SELECT CASE WHEN event_time IS NULL OR event_time >= TIMESTAMP '2024-01-20' THEN 'operational' ELSE 'archive' END AS part, count(*) AS n, min(event_id) AS first_id FROM journal GROUP BY 1")
def archive_split(spark: SparkSession, d: str) -> DataFrame:
    """P18"""
    recent = F.col("event_time").isNull() | (F.col("event_time") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return B.journal(spark, d).groupBy(F.when(recent, "operational").otherwise("archive").alias("part")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT channel_id, substr(sha256('pepper' || CAST(channel_id AS VARCHAR)), 1, 16) AS alias, CAST('0x' || substr(md5(CAST(channel_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 3 AS sampled FROM channels")
def pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    """F11, P11, P13"""
    c = F.col("channel_id")
    return B.channels(spark, d).select(c, S.pseudonym(c, "pepper").alias("alias"), S.in_sample(c, 10, 3).alias("sampled"))


@query("SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, count(*) - count(DISTINCT event_id) AS repeated_ids, count(*) FILTER (WHERE alarm) AS alarms, min(event_time) AS first_time, max(event_time) AS last_time, count(DISTINCT channel_id) AS channels FROM journal")
def journal_audit(spark: SparkSession, d: str) -> DataFrame:
    """A04, A21, A32"""
    return B.journal(spark, d).agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("ids"), (F.count("*") - F.count_distinct("event_id")).alias("repeated_ids"), F.count_if(F.col("alarm")).alias("alarms"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"), F.count_distinct("channel_id").alias("channels"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM journal")
def json_payload(spark: SparkSession, d: str) -> DataFrame:
    """F22"""
    return B.journal(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT o.object_id, o.object_name, r.r_name AS parent_name FROM objects o LEFT JOIN region r ON r.r_regionkey = o.parent_id")
def object_parents(spark: SparkSession, d: str) -> DataFrame:
    """Object hierarchy"""
    r = B.table(spark, d, "region").select(F.col("r_regionkey").alias("parent_id"), F.col("r_name").alias("parent_name"))
    return B.objects(spark, d).join(r, "parent_id", "left").select("object_id", "object_name", "parent_name")
