"""Queries on splits, samples, models, forecasts and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators import bindings as B
from vigil.operators import forecasts as P
from vigil.plans import ml as M
from vigil.plans.evaluation import CD, NB, SC, channel_days, crossed_of, rounded, scores_of
from vigil.plans.registry import query

LAST_DAY = "2024-01-30"
ROWS = CD + ", rows AS (SELECT a.channel_id, a.object_id, a.sensor_type, a.day, a.n_events, a.n_alarm, CAST(b.n_alarm > 0 AS INTEGER) AS label FROM cd a LEFT JOIN cd b ON b.channel_id = a.channel_id AND b.day = a.day + 1)"


def rows_of(spark: SparkSession, d: str) -> DataFrame:
    """Channel days with counts, labelled by an alarm on the next observed day."""
    days = channel_days(spark, d)
    after = days.select("channel_id", F.date_sub("day", 1).alias("day"), (F.col("n_alarm") > 0).cast("int").alias("label"))
    return days.join(after, ["channel_id", "day"], "left")


@query(f"{ROWS} SELECT CASE WHEN day + 2 < DATE '2024-01-15' THEN 'train' WHEN day >= DATE '2024-01-15' AND day + 2 < DATE '2024-01-20' THEN 'calibration' WHEN day >= DATE '2024-01-20' AND day + 2 < DATE '2024-01-26' THEN 'validation' WHEN day >= DATE '2024-01-26' THEN 'stress' END AS split, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM rows GROUP BY 1 HAVING split IS NOT NULL")
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    """M01, P10"""
    return M.temporal_split(rows_of(spark, d), "2024-01-15", "2024-01-20", "2024-01-26").groupBy("split").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(f"{ROWS}, c AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM rows), neg AS (SELECT * FROM rows WHERE label = 0 ORDER BY md5('s:' || channel_id || ':' || day), channel_id, day LIMIT (SELECT least(n, p) FROM c)) SELECT channel_id, day, label, CAST(1.0 AS DOUBLE) AS weight FROM rows WHERE label = 1 UNION ALL SELECT channel_id, day, label, (SELECT n / least(n, p) FROM c) FROM neg")
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    """One negative for each positive"""
    return M.sampled(rows_of(spark, d), 1).select("channel_id", "day", "label", "weight")


@query(f"{ROWS} SELECT sensor_type, channel_id, day FROM rows WHERE sensor_type IN (SELECT sensor_type FROM rows GROUP BY 1 HAVING count(*) FILTER (WHERE label = 1) >= 60)")
def selected_types(spark: SparkSession, d: str) -> DataFrame:
    """P20"""
    return P.selected_types(rows_of(spark, d), 60).select("sensor_type", "channel_id", "day")


INC = CD + ", inc AS (SELECT DISTINCT object_id, day FROM cd WHERE n_alarm >= 3), od AS (SELECT DISTINCT object_id, day FROM cd)"


@query(f"{INC}, l AS (SELECT object_id, day, day + 2 > DATE '{LAST_DAY}' AS beyond, EXISTS (SELECT 1 FROM inc i WHERE i.object_id = od.object_id AND i.day BETWEEN od.day - 6 AND od.day) AS recent, EXISTS (SELECT 1 FROM inc i WHERE i.object_id = od.object_id AND i.day = od.day + 1) AS nx, EXISTS (SELECT 1 FROM inc i WHERE i.object_id = od.object_id AND i.day = od.day + 2) AS th FROM od) SELECT object_id, day, CASE WHEN beyond THEN 'window_beyond_data' WHEN recent THEN 'ongoing' WHEN nx THEN 'competing' WHEN th THEN 'positive' ELSE 'negative' END AS reason_incident, CASE WHEN beyond OR recent OR nx THEN NULL WHEN th THEN 1 ELSE 0 END AS target_incident FROM l")
def incident_labels(spark: SparkSession, d: str) -> DataFrame:
    """Three alarms of a channel in a day make an incident"""
    days = channel_days(spark, d)
    return P.incident_labels(days.select("object_id", "day").distinct(), days.where("n_alarm >= 3").select("object_id", "day"), F.lit(LAST_DAY).cast("date"))


@query(f"{CD}, e AS (SELECT channel_id, sensor_type, day, CAST(n_alarm > 0 AS INTEGER) AS event FROM cd), a AS (SELECT *, CAST(coalesce(sum(event) OVER w5, 0) AS BIGINT) AS events_5, CAST(coalesce(sum(event) OVER wa, 0) AS BIGINT) AS events_all, count(*) OVER wa AS days_all FROM e WINDOW w5 AS (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), wa AS (PARTITION BY channel_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)), g AS (SELECT sensor_type, day, sum(event) AS x, count(*) AS n FROM e GROUP BY 1, 2), p AS (SELECT sensor_type, day, sum(x) OVER w / sum(n) OVER w AS prior FROM g WINDOW w AS (PARTITION BY sensor_type ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)) SELECT channel_id, a.day, events_5, events_all, days_all, round((events_all + 20 * coalesce(prior, 0)) / (days_all + 20), 6) AS rate FROM a LEFT JOIN p ON p.sensor_type = a.sensor_type AND p.day = a.day")
def propensity(spark: SparkSession, d: str) -> DataFrame:
    """J10, L23, W25"""
    days = channel_days(spark, d).select("channel_id", "sensor_type", "day", (F.col("n_alarm") > 0).cast("int").alias("event"))
    return rounded(P.propensity(days, "sensor_type", (5,), 20.0), "rate").select("channel_id", "day", "events_5", "events_all", "days_all", "rate")


@query(", rd AS (SELECT channel_id, count(*) FILTER (WHERE value_state = 'purchase') AS readings, arg_max(value_numeric, event_time) FILTER (WHERE value_state = 'purchase' AND event_time >= TIMESTAMP '2024-01-20') AS last_reading FROM journal GROUP BY 1) SELECT channel_id, array_to_string(list_filter([CASE WHEN readings = 0 THEN 'NOT_GAS_STREAM' END, CASE WHEN readings > 0 AND last_reading IS NULL THEN 'NO_GAS_READING_AT_D' END, CASE WHEN last_reading >= 100 THEN 'ABOVE_THRESHOLD_AT_D' END], lambda x: x IS NOT NULL), '|') AS reasons, readings > 0 AND last_reading IS NOT NULL AND last_reading < 100 AS eligible FROM rd")
def eligibility(spark: SparkSession, d: str) -> DataFrame:
    """P14"""
    reading = F.col("value_state") == "purchase"
    recent = reading & (F.col("event_time") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    rows = B.journal(spark, d).groupBy("channel_id").agg(F.count_if(reading).alias("readings"), F.max_by(F.when(recent, F.col("value_numeric")), F.when(recent, F.col("event_time"))).alias("last_reading"))
    return P.eligibility(rows, 100.0).select("channel_id", F.array_join("reasons", "|").alias("reasons"), "eligible")


@query(f"{SC} SELECT channel_id, day, score, CAST(day + 2 AS DATE) AS window_start, CAST(day + 3 AS DATE) AS window_end, CAST(24 AS BIGINT) AS horizon_hours FROM scores")
def forecast_ledger(spark: SparkSession, d: str) -> DataFrame:
    """L28, L10"""
    return P.ledger(scores_of(spark, d)).select("channel_id", "day", "score", "window_start", "window_end", "horizon_hours")


PLAN = ", act AS (SELECT DISTINCT object_id, CAST(event_time AS DATE) AS day FROM journal JOIN channels USING (channel_id) WHERE value_state = 'purchase' AND value_numeric >= 100 AND event_time < TIMESTAMP '2024-01-26'), ag AS (SELECT object_id, day, lead(day) OVER (PARTITION BY object_id ORDER BY day) AS nx FROM act), sil AS (SELECT object_id, arg_min(nx - day - 1, DATE '2024-01-25' - nx + 1) AS silence_length_days, min(DATE '2024-01-25' - nx + 1) AS silence_ended_days_ago FROM ag WHERE nx - day - 1 >= 1 AND DATE '2024-01-25' - nx + 1 BETWEEN 1 AND 21 GROUP BY 1), sch AS (SELECT object_id, DATE '2024-01-20' + CAST(object_id % 7 AS INTEGER) AS start, DATE '2024-01-20' + CAST(object_id % 7 AS INTEGER) + 1 AS \"end\" FROM objects WHERE object_id % 3 = 0), ms AS (SELECT o.object_id, CASE WHEN sch.object_id IS NOT NULL THEN 'verified_schedule' WHEN sil.object_id IS NOT NULL THEN 'possible_recent_silence' ELSE 'unknown' END AS maintenance_context, CAST(silence_length_days AS INTEGER) AS silence_length_days, CAST(silence_ended_days_ago AS INTEGER) AS silence_ended_days_ago, CAST(sch.start AS DATE) AS schedule_start FROM objects o LEFT JOIN sil USING (object_id) LEFT JOIN sch ON sch.object_id = o.object_id AND DATE '2024-01-25' BETWEEN sch.start AND sch.\"end\")"


def maintenance_of(spark: SparkSession, d: str) -> DataFrame:
    """Objects on 25 January; every third has a planned window of two days."""
    activity = B.journal(spark, d).where("value_state = 'purchase' and value_numeric >= 100").join(B.channels(spark, d), "channel_id").select("object_id", F.to_date("event_time").alias("day"))
    start = F.date_add(F.lit("2024-01-20").cast("date"), (F.col("object_id") % 7).cast("int"))
    schedule = B.objects(spark, d).where("object_id % 3 = 0").select("object_id", start.alias("start"), F.date_add(start, 1).alias("end"))
    return P.maintenance_state(B.objects(spark, d).select("object_id"), activity, schedule, F.lit("2024-01-25").cast("date"), least=1)


@query(f"{PLAN} SELECT * FROM ms")
def maintenance_state(spark: SparkSession, d: str) -> DataFrame:
    """Verified schedule, recent silence or unknown, as of a day"""
    return maintenance_of(spark, d).select("object_id", "maintenance_context", "silence_length_days", "silence_ended_days_ago", "schedule_start")


@query(f"{PLAN}, dy AS (SELECT channel_id, count(*) FILTER (WHERE value_state = 'purchase') AS readings, arg_max(value_numeric, (event_time, event_id)) FILTER (WHERE value_state = 'purchase') AS last_reading FROM journal WHERE event_time < TIMESTAMP '2024-01-26' GROUP BY 1), rc AS (SELECT channel_id, object_id, readings, last_reading, maintenance_context FROM dy JOIN channels USING (channel_id) JOIN ms USING (object_id)) SELECT channel_id, CASE WHEN last_reading >= 100 THEN 'CURRENT_ALARM_PROTOCOL' WHEN readings = 0 THEN 'CHECK_TELEMETRY' WHEN channel_id % 10 = 3 THEN 'NO_GAS_FORECAST' WHEN maintenance_context = 'verified_schedule' THEN 'REVIEW_VERIFIED_PPR' WHEN maintenance_context = 'possible_recent_silence' THEN 'CHECK_MAINTENANCE_LOG' ELSE 'REVIEW_GAS_TREND' END AS code, CASE WHEN last_reading >= 100 THEN 'ABOVE_THRESHOLD_AT_D' WHEN readings = 0 THEN 'NO_GAS_READING_AT_D' WHEN channel_id % 10 = 3 THEN 'ABSTAIN' WHEN maintenance_context = 'verified_schedule' THEN 'GAS_PROXY|VERIFIED_SCHEDULE' WHEN maintenance_context = 'possible_recent_silence' THEN 'GAS_PROXY|POSSIBLE_RECENT_SILENCE' ELSE 'GAS_PROXY' END AS basis FROM rc")
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """advice on each channel by what is known at the 25th, by reasons and maintenance context; every tenth channel abstains"""
    reading = F.col("value_state") == "purchase"
    days = B.journal(spark, d).where("event_time < timestamp_ntz'2024-01-26'").groupBy("channel_id").agg(F.count_if(reading).alias("readings"), F.max_by(F.when(reading, F.col("value_numeric")), F.when(reading, F.struct("event_time", "event_id"))).alias("last_reading"))
    rows = days.join(B.channels(spark, d), "channel_id").join(maintenance_of(spark, d), "object_id")
    reasons = F.array_compact(F.array(F.when(F.col("readings") == 0, "NO_GAS_READING_AT_D"), F.when(F.col("last_reading") >= 100, "ABOVE_THRESHOLD_AT_D")))
    advice = P.recommendation(reasons, F.when(F.col("channel_id") % 10 == 3, "abstain").otherwise("experimental_shadow"), F.col("maintenance_context"))
    return rows.select("channel_id", advice["code"].alias("code"), F.array_join(advice["basis_codes"], "|").alias("basis"))


@query(f"{SC} SELECT channel_id, day, CASE WHEN label IS NULL THEN 'NO_INCIDENT_FORECAST' WHEN channel_id % 2 = 0 OR channel_id % 3 = 0 THEN 'DEMO_ONLY' ELSE 'REVIEW_INCIDENT_FACTORS' END AS code, CASE WHEN label IS NULL AND channel_id % 2 = 0 THEN 'NO_LABEL|STUB_LABELS' WHEN label IS NULL THEN 'NO_LABEL' WHEN channel_id % 2 = 0 OR channel_id % 3 = 0 THEN 'STUB_LABELS' ELSE 'INCIDENT_REGISTER' END AS basis FROM scores")
def incident_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """even channels have stub labels, every third has weak evidence"""
    c = F.col("channel_id")
    advice = P.incident_recommendation(F.when(F.col("label").isNull(), "NO_LABEL"), F.when(c % 2 == 0, "stub"), F.when(c % 3 == 0, "E4"))
    return scores_of(spark, d).select("channel_id", "day", advice["code"].alias("code"), F.array_join(advice["basis_codes"], "|").alias("basis"))


@query(f"{SC}, h AS (SELECT day, count(*) AS f FROM scores GROUP BY 1) SELECT day, CAST(f + CASE WHEN isodow(day) = 1 THEN 1 ELSE 0 END AS BIGINT) AS fingerprint, CASE WHEN isodow(day) = 7 THEN 'new' WHEN isodow(day) = 1 THEN 'revision' ELSE 'same' END AS verdict, CASE WHEN isodow(day) = 1 THEN 2 ELSE 1 END AS revision FROM h")
def day_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Sundays are new, Mondays changed"""
    h = scores_of(spark, d).groupBy("day").agg(F.count("*").alias("fingerprint"))
    held = h.where(F.weekday("day") != 6).withColumn("revision", F.lit(1))
    return P.add_revision(held, h.withColumn("fingerprint", F.col("fingerprint") + (F.weekday("day") == 0).cast("int")))


@query(f"{SC} SELECT m AS module, channel_id, day, CASE WHEN m = 'a' THEN score END AS score, CASE WHEN m = 'a' THEN 'scored' ELSE 'abstain' END AS status FROM scores, (SELECT unnest(['a', 'b', 'c']) AS m)")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Module a has an open gate, b a closed one, c none"""
    s = scores_of(spark, d).select("channel_id", "day", "score", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("module"))
    gates = M.decision(spark.createDataFrame([("a", 0.2), ("b", -0.1)], "module string, low double"), 0.0)
    return P.scorecard(s, gates.select("module", "decision"))


@query(f"{NB}, mv AS (SELECT CAST(rep AS INTEGER) AS rep, channel_id, object_id, t + to_days(CAST(7 * [-2, -1, 1, 2][CAST('0x' || substr(md5(rep || ':' || channel_id), 1, 8) AS BIGINT) % 4 + 1] AS INTEGER)) AS t FROM x, (SELECT unnest(range(0, 20)) AS rep)), hit AS (SELECT DISTINCT a.rep, a.channel_id, a.t FROM mv a JOIN mv b ON a.rep = b.rep AND a.object_id = b.object_id AND a.channel_id <> b.channel_id AND b.t BETWEEN a.t - INTERVAL 6 HOUR AND a.t + INTERVAL 15 MINUTE) SELECT r.rep, count(hit.t) AS with_neighbours FROM (SELECT DISTINCT rep FROM mv) r LEFT JOIN hit ON hit.rep = r.rep GROUP BY 1")
def shifted_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """L22"""
    return P.shifted_neighbours(crossed_of(spark, d), 20)
