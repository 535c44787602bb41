"""Queries on value classes, failure rules, snapshots, gates and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import bindings as B
from vigil.operators import forecasts as Q
from vigil.operators import rules as R
from vigil.operators.states import day_range
from vigil.plans.evaluation import CD, SC, channel_days, scores_of
from vigil.plans.registry import query

VALUES = ", v AS (SELECT event_id, event_time, CASE event_id % 9 WHEN 0 THEN '-127' WHEN 1 THEN '120,5' WHEN 2 THEN '12,5' WHEN 3 THEN '01.01.1970 00:00:00' WHEN 4 THEN strftime(event_time + INTERVAL 3 SECOND, '%d.%m.%Y %H:%M:%S') WHEN 5 THEN '05.06.2023 1:02:03' WHEN 6 THEN ' ' WHEN 7 THEN value_state ELSE '?' END AS raw FROM journal)"


@query(f"{VALUES} SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'tech_value' WHEN 1 THEN 'gas_out_of_range' WHEN 2 THEN 'numeric' WHEN 3 THEN 'clock_1970' WHEN 4 THEN 'dup_timestamp' WHEN 5 THEN 'date_other' WHEN 6 THEN 'empty_value' WHEN 7 THEN CASE raw WHEN 'error' THEN 'link_fault' WHEN 'view' THEN 'normal' ELSE 'unknown_value' END ELSE 'unknown_value' END AS class FROM v")
def value_classes(spark: SparkSession, d: str) -> DataFrame:
    """Raw values made from events by id"""
    e, t = F.col("event_id"), F.col("event_time")
    texts = {0: F.lit("-127"), 1: F.lit("120,5"), 2: F.lit("12,5"), 3: F.lit("01.01.1970 00:00:00"), 4: F.date_format(t + F.expr("interval 3 seconds"), "dd.MM.yyyy HH:mm:ss"), 5: F.lit("05.06.2023 1:02:03"), 6: F.lit(" "), 7: F.col("value_state")}
    raw = F.coalesce(*(F.when(e % 9 == k, c) for k, c in texts.items()), F.lit("?"))
    rows = B.journal(spark, d).withColumn("raw", raw)
    return rows.select("event_id", R.value_class(F.col("raw"), t, F.lit(True), [-127.0], {"error": "link_fault", "view": "normal"}, 0.0, 100.0).alias("class"))


@query("SELECT event_id, CASE WHEN sensor_type = 'AUTOMOBILE' THEN value_state IN ('error', 'signup') ELSE value_state = 'error' END AS failed FROM journal JOIN channels USING (channel_id) WHERE event_time IS NOT NULL")
def failure_flags(spark: SparkSession, d: str) -> DataFrame:
    """P07, P08"""
    rows = R.timed(B.journal(spark, d)).join(B.channels(spark, d), "channel_id")
    return rows.select("event_id", R.failure(F.col("value_state"), F.col("sensor_type"), ("error",), {"AUTOMOBILE": ("error", "signup")}).alias("failed"))


@query("SELECT event_id, channel_id FROM journal WHERE event_time > TIMESTAMP '2024-01-21' AND event_time <= TIMESTAMP '2024-01-31'")
def bounded_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The cap is far above what ten days hold"""
    return R.snapshot(B.journal(spark, d), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 10, 2_000_000_000).select("event_id", "channel_id")


@query("SELECT channel_id, CAST(date_trunc('second', event_time) AS TIMESTAMP) AS t, min(value_numeric) AS low, max(value_numeric) AS high, object_id FROM journal JOIN channels USING (channel_id) WHERE value_state = 'purchase' AND sensor_type = 'MACHINERY' GROUP BY 1, 2, 5")
def gas_seconds(spark: SparkSession, d: str) -> DataFrame:
    """J13, L18"""
    own = B.channels(spark, d).where("sensor_type = 'MACHINERY'")
    return R.gas_seconds(B.journal(spark, d), own, F.col("value_state") == "purchase")


@query(f"{SC} SELECT channel_id, day, score, CASE WHEN channel_id % 3 = 0 THEN CASE WHEN isodow(day) % 2 = 1 THEN 'first' ELSE 'second' END END AS decision FROM scores")
def linked_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The decision of the highest id; those of another version or score aren't linked"""
    s = scores_of(spark, d).select("channel_id", "day", F.lit("1.0").alias("version"), "score")
    some, odd = s.where("channel_id % 3 = 0"), (F.weekday("day") + 1) % 2 == 1
    decisions = some.withColumns({"id": F.when(odd, 3).otherwise(1), "decision": F.lit("first")}).union(some.withColumns({"id": F.lit(2), "decision": F.lit("second")}))
    others = s.where("channel_id % 3 = 1").withColumns({"version": F.lit("2.0"), "id": F.lit(4), "decision": F.lit("other version")}).union(s.where("channel_id % 3 = 2").withColumns({"score": F.col("score") + 1, "id": F.lit(5), "decision": F.lit("other score")}))
    return R.linked_decisions(s, decisions.union(others), ["channel_id", "day", "version", "score"]).drop("version")


@query("SELECT channel_id, arg_max(CASE WHEN value_state = 'view' THEN props END, (event_time, event_id)) FILTER (WHERE value_state = 'view') AS last_view, arg_max(value_state, (event_time, event_id)) AS last_state FROM journal GROUP BY 1")
def last_known(spark: SparkSession, d: str) -> DataFrame:
    """A15, F19"""
    rows = B.journal(spark, d).select("channel_id", "event_time", "event_id", F.when(F.col("value_state") == "view", F.col("props")).alias("last_view"), F.col("value_state").alias("last_state"))
    return R.last_known(rows, "channel_id", ["event_time", "event_id"], ["last_view", "last_state"])


@query(f"{SC} SELECT count(*) AS rows, count(*) FILTER (WHERE channel_id % 5 <> 0) AS scored, count(*) FILTER (WHERE channel_id % 5 = 0) AS abstained, count(DISTINCT channel_id) AS channels, round(avg(score) FILTER (WHERE channel_id % 5 <> 0), 6) AS mean_score, max(day) AS newest_day FROM scores")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """A31"""
    rows = scores_of(spark, d).withColumn("score", F.when(F.col("channel_id") % 5 != 0, F.col("score")))
    return R.run_summary(rows).withColumn("mean_score", F.round("mean_score", 6))


#: (day, today, covered until): closed, not over, not covered, and without rows.
ASKED = (("2024-01-20", "2024-01-31", "2024-01-30"), ("2024-01-30", "2024-01-30", "2024-01-30"), ("2024-01-29", "2024-01-31", "2024-01-28"), ("2024-02-05", "2024-02-10", "2024-02-09"))


@query(", ak AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"DATE '{x}'" for x in a) + ")" for a in ASKED) + ") v(day, today, covered)), ar AS (SELECT ak.*, count(j.event_id) AS rows, (SELECT max(CAST(event_time AS DATE)) FROM journal) AS newest FROM ak LEFT JOIN journal j ON CAST(j.event_time AS DATE) = ak.day GROUP BY ALL) SELECT day, rows, newest, CASE WHEN NOT day < today THEN 'day_not_over' WHEN day > covered THEN 'not_covered' WHEN rows = 0 THEN 'no_rows' ELSE 'closed' END AS state FROM ar")
def closed_day(spark: SparkSession, d: str) -> DataFrame:
    """R11"""
    parts = [R.closed_day(B.journal(spark, d), *a).select(F.lit(a[0]).cast("date").alias("day"), "*") for a in ASKED]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"{CD}, s AS (SELECT channel_id, day, n_alarm, sum(n_alarm) OVER w3 AS recent, sum(n_events) OVER w7 AS measured FROM cd WINDOW w3 AS (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW), w7 AS (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)), r AS (SELECT s.channel_id, s.day, CASE WHEN measured = 0 THEN 'no_measurements' WHEN recent > 0 THEN 'recent_tech_value' WHEN s.day + 3 > DATE '2024-01-30' THEN 'window_beyond_data' WHEN b.n_alarm > 0 THEN 'positive' WHEN b.n_events > 0 THEN 'negative' ELSE 'unobserved_window' END AS reason_tech FROM s LEFT JOIN cd b ON b.channel_id = s.channel_id AND b.day = s.day + 2) SELECT *, CASE reason_tech WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END AS target_tech FROM r")
def technical_labels(spark: SparkSession, d: str) -> DataFrame:
    """Errors play technical values; three clean days"""
    days = channel_days(spark, d)
    rows = days.select("channel_id", "day", F.sum("n_alarm").over(day_range(3, "channel_id")).alias("recent"), F.sum("n_events").over(day_range(7, "channel_id")).alias("measured"))
    rows = rows.join(days.select("channel_id", F.date_sub("day", 2).alias("day"), F.col("n_alarm").alias("a2"), F.col("n_events").alias("e2")), ["channel_id", "day"], "left").fillna(0, ["a2", "e2"])
    out = R.technical_label(rows, F.col("recent"), F.col("measured"), F.col("a2"), F.col("e2"), F.date_add("day", 3) <= F.lit("2024-01-30").cast("date"))
    return out.select("channel_id", "day", "reason_tech", "target_tech")


@query(f"{CD} SELECT a.channel_id, a.day, CAST(c.n_alarm > 0 AS INTEGER) AS label, coalesce(b.n_alarm > 0, false) AND c.n_alarm IS NOT NULL AS excluded, CASE WHEN NOT (coalesce(b.n_alarm > 0, false) AND c.n_alarm IS NOT NULL) THEN CAST(c.n_alarm > 0 AS INTEGER) END AS label_v2 FROM cd a LEFT JOIN cd b ON b.channel_id = a.channel_id AND b.day = a.day + 1 LEFT JOIN cd c ON c.channel_id = a.channel_id AND c.day = a.day + 2")
def labels_without_next_day(spark: SparkSession, d: str) -> DataFrame:
    """L12"""
    days = channel_days(spark, d)
    later = lambda k, name: days.select("channel_id", F.date_sub("day", k).alias("day"), (F.col("n_alarm") > 0).alias(name))
    rows = days.select("channel_id", "day").join(later(1, "next"), ["channel_id", "day"], "left").join(later(2, "then"), ["channel_id", "day"], "left").withColumn("label", F.col("then").cast("int"))
    return R.without_next_day(rows, "label", F.col("next")).select("channel_id", "day", "label", "excluded", "label_v2")


@query("SELECT event_id, concat_ws('-', value_state, channel_id) AS joined, CAST(event_time AS DATE) + 2 AS due, date_diff('hour', date_trunc('hour', event_time), TIMESTAMP '2024-02-01') AS hours_left, CAST(event_time AS TIMESTAMP) + INTERVAL 3 HOUR AS moscow, list_has_any([value_state], ['error', 'signup']) AS bad, CAST(len(range(0, channel_id % 5)) AS INTEGER) AS steps, CASE WHEN channel_id % 2 = 0 THEN 'alarms in 7 days' ELSE 'x' END AS feature FROM journal")
def small_functions(spark: SparkSession, d: str) -> DataFrame:
    """F09, F14, F15, F21, F24, U06"""
    c, t = F.col("channel_id"), F.col("event_time")
    feature = F.when(c % 2 == 0, "f_n_alarm_7d").otherwise("x")
    hour = F.date_trunc("hour", t).cast("timestamp_ntz")
    steps = F.when(c % 5 > 0, F.size(F.sequence(F.lit(1), (c % 5).cast("int")))).otherwise(0)
    return B.journal(spark, d).select("event_id", F.concat_ws("-", "value_state", c.cast("string")).alias("joined"), F.date_add(F.to_date(t), 2).alias("due"), F.timestamp_diff("HOUR", hour, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("hours_left"), F.convert_timezone(F.lit("UTC"), F.lit("Europe/Moscow"), t).alias("moscow"), F.arrays_overlap(F.array("value_state"), F.array(F.lit("error"), F.lit("signup"))).alias("bad"), steps.alias("steps"), Q.humanised(feature, {"n_alarm": "alarms"}).alias("feature"))
