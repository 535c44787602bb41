"""Queries on cells, episodes, crossings and panels. Time cells are hours; tau is 12 hours; purchases of 100 or more cross."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators import bindings as B
from vigil.operators import panel as P
from vigil.operators import states as T
from vigil.operators.ranks import percentiles
from vigil.plans.registry import query

READING, END, LAST = "value_state = 'purchase'", "2024-01-31 00:00:00", "2024-01-30 23:59:59"
CLASSES = ["error", "view", "click", "signup", "purchase"]
CELLS = ", flags AS (SELECT channel_id, date_trunc('hour', event_time) AS t, count(DISTINCT value_state) AS n_values, bool_or(value_state = 'error') AS f, bool_or(value_state IN ('view', 'click', 'purchase')) AS o, bool_or(value_state = 'signup') AS u FROM journal GROUP BY 1, 2), cells AS (SELECT channel_id, CAST(t AS TIMESTAMP) AS t, n_values, CASE WHEN f AND o THEN 'conflict' WHEN u THEN 'unknown' END AS link_cause, CASE WHEN (f AND o) OR u THEN 'A' WHEN f THEN 'F' WHEN o THEN 'O' END AS link_state, CASE WHEN f AND o THEN 'conflict' WHEN u AND NOT f AND NOT o THEN 'unknown' END AS power_cause, CASE WHEN (f AND o) OR (u AND NOT f AND NOT o) THEN 'A' WHEN f THEN 'F' WHEN o THEN 'O' END AS power_state FROM flags)"
POINTS = CELLS + ", points AS (SELECT channel_id, t, link_state AS state FROM cells WHERE link_state IS NOT NULL QUALIFY lag(link_state) OVER (PARTITION BY channel_id ORDER BY t) IS DISTINCT FROM link_state)"
EPISODES = POINTS + ", near AS (SELECT channel_id, t, state, lag(state) OVER w AS before, lead(state) OVER w AS after, lead(t) OVER w AS next_t FROM points WINDOW w AS (PARTITION BY channel_id ORDER BY t)), ep0 AS (SELECT channel_id, t AS onset_t, CASE WHEN before = 'O' THEN 'strict' ELSE 'ambiguous' END AS onset_type, coalesce(after = 'O', false) AS exact, coalesce(next_t, TIMESTAMP '2024-01-31') AS end_t FROM near WHERE state = 'F'), episodes AS (SELECT *, CAST(date_diff('second', onset_t, end_t) AS DOUBLE) AS duration_s, CASE WHEN exact THEN CAST(date_diff('second', onset_t, end_t) >= 43200 AS INTEGER) END AS sustained FROM ep0)"
CROSS = ", rc AS (SELECT channel_id, CAST(date_trunc('hour', event_time) AS TIMESTAMP) AS t, min(value_numeric) AS low, max(value_numeric) AS high FROM journal WHERE value_state = 'purchase' GROUP BY 1, 2), rb AS (SELECT *, lag(low) OVER w AS bl, lag(high) OVER w AS bh FROM rc WINDOW w AS (PARTITION BY channel_id ORDER BY t)), crossings AS (SELECT channel_id, t, low, high, coalesce(low >= 100 AND bh < 100, false) AS \"cross\", high >= 100 AND (bh IS NULL OR (low < 100 AND high >= 100) OR (low >= 100 AND coalesce(bl < 100 AND bh >= 100, false))) AS cross_unknown FROM rb)"
DAILY = ", dc AS (SELECT *, CAST(event_time AS DATE) AS day, date_trunc('hour', event_time) AS cell, value_state = 'purchase' AS rd FROM journal), dl AS (SELECT *, max(cell) FILTER (WHERE rd) OVER (PARTITION BY channel_id, day) AS last_cell FROM dc), daily AS (SELECT channel_id, day, count(*) AS n_events, count(*) FILTER (WHERE alarm) AS n_alarm, " + ", ".join(f"count(*) FILTER (WHERE value_state = '{c}') AS n_{c}" for c in CLASSES) + ", count(value_numeric) FILTER (WHERE rd) AS num_n, avg(value_numeric) FILTER (WHERE rd) AS num_mean, min(value_numeric) FILTER (WHERE rd) AS num_min, max(value_numeric) FILTER (WHERE rd) AS num_max, stddev_samp(value_numeric) FILTER (WHERE rd) AS num_std, arg_max(value_numeric, event_time) FILTER (WHERE rd) AS num_last, count(*) FILTER (WHERE rd AND value_numeric >= 100) AS num_above, coalesce(min(value_numeric) FILTER (WHERE rd AND cell = last_cell) < 100 AND max(value_numeric) FILTER (WHERE rd AND cell = last_cell) >= 100, false) AS num_last_mixed FROM dl GROUP BY 1, 2)"


def at(time: str) -> Column:
    return F.lit(time).cast("timestamp_ntz")


def cells_of(spark: SparkSession, d: str) -> DataFrame:
    return T.cells(B.journal(spark, d), {"link": T.LINK, "power": T.POWER}, "hour")


def points_of(spark: SparkSession, d: str) -> DataFrame:
    return T.change_points(cells_of(spark, d), "link_state")


def episodes_of(spark: SparkSession, d: str) -> DataFrame:
    return T.episodes(points_of(spark, d), at(END), 43200.0)


def crossings_of(spark: SparkSession, d: str) -> DataFrame:
    return T.crossings(B.journal(spark, d).where(READING), 100.0, "hour")


def panel_of(spark: SparkSession, d: str) -> DataFrame:
    return P.event_panel(B.journal(spark, d), T.LINK, F.expr(READING), 100.0, 43200.0, at(LAST), CLASSES, "hour")


@query(f"{CELLS} SELECT * FROM cells")
def state_cells(spark: SparkSession, d: str) -> DataFrame:
    """A11, P09"""
    return cells_of(spark, d)


@query(f"{POINTS} SELECT * FROM points")
def change_points(spark: SparkSession, d: str) -> DataFrame:
    """W06"""
    return points_of(spark, d)


@query(f"{EPISODES} SELECT * FROM episodes")
def fault_episodes(spark: SparkSession, d: str) -> DataFrame:
    """W07, L04"""
    return episodes_of(spark, d)


@query(f"{EPISODES} SELECT channel_id, CAST(onset_t AS DATE) AS day, count(*) FILTER (WHERE onset_type = 'strict') AS link_strict, count(*) FILTER (WHERE onset_type <> 'strict') AS link_ambiguous, count(*) FILTER (WHERE onset_type = 'strict' AND sustained = 1) AS link_sustained, count(*) FILTER (WHERE onset_type = 'strict' AND sustained = 0) AS link_transient, count(*) FILTER (WHERE onset_type = 'strict' AND sustained IS NULL) AS link_censored FROM episodes GROUP BY 1, 2")
def onsets_by_day(spark: SparkSession, d: str) -> DataFrame:
    """A14"""
    return T.onsets_by_day(episodes_of(spark, d), "link")


@query(f"{EPISODES} SELECT channel_id, CAST(end_t AS DATE) AS day, count(*) FILTER (WHERE sustained = 1) AS link_long, count(*) FILTER (WHERE sustained = 0) AS link_short FROM episodes WHERE exact GROUP BY 1, 2")
def ended_by_day(spark: SparkSession, d: str) -> DataFrame:
    """A14"""
    return T.ended_by_day(episodes_of(spark, d), "link")


@query(f"{EPISODES} SELECT onset_type, exact, count(*) AS n, quantile_disc(duration_s, 0.1) AS p10, quantile_disc(duration_s, 0.5) AS p50, quantile_disc(duration_s, 0.9) AS p90, quantile_disc(duration_s, 0.99) AS p99 FROM episodes GROUP BY 1, 2")
def episode_durations(spark: SparkSession, d: str) -> DataFrame:
    """A19"""
    shares = {"p10": (0.1, "disc"), "p50": (0.5, "disc"), "p90": (0.9, "disc"), "p99": (0.99, "disc")}
    return percentiles(episodes_of(spark, d), ["onset_type", "exact"], "duration_s", shares)


@query(f"{DAILY} SELECT channel_id, day, n_events, n_alarm, n_error, n_view, n_click, n_signup, n_purchase, num_n, round(num_mean, 6) AS num_mean, num_min, num_max, round(num_std, 6) AS num_std, num_last, num_above, num_last_mixed FROM daily")
def daily_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """A07, A08, A09, A10, A12"""
    return T.daily(B.journal(spark, d), CLASSES, F.expr(READING), 100.0, "hour").withColumns({c: F.round(c, 6) for c in ("num_mean", "num_std")})


@query(f"{CELLS} SELECT channel_id, CAST(t AS DATE) AS day, count(*) FILTER (WHERE n_values > 1) AS multi_value, count(*) FILTER (WHERE link_state = 'F') AS faults, count(*) FILTER (WHERE link_state = 'A') AS ambiguous, count(*) FILTER (WHERE power_state = 'F') AS power_faults FROM cells GROUP BY 1, 2")
def cell_counters(spark: SparkSession, d: str) -> DataFrame:
    """A13"""
    return cells_of(spark, d).groupBy("channel_id", F.to_date("t").alias("day")).agg(F.count_if(F.col("n_values") > 1).alias("multi_value"), F.count_if(F.col("link_state") == "F").alias("faults"), F.count_if(F.col("link_state") == "A").alias("ambiguous"), F.count_if(F.col("power_state") == "F").alias("power_faults"))


@query(f"{CELLS} SELECT coalesce(link_state, '-') AS link_state, coalesce(link_cause, '-') AS link_cause, count(*) AS n, count(DISTINCT channel_id) AS channels FROM cells GROUP BY 1, 2")
def stream_audit(spark: SparkSession, d: str) -> DataFrame:
    """A22"""
    return cells_of(spark, d).groupBy(F.coalesce("link_state", F.lit("-")).alias("link_state"), F.coalesce("link_cause", F.lit("-")).alias("link_cause")).agg(F.count("*").alias("n"), F.count_distinct("channel_id").alias("channels"))


@query(", n AS (SELECT value_state, lead(value_state) OVER (PARTITION BY channel_id ORDER BY event_time, event_id) AS after FROM journal) SELECT after, count(*) AS n FROM n WHERE value_state = 'signup' AND after IS NOT NULL GROUP BY 1 ORDER BY n DESC, after LIMIT 10")
def classes_after_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Classes that follow unknown values"""
    by = Window.partitionBy("channel_id").orderBy("event_time", "event_id")
    rows = B.journal(spark, d).select("value_state", F.lead("value_state").over(by).alias("after")).where("value_state = 'signup' and after is not null")
    return rows.groupBy("after").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "after").limit(10)


@query(f"{CROSS} SELECT * FROM crossings")
def threshold_crossings(spark: SparkSession, d: str) -> DataFrame:
    """W17"""
    return crossings_of(spark, d)


GRID = DAILY + ", grid AS (SELECT DISTINCT channel_id, CAST(day + CAST(k AS INTEGER) AS DATE) AS day FROM daily, (SELECT unnest(range(0, 7)) AS k) WHERE day + CAST(k AS INTEGER) <= DATE '2024-01-30')"


@query(f"{GRID} SELECT * FROM grid")
def activity_grid(spark: SparkSession, d: str) -> DataFrame:
    """L03, U03"""
    days = B.journal(spark, d).select("channel_id", F.to_date("event_time").alias("day")).distinct()
    return P.activity_grid(days, 7, F.lit("2024-01-30").cast("date"))


@query(f"{DAILY} SELECT channel_id, day, CAST(sum(n_events) OVER w3 AS BIGINT) AS events_3d, CAST(sum(n_alarm) OVER w7 AS BIGINT) AS alarms_7d, max(num_max) OVER w7 AS max_7d FROM daily WINDOW w3 AS (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW), w7 AS (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)")
def rolling_days(spark: SparkSession, d: str) -> DataFrame:
    """W08, W09"""
    rows = T.daily(B.journal(spark, d), CLASSES, F.expr(READING), 100.0, "hour")
    return rows.select("channel_id", "day", F.sum("n_events").over(T.day_range(3, "channel_id")).alias("events_3d"), F.sum("n_alarm").over(T.day_range(7, "channel_id")).alias("alarms_7d"), F.max("num_max").over(T.day_range(7, "channel_id")).alias("max_7d"))


@query(f"{GRID} SELECT g.channel_id, g.day, last_value(num_last IGNORE NULLS) OVER (PARTITION BY g.channel_id ORDER BY g.day) AS last_reading FROM grid g LEFT JOIN daily d ON d.channel_id = g.channel_id AND d.day = g.day")
def filled_readings(spark: SparkSession, d: str) -> DataFrame:
    """W10"""
    rows = T.daily(B.journal(spark, d), CLASSES, F.expr(READING), 100.0, "hour")
    upto = Window.partitionBy("channel_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return P.activity_grid(rows, 7, F.lit("2024-01-30").cast("date")).join(rows.select("channel_id", "day", "num_last"), ["channel_id", "day"], "left").select("channel_id", "day", F.last("num_last", ignorenulls=True).over(upto).alias("last_reading"))


@query(f"{POINTS}{GRID}, probes AS (SELECT channel_id, day, CAST(day AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS cutoff FROM grid) SELECT p.channel_id, p.day, s.state, s.t AS state_t FROM probes p ASOF LEFT JOIN points s ON p.channel_id = s.channel_id AND p.cutoff >= s.t")
def state_at_day_end(spark: SparkSession, d: str) -> DataFrame:
    """J09"""
    days = B.journal(spark, d).select("channel_id", F.to_date("event_time").alias("day")).distinct()
    probes = P.activity_grid(days, 7, F.lit("2024-01-30").cast("date")).withColumn("cutoff", F.date_add("day", 1).cast("timestamp_ntz") - F.expr("interval 1 microsecond"))
    points = points_of(spark, d).withColumnRenamed("t", "state_t")
    return T.asof_backward(probes, points, "channel_id", "cutoff", "state_t", ["state", "state_t"]).drop("cutoff")


PANEL = EPISODES + GRID + CROSS + """, pts AS (SELECT * FROM points), blocks AS (SELECT channel_id, CAST(t AS DATE) AS day, count(*) AS n FROM points WHERE state = 'A' GROUP BY 1, 2),
ep2 AS (SELECT channel_id, t AS onset_t, CASE WHEN before = 'O' THEN 'strict' ELSE 'ambiguous' END AS onset_type, coalesce(after = 'O', false) AS exact, coalesce(next_t, TIMESTAMP '2024-01-30 23:59:59') AS end_t FROM near WHERE state = 'F'),
ep3 AS (SELECT *, CASE WHEN exact THEN date_diff('second', onset_t, end_t) >= 43200 END AS s FROM ep2),
on_ AS (SELECT channel_id, CAST(onset_t AS DATE) AS day, count(*) FILTER (WHERE onset_type = 'strict') AS st, count(*) FILTER (WHERE onset_type <> 'strict') AS am, count(*) FILTER (WHERE onset_type = 'strict' AND s) AS su, count(*) FILTER (WHERE onset_type = 'strict' AND NOT s) AS tr, count(*) FILTER (WHERE onset_type = 'strict' AND s IS NULL) AS ce FROM ep3 GROUP BY 1, 2),
cr AS (SELECT channel_id, CAST(t AS DATE) AS day, count(*) FILTER (WHERE "cross") AS c, count(*) FILTER (WHERE cross_unknown) AS cu FROM crossings GROUP BY 1, 2),
p0 AS (SELECT g.channel_id, g.day, coalesce(d.n_events, 0) AS n_events, coalesce(d.num_n, 0) AS num_n, d.num_last, d.num_last_mixed, coalesce(st, 0) AS st, coalesce(am, 0) AS am, coalesce(su, 0) AS su, coalesce(tr, 0) AS tr, coalesce(ce, 0) AS ce, coalesce(b.n, 0) AS bl, coalesce(c, 0) AS c, coalesce(cu, 0) AS cu FROM grid g LEFT JOIN daily d USING (channel_id, day) LEFT JOIN on_ USING (channel_id, day) LEFT JOIN blocks b USING (channel_id, day) LEFT JOIN cr USING (channel_id, day)),
p1 AS (SELECT *, CAST(sum(num_n) OVER (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS num_7d, CAST(sum(n_events) OVER (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS events_3d, last_value(num_last IGNORE NULLS) OVER (PARTITION BY channel_id ORDER BY day) AS last_num, coalesce(last_value(CASE WHEN num_last IS NOT NULL THEN num_last_mixed END IGNORE NULLS) OVER (PARTITION BY channel_id ORDER BY day), false) AS mixed FROM p0),
p2 AS (SELECT p1.*, s.state AS now FROM p1 ASOF LEFT JOIN points s ON p1.channel_id = s.channel_id AND CAST(p1.day AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND >= s.t),
p3 AS (SELECT p.*, coalesce(a.st + a.am, 0) > 0 AS comp, coalesce(a.c, 0) > 0 AS compc, coalesce(b.n_events, 0) + coalesce(e.n_events, 0) > 0 AS observed, coalesce(b.st, 0) AS st2, coalesce(b.am + b.bl, 0) AS am2, coalesce(b.su, 0) AS su2, coalesce(b.tr, 0) AS tr2, coalesce(b.ce, 0) AS ce2, coalesce(b.c, 0) AS c2, coalesce(b.cu, 0) AS cu2, coalesce(b.num_n, 0) AS num2, p.day + 3 <= DATE '2024-01-30' AS inside FROM p2 p LEFT JOIN p0 a ON a.channel_id = p.channel_id AND a.day = p.day + 1 LEFT JOIN p0 b ON b.channel_id = p.channel_id AND b.day = p.day + 2 LEFT JOIN p0 e ON e.channel_id = p.channel_id AND e.day = p.day + 3),
panel AS (SELECT channel_id, day, n_events, events_3d, num_7d, last_num, now, comp, compc,
CASE WHEN now IS NULL THEN 'no_state_history' WHEN now <> 'O' THEN 'state_not_ok_at_D' WHEN NOT inside THEN 'window_beyond_data' WHEN st2 > 0 THEN 'positive' WHEN am2 > 0 THEN 'ambiguous_onset' WHEN observed THEN 'negative' ELSE 'unobserved_window' END AS reason_onset,
CASE WHEN now IS NULL THEN 'no_state_history' WHEN now <> 'O' THEN 'state_not_ok_at_D' WHEN NOT inside THEN 'window_beyond_data' WHEN su2 > 0 THEN 'positive' WHEN ce2 > 0 THEN 'censored_duration' WHEN am2 > 0 THEN 'ambiguous_onset' WHEN observed AND tr2 > 0 THEN 'negative_transient_only' WHEN observed THEN 'negative' ELSE 'unobserved_window' END AS reason_sustained,
CASE WHEN num_7d = 0 THEN 'no_readings' WHEN mixed THEN 'ambiguous_last_reading_at_D' WHEN last_num >= 100 THEN 'above_threshold_at_D' WHEN NOT inside THEN 'window_beyond_data' WHEN c2 > 0 THEN 'positive' WHEN cu2 > 0 THEN 'unknown_previous_reading' WHEN num2 > 0 THEN 'negative' ELSE 'unobserved_window' END AS reason_crossing FROM p3)"""


@query(PANEL + "SELECT channel_id, day, n_events, events_3d, num_7d, last_num, now AS link_now, comp AS competing_onset_d1, compc AS competing_crossing_d1, reason_onset, reason_sustained, reason_crossing, " + ", ".join(f"CASE WHEN reason_{k} = 'positive' THEN 1 WHEN reason_{k} LIKE 'negative%' THEN 0 END AS target_{k}" for k in ("onset", "sustained", "crossing")) + " FROM panel")
def event_panel(spark: SparkSession, d: str) -> DataFrame:
    """L05, L06, L08, L09, L10, J07, W08, W10"""
    return panel_of(spark, d).select("channel_id", "day", "n_events", F.col("f_n_events_3d").alias("events_3d"), F.col("f_num_n_7d").alias("num_7d"), F.col("f_num_last").alias("last_num"), "link_now", "competing_onset_d1", "competing_crossing_d1", "reason_onset", "reason_sustained", "reason_crossing", "target_onset", "target_sustained", "target_crossing")


@query(PANEL + "SELECT 'onset' AS target, reason_onset AS reason, count(*) AS n FROM panel GROUP BY 1, 2 UNION ALL SELECT 'sustained', reason_sustained, count(*) FROM panel GROUP BY 1, 2 UNION ALL SELECT 'crossing', reason_crossing, count(*) FROM panel GROUP BY 1, 2")
def panel_audit(spark: SparkSession, d: str) -> DataFrame:
    """All targets in one pass"""
    long = panel_of(spark, d).select("reason_onset", "reason_sustained", "reason_crossing").unpivot([], ["reason_onset", "reason_sustained", "reason_crossing"], "target", "reason")
    return long.groupBy(F.replace("target", F.lit("reason_"), F.lit("")).alias("target"), "reason").agg(F.count("*").alias("n"))


OBSERVED = ", ob AS (SELECT channel_id, CAST(event_time + INTERVAL 60 MINUTE AS DATE) AS day, count(*) AS n_events, count(*) FILTER (WHERE alarm) AS n_alarm, avg(value_numeric) AS value_mean, stddev_samp(value_numeric) AS value_std, arg_max(value_numeric, (event_time, event_id)) AS value_last, arg_max(alarm, (event_time, event_id)) AS now, count(DISTINCT value_state) AS n_states FROM journal GROUP BY 1, 2), o1 AS (SELECT *, day - lag(day) OVER w AS gap_days, n_alarm / n_events AS alarm_share, day - last_value(CASE WHEN n_alarm > 0 THEN day END IGNORE NULLS) OVER w AS since, count(*) OVER w AS observed_days FROM ob WINDOW w AS (PARTITION BY channel_id ORDER BY day)), actual AS (SELECT channel_id, CAST(event_time AS DATE) AS day, bool_or(alarm) AS f FROM journal GROUP BY 1, 2)"


@query(OBSERVED + " SELECT a.channel_id, a.day, a.n_events, a.n_alarm, round(a.value_mean, 6) AS value_mean, round(a.value_std, 6) AS value_std, a.value_last, a.n_states, CAST(a.gap_days AS INTEGER) AS gap_days, round(a.alarm_share, 6) AS alarm_share, CAST(a.since AS INTEGER) AS days_since_failure, a.observed_days, b.n_events AS n_events_before, x.f IS NOT NULL AND y.f IS NOT NULL AS observed, CASE WHEN NOT a.now AND a.since IS DISTINCT FROM 0 AND coalesce(a.since, 99) >= 2 AND x.f IS NOT NULL AND y.f IS NOT NULL THEN CAST(x.f OR y.f AS INTEGER) END AS target_failure, CASE WHEN x.f THEN CAST(a.day + 2 AS DATE) WHEN y.f THEN CAST(a.day + 3 AS DATE) END AS first_failure FROM o1 a LEFT JOIN o1 b ON b.channel_id = a.channel_id AND b.day = a.day - 1 LEFT JOIN actual x ON x.channel_id = a.channel_id AND x.day = a.day + 2 LEFT JOIN actual y ON y.channel_id = a.channel_id AND y.day = a.day + 3")
def observed_panel(spark: SparkSession, d: str) -> DataFrame:
    """Two window days, two clean days, 60 minutes of latency"""
    out = P.observed_panel(B.journal(spark, d), F.col("alarm"), 1, 2, 2, 60)
    return out.select("channel_id", "day", "n_events", "n_alarm", F.round("value_mean", 6).alias("value_mean"), F.round("value_std", 6).alias("value_std"), "value_last", "n_states", "gap_days", F.round("alarm_share", 6).alias("alarm_share"), "days_since_failure", "observed_days", "n_events_before", "observed", "target_failure", "first_failure")


@query(PANEL + ", o AS (SELECT channel_id, day FROM panel WHERE reason_onset IN ('positive', 'negative')), s AS (SELECT channel_id, day FROM panel) SELECT reason_onset, reason_sustained, count(*) AS n FROM panel WHERE CASE WHEN reason_onset = 'positive' THEN 1 WHEN reason_onset LIKE 'negative%' THEN 0 END IS DISTINCT FROM CASE WHEN reason_sustained = 'positive' THEN 1 WHEN reason_sustained LIKE 'negative%' THEN 0 END GROUP BY 1, 2")
def label_changes(spark: SparkSession, d: str) -> DataFrame:
    """Onset against sustained labels"""
    p = panel_of(spark, d)
    a, b = (p.select("channel_id", "day", F.col(f"target_{k}").alias("label"), f"reason_{k}") for k in ("onset", "sustained"))
    changed = P.label_changes(a, b, ["channel_id", "day"], "label")
    return changed.join(p.select("channel_id", "day", "reason_onset", "reason_sustained"), ["channel_id", "day"]).groupBy("reason_onset", "reason_sustained").agg(F.count("*").alias("n"))
