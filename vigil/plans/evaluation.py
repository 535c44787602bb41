"""Queries on objects, silence, triage, alerts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.functions import scalars as S
from vigil.operators import alerts as A
from vigil.operators import bindings as B
from vigil.operators import objects as O
from vigil.plans.registry import query
from vigil.plans.temporal import CROSS, crossings_of

FAMILIES = {"fire": ("AUTOMOBILE", "BUILDING"), "access": ("FURNITURE", "MACHINERY")}
CD = ", cd AS (SELECT j.channel_id, CAST(event_time AS DATE) AS day, object_id, sensor_type, count(*) AS n_events, count(*) FILTER (WHERE alarm) AS n_alarm FROM journal j JOIN channels c USING (channel_id) GROUP BY 1, 2, 3, 4)"
_PARTS = ", ".join(f"count(DISTINCT CASE WHEN sensor_type IN {t} AND n_alarm > 0 THEN sensor_type END) AS {n}_types, CAST(coalesce(sum(n_alarm) FILTER (WHERE sensor_type IN {t}), 0) AS BIGINT) AS {n}_alarms" for n, t in FAMILIES.items())
OD = CD + f", od AS (SELECT object_id, day, count(*) AS channels, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(n_alarm) AS BIGINT) AS n_alarm, count(DISTINCT sensor_type) AS types, {_PARTS} FROM cd GROUP BY 1, 2)"
SC = ", sc AS (SELECT channel_id, CAST(event_time AS DATE) AS day, round(max(value_numeric) / 500, 6) AS score FROM journal WHERE value_state = 'purchase' GROUP BY 1, 2), nx AS (SELECT channel_id, CAST(event_time AS DATE) AS day, CAST(bool_or(alarm) AS INTEGER) AS label FROM journal GROUP BY 1, 2), scores AS (SELECT sc.channel_id, sc.day, score, label FROM sc LEFT JOIN nx ON nx.channel_id = sc.channel_id AND nx.day = sc.day + 1)"
RK = SC + ", rk AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, channel_id) AS rank FROM scores)"
ST = SC + ", t AS (SELECT score, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS neg FROM scores WHERE label IS NOT NULL GROUP BY 1), tt AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM t WINDOW w AS (ORDER BY score DESC))"


def channel_days(spark: SparkSession, d: str) -> DataFrame:
    j = B.journal(spark, d).groupBy("channel_id", F.to_date("event_time").alias("day")).agg(F.count("*").alias("n_events"), F.count_if(F.col("alarm")).alias("n_alarm"))
    return j.join(B.channels(spark, d).select("channel_id", "object_id", "sensor_type"), "channel_id")


def scores_of(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in score: the day's largest purchase / 500, labelled by an error on the next observed day."""
    j = B.journal(spark, d).withColumn("day", F.to_date("event_time"))
    s = j.where("value_state = 'purchase'").groupBy("channel_id", "day").agg(F.round(F.max("value_numeric") / 500, 6).alias("score"))
    label = j.groupBy("channel_id", F.date_sub("day", 1).alias("day")).agg(F.max(F.col("alarm").cast("int")).alias("label"))
    return s.join(label, ["channel_id", "day"], "left")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"{OD} SELECT *, round(n_alarm / n_events, 6) AS alarm_share, CAST(day - lag(day) OVER (PARTITION BY object_id, fire_alarms > 0 ORDER BY day) AS INTEGER) AS same_kind_gap FROM od")
def object_days(spark: SparkSession, d: str) -> DataFrame:
    """A16, A17, F06"""
    out = rounded(O.object_days(channel_days(spark, d), FAMILIES), "alarm_share")
    by = Window.partitionBy("object_id", F.col("fire_alarms") > 0).orderBy("day")
    return out.withColumn("same_kind_gap", F.date_diff("day", F.lag("day").over(by)))


@query(f"{OD} SELECT object_id, day, CAST(day - last_value(CASE WHEN fire_types >= 2 THEN day END IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS days_since_fire FROM od")
def days_since_event(spark: SparkSession, d: str) -> DataFrame:
    """W14"""
    return O.days_since(O.object_days(channel_days(spark, d), FAMILIES), "object_id", F.col("fire_types") >= 2, "days_since_fire").select("object_id", "day", "days_since_fire")


@query(f"{OD} SELECT a.object_id, a.day, CAST(b.fire_types >= 2 AS INTEGER) AS target_fire FROM od a LEFT JOIN od b ON b.object_id = a.object_id AND b.day = a.day + 2")
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    """L13"""
    return O.corroboration(O.object_days(channel_days(spark, d), FAMILIES), "fire").select("object_id", "day", "target_fire")


@query(f"{CD}, n AS (SELECT channel_id, object_id, day, lead(day, 1) OVER w AS n1, lead(day, 2) OVER w AS n2 FROM cd WINDOW w AS (PARTITION BY channel_id ORDER BY day)), g AS (SELECT *, CASE WHEN n1 - day >= 2 THEN n1 ELSE n2 END - day AS gap FROM n), act AS (SELECT DISTINCT object_id, day FROM cd), p AS (SELECT g.*, (SELECT count(*) FROM act a WHERE a.object_id = g.object_id AND a.day BETWEEN g.day + 2 AND g.day + 4) = 3 AS peers, g.day + 4 <= DATE '2024-01-30' AS inside FROM g), r AS (SELECT channel_id, object_id, day, CASE WHEN NOT inside THEN 'window_beyond_data' WHEN gap < 5 THEN 'negative' WHEN NOT peers THEN 'no_peer' WHEN gap <= 31 THEN 'positive' ELSE 'no_return' END AS reason_dropout FROM p) SELECT *, CASE reason_dropout WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END AS target_dropout FROM r")
def dropout(spark: SparkSession, d: str) -> DataFrame:
    """L14, W20"""
    return O.dropout(channel_days(spark, d), F.lit("2024-01-30").cast("date"))


SILENCE = CD + ", nd AS (SELECT channel_id, day, lead(day) OVER (PARTITION BY channel_id ORDER BY day) AS next FROM cd), silence AS (SELECT channel_id, CAST(day + 1 AS DATE) AS start, CAST(next - 1 AS DATE) AS \"end\", CAST(next - day - 1 AS INTEGER) AS length FROM nd WHERE next - day - 1 >= 2)"


@query(f"{SILENCE} SELECT * FROM silence")
def silence_runs(spark: SparkSession, d: str) -> DataFrame:
    """Channels silent for two days or more"""
    return O.silence_runs(channel_days(spark, d), "channel_id", 2)


@query(f"{CD}, tn AS (SELECT channel_id, day, n_alarm > 0 AS flag, CASE WHEN lag(n_alarm > 0) OVER w = (n_alarm > 0) THEN 0 ELSE 1 END AS turn FROM cd WINDOW w AS (PARTITION BY channel_id ORDER BY day)), rn AS (SELECT *, sum(turn) OVER (PARTITION BY channel_id ORDER BY day) AS run FROM tn) SELECT channel_id, flag, min(day) AS start, max(day) AS \"end\", count(*) AS days FROM rn GROUP BY channel_id, run, flag")
def alarm_runs(spark: SparkSession, d: str) -> DataFrame:
    """W15"""
    return O.flag_runs(channel_days(spark, d), "channel_id", F.col("n_alarm") > 0)


@query(f"{SILENCE}, ev AS (SELECT channel_id, day FROM cd WHERE n_alarm > 0) SELECT ev.channel_id, ev.day, coalesce(bool_or(ev.day BETWEEN s.start - 3 AND s.\"end\" + 5), false) AS in_window, CAST(ev.day - max(s.\"end\") FILTER (WHERE s.\"end\" < ev.day) AS INTEGER) AS days_since_run FROM ev LEFT JOIN silence s ON s.channel_id = ev.channel_id GROUP BY 1, 2")
def maintenance_context(spark: SparkSession, d: str) -> DataFrame:
    """J15, L16"""
    days = channel_days(spark, d)
    return O.maintenance_context(days.where("n_alarm > 0").select("channel_id", "day"), O.silence_runs(days, "channel_id", 2), "channel_id", 3, 5)


@query(f"{SILENCE}, wd AS (SELECT DISTINCT channel_id, CAST(start - 3 + CAST(k AS INTEGER) AS DATE) AS day FROM silence, (SELECT unnest(range(0, 60)) AS k) WHERE start - 3 + CAST(k AS INTEGER) <= \"end\" + 5) SELECT cd.channel_id, cd.day, wd.day IS NOT NULL AS in_window FROM cd LEFT JOIN wd USING (channel_id, day)")
def window_flags(spark: SparkSession, d: str) -> DataFrame:
    """J11, J12, L16"""
    days = channel_days(spark, d)
    inside = O.window_days(O.silence_runs(days, "channel_id", 2), "channel_id", 3, 5).withColumn("x", F.lit(True))
    return days.join(inside, ["channel_id", "day"], "left").select("channel_id", "day", F.coalesce("x", F.lit(False)).alias("in_window"))


@query(f"{OD}, cal AS (SELECT object_id, CAST(DATE '2024-01-01' + CAST(k AS INTEGER) AS DATE) AS day FROM objects, (SELECT unnest(range(0, 30)) AS k)) SELECT cal.object_id, cal.day, coalesce(od.n_events, 0) AS n_events FROM cal LEFT JOIN od USING (object_id, day)")
def object_calendar(spark: SparkSession, d: str) -> DataFrame:
    """J14"""
    grid = O.calendar(B.objects(spark, d).select("object_id"), F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))
    return grid.join(O.object_days(channel_days(spark, d), FAMILIES).select("object_id", "day", "n_events"), ["object_id", "day"], "left").fillna(0, ["n_events"])


NB = CROSS + ", x AS (SELECT channel_id, object_id, t FROM crossings JOIN channels USING (channel_id) WHERE \"cross\"), nb AS (SELECT x.channel_id, x.object_id, x.t, count(DISTINCT y.channel_id) AS neighbours FROM x LEFT JOIN x y ON y.object_id = x.object_id AND y.channel_id <> x.channel_id AND y.t BETWEEN x.t - INTERVAL 6 HOUR AND x.t + INTERVAL 15 MINUTE GROUP BY 1, 2, 3)"
SH = NB + ", shapes AS (SELECT c.channel_id, c.t, (SELECT max(high) FROM crossings y WHERE y.channel_id = c.channel_id AND y.t BETWEEN c.t AND c.t + INTERVAL 24 HOUR) AS peak, (SELECT min(t) FROM crossings y WHERE y.channel_id = c.channel_id AND y.low < 100 AND y.t > c.t AND y.t <= c.t + INTERVAL 72 HOUR) AS below, (SELECT max(t) FROM crossings y WHERE y.channel_id = c.channel_id AND y.high < 50 AND y.t < c.t) AS calm FROM crossings c WHERE \"cross\"), sh AS (SELECT channel_id, t, peak, coalesce(date_diff('minute', t, below), 4320)::DOUBLE AS minutes_above, below IS NULL AS censored, date_diff('minute', calm, t)::DOUBLE AS rise_minutes FROM shapes)"


def crossed_of(spark: SparkSession, d: str) -> DataFrame:
    return crossings_of(spark, d).where("cross").join(B.channels(spark, d).select("channel_id", "object_id"), "channel_id").select("channel_id", "object_id", "t")


def shapes_of(spark: SparkSession, d: str) -> DataFrame:
    return O.crossing_shapes(crossings_of(spark, d), 100.0, 50.0, 24 * 60, 72 * 60)


@query(f"{NB} SELECT * FROM nb")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """J16, L19"""
    return O.neighbours(crossed_of(spark, d))


@query(f"{SH} SELECT * FROM sh")
def crossing_shapes(spark: SparkSession, d: str) -> DataFrame:
    """W18"""
    return shapes_of(spark, d)


#: Triage of the driver's crossings: hours stand for minutes, days with a reading of 100 or more are an object's activity.
TR = CROSS + ", cx AS (SELECT c.*, object_id FROM crossings c JOIN channels USING (channel_id)), ac AS (SELECT DISTINCT object_id, CAST(t AS DATE) AS day FROM cx WHERE high >= 100), an AS (SELECT object_id, day, lead(day) OVER (PARTITION BY object_id ORDER BY day) AS nx FROM ac), runs AS (SELECT object_id, day + 1 AS start, nx - 1 AS \"end\" FROM an WHERE nx - day - 1 >= 1), fd AS (SELECT object_id, min(day) AS first_day FROM ac GROUP BY 1), lv AS (SELECT c.channel_id, c.object_id, c.t, CAST(c.t AS DATE) AS day, c.t + INTERVAL 72 HOUR AS decision_t, (SELECT min(t) FROM cx y WHERE y.channel_id = c.channel_id AND y.high < 100 AND y.t > c.t AND y.t <= c.t + INTERVAL 24 HOUR) AS drop_t, (SELECT max(t) FROM cx y WHERE y.channel_id = c.channel_id AND y.high >= 100 AND y.t > c.t AND y.t <= c.t + INTERVAL 72 HOUR) AS above_t, (SELECT max(high) FROM cx y WHERE y.channel_id = c.channel_id AND y.t BETWEEN c.t AND c.t + INTERVAL 72 HOUR) AS peak, (SELECT max(t) FROM cx y WHERE y.channel_id = c.channel_id AND y.t BETWEEN c.t AND c.t + INTERVAL 72 HOUR) AS last_t FROM cx c WHERE \"cross\"), ls AS (SELECT *, coalesce(above_t > drop_t, false) AS repeat, drop_t IS NOT NULL AND NOT coalesce(above_t > drop_t, false) AS ended_fast, 4320.0 - date_diff('minute', t, last_t) AS age_minutes FROM lv), lt AS (SELECT *, CASE WHEN NOT ended_fast THEN 'unknown' WHEN age_minutes <= 2880 THEN 'observed_below' ELSE 'inferred_below' END AS state, (SELECT count(DISTINCT y.channel_id) FROM lv y WHERE y.object_id = ls.object_id AND y.channel_id <> ls.channel_id AND y.t BETWEEN ls.t - INTERVAL 6 HOUR AND ls.decision_t) AS neighbours, (SELECT count(DISTINCT y.channel_id) FROM lv y WHERE y.object_id = ls.object_id AND y.channel_id <> ls.channel_id AND y.day = ls.day) AS others_on_day, CASE WHEN ls.day - first_day < 5 OR first_day IS NULL THEN 'unknown' WHEN EXISTS (SELECT 1 FROM runs r WHERE r.object_id = ls.object_id AND ls.day - r.\"end\" BETWEEN 1 AND 21) THEN 'true' ELSE 'false' END AS after_silence FROM ls LEFT JOIN fd USING (object_id)), tb AS (SELECT *, NOT ended_fast OR peak > 300 OR state = 'unknown' AS bad FROM lt), tl AS (SELECT *, CASE WHEN bad THEN 'needs_attention' WHEN after_silence = 'true' THEN 'likely_after_maintenance' WHEN neighbours >= 1 THEN 'likely_bump_test' ELSE 'short_isolated' END AS now, day + 1 - INTERVAL 1 MICROSECOND AS day_end FROM tb), tr AS (SELECT *, CASE WHEN decision_t <= TIMESTAMP '2024-01-31' THEN now END AS live, CASE WHEN decision_t <= TIMESTAMP '2024-01-31' THEN CASE WHEN now LIKE 'likely%' AND state <> 'observed_below' THEN 'needs_attention' ELSE now END END AS strict, CASE WHEN day_end > TIMESTAMP '2024-01-31' THEN 'censored_right' WHEN decision_t > day_end THEN 'censored_by_day' WHEN bad THEN 'needs_attention' WHEN after_silence = 'true' THEN 'likely_after_maintenance' WHEN others_on_day >= 2 THEN 'likely_bump_test' ELSE 'short_isolated' END AS retro FROM tl)"


def triage_of(spark: SparkSession, d: str) -> DataFrame:
    cell = crossings_of(spark, d).join(B.channels(spark, d).select("channel_id", "object_id"), "channel_id")
    activity = cell.where("high >= 100").select("object_id", F.to_date("t").alias("day")).distinct()
    return O.triage(cell, activity, O.silence_runs(activity, "object_id", 1), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), threshold=100.0, peak_limit=300.0, live=72 * 60, fast=24 * 60, recent=48 * 60, history=5)


@query(f"{TR} SELECT channel_id, t, live, strict, retro, CASE WHEN decision_t <= TIMESTAMP '2024-01-31' THEN 'decided' ELSE 'censored_right' END AS status_at_archive_end, CASE WHEN CAST(decision_t AS DATE) > day THEN 'pending_at_day_end' ELSE 'decided' END AS status_at_day_end, NOT bad AND neighbours >= 1 AS series_only, NOT bad AND neighbours >= 1 AND state = 'observed_below' AS series_only_strict, ended_fast, repeat AS repeat_by_c, peak AS peak_by_c, neighbours AS other_ch_by_live_cutoff, after_silence, CAST(age_minutes AS DOUBLE) AS last_reading_age_min, state FROM tr")
def triage(spark: SparkSession, d: str) -> DataFrame:
    """L20, W19"""
    return triage_of(spark, d).select("channel_id", "t", "live", "strict", "retro", "status_at_archive_end", "status_at_day_end", "series_only", "series_only_strict", "reasons.*", "state")


@query(f"{TR} SELECT object_id, day, max(after_silence) AS after_silence, bool_or(after_silence <> 'unknown' AND EXISTS (SELECT 1 FROM runs r WHERE r.object_id = tr.object_id AND tr.day BETWEEN r.start - 3 AND r.\"end\" + 21)) AS in_posthoc FROM tr GROUP BY 1, 2")
def silence_context(spark: SparkSession, d: str) -> DataFrame:
    """Three-valued context of each object and day with a crossing"""
    return triage_of(spark, d).groupBy("object_id", "day").agg(F.max("after_silence").alias("after_silence"), F.bool_or("in_posthoc").alias("in_posthoc"))


@query(f"{TR}, trl AS (SELECT *, strict AS label FROM tr WHERE strict IS NOT NULL), ex AS (SELECT label, object_id, count(*) AS k, count(*) FILTER (WHERE isodow(t) >= 6) AS w, count(*) FILTER (WHERE hour(t) NOT BETWEEN 7 AND 18) AS o FROM trl GROUP BY 1, 2), er AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k DESC, object_id) AS r FROM ex) SELECT label, CAST(sum(k) AS BIGINT) AS n, round(sum(w) / sum(k), 6) AS weekend_share, round(sum(o) / sum(k), 6) AS off_hours_share, round(sum(k) FILTER (WHERE r = 1) / sum(k), 6) AS top1_share, round(sum(k) FILTER (WHERE r <= 3) / sum(k), 6) AS top3_share FROM er GROUP BY 1")
def triage_exposure(spark: SparkSession, d: str) -> DataFrame:
    """A23, W24"""
    return rounded(O.exposure(triage_of(spark, d).where("strict is not null").withColumn("label", F.col("strict")), ["label"], "t", "object_id"), "weekend_share", "off_hours_share", "top1_share", "top3_share")


@query(f"{SH}, b AS (SELECT floor(peak / 10) * 10 AS peak_bin, count(*) AS n FROM sh GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1) SELECT (SELECT peak_bin FROM b) AS peak_bin, round(quantile_cont(peak, 0.25), 6) AS peak_q1, round(quantile_cont(peak, 0.75), 6) AS peak_q3, quantile_disc(minutes_above, 0.95) AS duration_p95, round(avg(CAST(censored AS INTEGER)), 6) AS censored_share FROM sh")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A26"""
    return rounded(O.fingerprint(shapes_of(spark, d), 10.0).withColumn("peak_bin", F.col("peak_bin").cast("double")), "peak_q1", "peak_q3", "censored_share")


@query(f"{TR}, c AS (SELECT CAST(DATE '2024-01-01' + CAST(k AS INTEGER) AS DATE) AS day FROM (SELECT unnest(range(0, 30)) AS k)), n AS (SELECT c.day, count(tr.t) AS n FROM c LEFT JOIN tr ON CAST(tr.t AS DATE) = c.day AND strict = 'needs_attention' GROUP BY 1) SELECT count(*) AS days, round(avg(n), 6) AS mean_n, round(quantile_cont(n, 0.95), 6) AS p95_n, max(n) AS max_n FROM n")
def alert_burden(spark: SparkSession, d: str) -> DataFrame:
    """A24"""
    days = triage_of(spark, d).where("strict = 'needs_attention'")
    return rounded(O.burden(days, F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date")), "mean_n", "p95_n")


@query("SELECT CASE WHEN value_numeric IS NULL THEN 'missing' WHEN value_numeric < 1 THEN 'below' WHEN value_numeric >= 200 THEN 'above' WHEN value_numeric < 10 THEN '[1,10)' WHEN value_numeric < 50 THEN '[10,50)' WHEN value_numeric < 100 THEN '[50,100)' ELSE '[100,200)' END AS bin, count(*) AS n FROM journal GROUP BY 1")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A25"""
    return O.histogram(B.journal(spark, d), "value_numeric", [1, 10, 50, 100, 200])


@query(f"{SC}, g AS (SELECT avg(label) AS g FROM scores), l AS (SELECT sensor_type, count(label) AS n, sum(label) AS p FROM scores JOIN channels USING (channel_id) GROUP BY 1) SELECT sensor_type, n, round((p + 50 * g) / (n + 50), 6) AS prior FROM l, g")
def type_priors(spark: SparkSession, d: str) -> DataFrame:
    """A30, L23"""
    s = scores_of(spark, d)
    whole = s.agg(F.avg("label").alias("g"))
    t = s.join(B.channels(spark, d), "channel_id").groupBy("sensor_type").agg(F.count("label").alias("n"), F.sum("label").alias("p"))
    return t.crossJoin(F.broadcast(whole)).select("sensor_type", "n", F.round((F.col("p") + 50 * F.col("g")) / (F.col("n") + 50), 6).alias("prior"))


@query(f"{OD}, e AS (SELECT object_id, day, list_sort(list({{'channel_id': channel_id, 'n_events': n_events}}))[1:5] AS e, count(*) AS n FROM cd GROUP BY 1, 2) SELECT object_id, day, CAST(least(n, 5) AS INTEGER) AS n_elements, n > 5 AS truncated, e[1].channel_id AS first_channel, CAST(list_sum(list_transform(e, lambda x: x.n_events)) AS BIGINT) AS kept_events FROM e")
def element_sets(spark: SparkSession, d: str) -> DataFrame:
    """L31"""
    days = channel_days(spark, d)
    sets = O.element_sets(days, days.select("object_id", "day").distinct(), 5)
    return sets.select("object_id", "day", "n_elements", "truncated", F.col("elements")[0]["channel_id"].alias("first_channel"), F.aggregate("elements", F.lit(0).cast("long"), lambda a, x: a + x["n_events"]).alias("kept_events"))


@query(f"{OD}, sg AS (SELECT object_id, day, string_agg(DISTINCT sensor_type, '|' ORDER BY sensor_type) AS signature, CAST(sum(n_alarm) > 3 AS INTEGER) AS label FROM cd GROUP BY 1, 2) SELECT signature, count(*) AS n, round(CASE WHEN count(*) >= 20 THEN avg(label) ELSE (SELECT avg(label) FROM sg) END, 6) AS rate FROM sg GROUP BY 1")
def composition_rates(spark: SparkSession, d: str) -> DataFrame:
    """L32"""
    rows = channel_days(spark, d).groupBy("object_id", "day").agg(F.array_join(F.array_sort(F.collect_set("sensor_type")), "|").alias("signature"), (F.sum("n_alarm") > 3).cast("int").alias("label"))
    return rounded(O.composition_rates(rows, 20), "rate")


@query(f"{RK} SELECT channel_id, day, score, rank FROM rk WHERE rank <= 5")
def daily_top(spark: SparkSession, d: str) -> DataFrame:
    """W23"""
    return A.ranked(scores_of(spark, d)).where("rank <= 5").select("channel_id", "day", "score", "rank")


@query(f"{RK}, past AS (SELECT DISTINCT channel_id FROM rk WHERE rank <= 5 AND day < DATE '2024-01-15' AND day > DATE '2024-01-08'), el AS (SELECT channel_id, day, score FROM scores WHERE day = DATE '2024-01-15' AND channel_id NOT IN (SELECT channel_id FROM past)) SELECT channel_id, day, score, row_number() OVER (ORDER BY score DESC, channel_id) AS rank FROM el ORDER BY score DESC, channel_id LIMIT 5")
def select_day(spark: SparkSession, d: str) -> DataFrame:
    """T04"""
    s = scores_of(spark, d)
    return A.select_day(s, A.ranked(s).where("rank <= 5"), "2024-01-15", 5, 7).select("channel_id", "day", "score", "rank")


@query(RK + ", al AS (SELECT channel_id, list(day ORDER BY day) AS days FROM rk WHERE rank <= 25 GROUP BY 1), k AS (SELECT channel_id, list_reduce(list_prepend([days[1]], list_transform(days[2:], lambda x: [x])), lambda a, x: CASE WHEN x[1] - a[-1] >= 5 THEN list_concat(a, x) ELSE a END) AS kept FROM al) SELECT channel_id, unnest(kept) AS day FROM k")
def cooled_alerts(spark: SparkSession, d: str) -> DataFrame:
    """T05"""
    return A.cooled(A.ranked(scores_of(spark, d)).where("rank <= 25").select("channel_id", "day", "score"), 5).select("channel_id", "day")


@query(f"{SC}, dl AS (SELECT CAST(day - DATE '2024-01-01' AS INTEGER) AS i, list(channel_id ORDER BY score DESC, channel_id) AS c FROM scores GROUP BY 1), fold AS (SELECT -1 AS i, CAST([] AS BIGINT[]) AS now, CAST([] AS BIGINT[]) AS h1, CAST([] AS BIGINT[]) AS h2, CAST([] AS BIGINT[]) AS h3, CAST([] AS BIGINT[]) AS h4 UNION ALL SELECT f.i + 1, list_filter(coalesce(dl.c, []), lambda x: NOT list_contains(f.now, x) AND NOT list_contains(f.h1, x) AND NOT list_contains(f.h2, x) AND NOT list_contains(f.h3, x))[1:10], f.now, f.h1, f.h2, f.h3 FROM fold f LEFT JOIN dl ON dl.i = f.i + 1 WHERE f.i < 30), pk AS (SELECT i, unnest(now) AS channel_id FROM fold) SELECT s.channel_id, s.day, s.score FROM pk JOIN scores s ON s.channel_id = pk.channel_id AND s.day - DATE '2024-01-01' = pk.i")
def refilled_alerts(spark: SparkSession, d: str) -> DataFrame:
    """A fold over days"""
    return A.refilled(scores_of(spark, d).select("channel_id", "day", "score"), 10, 5)


@query(f"{RK}, al AS (SELECT channel_id, CAST(day - DATE '2024-01-01' AS INTEGER) AS i FROM rk WHERE rank <= 10), ev AS (SELECT channel_id, list_sort(list(DISTINCT CAST(CAST(event_time AS DATE) - DATE '2024-01-01' AS INTEGER))) AS e FROM journal WHERE alarm GROUP BY 1), aa AS (SELECT channel_id, list_sort(list(i)) AS a FROM al GROUP BY 1), fd AS (SELECT channel_id, a, e, 1 AS k, CAST([] AS INTEGER[]) AS used, CAST(NULL AS INTEGER) AS i, CAST(NULL AS INTEGER) AS hit FROM aa JOIN ev USING (channel_id) UNION ALL SELECT channel_id, a, e, k + 1, CASE WHEN list_filter(e, lambda x: x >= a[k] + 2 AND x < a[k] + 5 AND NOT list_contains(used, x))[1] IS NULL THEN used ELSE list_append(used, list_filter(e, lambda x: x >= a[k] + 2 AND x < a[k] + 5 AND NOT list_contains(used, x))[1]) END, a[k], list_filter(e, lambda x: x >= a[k] + 2 AND x < a[k] + 5 AND NOT list_contains(used, x))[1] FROM fd WHERE k <= len(a)) SELECT channel_id, CAST(DATE '2024-01-01' + i AS DATE) AS day, CAST(DATE '2024-01-01' + hit AS DATE) AS event_day FROM fd WHERE hit IS NOT NULL")
def matched_alerts(spark: SparkSession, d: str) -> DataFrame:
    """One event for each alert, the earliest free one"""
    events = B.journal(spark, d).where("alarm").select("channel_id", F.to_date("event_time").alias("event_day"))
    return A.matched(A.ranked(scores_of(spark, d)).where("rank <= 10"), events, 2, 3)


@query(f"{RK}, a AS (SELECT DISTINCT channel_id, CAST(day + 2 AS DATE) AS start FROM rk WHERE rank <= 10), e AS (SELECT DISTINCT channel_id, CAST(event_time AS DATE) AS start FROM journal WHERE alarm) SELECT (SELECT count(*) FROM a) AS alerts, (SELECT count(*) FROM e) AS events, (SELECT count(*) FROM a JOIN e USING (channel_id, start)) AS hits")
def matched_on_start(spark: SparkSession, d: str) -> DataFrame:
    """J18"""
    alerts = A.ranked(scores_of(spark, d)).where("rank <= 10").select("channel_id", F.date_add("day", 2).alias("start"))
    events = B.journal(spark, d).where("alarm").select("channel_id", F.to_date("event_time").alias("start"))
    return A.matched_on_start(alerts, events, "channel_id", "start")


@query(f"{ST} SELECT sum(pos + neg) AS n, sum(pos) AS positives, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS ap, round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM tt")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    """M07"""
    return rounded(A.average_precision(scores_of(spark, d)), "ap", "auc")


@query(SC + ", t AS (SELECT sensor_type, score, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS neg FROM scores JOIN channels USING (channel_id) WHERE label IS NOT NULL GROUP BY 1, 2), tt AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM t WINDOW w AS (PARTITION BY sensor_type ORDER BY score DESC)) SELECT sensor_type, sum(pos + neg) AS n, sum(pos) AS positives, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS ap, round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM tt GROUP BY 1")
def metrics_by_type(spark: SparkSession, d: str) -> DataFrame:
    """M11"""
    return rounded(A.average_precision(scores_of(spark, d).join(B.channels(spark, d), "channel_id"), "sensor_type"), "ap", "auc")


@query(f"{SC} SELECT count(*) AS n, round(count(*) FILTER (WHERE score >= 0.4 AND label = 1) / count(*) FILTER (WHERE score >= 0.4), 6) AS precision, round(count(*) FILTER (WHERE score >= 0.4 AND label = 1) / count(*) FILTER (WHERE label = 1), 6) AS recall, round(avg((score - label) ** 2), 6) AS brier, round(1000 * count(*) FILTER (WHERE score >= 0.4 AND label = 0) / count(*), 6) AS false_in_1000 FROM scores WHERE label IS NOT NULL")
def point_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M07"""
    return rounded(A.point_metrics(scores_of(spark, d), 0.4), "precision", "recall", "brier", "false_in_1000")


CB = SC + ", cb AS (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_score, avg(label) AS rate FROM scores WHERE label IS NOT NULL GROUP BY 1)"


@query(f"{CB} SELECT bin, n, round(mean_score, 4) AS mean_score, round(rate, 4) AS rate FROM cb")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """M08"""
    return A.calibration(scores_of(spark, d)).withColumns({c: F.round(c, 4) for c in ("mean_score", "rate")})


@query(f"{CB} SELECT round(sum(n * abs(mean_score - rate)) / sum(n), 6) AS ece FROM cb")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    """M08"""
    return rounded(A.expected_calibration_error(scores_of(spark, d)), "ece")


@query(f"{ST} SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, tp FROM tt WHERE tp / (tp + fp) >= 0.2 ORDER BY tp DESC, score DESC LIMIT 1")
def precision_threshold(spark: SparkSession, d: str) -> DataFrame:
    """M06, M20"""
    return rounded(A.threshold_for_precision(scores_of(spark, d), 0.2), "precision")


@query(f"{ST} SELECT score AS threshold, round(2 * tp / (tp + fp + (SELECT sum(pos) FROM t)), 6) AS f1 FROM tt ORDER BY 2 * tp / (tp + fp + (SELECT sum(pos) FROM t)) DESC, score DESC LIMIT 1")
def best_f1(spark: SparkSession, d: str) -> DataFrame:
    """M06"""
    return rounded(A.best_f1(scores_of(spark, d)), "f1")


@query(f"{RK} SELECT CAST(k AS INTEGER) AS k, (SELECT count(*) FROM rk WHERE label = 1) AS positives, count(*) FILTER (WHERE rank <= k) AS alerts, count(label) FILTER (WHERE rank <= k) AS known, count(*) FILTER (WHERE rank <= k AND label = 1) AS hits, round(hits / known, 6) AS precision, round(hits / alerts, 6) AS precision_low, round((hits + alerts - known) / alerts, 6) AS precision_high, round(hits / (SELECT count(*) FROM rk WHERE label = 1), 6) AS recall FROM rk, (SELECT unnest([5, 10, 25, 50]) AS k) GROUP BY k")
def budget_curve(spark: SparkSession, d: str) -> DataFrame:
    """M09"""
    return rounded(A.budget_curve(scores_of(spark, d), [5, 10, 25, 50]), "precision", "precision_low", "precision_high", "recall")


@query(f"{RK} SELECT min(score) AS threshold FROM rk WHERE rank <= 10")
def budget_threshold(spark: SparkSession, d: str) -> DataFrame:
    """M20"""
    return A.budget_threshold(scores_of(spark, d), 10)


@query(f"{SC}, dd AS (SELECT day, count(DISTINCT channel_id) AS n FROM scores GROUP BY 1) SELECT round(avg(least(n, 25) / n), 6) AS saturation FROM dd")
def saturation(spark: SparkSession, d: str) -> DataFrame:
    """M19"""
    return rounded(A.saturation(scores_of(spark, d), 25), "saturation")


@query(f"{SC}, bs AS (SELECT day AS block, count(*) AS n, sum((score - label) ** 2) - sum((0.1 - label) ** 2) AS d, row_number() OVER (ORDER BY day) - 1 AS i FROM scores WHERE label IS NOT NULL GROUP BY 1), sz AS (SELECT count(*) AS size FROM bs), dr AS (SELECT rep, CAST('0x' || substr(md5('s:' || rep || ':' || dr), 1, 8) AS BIGINT) % size AS i FROM (SELECT unnest(range(0, 200)) AS rep), sz, LATERAL (SELECT unnest(range(0, size)) AS dr)), ea AS (SELECT rep, sum(d) / sum(n) AS x FROM dr JOIN bs USING (i) GROUP BY 1) SELECT count(*) AS repeats, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.5), 6) AS middle, round(quantile_cont(x, 0.975), 6) AS high FROM ea")
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """M10"""
    return rounded(A.block_bootstrap(scores_of(spark, d).withColumn("flat", F.lit(0.1)), F.col("day"), "score", "flat", 200), "low", "middle", "high")


@query(f"{SC} SELECT count(*) AS rows, count(*) FILTER (WHERE score IS NULL) AS nulls, count(*) FILTER (WHERE isnan(score)) AS nans, count(*) FILTER (WHERE score < 0 OR score > 1) AS out_of_range, (SELECT count(*) FROM (SELECT 1 FROM scores GROUP BY channel_id, day HAVING count(*) > 1)) AS repeated FROM scores")
def score_contract(spark: SparkSession, d: str) -> DataFrame:
    """P16, P21"""
    return A.contract(scores_of(spark, d))


@query(f"{SC}, b AS (SELECT channel_id, day, round(score + 0.001, 6) AS score FROM scores WHERE channel_id % 7 <> 0) SELECT count(*) AS rows, round(max(abs(a.score - b.score)), 6) AS largest, count(*) FILTER (WHERE (a.score IS NULL) <> (b.score IS NULL)) AS one_sided FROM scores a FULL JOIN b ON a.channel_id = b.channel_id AND a.day = b.day")
def score_parity(spark: SparkSession, d: str) -> DataFrame:
    """M21"""
    s = scores_of(spark, d)
    return rounded(A.parity(s, s.where("channel_id % 7 <> 0").withColumn("score", F.round(F.col("score") + 0.001, 6)), ["channel_id", "day"]), "largest")


@query(f"{SILENCE}{SC}, wd AS (SELECT DISTINCT channel_id, CAST(start - 3 + CAST(k AS INTEGER) AS DATE) AS day FROM silence, (SELECT unnest(range(0, 60)) AS k) WHERE start - 3 + CAST(k AS INTEGER) <= \"end\" + 5) SELECT count(wd.day) AS n_inside, round(avg(label) FILTER (WHERE wd.day IS NOT NULL), 6) AS rate_inside, round(avg(label) FILTER (WHERE wd.day IS NULL), 6) AS rate_outside, round(avg(label) FILTER (WHERE wd.day IS NOT NULL) / avg(label) FILTER (WHERE wd.day IS NULL), 6) AS lift FROM scores LEFT JOIN wd USING (channel_id, day)")
def window_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """M18"""
    inside = O.window_days(O.silence_runs(channel_days(spark, d), "channel_id", 2), "channel_id", 3, 5).withColumn("x", F.lit(True))
    rows = scores_of(spark, d).join(inside, ["channel_id", "day"], "left")
    return rounded(A.enrichment(rows, F.col("x").isNotNull()), "rate_inside", "rate_outside", "lift")


@query(f"{RK}, al AS (SELECT channel_id, day FROM rk WHERE rank <= 25) SELECT a.channel_id, a.day, NOT EXISTS (SELECT 1 FROM al b WHERE b.channel_id = a.channel_id AND b.day < a.day AND b.day >= a.day - 2) AS attention FROM al a")
def suppressed_alerts(spark: SparkSession, d: str) -> DataFrame:
    """L27"""
    return A.suppressed(A.ranked(scores_of(spark, d)).where("rank <= 25").select("channel_id", "day"), 2)
