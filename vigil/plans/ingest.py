"""Queries on ingest rules, scalar functions and sources, over raw text made from the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.functions import scalars as S
from vigil.operators import bindings as B
from vigil.operators.states import day_range
from vigil.plans.ml import last_rows as rows_of
from vigil.plans.registry import query
from vigil.plans.streams import scratch
from vigil.sources import files as R

RAW = ", raw AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 97 = 5 THEN 'x' ELSE CAST(channel_id AS VARCHAR) END AS channel_id, strftime(event_time, '%Y-%m-%d') AS date_raw, CASE WHEN event_id % 89 = 7 THEN '3:4:5' ELSE strftime(event_time, '%H:%M:%S') END AS time_raw, CASE WHEN event_id % 83 = 9 THEN '?' WHEN alarm THEN ' T' ELSE 'false' END AS alarm_raw, CASE event_id % 5 WHEN 0 THEN value_state WHEN 1 THEN replace(CAST(event_id AS VARCHAR) || ',5', ' ', '') WHEN 2 THEN '' WHEN 3 THEN NULL ELSE ' 12.25 ' END AS value_raw FROM journal)"
PARSED = RAW + ", parsed AS (SELECT try_cast(trim(event_id) AS BIGINT) AS event_id, try_cast(trim(channel_id) AS BIGINT) AS channel_id, CASE WHEN length(time_raw) = 8 THEN try_strptime(date_raw || ' ' || time_raw, '%Y-%m-%d %H:%M:%S') END AS event_time, CASE WHEN lower(trim(alarm_raw)) IN ('t', 'true') THEN true WHEN lower(trim(alarm_raw)) IN ('f', 'false') THEN false END AS alarm, try_cast(replace(trim(value_raw), ',', '.') AS DOUBLE) AS value_numeric, CASE WHEN try_cast(replace(trim(value_raw), ',', '.') AS DOUBLE) IS NULL THEN nullif(trim(value_raw), '') END AS value_state, sha256(replace(to_json([event_id, channel_id, date_raw, time_raw, alarm_raw, value_raw])::VARCHAR, ', ', ',')) AS row_hash FROM raw), checked AS (SELECT *, CASE WHEN event_id IS NULL THEN 'event_id' WHEN channel_id IS NULL THEN 'channel_id' WHEN event_time IS NULL THEN 'event_time' WHEN alarm IS NULL THEN 'alarm' END AS error FROM parsed)"


def raw_of(spark: SparkSession, d: str) -> DataFrame:
    """Journal rows as raw text with some faults."""
    j = B.journal(spark, d)
    e = F.col("event_id")
    number = F.concat(e.cast("string"), F.lit(",5"))
    value = F.when(e % 5 == 0, F.col("value_state")).when(e % 5 == 1, number).when(e % 5 == 2, "").when(e % 5 == 4, " 12.25 ")
    return j.select(e.cast("string").alias("event_id"), F.when(e % 97 == 5, "x").otherwise(F.col("channel_id").cast("string")).alias("channel_id"), F.date_format("event_time", "yyyy-MM-dd").alias("date_raw"), F.when(e % 89 == 7, "3:4:5").otherwise(F.date_format("event_time", "HH:mm:ss")).alias("time_raw"), F.when(e % 83 == 9, "?").when(F.col("alarm"), " T").otherwise("false").alias("alarm_raw"), value.alias("value_raw"))


@query(f"{PARSED} SELECT * FROM checked")
def parsed_events(spark: SparkSession, d: str) -> DataFrame:
    """P01, F01-F03, F11, F12, S08"""
    return R.parse_events(raw_of(spark, d))


@query(f"{PARSED} SELECT coalesce(error, 'none') AS error, count(*) AS n FROM checked GROUP BY 1")
def parse_errors(spark: SparkSession, d: str) -> DataFrame:
    """A04"""
    return R.parse_events(raw_of(spark, d)).groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


@query(f"{PARSED} SELECT (SELECT count(*) FROM raw) * 2 + 5 AS rows, 5 AS headers, count(error) * 2 AS bad, count(*) FILTER (WHERE error IS NULL) AS repeated, 0 AS other_year, count(*) FILTER (WHERE error IS NULL) AS staged, 0 AS unexplained FROM checked".replace("5 AS headers", "CAST(5 AS BIGINT) AS headers").replace("0 AS other_year", "CAST(0 AS BIGINT) AS other_year").replace("0 AS unexplained", "CAST(0 AS BIGINT) AS unexplained"))
def row_balance(spark: SparkSession, d: str) -> DataFrame:
    """The journal twice, with five repeated headers, counted while it is staged"""
    raw = raw_of(spark, d)
    header = spark.range(5).select(*(F.lit(c).alias(c) for c in raw.columns))
    return R.stage_balanced(raw.union(raw).union(header), scratch(spark))


@query(f"{PARSED} SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 3 <> 0) AS inserted, count(*) FILTER (WHERE event_id % 3 = 0) AS skipped FROM checked WHERE error IS NULL")
def append_counts(spark: SparkSession, d: str) -> DataFrame:
    """A third of the rows are there already"""
    good = R.parse_events(raw_of(spark, d)).where("error is null")
    return R.append_counts(good, good.where("event_id % 3 = 0"))


@query("SELECT channel_id, CASE WHEN channel_id % 4 = 0 THEN 'NEW' ELSE sensor_type END AS sensor_type FROM channels UNION ALL SELECT channel_id + 1000000, 'NEW' FROM channels WHERE channel_id % 4 = 0")
def upserted_channels(spark: SparkSession, d: str) -> DataFrame:
    """S12, U01, U04"""
    old = B.channels(spark, d).select("channel_id", "sensor_type")
    some = old.where("channel_id % 4 = 0")
    new = some.select("channel_id", F.lit("OLDER").alias("sensor_type"), F.lit(1).alias("at")).union(some.select("channel_id", F.lit("NEW"), F.lit(2))).union(some.select(F.col("channel_id") + 1000000, F.lit("NEW"), F.lit(1)))
    return R.upsert(old, new, "channel_id", "at")


@query("SELECT channel_id, substr(tag, 1, 3) AS site, CASE WHEN channel_id % 2 = 0 THEN CAST(channel_id % 500 AS INTEGER) END AS picket FROM (SELECT channel_id, 'S' || lpad(CAST(object_id AS VARCHAR), 2, '0') || '-' || sensor_type AS tag FROM channels)")
def parsed_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """S04, S06, F04, F05"""
    c = B.channels(spark, d)
    tag = F.concat(F.lit("S"), F.lpad(F.col("object_id").cast("string"), 2, "0"), F.lit("-"), F.col("sensor_type"))
    name = F.when(F.col("channel_id") % 2 == 0, F.concat(F.lit("датчик пк "), (F.col("channel_id") % 500).cast("string"))).otherwise("без места")
    raw = c.select(F.concat(F.lit(" "), F.col("channel_id").cast("string")).alias("channel_id"), tag.alias("tag"), name.alias("name"), F.lit(2).alias("position"))
    stale = raw.withColumns({"tag": F.lit("old"), "position": F.lit(1)})
    return R.catalogue(raw.union(stale)).select("channel_id", "site", "picket")


@query("SELECT channel_id, lon, lat, 'POINT(' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS wkt, abs(lat) <= 90 AS fine FROM (SELECT channel_id, CAST(channel_id % 360 - 180 AS DOUBLE) AS lon, CAST(channel_id % 200 - 100 AS DOUBLE) AS lat FROM channels)")
def geo_points(spark: SparkSession, d: str) -> DataFrame:
    """Points as text, parsed again"""
    c = B.channels(spark, d).select("channel_id", (F.col("channel_id") % 360 - 180).cast("double").alias("lon"), (F.col("channel_id") % 200 - 100).cast("double").alias("lat"))
    c = c.withColumn("wkt", F.concat(F.lit("POINT("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")))
    return c.withColumn("fine", S.wkt_point(F.col("wkt")).isNotNull())


@query("SELECT channel_id, round(CAST('0x' || substr(sha256(CAST(channel_id AS VARCHAR)), 1, 16) AS UBIGINT) / 18446744073709551615.0, 6) AS place FROM channels")
def synthetic_places(spark: SparkSession, d: str) -> DataFrame:
    """F23"""
    return B.channels(spark, d).select("channel_id", S.synthetic_coordinate(F.col("channel_id")).alias("place"))


@query("SELECT event_id, isodow(event_time) AS weekday, month(event_time) AS month, hour(event_time) AS hour, week(event_time) AS week, isoyear(event_time) AS week_year, CAST(date_trunc('day', event_time) AS DATE) AS day, year(event_time) || CASE WHEN month(event_time) <= 6 THEN 'H1' ELSE 'H2' END AS period FROM journal")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    """F13, F16, L21"""
    t = F.col("event_time")
    return B.journal(spark, d).select("event_id", (F.weekday(t) + 1).cast("long").alias("weekday"), F.month(t).cast("long").alias("month"), F.hour(t).cast("long").alias("hour"), F.weekofyear(t).cast("long").alias("week"), F.extract(F.lit("yearofweek"), t).cast("long").alias("week_year"), F.to_date(t).alias("day"), S.period_name(t).alias("period"))


@query("SELECT event_id, round(sign(v) * ln(1 + abs(v)), 6) AS signed_log, round(1 / (1 + exp(-v / 100)), 6) AS logistic, greatest(-1, least(1, v)) AS clipped, round(1 / (1 + CAST(event_id % 30 AS DOUBLE)), 6) AS recurrence FROM (SELECT event_id, value_numeric - 100 AS v FROM journal)")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """F17, F18, F29"""
    v = F.col("value_numeric") - 100
    return B.journal(spark, d).select("event_id", F.round(S.signed_log(v), 6).alias("signed_log"), F.round(S.logistic(v / 100), 6).alias("logistic"), S.clip(v, -1.0, 1.0).alias("clipped"), F.round(S.recurrence_score(F.col("event_id") % 30), 6).alias("recurrence"))


@query(", y AS (SELECT channel_id % 9 + 2015 AS year, ['parquet', 'csv', '7z'][channel_id % 3 + 1] AS format, CAST(channel_id AS VARCHAR) AS path FROM channels WHERE channel_id % 9 <> 4) SELECT CAST(year AS INTEGER) AS year, path, format FROM y QUALIFY row_number() OVER (PARTITION BY year ORDER BY CASE format WHEN 'parquet' THEN 0 WHEN 'csv' THEN 1 ELSE 2 END, path) = 1")
def picked_sources(spark: SparkSession, d: str) -> DataFrame:
    """A listing made from the catalogue"""
    c = F.col("channel_id")
    listing = B.channels(spark, d).where("channel_id % 9 <> 4").select((c % 9 + 2015).cast("int").alias("year"), F.element_at(F.array(F.lit("parquet"), F.lit("csv"), F.lit("7z")), (c % 3 + 1).cast("int")).alias("format"), c.cast("string").alias("path"))
    return R.pick_sources(listing)


@query(", r AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '=' || value_state ELSE value_state END AS text FROM journal) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '''' || text ELSE text END AS text, true AS truncated FROM r ORDER BY event_id LIMIT 500")
def safe_report(spark: SparkSession, d: str) -> DataFrame:
    """S19, F26"""
    rows = B.journal(spark, d).select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("="), F.col("value_state"))).otherwise(F.col("value_state")).alias("text"))
    return R.report(rows, 500, F.asc("event_id"))


WEATHER = ", w AS (SELECT CAST(event_time AS DATE) AS day, count(*) AS rain FROM journal GROUP BY 1)"


@query(f"{WEATHER} SELECT day, rain, CASE WHEN count(*) OVER w3 = 3 THEN CAST(sum(rain) OVER w3 AS BIGINT) END AS sum_3, round(CASE WHEN count(*) OVER w7 = 7 THEN avg(rain) OVER w7 END, 6) AS mean_7, CASE WHEN count(*) OVER w7 = 7 THEN max(rain) OVER w7 END AS max_7, lead(rain, 1) OVER (ORDER BY day) AS next_1, lead(rain, 2) OVER (ORDER BY day) AS next_2, rain - lag(rain) OVER (ORDER BY day) AS change FROM w WINDOW w3 AS (ORDER BY day ROWS 2 PRECEDING), w7 AS (ORDER BY day ROWS 6 PRECEDING)")
def weather_features(spark: SparkSession, d: str) -> DataFrame:
    """A daily series (events of a day); as many rows as days"""
    daily = B.journal(spark, d).groupBy(F.to_date("event_time").alias("day")).agg(F.count("*").alias("rain"))
    return R.weather_features(daily, "rain").withColumn("mean_7", F.round("mean_7", 6))


@query(f"{WEATHER} SELECT count(*) AS days, count(*) = max(day) - min(day) + 1 AS continuous, count(rain) = count(*) AS complete FROM w")
def weather_contract(spark: SparkSession, d: str) -> DataFrame:
    """S21"""
    return R.checked_weather(B.journal(spark, d).groupBy(F.to_date("event_time").alias("day")).agg(F.count("*").alias("rain")))


@query(f"{WEATHER} SELECT j.event_id, w.rain, p.rain AS rain_shifted FROM journal j LEFT JOIN w ON w.day = CAST(j.event_time AS DATE) LEFT JOIN w p ON p.day = CAST(j.event_time AS DATE) - 7")
def attached_weather(spark: SparkSession, d: str) -> DataFrame:
    """With a placebo seven days back"""
    j = B.journal(spark, d).withColumn("day", F.to_date("event_time"))
    w = j.groupBy("day").agg(F.count("*").alias("rain"))
    return j.join(w, "day", "left").join(w.select(F.date_add("day", 7).alias("day"), F.col("rain").alias("rain_shifted")), "day", "left").select("event_id", "rain", "rain_shifted")


@query("SELECT channel_id, day, list_concat(list_transform(range(0, greatest(0, 3 - len(n))), lambda x: NULL), n)[1] AS oldest, n[-1] AS newest, CAST(len(n) AS INTEGER) AS held FROM (SELECT channel_id, day, list(n) OVER (PARTITION BY channel_id ORDER BY day ROWS 2 PRECEDING) AS n FROM (SELECT channel_id, CAST(event_time AS DATE) AS day, count(*) AS n FROM journal GROUP BY 1, 2))")
def last_rows(spark: SparkSession, d: str) -> DataFrame:
    """W21, W22"""
    days = B.journal(spark, d).groupBy("channel_id", F.to_date("event_time").alias("day")).agg(F.count("*").alias("n"))
    out = rows_of(days, 3, ["n"])
    return out.select("channel_id", "day", F.col("sequence")[0]["n"].alias("oldest"), F.col("sequence")[2]["n"].alias("newest"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("held"))


@query(", s AS (SELECT event_id, list_filter([CASE WHEN event_id % 7 = 0 THEN 'future_time' END, CASE WHEN event_id % 5 = 0 THEN 'half_location' END, CASE WHEN event_id % 11 = 0 THEN 'longitude_range' END, CASE WHEN event_id % 3 = 0 THEN 'unknown_kind' END], lambda x: x IS NOT NULL) AS e FROM journal) SELECT event_id, array_to_string(e, '|') AS errors FROM s")
def message_errors(spark: SparkSession, d: str) -> DataFrame:
    """Messages made from events with faults by id"""
    e = F.col("event_id")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    longitude = F.when(e % 11 == 0, 999.0).otherwise(10.0)
    m = B.journal(spark, d).select("event_id", F.when(e % 7 == 0, F.lit("2024-06-02 00:00:00").cast("timestamp_ntz")).otherwise(F.col("event_time")).alias("observed_at"), longitude.alias("longitude"), F.when(e % 5 != 0, 50.0).alias("latitude"), F.when(e % 3 == 0, "other").otherwise("telemetry").alias("kind"), F.col("value_numeric").alias("value"), e.cast("string").alias("external_id"))
    return R.check_messages(m, now).select("event_id", F.array_join("errors", "|").alias("errors"))


@query("SELECT CAST(event_time AS DATE) AS day, count(*) AS rows, min(event_id) AS first, max(event_id) AS last, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(event_time AS DATE), event_id, channel_id, value_state)), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM journal GROUP BY 1")
def table_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Rows, range and checksum of each day"""
    return R.manifest(B.journal(spark, d).select(F.to_date("event_time").alias("day"), "event_id", "channel_id", "value_state"), "day", "event_id")


@query("SELECT channel_id, min(event_id) AS first_id, count(*) AS n FROM (SELECT channel_id, event_id FROM journal UNION ALL SELECT channel_id, event_id FROM journal) GROUP BY 1")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    """U01"""
    j = B.journal(spark, d).select("channel_id", "event_id")
    return j.unionByName(j).groupBy("channel_id").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))


@query("SELECT CAST(event_time AS DATE) AS day, channel_id FROM journal WHERE alarm EXCEPT SELECT CAST(event_time AS DATE), channel_id FROM journal WHERE value_state = 'purchase'")
def day_difference(spark: SparkSession, d: str) -> DataFrame:
    """U02, U05"""
    j = B.journal(spark, d).select(F.to_date("event_time").alias("day"), "channel_id", "alarm", "value_state")
    return j.where("alarm").select("day", "channel_id").subtract(j.where("value_state = 'purchase'").select("day", "channel_id"))


@query("SELECT channel_id, day, gap_days, CASE WHEN n >= 2 THEN median_gap END AS median_gap FROM (SELECT channel_id, day, gap_days, quantile_cont(gap_days, 0.5) OVER w AS median_gap, count(gap_days) OVER w AS n FROM (SELECT channel_id, day, CAST(day - lag(day) OVER (PARTITION BY channel_id ORDER BY day) AS INTEGER) AS gap_days FROM (SELECT DISTINCT channel_id, CAST(event_time AS DATE) AS day FROM journal)) WINDOW w AS (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))")
def cadence(spark: SparkSession, d: str) -> DataFrame:
    """Rolling median of gaps"""
    by = Window.partitionBy("channel_id").orderBy("day")
    days = B.journal(spark, d).select("channel_id", F.to_date("event_time").alias("day")).distinct().withColumn("gap_days", F.date_diff("day", F.lag("day").over(by)))
    last = day_range(7, "channel_id")
    return days.select("channel_id", "day", "gap_days", F.when(F.count("gap_days").over(last) >= 2, F.percentile("gap_days", F.lit(0.5)).over(last)).alias("median_gap"))
