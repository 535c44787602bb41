"""Queries that write files of the driver's tables to the shared folder and read them again: sources, sinks and registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators import bindings as B
from vigil.plans.registry import query
from vigil.plans.streams import scratch
from vigil.sources import files as R

TEXT = "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(channel_id AS VARCHAR) AS channel_id, strftime(event_time, '%Y-%m-%d') AS date_raw, strftime(event_time, '%H:%M:%S') AS time_raw, CASE WHEN alarm THEN 'true' ELSE 'false' END AS alarm_raw, value_state AS value_raw FROM journal"


def journal_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_time")
    return B.journal(spark, d).select(F.col("event_id").cast("string"), F.col("channel_id").cast("string"), F.date_format(t, "yyyy-MM-dd").alias("date_raw"), F.date_format(t, "HH:mm:ss").alias("time_raw"), F.col("alarm").cast("string").alias("alarm_raw"), F.col("value_state").alias("value_raw"))


@query(TEXT)
def journal_files(spark: SparkSession, d: str) -> DataFrame:
    """A journal of CSV files with its own column names, as text"""
    at = scratch(spark)
    journal_text(spark, d).toDF(*R.JOURNAL_COLUMNS).write.option("header", True).csv(at)
    return R.read_journal(spark, at).drop("file")


@query(f"SELECT 'csv' AS source, * FROM ({TEXT}) UNION ALL SELECT 'parquet', * FROM ({TEXT})")
def switched_sources(spark: SparkSession, d: str) -> DataFrame:
    """CSV, and the Parquet of text that it is staged to, read by one switch"""
    at = scratch(spark)
    rows = journal_text(spark, d)
    rows.write.option("header", True).csv(f"{at}/source.csv")
    R.stage_strings(spark, f"{at}/source.csv", f"{at}/source.parquet", rows.columns)
    csv, parquet = (R.scan_source(spark, f"{at}/source.{kind}", rows.columns).select(F.lit(kind).alias("source"), "*") for kind in ("csv", "parquet"))
    return csv.unionByName(parquet)


@query("SELECT f AS format, CAST(channel_id AS VARCHAR) AS channel_id, sensor_type, CASE WHEN object_id % 2 = 0 THEN 'true' ELSE 'false' END AS even FROM channels, (SELECT unnest(['csv', 'xml', 'parquet']) AS f)")
def record_formats(spark: SparkSession, d: str) -> DataFrame:
    """Records of three formats with an extra column, decoded to text"""
    at = scratch(spark)
    rows = B.channels(spark, d).select("channel_id", "sensor_type", (F.col("object_id") % 2 == 0).alias("even"), F.lit("x").alias("extra"))
    rows.write.option("header", True).csv(f"{at}/csv")
    rows.write.format("xml").option("rowTag", "record").option("rootTag", "records").save(f"{at}/xml")
    rows.write.parquet(f"{at}/parquet")
    parts = [R.read_records(spark, f"{at}/{f}", f, ["channel_id", "sensor_type", "even"], most=10_000_000).select(F.lit(f).alias("format"), "*") for f in ("csv", "xml", "parquet")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


RAW = ", ro AS (SELECT CASE WHEN object_id % 10 = 7 THEN '' WHEN object_id % 10 = 8 THEN 'x' || object_id ELSE ' ' || object_id END AS object_id, CASE WHEN object_id % 5 = 0 THEN '' WHEN object_id % 5 = 1 THEN 'high' ELSE '2' END AS level, CASE WHEN object_id % 4 = 0 THEN NULL WHEN object_id % 4 = 1 THEN '1.5' ELSE CAST(parent_id AS VARCHAR) END AS parent_id, '' AS kind, object_name AS name FROM objects)"


@query(f"{RAW} SELECT try_cast(trim(object_id) AS BIGINT) AS object_id, CASE WHEN level = '2' THEN 2 END AS level, CASE WHEN parent_id <> '1.5' THEN CAST(parent_id AS INTEGER) END AS parent_id, CAST(NULL AS VARCHAR) AS kind, name, CASE WHEN trim(object_id) = '' THEN 'empty_id' WHEN try_cast(trim(object_id) AS BIGINT) IS NULL THEN 'invalid_id' WHEN level = 'high' THEN 'invalid_level' WHEN parent_id = '1.5' THEN 'invalid_parent' END AS error FROM ro")
def object_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """An object catalogue of text with optional numbers, some of them broken"""
    o = F.col("object_id")
    raw = B.objects(spark, d).select(F.when(o % 10 == 7, "").when(o % 10 == 8, F.concat(F.lit("x"), o.cast("string"))).otherwise(F.concat(F.lit(" "), o.cast("string"))).alias("object_id"), F.when(o % 5 == 0, "").when(o % 5 == 1, "high").otherwise("2").alias("level"), F.when(o % 4 == 1, "1.5").when(o % 4 != 0, F.col("parent_id").cast("string")).alias("parent_id"), F.lit("").alias("kind"), F.col("object_name").alias("name"))
    return R.object_catalogue(raw)


@query("SELECT year(event_time) AS y, count(*) AS rows, CAST(1 AS BIGINT) AS files, true AS in_order FROM journal GROUP BY 1")
def exported_journal(spark: SparkSession, d: str) -> DataFrame:
    """One file for each calendar year, in the order of time"""
    at = scratch(spark)
    R.export_journal(B.journal(spark, d).select("event_id", "channel_id", "event_time", "alarm"), at)
    # Line order inside a file: the number that rows get as they are read.
    rows = spark.read.option("header", True).schema("event_id long, channel_id long, event_time timestamp_ntz, alarm boolean, y int").csv(at).select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    marks = rows.groupBy("y", "file", F.floor(F.col("line") / 1000).alias("block")).agg(F.count("*").alias("n"), F.min("event_time").alias("a"), F.max("event_time").alias("z"), F.min("line").alias("line"))
    order = Window.partitionBy("file").orderBy("line")
    marks = marks.withColumn("fine", F.coalesce(F.col("a") >= F.lag("z").over(order), F.lit(True)))
    return marks.groupBy("y").agg(F.sum("n").alias("rows"), F.count_distinct("file").alias("files"), F.bool_and("fine").alias("in_order"))


@query("SELECT channel_id, sensor_type, sensor_name, object_id FROM channels")
def exported_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """S16"""
    at = scratch(spark)
    channels = B.channels(spark, d)
    R.export_catalogue(channels, at)
    return spark.read.option("header", True).schema(channels.schema).csv(at)


@query("SELECT CAST(channel_id % 4 AS INTEGER) AS channel_group, 2024 AS d_year, count(*) AS rows, count(DISTINCT channel_id) AS channels, max(day) AS last_day FROM (SELECT DISTINCT channel_id, CAST(event_time AS DATE) AS day FROM journal) GROUP BY 1")
def panel_sink(spark: SparkSession, d: str) -> DataFrame:
    """A panel written by year and group of channels"""
    at = scratch(spark)
    R.write_panel(B.journal(spark, d).select("channel_id", F.to_date("event_time").alias("day")).distinct(), at, groups=4)
    return spark.read.parquet(at).groupBy("channel_group", "d_year").agg(F.count("*").alias("rows"), F.count_distinct("channel_id").alias("channels"), F.max("day").alias("last_day"))


@query(", li AS (SELECT DISTINCT sha256(value_state || ':' || sha256(props)) AS file_key, min(event_id) AS id FROM journal GROUP BY 1) SELECT file_key FROM li WHERE id % 3 <> 0")
def import_registry(spark: SparkSession, d: str) -> DataFrame:
    """Contents by kind; a third was completed, a third failed and comes again, as does what is new"""
    j = B.journal(spark, d)
    listing = j.select(F.col("event_id").cast("string").alias("path"), F.col("value_state").alias("kind"), F.encode("props", "UTF-8").alias("content"))
    key = F.sha2(F.concat("value_state", F.lit(":"), F.sha2("props", 256)), 256)
    known = j.groupBy(key.alias("file_key")).agg(F.min("event_id").alias("id"))
    done = known.where("id % 3 < 2").select("file_key", F.when(F.col("id") % 3 == 0, "completed").otherwise("failed").alias("status"))
    return R.new_files(listing, done).select("file_key")


EQ = ", ms AS (SELECT event_id AS id, event_time AS seen, channel_id + CASE WHEN event_id % 4 = 0 THEN 5000000 ELSE 0 END AS channel_id, CASE WHEN event_id % 9 > 0 THEN CASE WHEN event_id % 50 = 1 THEN object_id + 1 ELSE object_id END END AS object_id, CASE WHEN event_id % 20 > 0 THEN value_state || event_id END AS name, CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 360 - 180 AS DOUBLE) END AS longitude, CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 180 - 90 AS DOUBLE) END AS latitude FROM journal JOIN channels USING (channel_id)), mh AS (SELECT ms.*, c.object_id AS held FROM ms LEFT JOIN channels c ON c.channel_id = ms.channel_id), mv AS (SELECT *, CASE WHEN object_id IS NULL OR name IS NULL THEN 'incomplete' WHEN coalesce(held, first_value(CASE WHEN name IS NOT NULL THEN object_id END IGNORE NULLS) OVER (PARTITION BY channel_id ORDER BY seen, id ROWS UNBOUNDED PRECEDING)) <> object_id THEN 'reassigned' ELSE 'accepted' END AS verdict FROM mh)"


def equipment_of(spark: SparkSession, d: str) -> DataFrame:
    e, o = F.col("event_id"), F.col("object_id")
    rows = B.journal(spark, d).join(B.channels(spark, d).select("channel_id", "object_id"), "channel_id")
    messages = rows.select(e.alias("id"), F.col("event_time").alias("seen"), (F.col("channel_id") + F.when(e % 4 == 0, 5000000).otherwise(0)).alias("channel_id"), F.when(e % 9 > 0, F.when(e % 50 == 1, o + 1).otherwise(o)).alias("object_id"), F.when(e % 20 > 0, F.concat("value_state", e.cast("string"))).alias("name"), F.when(e % 7 == 0, (e % 360 - 180).cast("double")).alias("longitude"), F.when(e % 7 == 0, (e % 180 - 90).cast("double")).alias("latitude"))
    return R.equipment_verdicts(messages, B.channels(spark, d))


@query(f"{EQ} SELECT id, channel_id, verdict FROM mv")
def equipment_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A message may not move a channel to another object"""
    return equipment_of(spark, d).select("id", "channel_id", "verdict")


@query(f"{EQ}, nw AS (SELECT channel_id, arg_max(object_id, (seen, id)) AS object_id, arg_max(name, (seen, id)) AS name FROM mv WHERE verdict = 'accepted' GROUP BY 1) SELECT coalesce(c.channel_id, nw.channel_id) AS channel_id, coalesce(nw.object_id, c.object_id) AS object_id, coalesce(nw.name, c.sensor_name) AS name FROM channels c FULL JOIN nw ON c.channel_id = nw.channel_id")
def equipment_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue after the accepted messages"""
    return R.upsert_equipment(B.channels(spark, d).withColumnRenamed("sensor_name", "name"), equipment_of(spark, d))


@query(f"{EQ}, nw AS (SELECT object_id, arg_max(name, (seen, id)) AS name FROM mv WHERE verdict = 'accepted' GROUP BY 1) SELECT coalesce(o.object_id, nw.object_id) AS object_id, coalesce(nw.name, o.object_name) AS name FROM objects o FULL JOIN nw ON o.object_id = nw.object_id")
def equipment_objects(spark: SparkSession, d: str) -> DataFrame:
    """Names of objects after the accepted messages"""
    return R.upsert_equipment_objects(B.objects(spark, d).withColumnRenamed("object_name", "name"), equipment_of(spark, d))


@query(f"{EQ}, nw AS (SELECT object_id, arg_max(longitude, (seen, id)) AS longitude, arg_max(latitude, (seen, id)) AS latitude FROM mv WHERE verdict = 'accepted' AND longitude IS NOT NULL GROUP BY 1), ol AS (SELECT object_id, CAST(object_id AS DOUBLE) AS longitude, CAST(-object_id AS DOUBLE) AS latitude FROM objects) SELECT coalesce(ol.object_id, nw.object_id) AS object_id, coalesce(nw.longitude, ol.longitude) AS longitude, coalesce(nw.latitude, ol.latitude) AS latitude FROM ol FULL JOIN nw ON ol.object_id = nw.object_id")
def equipment_locations(spark: SparkSession, d: str) -> DataFrame:
    """Places of objects after the accepted messages"""
    held = B.objects(spark, d).select("object_id", F.col("object_id").cast("double").alias("longitude"), (-F.col("object_id")).cast("double").alias("latitude"))
    return R.upsert_locations(held, equipment_of(spark, d))
