"""Latest states, alarms, object boards, searches and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order. Only the top row of each task goes into the shuffle."""
    by = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def latest_events(journal: DataFrame) -> DataFrame:
    """Latest event of each channel: by time, unknown times last, then by id."""
    return latest_per_key(journal, "channel_id", F.desc_nulls_last("event_time"), F.desc("event_id"))


def enriched(events: DataFrame, channels: DataFrame, objects: DataFrame, how: str = "left") -> DataFrame:
    """Events with channel and object columns; catalogues are joined as the optimiser sees fit."""
    return events.join(channels, "channel_id", how).join(objects, "object_id", "left")


def active_alarms(journal: DataFrame, channels: DataFrame, objects: DataFrame, limit: int | None = None) -> DataFrame:
    """Channels whose latest event is an alarm, newest first."""
    rows = enriched(latest_events(journal).where("alarm"), channels, objects, "inner")
    return top(rows, limit, F.desc_nulls_last("event_time"), F.desc("event_id")) if limit else rows


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows with their position; the sort behind it is a distributed top-n."""
    first = rows.orderBy(*order).limit(n)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def page(rows: DataFrame, offset: int, size: int, *order: Column) -> DataFrame:
    """One page with has_more, found by reading one row beyond it."""
    some = rows.orderBy(*order).offset(offset).limit(size + 1)
    by = Window.orderBy(*order)
    numbered = some.withColumn("position", F.row_number().over(by)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size)
    return numbered.where(F.col("position") <= size)


def keyset_page(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    return rows.where(F.col(key) > after).orderBy(key).limit(size)


def object_board(journal: DataFrame, channels: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects with channels, channels with data, channels in alarm, last event and status."""
    latest = latest_events(journal).select("channel_id", "event_time", "alarm")
    rows = objects.join(channels, "object_id").join(latest, "channel_id", "left")
    board = rows.groupBy("object_id", "object_name").agg(F.count("*").alias("sensors"), F.count("event_time").alias("sensors_with_data"), F.count_if(F.col("alarm")).alias("alarm_sensors"), F.max("event_time").alias("last_event"))
    status = F.when(F.col("alarm_sensors") > 0, "alarm").when(F.col("sensors_with_data") > 0, "normal").otherwise("unknown")
    return board.withColumn("status", status)


def alarm_filter(state: str) -> Column:
    """all, alarm, normal or unknown."""
    alarm = F.col("alarm")
    return {"all": F.lit(True), "alarm": alarm.eqNullSafe(True), "normal": alarm.eqNullSafe(False), "unknown": alarm.isNull()}[state]


def name_or_id(query: str, names: list[str], key: str) -> Column:
    """Names that contain the text in any case, or the exact id where the text is a number of at most 18 digits."""
    out = F.lit(False)
    for n in names:
        out = out | F.col(n).ilike(f"%{query}%")
    return out | (F.col(key) == int(query)) if query.isdecimal() and len(query) <= 18 else out


def value_search(query: str) -> Column:
    """Raw value, state or event id that contains the text."""
    return F.col("value_state").ilike(f"%{query}%") | F.col("value_numeric").cast("string").ilike(f"%{query}%") | F.col("event_id").cast("string").ilike(f"%{query}%")


def history(journal: DataFrame, channel_id: int, limit: int) -> DataFrame:
    """The last events of a channel in the order of time."""
    last = journal.where(F.col("channel_id") == channel_id).orderBy(F.desc_nulls_last("event_time"), F.desc("event_id")).limit(limit)
    return last.withColumn("position", F.row_number().over(Window.orderBy(F.asc_nulls_first("event_time"), "event_id")))


def daily_counts(journal: DataFrame) -> DataFrame:
    """Observations and alarm observations of each day."""
    return journal.groupBy(F.to_date("event_time").alias("day")).agg(F.count("*").alias("observations"), F.count_if(F.col("alarm")).alias("alarms"))


def unread(notices: DataFrame, read: DataFrame, events: DataFrame) -> DataFrame:
    """Notices that nobody has read; those of observed alarms with their event's channel."""
    fresh = notices.join(read, "notice_id", "left_anti")
    seen = events.select(F.col("event_id").alias("ref"), F.lit("observed_alarm").alias("kind"), "channel_id")
    return fresh.join(seen, ["kind", "ref"], "left")


def sensor_board(journal: DataFrame, channels: DataFrame, scores: DataFrame, object_id: int) -> DataFrame:
    """Channels of an object with latest state and latest score: alarms first, then by score, time and id."""
    own = channels.where(F.col("object_id") == object_id)
    state = latest_events(journal.join(own.select("channel_id"), "channel_id", "left_semi")).select("channel_id", "event_time", "alarm", "value_state")
    score = latest_per_key(scores.join(own.select("channel_id"), "channel_id", "left_semi"), "channel_id", F.desc("as_of_date"), F.desc("id")).select("channel_id", "as_of_date", "score")
    rows = own.join(state, "channel_id", "left").join(score, "channel_id", "left")
    order = (F.desc(F.coalesce(F.col("alarm"), F.lit(False))), F.desc(F.coalesce(F.col("score"), F.lit(-1.0))), F.desc_nulls_last("event_time"), F.asc("channel_id"))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("object_id").orderBy(*order)))


def request_history(requests: DataFrame) -> DataFrame:
    """Each request with the status and time of the one before on its channel, and whether that change is allowed.

    Allowed: a first request, an unchanged status, and any status after P or O; F is final."""
    by = Window.partitionBy("channel_id").orderBy("created_at", "request_id")
    rows = requests.withColumn("previous_status", F.lag("status").over(by)).withColumn("previous_at", F.lag("created_at").over(by))
    allowed = F.col("previous_status").isNull() | (F.col("previous_status") == F.col("status")) | F.col("previous_status").isin("O", "P")
    return rows.withColumn("allowed", allowed)


def repair_summary(requests: DataFrame, channels: DataFrame) -> DataFrame:
    """Requests of each object and status, and the newest finished one."""
    rows = requests.join(channels.select("channel_id", "object_id"), "channel_id")
    return rows.groupBy("object_id", "status").agg(F.count("*").alias("requests"), F.max(F.when(F.col("status") == "F", F.col("created_at"))).alias("last_completed"))
