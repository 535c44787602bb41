"""Value classes, failure rules, snapshots, gates and rule scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import scalars as S
from vigil.operators.panel import labelled

#: A text that is a date and time in day-first order.
DATE_TEXT = r"^\d{2}\.\d{2}\.\d{4} \d{1,2}:\d{2}:\d{2}$"


def value_class(raw: Column, time: Column, is_gas: Column, technical: list[float], text_classes: dict[str, str], low: float, high: float) -> Column:
    """The class of a raw value, by the first rule that holds: technical code, gas out of range, numeric, clock reset
    to 1970, the event's own time within five seconds, another date, empty, a known text, unknown."""
    text, number = S.empty_to_null(raw), S.parse_number(raw)
    stamp = F.when(text.rlike(DATE_TEXT), F.try_to_timestamp(text, F.lit("dd.MM.yyyy H:mm:ss")).cast("timestamp_ntz"))
    # Names of classes, and the text of a clock that was reset, are fixed values of the format.
    known = F.coalesce(*(F.when(text == k, F.lit(v)) for k, v in text_classes.items()), F.lit("unknown_value"))
    return (
        F.when(number.isin(*technical), "tech_value").when(is_gas & ((number < low) | (number > high)), "gas_out_of_range").when(number.isNotNull(), "numeric")
        .when(text.startswith("01.01.1970"), "clock_1970").when(F.abs(F.timestamp_diff("SECOND", stamp, time)) <= 5, "dup_timestamp").when(stamp.isNotNull(), "date_other")
        .when(text.isNull(), "empty_value").otherwise(known)
    )


def failure(state: Column, sensor_type: Column, default: tuple[str, ...], by_type: dict[str, tuple[str, ...]]) -> Column:
    """Whether a state is a failure: the list of its sensor type, else the default one; unknown states aren't."""
    out = F.when(F.lit(False), F.lit(False))
    for t, states in by_type.items():
        out = out.when(sensor_type == t, state.isin(*states))
    return F.coalesce(out.otherwise(state.isin(*default)), F.lit(False))


def timed(events: DataFrame) -> DataFrame:
    """Events with a time."""
    return events.where(F.col("event_time").isNotNull())


def snapshot(events: DataFrame, until: Column, days: int, most: int) -> DataFrame:
    """The events of the last `days` days before `until`; raises if they are more than `most`."""
    rows = events.where((F.col("event_time") > until - F.make_dt_interval(days=F.lit(days))) & (F.col("event_time") <= until))
    if rows.select(F.lit(1)).limit(most + 1).count() > most:
        raise ValueError(f"the snapshot has more than {most} rows")
    return rows


def gas_seconds(events: DataFrame, channels: DataFrame, reading: Column) -> DataFrame:
    """Least and largest reading of each channel and second; other channels go before anything is computed."""
    own = events.join(channels.select("channel_id"), "channel_id", "left_semi").where(reading)
    cells = own.groupBy("channel_id", F.date_trunc("second", "event_time").cast("timestamp_ntz").alias("t")).agg(F.min("value_numeric").alias("low"), F.max("value_numeric").alias("high"))
    return cells.join(channels.select("channel_id", "object_id"), "channel_id")


def linked_decisions(scores: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """scores with the last decision (by id) on all the keys."""
    last = decisions.groupBy(*keys).agg(F.max_by("decision", "id").alias("decision"))
    return scores.join(last, keys, "left")


def last_known(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last value of each column that isn't null, for each key; order ends with a column that tells ties apart."""
    return rows.groupBy(key).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(v) for v in values))


def run_summary(rows: DataFrame) -> DataFrame:
    """Rows, scored and abstained ones, channels, mean score and newest day of a run."""
    return rows.agg(F.count("*").alias("rows"), F.count("score").alias("scored"), F.count_if(F.col("score").isNull()).alias("abstained"), F.count_distinct("channel_id").alias("channels"), F.avg("score").alias("mean_score"), F.max("day").alias("newest_day"))


def closed_day(journal: DataFrame, day: str, today: str, covered_until: str) -> DataFrame:
    """One row: whether a day may be scored: it is over, the marker covers it, and it has rows."""
    d = F.lit(day).cast("date")
    rows = journal.agg(F.count_if(F.to_date("event_time") == d).alias("rows"), F.max(F.to_date("event_time")).alias("newest"))
    over, covered = d < F.lit(today).cast("date"), d <= F.lit(covered_until).cast("date")
    reason = F.when(~over, "day_not_over").when(~covered, "not_covered").when(F.col("rows") == 0, "no_rows").otherwise("closed")
    return rows.select("rows", "newest", reason.alias("state"))


def technical_label(panel: DataFrame, clean: Column, measured: Column, later: Column, later_any: Column, inside: Column) -> DataFrame:
    """Label of technical values in the window after clean days, with its reason."""
    label, reason = labelled([(measured == 0, None, "no_measurements"), (clean > 0, None, "recent_tech_value"), (~inside, None, "window_beyond_data"), (later > 0, 1, "positive"), (later_any > 0, 0, "negative")], "unobserved_window")
    return panel.withColumns({"target_tech": label, "reason_tech": reason})


def without_next_day(panel: DataFrame, label: str, next_day: Column) -> DataFrame:
    """The label without rows whose next day already fails, and what became of each row."""
    gone = F.coalesce(next_day, F.lit(False)) & F.col(label).isNotNull()
    return panel.withColumns({"label_v2": F.when(~gone, F.col(label)), "excluded": gone})
