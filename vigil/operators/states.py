"""Event classes, state cells, change points, episodes, daily aggregates and threshold crossings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def in_time():
    return Window.partitionBy("channel_id").orderBy("t")



@dataclass(frozen=True)
class Stream:
    """Classes of one state stream. unknown_wins: an unknown value makes the cell ambiguous even beside known ones."""

    fault: tuple[str, ...]
    ok: tuple[str, ...]
    unknown: tuple[str, ...]
    unknown_wins: bool = True


#: Streams of the driver's events: errors are faults, sign-ups unknown, all else is in order.
LINK = Stream(("error",), ("view", "click", "purchase"), ("signup",))
POWER = Stream(("error",), ("view", "click", "purchase"), ("signup",), unknown_wins=False)


def cells(events: DataFrame, streams: dict[str, Stream], grain: str = "second", value: str = "value_state") -> DataFrame:
    """One row for each channel and time cell: number of distinct values, and state and cause of each stream.

    Values of one cell have no order. Faults beside values in order are a conflict (A), unknown values are A,
    else F or O; null where the cell tells nothing of the stream."""
    has = lambda classes: F.bool_or(F.coalesce(F.col(value).isin(*classes), F.lit(False)))
    flags = [f(getattr(s, part)).alias(f"{n}_{part}") for n, s in streams.items() for part, f in (("fault", has), ("ok", has), ("unknown", has))]
    out = events.groupBy("channel_id", F.date_trunc(grain, "event_time").cast("timestamp_ntz").alias("t")).agg(F.count_distinct(value).alias("n_values"), *flags)
    for n, s in streams.items():
        f, o, u = (F.col(f"{n}_{part}") for part in ("fault", "ok", "unknown"))
        wins = u if s.unknown_wins else u & ~f & ~o
        out = out.withColumn(f"{n}_cause", F.when(f & o, "conflict").when(wins, "unknown"))
        out = out.withColumn(f"{n}_state", F.when(F.col(f"{n}_cause").isNotNull(), "A").when(f, "F").when(o, "O"))
        out = out.drop(f"{n}_fault", f"{n}_ok", f"{n}_unknown")
    return out


def change_points(cell: DataFrame, state: str) -> DataFrame:
    """channel_id, t, state: where a channel's known state differs from the one before."""
    known = cell.where(F.col(state).isNotNull()).select("channel_id", "t", F.col(state).alias("state"))
    return known.withColumn("before", F.lag("state").over(in_time())).where("before is null or before <> state").drop("before")


def seconds(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b).cast("double")


def episodes(points: DataFrame, data_end: Column, tau_seconds: float) -> DataFrame:
    """Fault blocks between change points.

    Onset is strict after O, else ambiguous; the end is exact if O follows, else a lower bound (data_end if
    nothing follows). sustained: 1 or 0 for exact ends by tau_seconds, null otherwise."""
    rows = points.select("channel_id", "t", "state", F.lag("state").over(in_time()).alias("before"), F.lead("state").over(in_time()).alias("after"), F.lead("t").over(in_time()).alias("next_t")).where("state = 'F'")
    rows = rows.select("channel_id", F.col("t").alias("onset_t"), F.when(F.col("before") == "O", "strict").otherwise("ambiguous").alias("onset_type"), F.coalesce(F.col("after") == "O", F.lit(False)).alias("exact"), F.coalesce("next_t", data_end).alias("end_t"))
    rows = rows.withColumn("duration_s", seconds(F.col("onset_t"), F.col("end_t")))
    return rows.withColumn("sustained", F.when(F.col("exact"), (F.col("duration_s") >= tau_seconds).cast("int")))


def onsets_by_day(episode: DataFrame, prefix: str) -> DataFrame:
    """Strict, ambiguous, sustained, transient and censored onsets of each channel and day."""
    strict = F.col("onset_type") == "strict"
    parts = {"strict": strict, "ambiguous": ~strict, "sustained": strict & (F.col("sustained") == 1), "transient": strict & (F.col("sustained") == 0), "censored": strict & F.col("sustained").isNull()}
    return episode.groupBy("channel_id", F.to_date("onset_t").alias("day")).agg(*(F.count_if(c).alias(f"{prefix}_{k}") for k, c in parts.items()))


def ended_by_day(episode: DataFrame, prefix: str) -> DataFrame:
    """Exactly ended long and short episodes of each channel and day of the end."""
    return episode.where("exact").groupBy("channel_id", F.to_date("end_t").alias("day")).agg(F.count_if(F.col("sustained") == 1).alias(f"{prefix}_long"), F.count_if(F.col("sustained") == 0).alias(f"{prefix}_short"))


def daily(events: DataFrame, classes: list[str], reading: Column, threshold: float, grain: str = "second") -> DataFrame:
    """Aggregates of each channel and day: class counters, statistics of readings, the last reading and whether the last cell straddles the threshold."""
    num = F.when(reading, F.col("value_numeric"))
    last = F.max_by(num, F.when(reading, F.struct("event_time", "value_numeric")))
    rows = events.withColumn("day", F.to_date("event_time")).withColumn("cell", F.date_trunc(grain, "event_time").cast("timestamp_ntz"))
    # The least and the largest reading of the last cell.
    low, high = (-F.max(F.when(reading, F.struct("cell", (-F.col("value_numeric")).alias("x"))))["x"], F.max(F.when(reading, F.struct("cell", F.col("value_numeric").alias("x"))))["x"])
    return rows.groupBy("channel_id", "day").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("alarm")).alias("n_alarm"), *(F.count_if(F.col("value_state") == c).alias(f"n_{c}") for c in classes),
        F.count(num).alias("num_n"), F.avg(num).alias("num_mean"), F.min(num).alias("num_min"), F.max(num).alias("num_max"), F.stddev_samp(num).alias("num_std"), last.alias("num_last"),
        F.count_if(reading & (F.col("value_numeric") >= threshold)).alias("num_above"), F.coalesce((low < threshold) & (high >= threshold), F.lit(False)).alias("num_last_mixed"),
    )


def crossings(readings: DataFrame, threshold: float, grain: str = "second") -> DataFrame:
    """channel_id, t, low, high, cross, cross_unknown for each cell of readings.

    cross: the whole cell is at or above the threshold and the whole cell before below it. cross_unknown:
    the cell reaches the threshold, but it straddles it, follows a straddling cell, or follows none."""
    cell = readings.groupBy("channel_id", F.date_trunc(grain, "event_time").cast("timestamp_ntz").alias("t")).agg(F.min("value_numeric").alias("low"), F.max("value_numeric").alias("high"))
    before_low, before_high = F.lag("low").over(in_time()), F.lag("high").over(in_time())
    straddles = lambda a, b: (a < threshold) & (b >= threshold)
    rows = cell.withColumns({"before_low": before_low, "before_high": before_high})
    cross = F.coalesce((F.col("low") >= threshold) & (F.col("before_high") < threshold), F.lit(False))
    doubt = F.col("before_high").isNull() | straddles(F.col("low"), F.col("high")) | ((F.col("low") >= threshold) & F.coalesce(straddles(F.col("before_low"), F.col("before_high")), F.lit(False)))
    return rows.select("channel_id", "t", "low", "high", cross.alias("cross"), ((F.col("high") >= threshold) & doubt).alias("cross_unknown"))


def asof_backward(probes: DataFrame, facts: DataFrame, key: str, probe_time: str, fact_time: str, values: list[str]) -> DataFrame:
    """probes with the values of the last fact of the key at or before their time: one shuffle by key, one sort, no join."""
    packed = F.struct(*values)
    left = probes.select("*", F.col(probe_time).alias("__t"), F.lit(1).alias("__probe"), F.lit(None).cast(facts.select(packed.alias("s")).schema["s"].dataType).alias("__fact"))
    right = facts.select(*(F.col(key) if c == key else F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probes.columns), F.col(fact_time).alias("__t"), F.lit(0).alias("__probe"), packed.alias("__fact"))
    by = Window.partitionBy(key).orderBy("__t", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__last", F.last("__fact", ignorenulls=True).over(by)).where("__probe = 1")
    return both.select(*probes.columns, *(F.col(f"__last.{v}").alias(v) for v in values))


def day_range(days: int, *partition: str, day: str = "day"):
    """A window over the last `days` calendar days, the row's own included."""
    return Window.partitionBy(*partition).orderBy(F.unix_date(day)).rangeBetween(-(days - 1), 0)
