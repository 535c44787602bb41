"""Channel-day panels: causal features up to day D and labels of later days with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators.states import Stream, day_range, seconds

Branch = tuple[Column, int | None, str]


def labelled(branches: list[Branch], otherwise: str) -> tuple[Column, Column]:
    """(label, reason) from one ordered list of branches, so that both always follow the same one."""
    label, reason = F.when(branches[0][0], F.lit(branches[0][1]).cast("int")), F.when(branches[0][0], branches[0][2])
    for condition, value, name in branches[1:]:
        label, reason = label.when(condition, F.lit(value).cast("int")), reason.when(condition, name)
    return label, reason.otherwise(otherwise)


def activity_grid(days: DataFrame, lookback: int, data_end: Column) -> DataFrame:
    """Every (channel, day) with an event in the last `lookback` days, up to the end of the data."""
    later = days.select("channel_id", F.explode(F.sequence("day", F.date_add("day", lookback - 1))).alias("day"))
    return later.where(F.col("day") <= data_end).distinct()


def shifted(facts: DataFrame, offset: int, columns: list[str]) -> DataFrame:
    """Facts of day X as columns name_d<offset> of day X - offset."""
    return facts.select("channel_id", F.date_sub("day", offset).alias("day"), *(F.col(c).alias(f"{c}_d{offset}") for c in columns))


def _moments(reading: Column) -> dict[str, Column]:
    """Mergeable parts of the statistics of readings: count, sum, sum of squares, extremes."""
    v = F.when(reading, F.col("value_numeric"))
    return {"num_n": F.count(v), "num_sum": F.sum(v), "num_sq": F.sum(v * v), "num_min": F.min(v), "num_max": F.max(v)}


def _runs(state: Column, was: Column, after: Column, t: Column, next_t: Column, tau_seconds: float) -> dict[str, Column]:
    """What one run of a known state counts as, by the runs on both sides of it."""
    strict = (state == "F") & F.coalesce(was == "O", F.lit(False))
    exact = F.coalesce(after == "O", F.lit(False))
    long = F.coalesce(seconds(t, next_t) >= tau_seconds, F.lit(False))
    return {"link_strict": strict, "link_ambiguous": (state == "F") & ~strict, "link_sustained": strict & exact & long, "link_transient": strict & exact & ~long, "link_censored": strict & ~exact, "link_blocks": state == "A"}


def _day_pieces(events: DataFrame, stream: Stream, reading: Column, threshold: float, tau_seconds: float, classes: list[str], grain: str) -> DataFrame:
    """One row for each channel and day with events: sums, and what the days around need to know of it.

    A piece of a channel is a day of it: events are shuffled by both, so a busy channel is dealt over its days. What can be
    told inside the day is counted; the first and last run of a state, the first and last cell with readings are kept as they are."""
    v, by = F.col("value_numeric"), Window.partitionBy("channel_id", "day").orderBy("t")
    has = lambda values: F.bool_or(F.coalesce(F.col("value_state").isin(*values), F.lit(False)))
    own = events.select("channel_id", "event_time", "alarm", "value_numeric", "value_state", F.to_date("event_time").alias("day")).repartition("channel_id", "day")
    cell = own.groupBy("channel_id", "day", F.date_trunc(grain, "event_time").cast("timestamp_ntz").alias("t")).agg(
        F.count("*").alias("n_events"), F.count_if(F.col("alarm")).alias("n_alarm"), *(F.count_if(F.col("value_state") == c).alias(f"n_{c}") for c in classes),
        *(c.alias(n) for n, c in _moments(reading).items()), F.count_if(reading & (v >= threshold)).alias("num_above"), F.max(F.when(reading, F.struct("event_time", "value_numeric"))).alias("last"),
        has(stream.fault).alias("f"), has(stream.ok).alias("o"), has(stream.unknown).alias("u"),
    )
    f, o, u = F.col("f"), F.col("o"), F.col("u")
    doubtful = (f & o) | (u if stream.unknown_wins else u & ~f & ~o)
    known, upto = F.when(F.col("num_n") > 0, F.struct("t", "num_min", "num_max")), by.rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.withColumns({"state": F.when(doubtful, "A").when(f, "F").when(o, "O"), "known": known})
    cell = cell.withColumns({"before": F.last("known", ignorenulls=True).over(upto), "held": F.last("state", ignorenulls=True).over(upto)})
    cell = cell.withColumn("begins", F.coalesce(~F.col("state").eqNullSafe(F.col("held")) & F.col("state").isNotNull(), F.lit(False)))
    runs = Window.partitionBy("channel_id", "day", "begins").orderBy("t")
    cell = cell.withColumns({"was": F.lag("state").over(runs), "after": F.lead("state").over(runs), "next_t": F.lead("t").over(runs)})
    inner = F.col("begins") & F.col("was").isNotNull() & F.col("after").isNotNull()
    crossed, unknown = _crossed(F.col("known"), F.col("before"), threshold)
    counted = {n: F.count_if(inner & c) for n, c in _runs(F.col("state"), F.col("was"), F.col("after"), F.col("t"), F.col("next_t"), tau_seconds).items()}
    run = F.when(F.col("begins"), F.struct("t", "state", "was", "after", "next_t"))
    sums = ["n_events", "n_alarm", *(f"n_{c}" for c in classes), "num_n", "num_sum", "num_sq", "num_above"]
    return cell.groupBy("channel_id", "day").agg(
        *(F.sum(c).alias(c) for c in sums), F.min("num_min").alias("num_min"), F.max("num_max").alias("num_max"), F.max("last")["value_numeric"].alias("num_last"), *(c.alias(n) for n, c in counted.items()),
        F.count_if(F.col("before").isNotNull() & crossed).alias("crossed"), F.count_if(F.col("before").isNotNull() & unknown).alias("cross_unknown"),
        F.min("known").alias("first_known"), F.max("known").alias("final"), F.min(run).alias("first_run"), F.max(run).alias("last_run"),
    )


def _crossed(cell: Column, before: Column, threshold: float) -> tuple[Column, Column]:
    """Whether a cell of readings crosses the threshold after the one before, and whether that can't be told."""
    straddles = lambda a, b: (a < threshold) & (b >= threshold)
    low, high = cell["num_min"], cell["num_max"]
    doubt = before["num_max"].isNull() | straddles(low, high) | ((low >= threshold) & F.coalesce(straddles(before["num_min"], before["num_max"]), F.lit(False)))
    return F.coalesce((low >= threshold) & (before["num_max"] < threshold), F.lit(False)), F.coalesce((high >= threshold) & doubt, F.lit(False))


def _linked(pieces: DataFrame, threshold: float, tau_seconds: float) -> DataFrame:
    """Pieces with the counts of their first and last runs and cells, by what other days of the channel end or begin with.

    One small row for each day is all that is shuffled here: a state carried into a day, a reading carried into it, and
    the change that follows it. The first run of a day is no change where the same state is carried in; then the second one is its first change."""
    by, back = Window.partitionBy("channel_id").orderBy("day"), Window.partitionBy("channel_id").orderBy(F.desc("day"))
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    first, last = F.col("first_run"), F.col("last_run")
    rows = pieces.repartition("channel_id").withColumns({"state_in": F.last(last["state"], ignorenulls=True).over(upto), "known_in": F.last("final", ignorenulls=True).over(upto), "next_day": F.lead("day").over(by)})
    changes = first.isNotNull() & ~first["state"].eqNullSafe(F.col("state_in"))
    change = F.when(changes, F.struct(first["t"].alias("t"), first["state"].alias("state"))).when(first["after"].isNotNull(), F.struct(first["next_t"].alias("t"), first["after"].alias("state")))
    rows = rows.withColumns({"changes": changes, "change": change})
    rows = rows.withColumn("follows", F.last("change", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    follows, more = F.col("follows"), F.coalesce(last["was"].isNotNull(), F.lit(False))
    outer = _runs(first["state"], F.col("state_in"), F.coalesce(first["after"], follows["state"]), first["t"], F.coalesce(first["next_t"], follows["t"]), tau_seconds)
    end = _runs(last["state"], last["was"], follows["state"], last["t"], follows["t"], tau_seconds)
    add = lambda name, *conditions: F.col(name) + sum((F.coalesce(c, F.lit(False)).cast("long") for c in conditions), F.lit(0))
    crossed, unknown = _crossed(F.col("first_known"), F.col("known_in"), threshold)
    out = {n: add(n, F.col("changes") & outer[n], more & end[n]) for n in outer} | {"crossed": add("crossed", crossed), "cross_unknown": add("cross_unknown", F.col("first_known").isNotNull() & unknown)}
    out["point"] = F.when(F.col("changes") | more, F.struct(last["t"].alias("t"), last["state"].alias("state")))
    return rows.withColumns(out).drop("first_run", "last_run", "first_known", "state_in", "known_in", "changes", "change", "follows")


def event_panel(events: DataFrame, stream: Stream, reading: Column, threshold: float, tau_seconds: float, data_end: Column, classes: list[str], grain: str, lookback: int = 7, windows: tuple[int, ...] = (3, 7)) -> DataFrame:
    """One row for each channel and grid day: counters, rolling sums, last reading, state at the day's end, onset
    and crossing labels of day D+2 with reasons, and competing outcomes of D+1. data_end: last time of the data. grain: at most a day.

    A scan in pieces: events are shuffled once, by channel and day, and summed there to one row, which tells what other days need
    to know of its ends; only these rows are shuffled again, by channel, and linked. Grid days come from the gap to the channel's next
    day with events, and later days are frames over the grid, so nothing is joined."""
    end_day = F.to_date(data_end)
    days = _linked(_day_pieces(events, stream, reading, threshold, tau_seconds, classes, grain), threshold, tau_seconds).where(F.col("day") <= end_day)
    counters = [c for c in days.columns if c not in ("channel_id", "day", "next_day", "num_sum", "num_sq", "num_min", "num_max", "num_last", "final", "point")]
    own = F.struct(*(c for c in days.columns if c not in ("channel_id", "day", "next_day")))
    until = F.least(F.date_add("day", lookback - 1), F.date_sub("next_day", 1), end_day)
    panel = days.select("channel_id", F.posexplode(F.sequence("day", until)).alias("k", "grid_day"), own.alias("own")).select("channel_id", F.col("grid_day").alias("day"), F.when(F.col("k") == 0, F.col("own")).alias("own"))
    counts = F.struct(*(F.coalesce(F.col(f"own.{c}"), F.lit(0)).alias(c) for c in counters))
    # One day of the grid at most has each distance, so a frame of one day holds that day or nothing.
    later = Window.partitionBy("channel_id").orderBy(F.unix_date("day"))
    upto = later.rowsBetween(Window.unboundedPreceding, 0)
    panel = panel.withColumn("counts", counts)
    n = F.col("own.num_n")
    mean = F.col("own.num_sum") / F.nullif(n, F.lit(0))
    deviation = F.when(n > 1, F.sqrt(F.greatest((F.col("own.num_sq") - F.col("own.num_sum") * mean) / (n - 1), F.lit(0.0))))
    mixed = F.coalesce((F.col("own.final.num_min") < threshold) & (F.col("own.final.num_max") >= threshold), F.lit(False))
    reading_kept = F.when(F.col("own.num_last").isNotNull(), F.struct(F.col("own.num_last").alias("num_last"), mixed.alias("mixed")))
    rolled = {f"f_{c}_{w}d": F.sum(f"counts.{c}").over(day_range(w, "channel_id")) for w in windows for c in ("n_events", "n_alarm", "num_n", "link_strict", "crossed")}
    rolled |= {f"f_num_max_{w}d": F.max("own.num_max").over(day_range(w, "channel_id")) for w in windows}
    rolled |= {"kept": F.last(reading_kept, ignorenulls=True).over(upto), "point": F.last("own.point", ignorenulls=True).over(upto)}
    rolled |= {f"day{k}": F.max("counts").over(later.rangeBetween(k, k)) for k in (1, 2, 3)}
    ahead = {1: ["link_strict", "link_ambiguous", "crossed"], 2: ["n_events", "link_strict", "link_ambiguous", "link_sustained", "link_censored", "link_transient", "link_blocks", "num_n", "crossed", "cross_unknown"], 3: ["n_events"]}
    panel = panel.withColumns(rolled).select(
        "channel_id", "day", *(F.col(f"counts.{c}").alias(c) for c in counters), *(F.col(f"own.{c}").alias(c) for c in ("num_min", "num_max", "num_last")), mean.alias("num_mean"), deviation.alias("num_std"), mixed.alias("num_last_mixed"),
        *(c for c in rolled if c.startswith("f_")), *(F.coalesce(F.col(f"day{k}.{c}"), F.lit(0)).alias(f"{c}_d{k}") for k, names in ahead.items() for c in names),
        F.col("kept.num_last").alias("f_num_last"), F.coalesce("kept.mixed", F.lit(False)).alias("f_last_mixed"), F.col("point.state").alias("link_now"), F.col("point.t").alias("state_t"),
    )
    inside = F.date_add("day", 3) <= end_day
    observed = F.col("n_events_d2") + F.col("n_events_d3") > 0
    doubt = F.col("link_ambiguous_d2") + F.col("link_blocks_d2") > 0
    start: list[Branch] = [(F.col("link_now").isNull(), None, "no_state_history"), (F.col("link_now") != "O", None, "state_not_ok_at_D"), (~inside, None, "window_beyond_data")]
    onset_label = labelled([*start, (F.col("link_strict_d2") > 0, 1, "positive"), (doubt, None, "ambiguous_onset"), (observed, 0, "negative")], "unobserved_window")
    sustained = labelled([*start, (F.col("link_sustained_d2") > 0, 1, "positive"), (F.col("link_censored_d2") > 0, None, "censored_duration"), (doubt, None, "ambiguous_onset"), (observed & (F.col("link_transient_d2") > 0), 0, "negative_transient_only"), (observed, 0, "negative")], "unobserved_window")
    crossing = labelled([(F.col(f"f_num_n_{windows[-1]}d") == 0, None, "no_readings"), (F.col("f_last_mixed"), None, "ambiguous_last_reading_at_D"), (F.coalesce(F.col("f_num_last") >= threshold, F.lit(False)), None, "above_threshold_at_D"), (~inside, None, "window_beyond_data"), (F.col("crossed_d2") > 0, 1, "positive"), (F.col("cross_unknown_d2") > 0, None, "unknown_previous_reading"), (F.col("num_n_d2") > 0, 0, "negative")], "unobserved_window")
    return panel.withColumns({
        "target_onset": onset_label[0], "reason_onset": onset_label[1], "target_sustained": sustained[0], "reason_sustained": sustained[1], "target_crossing": crossing[0], "reason_crossing": crossing[1],
        "competing_onset_d1": F.col("link_strict_d1") + F.col("link_ambiguous_d1") > 0, "competing_crossing_d1": F.col("crossed_d1") > 0,
        "target_start": F.date_add("day", 2), "target_end": F.date_add("day", 3), "weekday": (F.weekday("day") + 1), "month": F.month("day"),
    })


def observed_panel(events: DataFrame, failure: Column, lead_days: int = 1, window_days: int = 1, clean_days: int = 0, latency_minutes: int = 0) -> DataFrame:
    """One row for each channel and observed day (by availability time): features, previous days, and labels that
    need every day of the window observed. Features are cut by availability, labels by event time."""
    available = F.col("event_time") + F.make_dt_interval(mins=F.lit(latency_minutes))
    rows = events.withColumns({"available": available, "day": F.to_date(available), "failed": F.coalesce(failure, F.lit(False))})
    order = F.struct("available", "event_time", "event_id")
    panel = rows.groupBy("channel_id", "day").agg(F.count("*").alias("n_events"), F.count_if(F.col("alarm")).alias("n_alarm"), F.count_if(F.col("failed")).alias("n_failed"), F.avg("value_numeric").alias("value_mean"), F.stddev_samp("value_numeric").alias("value_std"), F.max_by("value_numeric", order).alias("value_last"), F.max_by("failed", order).alias("failed_now"), F.max_by(F.coalesce("alarm", F.lit(False)), order).alias("alarm_now"), F.count_distinct("value_state").alias("n_states"))
    by = Window.partitionBy("channel_id").orderBy("day")
    last_failure = F.last(F.when(F.col("n_failed") > 0, F.col("day")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    panel = panel.withColumns({"gap_days": F.date_diff("day", F.lag("day").over(by)), "alarm_share": F.col("n_alarm") / F.col("n_events"), "days_since_failure": F.date_diff("day", last_failure), "observed_days": F.count("*").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    before = panel.select("channel_id", F.date_add("day", 1).alias("day"), F.col("n_events").alias("n_events_before"), F.col("alarm_share").alias("alarm_share_before"), F.col("value_last").alias("value_before"))
    actual = events.groupBy("channel_id", F.to_date("event_time").alias("day")).agg(F.count("*").alias("seen"), F.bool_or(F.coalesce(failure, F.lit(False))).alias("any_failure"), F.bool_or(F.coalesce("alarm", F.lit(False))).alias("any_alarm"))
    panel = panel.join(before, ["channel_id", "day"], "left")
    offsets = range(1 + lead_days, 1 + lead_days + window_days)
    for k in offsets:
        panel = panel.join(shifted(actual, k, ["seen", "any_failure", "any_alarm"]), ["channel_id", "day"], "left")
    every = lambda f: [f(k) for k in offsets]
    conjunction = F.lit(True)
    for k in offsets:
        conjunction = conjunction & F.col(f"seen_d{k}").isNotNull()
    any_of = lambda name: F.exists(F.array(*every(lambda k: F.coalesce(f"{name}_d{k}", F.lit(False)))), lambda x: x)
    first = F.array_min(F.array(*every(lambda k: F.when(F.col(f"any_failure_d{k}"), F.date_add("day", k)))))
    clean = F.col("days_since_failure").isNull() | (F.col("days_since_failure") >= clean_days) if clean_days else F.lit(True)
    fine = ~F.col("failed_now") & clean
    return panel.withColumns({"observed": conjunction, "target_failure": F.when(fine & conjunction, any_of("any_failure").cast("int")), "target_alarm": F.when(~F.col("alarm_now") & conjunction, any_of("any_alarm").cast("int")), "first_failure": first}).drop(*(f"{c}_d{k}" for k in offsets for c in ("seen", "any_failure", "any_alarm")))


def label_changes(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows whose label differs between two panels, nulls compared as values."""
    both = a.select(*keys, F.col(label).alias("a")).join(b.select(*keys, F.col(label).alias("b")), keys, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


#: Prefixes of columns that tell of the future (fixed names of the panels).
FUTURE = ("target_", "reason_", "competing_", "label_", "d_future")


def assert_leakage_safe(columns: list[str], features: list[str]) -> None:
    """Raise if a feature is missing, repeated, or tells of the future."""
    bad = [c for c in features if c.startswith(FUTURE) or c not in columns or c.endswith(("_d1", "_d2", "_d3"))]
    if bad or len(set(features)) < len(features):
        raise ValueError(f"not allowed as features: {bad or 'repeated names'}")
