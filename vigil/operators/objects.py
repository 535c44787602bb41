"""Object-day roll-ups, silence, maintenance windows, crossing shapes and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators.panel import labelled
from vigil.operators.ranks import percentiles


def family(sensor_type: Column, families: dict[str, tuple[str, ...]]) -> Column:
    """The family of a sensor type, `other` if none holds it."""
    out = F.lit("other")
    for name, types in families.items():
        out = F.when(sensor_type.isin(*types), name).otherwise(out)
    return out


def object_days(channel_days: DataFrame, families: dict[str, tuple[str, ...]]) -> DataFrame:
    """channel_days: channel_id, day, object_id, sensor_type, n_events, n_alarm. Sums, shares and, for each family,
    distinct alarming types and alarms."""
    rows = channel_days.withColumn("family", family(F.col("sensor_type"), families))
    parts = []
    for name in families:
        own = F.col("family") == name
        parts += [F.count_distinct(F.when(own & (F.col("n_alarm") > 0), F.col("sensor_type"))).alias(f"{name}_types"), F.coalesce(F.sum(F.when(own, F.col("n_alarm"))), F.lit(0)).alias(f"{name}_alarms")]
    out = rows.groupBy("object_id", "day").agg(F.count("*").alias("channels"), F.sum("n_events").alias("n_events"), F.sum("n_alarm").alias("n_alarm"), F.count_distinct("sensor_type").alias("types"), *parts)
    return out.withColumn("alarm_share", F.col("n_alarm") / F.col("n_events"))


def days_since(rows: DataFrame, key: str, event: Column, name: str) -> DataFrame:
    """Days since the last earlier day with the event."""
    before = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.date_diff("day", F.last(F.when(event, F.col("day")), ignorenulls=True).over(before)))


def corroboration(days: DataFrame, name: str, least: int = 2) -> DataFrame:
    """Label of day D: on D+2 at least `least` types of the family alarm on the object; null where D+2 isn't observed."""
    later = days.select("object_id", F.date_sub("day", 2).alias("day"), F.col(f"{name}_types").alias("then"))
    return days.join(later, ["object_id", "day"], "left").withColumn(f"target_{name}", (F.col("then") >= least).cast("int")).drop("then")


def dropout(channel_days: DataFrame, data_end: Column, silent: int = 3, within: int = 31) -> DataFrame:
    """Label of an observed day D: the channel is silent on D+2..D+1+silent while another channel of its object
    reports on each of these days, and returns within `within` days; 0 if it reports in the window."""
    by = Window.partitionBy("channel_id").orderBy("day")
    rows = channel_days.select("channel_id", "object_id", "day", F.lead("day", 1).over(by).alias("next1"), F.lead("day", 2).over(by).alias("next2"))
    # The next observation after D+1.
    rows = rows.withColumn("gap", F.date_diff(F.when(F.date_diff("next1", "day") >= 2, F.col("next1")).otherwise(F.col("next2")), "day"))
    active = channel_days.groupBy("object_id", "day").agg(F.count_distinct("channel_id").alias("peers"))
    for k in range(2, 2 + silent):
        rows = rows.join(active.select("object_id", F.date_sub("day", k).alias("day"), F.col("peers").alias(f"p{k}")), ["object_id", "day"], "left")
    peers = F.lit(True)
    for k in range(2, 2 + silent):
        peers = peers & F.coalesce(F.col(f"p{k}") >= 1, F.lit(False))
    inside = F.date_add("day", 1 + silent) <= data_end
    label, reason = labelled([(~inside, None, "window_beyond_data"), (F.col("gap") < 2 + silent, 0, "negative"), (~peers, None, "no_peer"), (F.col("gap") <= within, 1, "positive")], "no_return")
    return rows.withColumns({"target_dropout": label, "reason_dropout": reason}).select("channel_id", "object_id", "day", "target_dropout", "reason_dropout")


def silence_runs(days: DataFrame, key: str, least: int) -> DataFrame:
    """Runs of at least `least` days without data between two days with data; none before the first or after the last."""
    by = Window.partitionBy(key).orderBy("day")
    rows = days.select(key, "day").distinct().withColumn("next", F.lead("day").over(by))
    rows = rows.withColumn("length", F.date_diff("next", "day") - 1).where(F.col("length") >= least)
    return rows.select(key, F.date_add("day", 1).alias("start"), F.date_sub("next", 1).alias("end"), "length")


def flag_runs(days: DataFrame, key: str, flag: Column) -> DataFrame:
    """Gaps and islands: maximal runs of rows with one value of the flag, by day."""
    by = Window.partitionBy(key).orderBy("day")
    rows = days.withColumn("flag", flag)
    rows = rows.withColumn("turn", F.coalesce((F.col("flag") != F.lag("flag").over(by)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("turn").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "run", "flag").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("days")).drop("run")


def calendar(keys: DataFrame, first: Column, last: Column) -> DataFrame:
    """Every key on every day."""
    return keys.select("*", F.explode(F.sequence(first, last)).alias("day"))


def maintenance_context(events: DataFrame, runs: DataFrame, key: str, before: int = 3, after: int = 21) -> DataFrame:
    """events (key, day and others) with in_window (a run from `before` days before its start to `after` days
    after its end holds the day) and days_since_run. An equi join on the key with a range test."""
    near = events.select(key, "day").distinct().join(runs.select(key, "start", "end"), key)
    inside = (F.col("day") >= F.date_sub("start", before)) & (F.col("day") <= F.date_add("end", after))
    context = near.groupBy(key, "day").agg(F.bool_or(inside).alias("in_window"), F.max(F.when(F.col("end") < F.col("day"), F.col("end"))).alias("last_end"))
    out = events.join(context, [key, "day"], "left")
    return out.withColumns({"in_window": F.coalesce("in_window", F.lit(False)), "days_since_run": F.date_diff("day", "last_end")}).drop("last_end")


def window_days(runs: DataFrame, key: str, before: int = 3, after: int = 21) -> DataFrame:
    """The days around each run, once each."""
    return runs.select(key, F.explode(F.sequence(F.date_sub("start", before), F.date_add("end", after))).alias("day")).distinct()


def neighbours(crossed: DataFrame, before: str = "6 hours", after: str = "15 minutes") -> DataFrame:
    """crossed (channel_id, object_id, t) with the number of other channels of its object that cross from `before`
    before to `after` after it, both ends included.

    A crossing at u is seen from u - after to u + before. A channel's overlapping spans are one, so the channels that a time sees are the spans
    that have begun by then less those that are over: running sums of begins and ends over an object's times. No two crossings meet,
    so the work grows with them, however many an object has. Sums run inside an object's day, on top of those of its earlier days."""
    keys = [c for c in ("rep", "object_id") if c in crossed.columns]
    own = crossed.select(*keys, "channel_id", "t").where(F.col("object_id").isNotNull() & F.col("channel_id").isNotNull()).distinct()
    by = Window.partitionBy(*keys, "channel_id").orderBy("t")
    near = lambda a, b: F.coalesce(a + F.expr(f"interval {before}") + F.expr(f"interval {after}") >= b, F.lit(False))
    points = own.select(*keys, F.array(
        F.struct(F.col("t").alias("at"), F.lit(0).alias("step")),
        F.struct((F.col("t") - F.expr(f"interval {after}")).alias("at"), (~near(F.lag("t").over(by), F.col("t"))).cast("int").alias("step")),
        F.struct((F.col("t") + F.expr(f"interval {before}") + F.expr("interval 1 microsecond")).alias("at"), (-(~near(F.col("t"), F.lead("t").over(by))).cast("int")).alias("step")),
    ).alias("points"))
    steps = points.select(*keys, F.inline("points")).groupBy(*keys, "at").agg(F.sum("step").alias("step")).withColumn("day", F.to_date("at"))
    earlier = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = steps.groupBy(*keys, "day").agg(F.sum("step").alias("step")).select(*keys, "day", F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*keys, "day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # The crossing's own channel is always seen.
    seen = steps.withColumn("sum", F.sum("step").over(inside)).join(days, [*keys, "day"]).select(*keys, F.col("at").alias("t"), (F.col("sum") + F.col("base") - 1).alias("neighbours"))
    out = crossed.join(seen, [*keys, "t"], "left").withColumn("neighbours", F.when(F.col("channel_id").isNotNull(), F.col("neighbours")))
    return out.select(*crossed.columns, F.coalesce("neighbours", F.lit(0).cast("long")).alias("neighbours"))


def crossing_shapes(cell: DataFrame, threshold: float, low: float, peak_minutes: int, cap_minutes: int) -> DataFrame:
    """Crossings (rows of states.crossings with cross) with the peak within peak_minutes, minutes until the first cell
    below the threshold (cap_minutes and censored if none comes), and minutes since the last cell below `low`."""
    rows = cell.withColumn("s", F.unix_micros(F.col("t").cast("timestamp")))
    by, minute = Window.partitionBy("channel_id").orderBy("s"), 60_000_000
    rows = rows.withColumns({
        "peak": F.max("high").over(by.rangeBetween(0, peak_minutes * minute)),
        "below": F.min(F.when(F.col("low") < threshold, F.col("s"))).over(by.rangeBetween(1, cap_minutes * minute)),
        "calm": F.last(F.when(F.col("high") < low, F.col("s")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)),
    }).where("cross")
    return rows.select("channel_id", "t", "peak", F.coalesce((F.col("below") - F.col("s")) / minute, F.lit(float(cap_minutes))).alias("minutes_above"), F.col("below").isNull().alias("censored"), ((F.col("s") - F.col("calm")) / minute).alias("rise_minutes"))


def live_shapes(cell: DataFrame, threshold: float = 1.0, live: float = 15, fast: float = 5, recent: float = 10) -> DataFrame:
    """Crossings (rows of cell with cross) with what is known of their shape `live` minutes on, at decision_t.

    cell: channel_id, object_id, t, low, high, cross. ended_fast: a whole cell below the threshold within `fast` minutes, and none
    with a reading above it from there to decision_t (else repeat). peak: the highest reading so far. state: unknown without such
    an end, else observed_below if the last reading is at most `recent` minutes old, or inferred_below."""
    minute = 60_000_000
    rows = cell.withColumn("s", F.unix_micros(F.col("t").cast("timestamp")))
    by = Window.partitionBy("channel_id").orderBy("s")
    frame = lambda a, b: by.rangeBetween(a, int(b * minute))
    rows = rows.withColumns({
        "drop_s": F.min(F.when(F.col("high") < threshold, F.col("s"))).over(frame(1, fast)),
        "above_s": F.max(F.when(F.col("high") >= threshold, F.col("s"))).over(frame(1, live)),
        "peak": F.max("high").over(frame(0, live)),
        "last_s": F.max(F.when(F.col("high").isNotNull(), F.col("s"))).over(frame(0, live)),
    }).where("cross")
    repeat = F.coalesce(F.col("above_s") > F.col("drop_s"), F.lit(False))
    age = F.lit(float(live)) - (F.col("last_s") - F.col("s")) / minute
    fine = F.col("drop_s").isNotNull() & ~repeat
    state = F.when(~fine | F.col("peak").isNull(), "unknown").when(age <= recent, "observed_below").otherwise("inferred_below")
    return rows.select("channel_id", "object_id", "t", (F.col("t") + F.make_dt_interval(secs=F.lit(live * 60))).alias("decision_t"), fine.alias("ended_fast"), repeat.alias("repeat"), "peak", age.alias("age_minutes"), state.alias("state"))


def silence_context(rows: DataFrame, activity: DataFrame, runs: DataFrame, history: int = 90, before: int = 3, after: int = 21) -> DataFrame:
    """rows (object_id, t) with after_silence (true, false, or unknown with less than `history` days since the object's first day of
    activity) and in_posthoc (a run from `before` days before its start to `after` days after its end holds the day)."""
    first = activity.groupBy("object_id").agg(F.min("day").alias("first_day"))
    days = rows.select("object_id", F.to_date("t").alias("day")).distinct()
    since = F.date_diff("day", "end")
    near = days.join(runs.select("object_id", "start", "end"), "object_id").where((F.col("day") >= F.date_sub("start", before)) & (F.col("day") <= F.date_add("end", after)))
    found = near.groupBy("object_id", "day").agg(F.bool_or(since.between(1, after)).alias("recent"))
    out = rows.withColumn("day", F.to_date("t")).join(first, "object_id", "left").join(found, ["object_id", "day"], "left")
    known = F.coalesce(F.date_diff("day", "first_day") >= history, F.lit(False))
    recent = F.coalesce("recent", F.lit(False))
    return out.withColumns({"after_silence": F.when(~known, "unknown").otherwise(recent.cast("string")), "in_posthoc": known & F.col("recent").isNotNull()}).drop("first_day", "recent")


def triage(cell: DataFrame, activity: DataFrame, runs: DataFrame, archive_end: Column, threshold: float = 1.0, peak_limit: float = 2.6, hours: int = 6, live: float = 15, fast: float = 5, recent: float = 10, history: int = 90) -> DataFrame:
    """Crossings with their live, strict and retrospective label, the state of knowledge of each, and the reasons.

    A bad shape (not ended fast, peak over the limit, unknown state) needs attention; a good one likely comes after maintenance if
    the object was silent shortly before, is likely a bump test if other channels of the object cross from `hours` before to
    decision_t, and else short and isolated. Strict: a likely cause with a state that is only inferred needs attention. In
    retrospect, by the day's end, two other channels on that day make a bump test."""
    shapes = live_shapes(cell, threshold, live, fast, recent)
    shapes = neighbours(shapes, f"{hours} hours", f"{live * 60:g} seconds")
    same_day = shapes.groupBy("object_id", F.to_date("t").alias("day")).agg((F.count_distinct("channel_id") - 1).alias("others_on_day"))
    rows = silence_context(shapes, activity, runs, history).join(same_day, ["object_id", "day"])
    bad = ~F.col("ended_fast") | F.col("peak").isNull() | (F.col("peak") > peak_limit) | (F.col("state") == "unknown")
    label = lambda others, least: F.when(bad, "needs_attention").when(F.col("after_silence") == "true", "likely_after_maintenance").when(F.col(others) >= least, "likely_bump_test").otherwise("short_isolated")
    now, c = label("neighbours", 1), F.col("decision_t")
    day_end = F.date_add("day", 1).cast("timestamp_ntz") - F.expr("interval 1 microsecond")
    decided = c <= archive_end
    return rows.withColumns({
        "shape_ok": ~bad,
        "live": F.when(decided, now),
        "strict": F.when(decided, F.when(now.startswith("likely_") & (F.col("state") != "observed_below"), "needs_attention").otherwise(now)),
        "retro": F.when(day_end > archive_end, "censored_right").when(c > day_end, "censored_by_day").otherwise(label("others_on_day", 2)),
        "status_at_archive_end": F.when(decided, "decided").otherwise("censored_right"),
        "status_at_day_end": F.when(F.to_date("decision_t") > F.col("day"), "pending_at_day_end").otherwise("decided"),
        "series_only": ~bad & (F.col("neighbours") >= 1),
        "series_only_strict": ~bad & (F.col("neighbours") >= 1) & (F.col("state") == "observed_below"),
        "reasons": F.struct("ended_fast", F.col("repeat").alias("repeat_by_c"), F.col("peak").alias("peak_by_c"), F.col("neighbours").alias("other_ch_by_live_cutoff"), "after_silence", F.col("age_minutes").alias("last_reading_age_min")),
    })


def roll_up(channel_days: DataFrame, sums: list[str], group_sums: list[str], patterns: dict[str, str], high: str = "num_max", threshold: float = 1.0) -> DataFrame:
    """Object days from channel days (channel_id, object_id, day, sensor_type and the columns to sum).

    A sensor belongs to the first group whose pattern its type (in lower case) contains, else to `other`. Channels, sums of all
    channels, channels and sums of each group, shares of channels whose link isn't in order and whose power is off (of those with a known
    state, where such columns are), the largest reading, and each group's own alarms of the day (not features). Rows without object are left out."""
    kind = F.lower(F.coalesce("sensor_type", F.lit("")))
    group = F.lit("other")
    for name in reversed(patterns):
        group = F.when(kind.rlike(patterns[name]), name).otherwise(group)
    rows = channel_days.where("object_id is not null").withColumn("__group", group)
    parts = [F.count("*").alias("obj__n_channels"), *(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(f"obj__{c}") for c in sums)]
    for name in [*patterns, "other"]:
        own = F.col("__group") == name
        parts += [F.count_if(own).alias(f"grp_{name}__n_channels"), *(F.coalesce(F.sum(F.when(own, F.col(c).cast("double"))), F.lit(0.0)).alias(f"grp_{name}__{c}") for c in group_sums)]
    for column, out, wanted in (("link_now", "obj__share_link_not_ok", F.col("link_now") != "O" if "link_now" in rows.columns else None), ("power_now", "obj__share_power_off", F.col("power_now") == "F" if "power_now" in rows.columns else None)):
        if column in rows.columns:
            parts.append(F.avg(wanted.cast("double")).alias(out))
    parts += [F.max(high).alias("obj__reading_max"), F.count_if(F.col(high) >= threshold).alias("__above")]
    out = rows.groupBy("object_id", "day").agg(*parts)
    own_alarms = {f"_fp_{name}": F.col(f"grp_{name}__n_alarm") + (F.col("__above") if i == 0 else 0) for i, name in enumerate(patterns)}
    return out.withColumns(own_alarms | {"d_month": F.month("day")}).drop("__above")


def exposure(rows: DataFrame, by: list[str], time: str, key: str) -> DataFrame:
    """Rows, shares on weekends and outside 7-19 h, and shares of the first and the first three keys."""
    counts = rows.groupBy(*by, key).agg(F.count("*").alias("k"), F.count_if(F.weekday(time) >= 5).alias("w"), F.count_if(~F.hour(time).between(7, 18)).alias("o"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("k"), key)))
    total = F.sum("k")
    return ranked.groupBy(*by).agg(total.alias("n"), (F.sum("w") / total).alias("weekend_share"), (F.sum("o") / total).alias("off_hours_share"), (F.sum(F.when(F.col("r") == 1, F.col("k"))) / total).alias("top1_share"), (F.sum(F.when(F.col("r") <= 3, F.col("k"))) / total).alias("top3_share"))


def fingerprint(shapes: DataFrame, width: float) -> DataFrame:
    """One row: the commonest peak bin (the lowest of ties), quartiles of peaks, nearest-rank p95 of durations, censored share."""
    bins = shapes.groupBy(F.floor(F.col("peak") / width).alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bin").limit(1).select((F.col("bin") * width).alias("peak_bin"))
    peaks = percentiles(shapes, [], "peak", {"peak_q1": (0.25, "cont"), "peak_q3": (0.75, "cont")}).drop("n")
    durations = percentiles(shapes, [], "minutes_above", {"duration_p95": (0.95, "disc")}).drop("n")
    return bins.crossJoin(peaks).crossJoin(durations).crossJoin(shapes.agg(F.avg(F.col("censored").cast("double")).alias("censored_share")))


def burden(alerts: DataFrame, first: Column, last: Column) -> DataFrame:
    """Mean and 95th percentile of alerts a day over a dense calendar, days without alerts included."""
    days = alerts.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    counts = days.join(alerts.groupBy("day").agg(F.count("*").alias("n")), "day", "left").fillna(0, ["n"])
    return counts.agg(F.count("*").alias("days"), F.avg("n").alias("mean_n"), F.expr("percentile(n, 0.95)").alias("p95_n"), F.max("n").alias("max_n"))


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts between right-open edges; values outside and missing ones have bins of their own."""
    v = F.col(value)
    bin_ = F.when(v.isNull(), "missing").when(v < edges[0], "below").when(v >= edges[-1], "above")
    for a, b in zip(edges, edges[1:]):  # noqa: B905
        bin_ = bin_.when((v >= a) & (v < b), f"[{a:g},{b:g})")
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def strata(rows: DataFrame, by: list[str], binned: dict[str, tuple[list[float], list[str]]], time: str) -> DataFrame:
    """by, measure, bin, n: histograms of every measure by right-open edges (values from the last edge on fall into the last label, nulls
    into `missing`), of the hour of time, and of weekdays and weekends, in one pass over the rows."""
    parts = []
    for measure, (edges, labels) in binned.items():
        v = F.col(measure).cast("double")
        name = F.lit(labels[-1])
        for edge, label in reversed(list(zip(edges, labels, strict=False))):
            name = F.when(v < edge, label).otherwise(name)
        parts.append(F.struct(F.lit(measure).alias("measure"), F.when(v.isNull() | F.isnan(v), "missing").otherwise(name).alias("bin")))
    parts += [F.struct(F.lit("hour").alias("measure"), F.hour(time).cast("string").alias("bin")), F.struct(F.lit("day").alias("measure"), F.when(F.weekday(time) >= 5, "weekend").otherwise("weekday").alias("bin"))]
    return rows.select(*by, F.explode(F.array(*parts)).alias("x")).groupBy(*by, "x.measure", "x.bin").agg(F.count("*").alias("n"))


def quartiles(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """by, measure, n, q1, median, q3 of each measure without its nulls."""
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures))).alias("x")).select(*by, "x.*").where(~F.isnan("v"))
    return percentiles(long, [*by, "measure"], "v", {"q1": (0.25, "cont"), "median": (0.5, "cont"), "q3": (0.75, "cont")})


def power(positives: DataFrame, least_each: int, least_sum: int, most_top1: float = 0.5, dev: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(periods, gate) of positives (object_id, period, inside): for each period all positives, those inside maintenance windows, those
    outside with their objects and the shares of the first and the first three; and one row of decision over the dev periods (all, if None).

    The gate opens if each dev period has least_each positives outside, all together least_sum, and no object more than most_top1 of them."""
    outside = positives.where(~F.col("inside"))
    shares = lambda rows, by: rows.groupBy(*by, "object_id").agg(F.count("*").alias("k")).withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("k"), "object_id"))).groupBy(*by).agg(F.sum("k").alias("outside"), F.count("*").alias("objects"), (F.max(F.when(F.col("r") == 1, F.col("k"))) / F.sum("k")).alias("top1_share"), (F.sum(F.when(F.col("r") <= 3, F.col("k"))) / F.sum("k")).alias("top3_share"))
    periods = positives.groupBy("period").agg(F.count("*").alias("positives"), F.count_if("inside").alias("in_window")).join(shares(outside, ["period"]), "period", "left").fillna(0, ["outside", "objects"])
    wanted = F.col("period").isin(dev) if dev else F.lit(True)
    # As many objects as there are; counted first, ranked in pieces of the period above, so that only counts of objects meet here.
    objects = outside.where(wanted).groupBy("object_id").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("dev_positives"), (F.max("k") / F.sum("k")).alias("dev_top1_share"))
    each = periods.where(wanted).agg(F.count("*").alias("seen"), F.coalesce(F.min("outside"), F.lit(0)).alias("fewest"))
    enough = (F.col("fewest") >= least_each) & (F.col("seen") == (len(dev) if dev else F.col("seen")))
    gate = objects.crossJoin(each).select("dev_positives", "dev_top1_share", enough.alias("each_enough"), (F.col("dev_positives") >= least_sum).alias("sum_enough"), F.coalesce(F.col("dev_top1_share") <= most_top1, F.lit(False)).alias("top1_fine"))
    proceed = F.col("each_enough") & F.col("sum_enough") & F.col("top1_fine")
    return periods, gate.withColumns({"proceed": proceed, "decision": F.when(proceed, "eligible_for_stage20_spec").otherwise("insufficient_labels_keep_v3")})


def element_sets(channel_days: DataFrame, objects_days: DataFrame, at_most: int) -> DataFrame:
    """Each object day with its channels' facts as an ordered array of at most `at_most` elements, and whether some were left out."""
    rows = channel_days.groupBy("object_id", "day").agg(F.array_sort(F.collect_list(F.struct("channel_id", "n_events"))).alias("all"))
    out = objects_days.join(rows, ["object_id", "day"], "left")
    size = F.coalesce(F.size("all"), F.lit(0))
    return out.select("object_id", "day", F.coalesce(F.slice("all", 1, at_most), F.expr("cast(array() as array<struct<channel_id:bigint,n_events:bigint>>)")).alias("elements"), F.least(size, F.lit(at_most)).alias("n_elements"), (size > at_most).alias("truncated"))


def composition_rates(rows: DataFrame, least: int) -> DataFrame:
    """Label rate of each sensor-type composition; the global rate where fewer than `least` rows support it."""
    whole = rows.agg(F.avg("label").alias("whole"))
    rates = rows.groupBy("signature").agg(F.count("*").alias("n"), F.avg("label").alias("rate")).crossJoin(F.broadcast(whole))
    return rates.select("signature", "n", F.when(F.col("n") >= least, F.col("rate")).otherwise(F.col("whole")).alias("rate"))
