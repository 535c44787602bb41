"""Incident labels, propensity, recommendations, ledgers and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators.objects import neighbours
from vigil.operators.panel import labelled


def incident_labels(object_days: DataFrame, incidents: DataFrame, data_end: Column, ongoing: int = 6) -> DataFrame:
    """Label of (object, D): an incident starts on D+2; null beyond the data, while one of D-ongoing..D may go on, or if one starts on D+1."""
    starts = incidents.select("object_id", F.col("day").alias("start")).distinct()
    at = lambda k, name: starts.select("object_id", F.date_sub("start", k).alias("day"), F.lit(True).alias(name))
    rows = object_days.select("object_id", "day").join(at(1, "next"), ["object_id", "day"], "left").join(at(2, "then"), ["object_id", "day"], "left")
    recent = starts.select("object_id", F.explode(F.sequence("start", F.date_add("start", ongoing))).alias("day")).distinct().withColumn("recent", F.lit(True))
    rows = rows.join(recent, ["object_id", "day"], "left")
    label, reason = labelled([(F.date_add("day", 2) > data_end, None, "window_beyond_data"), (F.col("recent"), None, "ongoing"), (F.col("next"), None, "competing"), (F.col("then"), 1, "positive")], "negative")
    return rows.select("object_id", "day", F.when(reason == "negative", 0).otherwise(label).alias("target_incident"), reason.alias("reason_incident"))


def propensity(days: DataFrame, key: str, windows: tuple[int, ...], m: float) -> DataFrame:
    """Events and observed days before D over windows and over all time, and the empirical-Bayes rate with the group's rate as prior."""
    order = F.unix_date("day")
    by = Window.partitionBy("channel_id").orderBy(order)
    past, group = by.rangeBetween(Window.unboundedPreceding, -1), Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    out = days.withColumns({f"events_{w}": F.coalesce(F.sum("event").over(by.rangeBetween(-w, -1)), F.lit(0)) for w in windows})
    out = out.withColumns({"events_all": F.coalesce(F.sum("event").over(past), F.lit(0)), "days_all": F.count("*").over(past)})
    # The group's history is summed by day first, so no window holds a whole group's rows.
    daily = days.groupBy(key, "day").agg(F.sum("event").alias("e"), F.count("*").alias("n"))
    prior = daily.select(key, "day", (F.sum("e").over(group) / F.sum("n").over(group)).alias("prior"))
    return out.join(prior, [key, "day"], "left").withColumn("rate", (F.col("events_all") + m * F.coalesce("prior", F.lit(0.0))) / (F.col("days_all") + m))


def shifted_neighbours(crossed: DataFrame, repeats: int, before: str = "6 hours", after: str = "15 minutes") -> DataFrame:
    """How many crossings have neighbours in each repeat, after channels were shifted by one or two weeks to either side, chosen by hash."""
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "channel_id")), 1, 8), 16, 10).cast("long") % 4
    weeks = F.element_at(F.array(*(F.lit(w) for w in (-2, -1, 1, 2))), (pick + 1).cast("int"))
    moved = crossed.select("channel_id", "object_id", "t", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")).withColumn("t", F.col("t") + F.make_dt_interval(days=7 * weeks))
    return neighbours(moved, before, after).groupBy("rep").agg(F.count_distinct(F.when(F.col("neighbours") > 0, F.struct("channel_id", "t"))).alias("with_neighbours"))


def eligibility(rows: DataFrame, threshold: float) -> DataFrame:
    """reasons (fixed codes) why a channel can't be scored on its day, and whether it can."""
    reasons = F.array_compact(F.array(F.when(F.col("readings") == 0, "NOT_GAS_STREAM"), F.when((F.col("readings") > 0) & F.col("last_reading").isNull(), "NO_GAS_READING_AT_D"), F.when(F.col("last_reading") >= threshold, "ABOVE_THRESHOLD_AT_D")))
    return rows.withColumns({"reasons": reasons, "eligible": F.size(reasons) == 0})


#: Codes of advice (fixed names of the interface).
ADVICE_VERSION = "manual-advisory-v1"


def _advice(branches: list[tuple[Column, str, Column]], code: str, basis: Column) -> Column:
    """struct(version, code, basis_codes, automated_action_allowed) by the first branch that holds."""
    made = lambda c, b: F.struct(F.lit(ADVICE_VERSION).alias("version"), F.lit(c).alias("code"), b.alias("basis_codes"), F.lit(False).alias("automated_action_allowed"))
    out = made(code, basis)
    for condition, name, reasons in reversed(branches):
        out = F.when(condition, made(name, reasons)).otherwise(out)
    return out


def _codes(*names: str) -> Column:
    return F.array(*(F.lit(n) for n in names))


def recommendation(reasons: Column, status: Column, context: Column) -> Column:
    """Advice on a channel's forecast by its reason codes, decision status and maintenance context. No score decides it, and it orders nothing.

    A reading above the threshold, a missing reading, an abstention, a verified schedule and a recent silence come in this order."""
    held = F.coalesce(reasons, F.expr("cast(array() as array<string>)"))
    has = lambda code: F.array_contains(held, code)
    return _advice([
        (has("ABOVE_THRESHOLD_AT_D"), "CURRENT_ALARM_PROTOCOL", _codes("ABOVE_THRESHOLD_AT_D")),
        (has("NO_GAS_READING_AT_D"), "CHECK_TELEMETRY", _codes("NO_GAS_READING_AT_D")),
        (F.coalesce(status == "abstain", F.lit(False)), "NO_GAS_FORECAST", F.when(F.size(held) > 0, F.array_sort(F.array_distinct(held))).otherwise(_codes("ABSTAIN"))),
        (F.coalesce(context == "verified_schedule", F.lit(False)), "REVIEW_VERIFIED_PPR", _codes("GAS_PROXY", "VERIFIED_SCHEDULE")),
        (F.coalesce(context == "possible_recent_silence", F.lit(False)), "CHECK_MAINTENANCE_LOG", _codes("GAS_PROXY", "POSSIBLE_RECENT_SILENCE")),
    ], "REVIEW_GAS_TREND", _codes("GAS_PROXY"))


def incident_recommendation(abstain: Column, label_source: Column, evidence: Column) -> Column:
    """Advice on an object's incident forecast by why it abstains, where its labels come from and how good the evidence is."""
    stub = F.coalesce(label_source == "stub", F.lit(False))
    some = F.coalesce(abstain != "", F.lit(False))
    return _advice([
        (some, "NO_INCIDENT_FORECAST", F.when(stub, F.array(abstain, F.lit("STUB_LABELS"))).otherwise(F.array(abstain))),
        (stub | F.coalesce(evidence == "E4", F.lit(False)), "DEMO_ONLY", _codes("STUB_LABELS")),
    ], "REVIEW_INCIDENT_FACTORS", _codes("INCIDENT_REGISTER"))


def maintenance_state(objects: DataFrame, activity: DataFrame, schedule: DataFrame, day: Column, least: int = 7, lookback: int = 21, history: int = 90) -> DataFrame:
    """objects (object_id) with maintenance_context at the end of `day`: verified_schedule if a planned window holds it (s <= day <= e),
    else possible_recent_silence if the latest silence of at least `least` days that readings bound on both sides ended 1 to `lookback`
    days ago, else unknown; with that silence's length and age and the window's bounds. Only days up to `day`, `history` back, count."""
    days = activity.where((F.col("day") <= day) & (F.col("day") >= F.date_sub(day, history))).select("object_id", "day").distinct()
    by = Window.partitionBy("object_id").orderBy("day")
    gaps = days.withColumn("next", F.lead("day").over(by)).where(F.date_diff("next", "day") - 1 >= least)
    gaps = gaps.select("object_id", (F.date_diff("next", "day") - 1).alias("silence_length_days"), (F.date_diff(day, F.col("next")) + 1).alias("silence_ended_days_ago")).where(F.col("silence_ended_days_ago").between(1, lookback))
    silent = gaps.groupBy("object_id").agg(F.min_by(F.struct("silence_length_days", "silence_ended_days_ago"), "silence_ended_days_ago").alias("x")).select("object_id", "x.*")
    planned = schedule.where((F.col("start") <= day) & (day <= F.col("end"))).groupBy("object_id").agg(F.max(F.struct("start", "end")).alias("w")).select("object_id", F.col("w.start").alias("schedule_start"), F.col("w.end").alias("schedule_end"))
    out = objects.join(silent, "object_id", "left").join(planned, "object_id", "left")
    context = F.when(F.col("schedule_start").isNotNull(), "verified_schedule").when(F.col("silence_length_days").isNotNull(), "possible_recent_silence").otherwise("unknown")
    return out.withColumn("maintenance_context", context)


def humanised(feature: Column, names: dict[str, str]) -> Column:
    """Readable name of a feature f_<base>_<days>d."""
    base, days = F.regexp_extract(feature, r"^f_(.+)_\d+d$", 1), F.regexp_extract(feature, r"_(\d+)d$", 1)
    known = F.coalesce(*(F.when(base == k, v) for k, v in names.items()), base)
    return F.when(base == "", feature).otherwise(F.concat(known, F.lit(" in "), days, F.lit(" days")))


def ledger(scores: DataFrame, lead: int = 2, length: int = 1) -> DataFrame:
    """Forecast rows with their window, hours from the cutoff to it, and a payload with its digest."""
    rows = scores.select("channel_id", "day", "score", F.date_add("day", lead).alias("window_start"), F.date_add("day", lead + length).alias("window_end"))
    rows = rows.withColumn("horizon_hours", F.timestamp_diff("HOUR", F.date_add("day", 1).cast("timestamp_ntz"), F.col("window_start").cast("timestamp_ntz")))
    payload = F.to_json(F.struct("channel_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "score"))
    return rows.withColumns({"payload": payload, "payload_hash": F.sha2(payload, 256)})


def add_revision(held: DataFrame, new: DataFrame) -> DataFrame:
    """new days with verdict: new, same (that day's newest fingerprint), or revision with its number. held: day, revision, fingerprint."""
    last = held.groupBy("day").agg(F.max_by("fingerprint", "revision").alias("known"), F.max("revision").alias("revision"))
    out = new.join(last, "day", "left")
    verdict = F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("fingerprint"), "same").otherwise("revision")
    number = F.when(verdict == "same", F.col("revision")).otherwise(F.coalesce("revision", F.lit(0)) + 1)
    return out.select("day", "fingerprint", verdict.alias("verdict"), number.alias("revision"))


def scorecard(predictions: DataFrame, gates: DataFrame) -> DataFrame:
    """Predictions of all modules with their gate: a module without an open gate abstains."""
    rows = predictions.join(F.broadcast(gates), "module", "left")
    open_ = F.coalesce(F.col("decision") == "use", F.lit(False))
    return rows.select("module", "channel_id", "day", F.when(open_, F.col("score")).alias("score"), F.when(open_, "scored").otherwise("abstain").alias("status"))


def selected_types(rows: DataFrame, least: int) -> DataFrame:
    """Rows of sensor types with at least `least` positives."""
    fine = rows.groupBy("sensor_type").agg(F.count_if(F.col("label") == 1).alias("p")).where(F.col("p") >= least)
    return rows.join(fine.select("sensor_type"), "sensor_type", "left_semi")


def board(daily: DataFrame, scenario: DataFrame, channels: DataFrame, enabled: list[str]) -> DataFrame:
    """Forecasts of both sources (id, channel_id, object_id, score, worker): whether each is bound, whether it is available, and why
    not; only available ones show their score.

    Bound: the object has channels, and the forecast is for the object as a whole (no channel) or for one of them. A daily
    row must have the decision_status of a shadow forecast, a scenario's row must be eligible and its worker enabled; both need a finite score."""
    held, known = channels.select("channel_id", F.col("object_id").alias("held")), channels.select("object_id").distinct().withColumn("known", F.lit(True))
    columns = ["id", "channel_id", "object_id", "score", "worker"]
    a = daily.select(*columns, (F.col("decision_status") == "experimental_shadow").alias("fit"), F.lit(True).alias("on"), F.lit("SCORE_UNAVAILABLE").alias("missing"))
    b = scenario.select(*columns, F.col("eligible").alias("fit"), F.col("worker").isin(*enabled).alias("on"), F.lit("RESULT_UNAVAILABLE").alias("missing"))
    rows = a.unionByName(b).join(held, "channel_id", "left").join(known, "object_id", "left")
    bound = F.coalesce(F.col("known") & (F.col("channel_id").isNull() | (F.col("held") == F.col("object_id"))), F.lit(False))
    finite = ~F.isnan("score") & (F.abs("score") < float("inf"))
    reason = F.when(~bound, "UNBOUND_CHANNEL").when(~F.coalesce("on", F.lit(False)), "MODULE_DISABLED").when(~F.coalesce(finite & F.col("fit"), F.lit(False)), F.col("missing"))
    return rows.select("worker", "id", "channel_id", "object_id", bound.alias("bound"), reason.isNull().alias("available"), reason.alias("availability_reason"), F.when(reason.isNull(), F.col("score")).alias("score"))
