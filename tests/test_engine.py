"""Hand-made journals, folds against plain loops, sources, streams and invariances."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from vigil.functions import scalars as S
from vigil.operators import alerts as A
from vigil.operators import forecasts as Q
from vigil.operators import objects as O
from vigil.operators import panel as P
from vigil.operators import states as T
from vigil.plans import ml as M
from vigil.sources import files as R
from vigil.operators import logistic as L
from vigil.streaming import stream as G

OK, FAULT, UNKNOWN = "Норма", "Неисправен", "Не определено"
STREAM = T.Stream((FAULT,), (OK,), (UNKNOWN,))
DAY0 = dt.datetime(2024, 3, 1)


def at(day, hour=12, minute=0, second=0):
    return DAY0 + dt.timedelta(days=day, hours=hour, minutes=minute, seconds=second)


def journal(spark, rows):
    """rows: (channel, time, text); numbers are readings."""
    full = [(i, c, t, s == FAULT, float(s) if isinstance(s, (int, float)) else None, s if isinstance(s, str) else None) for i, (c, t, s) in enumerate(rows)]
    return spark.createDataFrame(full, "event_id long, channel_id long, event_time timestamp_ntz, alarm boolean, value_numeric double, value_state string")


def panel(spark, rows, end, tau=300.0):
    j = journal(spark, rows)
    reading = F.col("value_numeric").isNotNull()
    out = P.event_panel(j, STREAM, reading, 1.0, tau, F.lit(end).cast("timestamp_ntz"), [OK, FAULT], "second")
    return {(r.channel_id, (r.day - DAY0.date()).days): r for r in out.collect()}


def rounded(rows):
    """Sums of floats depend on their order in the last digits."""
    return {k: [round(v, 9) if isinstance(v, float) else v for v in r] for k, r in rows.items()}


def daily_ok(n, channel=1):
    return [(channel, at(d), OK) for d in range(n)]


def test_strict_onset_and_competing_day(spark):
    p = panel(spark, [*daily_ok(12), (1, at(5, 13), FAULT), (1, at(5, 14), OK)], at(11, 23))
    assert (p[1, 3].target_onset, p[1, 3].reason_onset) == (1, "positive")
    assert p[1, 4].target_onset == 0 and p[1, 4].competing_onset_d1
    assert p[1, 3].target_sustained == 1 and p[1, 9].reason_onset == "window_beyond_data"


def test_same_second_conflict_is_ambiguous(spark):
    p = panel(spark, [*daily_ok(12), (1, at(5, 13), FAULT), (1, at(5, 13), OK)], at(11, 23))
    assert (p[1, 3].target_onset, p[1, 3].reason_onset) == (None, "ambiguous_onset")


@pytest.mark.parametrize(("minutes", "label", "reason"), [(2, 0, "negative_transient_only"), (10, 1, "positive")])
def test_transient_and_sustained(spark, minutes, label, reason):
    p = panel(spark, [*daily_ok(12), (1, at(5, 13), FAULT), (1, at(5, 13, minutes), OK)], at(11, 23))
    assert (p[1, 3].target_sustained, p[1, 3].reason_sustained) == (label, reason)


def test_unclosed_episode_is_censored(spark):
    p = panel(spark, [*daily_ok(5), (1, at(5, 13), FAULT), *[(1, at(d, 12), FAULT) for d in range(6, 12)]], at(11, 23))
    assert (p[1, 3].target_sustained, p[1, 3].reason_sustained) == (None, "censored_duration")
    assert p[1, 8].reason_onset == "state_not_ok_at_D"


def test_silent_days_are_unobserved(spark):
    p = panel(spark, [(1, at(0), OK), (2, at(20), OK)], at(20, 23))
    assert (p[1, 2].target_onset, p[1, 2].reason_onset) == (None, "unobserved_window")


def test_crossing_labels(spark):
    rows = [(1, at(d), 0.2) for d in range(12)] + [(1, at(5, 13), 3.0), (1, at(8, 13), 0.5), (1, at(8, 13), 2.0)]
    p = panel(spark, rows, at(11, 23))
    assert (p[1, 3].target_crossing, p[1, 3].reason_crossing) == (1, "positive")
    assert p[1, 6].reason_crossing == "unknown_previous_reading" and p[1, 8].reason_crossing == "ambiguous_last_reading_at_D"
    assert p[1, 5].reason_crossing == "above_threshold_at_D" and p[1, 4].target_crossing == 0


def random_rows(n_days=30, seed=1):
    rng = random.Random(seed)
    values = [OK, FAULT, UNKNOWN, "x", 0.1, 0.7, 1.5, 6.0, "Норма "]
    return [(c, at(d, rng.randrange(24), rng.randrange(60), rng.randrange(3)), rng.choice(values)) for c in range(8) for d in range(n_days) for _ in range(rng.randrange(6))]


def test_partitions_and_row_order_do_not_matter(spark):
    rows = random_rows()
    first = panel(spark, rows, at(29, 23))
    random.Random(2).shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rounded(panel(spark, rows, at(29, 23))) == rounded(first)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_later_rows_do_not_change_features(spark):
    rows = random_rows(15)
    short, long = panel(spark, rows, at(14, 23)), panel(spark, [*rows, *[(c, at(20 + d), FAULT) for c in range(8) for d in range(4)]], at(24, 23))
    for k, r in short.items():
        old, new = r.asDict(), long[k].asDict()
        assert {n: v for n, v in old.items() if n.startswith(("f_", "n_", "num_")) and "_d" not in n[-3:]} == {n: new[n] for n in old if n.startswith(("f_", "n_", "num_")) and "_d" not in n[-3:]}


def test_leakage_guard():
    P.assert_leakage_safe(["a", "target_x"], ["a"])
    for bad in (["target_x"], ["a", "a"], ["b"], ["n_d2"]):
        with pytest.raises(ValueError):
            P.assert_leakage_safe(["a", "target_x", "n_d2"], bad)


def test_censored_horizon_of_observed_panel(spark):
    out = P.observed_panel(journal(spark, [(1, at(0), OK)]), F.col("alarm")).collect()
    assert [r.target_failure for r in out] == [None]


def test_dropout_needs_a_peer_and_a_return(spark):
    rows = [(1, d) for d in range(8)] + [(2, d) for d in (0, 1, 5, 6, 7)]
    days = spark.createDataFrame([(c, 9, (DAY0 + dt.timedelta(days=d)).date()) for c, d in rows], "channel_id long, object_id long, day date")
    out = {(r.channel_id, (r.day - DAY0.date()).days): r for r in O.dropout(days, F.lit(at(20).date())).collect()}
    assert out[2, 0].target_dropout == 1 and out[1, 0].target_dropout == 0


def test_silence_only_between_days_with_data(spark):
    days = spark.createDataFrame([(1, (DAY0 + dt.timedelta(days=d)).date()) for d in (3, 4, 9, 11)], "k long, day date")
    assert [(r.length, r.start.day) for r in O.silence_runs(days, "k", 4).collect()] == [(4, 6)]


def test_neighbour_edges_are_inclusive(spark):
    t = at(5)
    rows = [(1, 1, t), (2, 1, t - dt.timedelta(hours=6)), (3, 1, t - dt.timedelta(hours=6, seconds=1)), (4, 1, t + dt.timedelta(minutes=15)), (5, 1, t + dt.timedelta(minutes=15, seconds=1)), (6, 2, t)]
    out = O.neighbours(spark.createDataFrame(rows, "channel_id long, object_id long, t timestamp_ntz"))
    assert {r.channel_id: r.neighbours for r in out.collect()}[1] == 2


def score_rows(seed=3, channels=40, days=25):
    rng = random.Random(seed)
    return [(c, (DAY0 + dt.timedelta(days=d)).date(), rng.randrange(40) / 40) for c in range(channels) for d in range(days) if rng.random() < 0.8]


def frame(spark, rows):
    return spark.createDataFrame(rows, "channel_id long, day date, score double")


@pytest.mark.parametrize(("k", "cooldown"), [(3, 5), (6, 3), (10, 7)])
def test_refilled_budget_equals_a_plain_loop(spark, k, cooldown):
    rows = score_rows()
    last, want = {}, []
    for day in sorted({d for _, d, _ in rows}):
        free = sorted((-s, c) for c, d, s in rows if d == day and (c not in last or (day - last[c]).days >= cooldown))[:k]
        for s, c in free:
            last[c] = day
            want.append((c, day, -s))
    assert sorted(map(tuple, A.refilled(frame(spark, rows), k, cooldown).collect())) == sorted(want)


def test_cooldown_after_budget_equals_a_plain_loop(spark):
    rows, last, want = score_rows(5), {}, []
    for c, d, s in sorted(rows, key=lambda r: (r[1], r[0])):
        if c not in last or (d - last[c]).days >= 4:
            last[c] = d
            want.append((c, d, s))
    assert sorted(map(tuple, A.cooled(frame(spark, rows), 4).collect())) == sorted(want)


def test_matching_equals_a_plain_loop(spark):
    alerts, rng = score_rows(7, 12), random.Random(8)
    events = sorted({(c, (DAY0 + dt.timedelta(days=d)).date()) for c in range(12) for d in range(30) if rng.random() < 0.3})
    used, want = set(), []
    for c, d, _ in sorted(alerts):
        free = [e for e in events if e[0] == c and d + dt.timedelta(days=2) <= e[1] < d + dt.timedelta(days=5) and e not in used]
        if free:
            used.add(free[0])
            want.append((c, d, free[0][1]))
    got = A.matched(frame(spark, alerts), spark.createDataFrame(events, "channel_id long, event_day date"), 2, 3).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_average_precision_with_ties(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0), (0.1, None)], "score double, label int")
    got = A.average_precision(rows).head()
    assert got.ap == pytest.approx((0.5 + 2 / 3) / 2) and got.auc == pytest.approx(0.625)


def test_parsing_rules(spark):
    rows = [(" 1 ", "2", "2024-03-01", "08:00:00", " T", "0,05"), ("1", "2", "2024-03-01", "8:0:0", "f", "1d"), ("x", "2", "2024-03-01", "08:00:00", "f", "NaN"), ("1", "2", "2024-03-01", "08:00:00", "?", ""), ("event_id", None, None, None, None, None)]
    raw = spark.createDataFrame(rows, "event_id string, channel_id string, date_raw string, time_raw string, alarm_raw string, value_raw string")
    got = R.parse_events(R.without_repeated_headers(raw)).collect()
    assert [r.error for r in got] == [None, "event_time", "event_id", "alarm"]
    assert [(r.value_numeric, r.value_state) for r in got] == [(0.05, None), (None, "1d"), (None, "NaN"), (None, None)]
    assert got[0].row_hash == hashlib.sha256(json.dumps(list(rows[0]), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def test_row_hash_keeps_nulls_and_letters(spark):
    row = ["ж\"\n", None, "a"]
    got = spark.createDataFrame([row], "a string, b string, c string").select(S.row_hash(F.col("a"), F.col("b"), F.col("c"))).head()[0]
    assert got == hashlib.sha256(json.dumps(row, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def test_text_functions(spark):
    df = spark.createDataFrame([("ПК 17 x", "S1-7-a", "=1+1", "POINT (30.5 59.9)", '{"type":"Point","coordinates":[200,1]}')], "a string, b string, c string, d string, e string")
    got = df.select(S.picket(F.col("a")), S.first_part(F.col("b")), S.neutral_cell(F.col("c")), S.wkt_point(F.col("d")), S.geojson_point(F.col("e"))).head()
    assert (got[0], got[1], got[2], got[3].lon, got[4]) == (17, "S1", "'=1+1", 30.5, None)


def test_csv_journal_round_trip_and_second_run_adds_nothing(spark, tmp_path):
    header = ",".join(R.JOURNAL_COLUMNS)
    lines = [header, "1,2,2024-03-01,08:00:00,f,Норма", "1,2,2024-03-01,08:00:00,f,Норма", header, "2,2,2024-03-02,08:00:00,t,", "3,2,bad,08:00:00,t,"]
    (tmp_path / "j.csv").write_text("﻿" + "\n".join(lines), encoding="utf-8")
    raw = R.read_journal(spark, str(tmp_path / "j.csv"))
    balance = R.stage_balanced(raw.drop("file"), str(tmp_path / "balanced")).head()
    assert (balance.rows, balance.headers, balance.bad, balance.repeated, balance.staged, balance.unexplained) == (5, 1, 1, 1, 2, 0)
    good = R.parse_events(R.without_repeated_headers(raw)).where("error is null")
    R.stage_by_year(good, str(tmp_path / "staged"))
    target = spark.read.parquet(str(tmp_path / "staged"))
    assert R.append_counts(good, target).head()[1:] == (0, 3)
    R.export_journal(target.drop("y"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        R.require(raw, ["nothing"])


@pytest.mark.parametrize("fmt", ["csv", "json", "xml", "parquet"])
def test_records_of_all_formats(spark, tmp_path, fmt):
    p = tmp_path / f"r.{fmt}"
    if fmt == "csv":
        p.write_text("a,b,c\n1,true,x\n")
    elif fmt == "json":
        p.write_text('[{"a": 1, "b": true, "c": "x"}]')
    elif fmt == "xml":
        p.write_text("<records><record><a>1</a><b>true</b><c>x</c></record></records>")
    else:
        spark.createDataFrame([(1, True, "x")], "a int, b boolean, c string").write.parquet(str(p))
    assert [tuple(r) for r in R.read_records(spark, str(p), fmt, ["a", "b"]).collect()] == [("1", "true")]


def test_imports_registers_and_manifests(spark):
    listing = spark.createDataFrame([("a", "events", bytearray(b"1")), ("b", "events", bytearray(b"2")), ("c", "events", bytearray(b"1"))], "path string, kind string, content binary")
    key = hashlib.sha256(b"events:" + hashlib.sha256(b"2").hexdigest().encode()).hexdigest()
    done = spark.createDataFrame([(key, "completed")], "file_key string, status string")
    assert R.new_files(listing, done).count() == 1
    raw = spark.createDataFrame([(1, "fire", at(1), True), (1, "fire", at(1, 5), True), (1, "odd", at(1), True), (2, "fire", at(1), False)], "object_id long, type string, start timestamp_ntz, confirmed boolean")
    assert R.register(raw, spark.createDataFrame([("fire",)], "type string")).count() == 1
    a = spark.createDataFrame([(1, 5), (2, 6)], "p int, k int")
    b = spark.createDataFrame([(1, 5), (2, 7)], "p int, k int")
    assert [r.p for r in R.changed_parts(R.manifest(a, "p", "k"), R.manifest(b, "p", "k"), "p").collect()] == [2]
    assert sorted(r.year for r in R.missing_years(spark.createDataFrame([(2019,), (2022,)], "year int")).collect()) == [2020, 2021]


def test_split_purges_windows_over_boundaries(spark):
    rows = spark.createDataFrame([((DAY0 + dt.timedelta(days=d)).date(),) for d in range(20)], "day date")
    out = M.temporal_split(rows, "2024-03-05", "2024-03-10", "2024-03-15").collect()
    assert {(r.day.day, r.split) for r in out if r.day.day in (2, 3, 4, 5)} == {(2, "train"), (5, "calibration")}


def test_platt_is_the_identity_for_one_class(spark):
    assert L.platt(spark.createDataFrame([(0.3, 1), (0.4, 1)], "score double, label int")) == (0.0, 1.0)


def test_names(spark):
    df = spark.createDataFrame([("f_n_alarm_7d",), ("plain",)], "f string")
    assert [r.n for r in df.select(Q.humanised(F.col("f"), {"n_alarm": "alarms"}).alias("n")).collect()] == ["alarms in 7 days", "plain"]


def test_advice_goes_by_reasons_and_context_in_order(spark):
    rows = [(["ABOVE_THRESHOLD_AT_D", "NO_GAS_READING_AT_D"], "abstain", None), (["NO_GAS_READING_AT_D"], "abstain", "verified_schedule"), (["B", "A"], "abstain", None), ([], "abstain", None), (None, "experimental_shadow", "verified_schedule"), ([], "experimental_shadow", "possible_recent_silence"), ([], None, None)]
    df = spark.createDataFrame(rows, "reasons array<string>, status string, context string")
    got = [(r.x.code, r.x.basis_codes, r.x.automated_action_allowed) for r in df.select(Q.recommendation(F.col("reasons"), F.col("status"), F.col("context")).alias("x")).collect()]
    assert got == [
        ("CURRENT_ALARM_PROTOCOL", ["ABOVE_THRESHOLD_AT_D"], False), ("CHECK_TELEMETRY", ["NO_GAS_READING_AT_D"], False), ("NO_GAS_FORECAST", ["A", "B"], False), ("NO_GAS_FORECAST", ["ABSTAIN"], False),
        ("REVIEW_VERIFIED_PPR", ["GAS_PROXY", "VERIFIED_SCHEDULE"], False), ("CHECK_MAINTENANCE_LOG", ["GAS_PROXY", "POSSIBLE_RECENT_SILENCE"], False), ("REVIEW_GAS_TREND", ["GAS_PROXY"], False),
    ]
    df = spark.createDataFrame([("why", "stub", None), ("why", None, None), ("", "stub", None), (None, "register", "E4"), (None, "register", "E2")], "a string, l string, e string")
    got = [(r.x.code, r.x.basis_codes) for r in df.select(Q.incident_recommendation(F.col("a"), F.col("l"), F.col("e")).alias("x")).collect()]
    assert got == [("NO_INCIDENT_FORECAST", ["why", "STUB_LABELS"]), ("NO_INCIDENT_FORECAST", ["why"]), ("DEMO_ONLY", ["STUB_LABELS"]), ("DEMO_ONLY", ["STUB_LABELS"]), ("REVIEW_INCIDENT_FACTORS", ["INCIDENT_REGISTER"])]


T0 = dt.datetime(2024, 6, 10, 12)


def readings(channel, t0, peak=1.4, drop=4, extra=(), high=None):
    values = [(-1, 0.2, 0.2), (0, peak, peak), (drop, 0.4, high or 0.4), *((m, v, v) for m, v in extra)]
    return [(channel, 1, t0 + dt.timedelta(minutes=m), low, top, m == 0) for m, low, top in values]


def triaged(spark, rows, end, days=(), runs=()):
    cell = spark.createDataFrame(rows, "channel_id long, object_id long, t timestamp_ntz, low double, high double, cross boolean")
    activity = cell.select("object_id", F.to_date("t").alias("day")).union(spark.createDataFrame([(1, d) for d in days], "object_id long, day date"))
    found = O.triage(cell, activity, spark.createDataFrame(list(runs), "object_id long, start date, end date"), F.lit(end.isoformat(sep=" ")).cast("timestamp_ntz"))
    return {r.channel_id: r for r in found.collect()}


def test_triage_of_repeats_and_neighbours_up_to_the_decision(spark):
    m = lambda x, s=0: T0 + dt.timedelta(minutes=x, seconds=s)
    rows = readings(1, T0, extra=[(10, 1.1)]) + readings(2, T0) + readings(3, m(15)) + readings(4, m(15, 1))
    got = triaged(spark, rows, m(60))
    assert got[1].reasons.repeat_by_c and got[1].live == "needs_attention" and got[1].neighbours == 2


def test_triage_left_bound_of_six_hours_and_the_strict_label(spark):
    rows = readings(1, T0) + readings(2, T0 - dt.timedelta(hours=6)) + readings(3, T0 - dt.timedelta(hours=6, seconds=1))
    one = triaged(spark, rows, T0 + dt.timedelta(hours=1))[1]
    assert (one.neighbours, one.state, one.live, one.strict) == (1, "inferred_below", "likely_bump_test", "needs_attention")
    assert one.series_only and not one.series_only_strict and one.others_on_day == 2


def test_triage_shapes(spark):
    end = T0 + dt.timedelta(hours=1)
    mixed = triaged(spark, readings(1, T0, high=1.2), end)[1]
    assert not mixed.ended_fast and mixed.live == "needs_attention"
    got = triaged(spark, readings(1, T0, 2.6, 5) + readings(2, T0 + dt.timedelta(minutes=1), 2.61) + readings(3, T0 + dt.timedelta(minutes=2), drop=6), end)
    assert got[1].shape_ok and got[1].state == "observed_below" and got[1].live == "likely_bump_test"
    assert got[2].live == got[3].live == "needs_attention"
    alone = triaged(spark, readings(1, T0), T0 + dt.timedelta(minutes=14))[1]
    assert alone.live is None and alone.status_at_archive_end == "censored_right"


def test_triage_over_midnight_and_after_silence(spark):
    t = dt.datetime(2023, 12, 31, 23, 55)
    one = triaged(spark, readings(1, t, drop=7), dt.datetime(2024, 1, 1, 1))[1]
    assert (one.status_at_day_end, one.retro, one.live) == ("pending_at_day_end", "censored_by_day", "needs_attention")
    runs = [(1, dt.date(2024, 6, 2), dt.date(2024, 6, 9))]
    after = triaged(spark, readings(1, T0), T0 + dt.timedelta(hours=1), [dt.date(2024, 2, 1)], runs)[1]
    assert after.after_silence == "true" and after.live == "likely_after_maintenance"
    assert triaged(spark, readings(1, T0), T0 + dt.timedelta(hours=1), [dt.date(2024, 6, 1)], runs)[1].after_silence == "unknown"


def test_stream_retries_conflicts_and_state_changes(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "external_id string, seen timestamp, payload string"
    spark.createDataFrame([("a", at(1), "1"), ("a", at(2), "1"), ("b", at(1), "x")], schema).write.parquet(source)
    run = lambda: G.run_to_end(G.payload_verdicts(spark.readStream.schema(schema).parquet(source)), str(tmp_path / "out"), str(tmp_path / "check"))
    run()
    spark.createDataFrame([("a", at(3), "2"), ("c", at(3), "1")], schema).write.mode("append").parquet(source)
    run()
    got = sorted((r.external_id, r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", "conflict"), ("a", "new"), ("a", "retry"), ("b", "new"), ("c", "new")]


def test_a_channel_s_state_is_carried_from_file_to_file(spark, tmp_path):
    """A fault that opens in one file and closes in the next, a crossing and a silence over the border, a cell that goes on."""
    schema = "event_id long, channel_id long, event_time timestamp, value_state string, value_numeric double"
    rows = [(1, 1, at(0, 1), "ok", None), (2, 1, at(0, 2), "fault", None), (3, 1, at(0, 3), "read", 0.5), (4, 2, at(0, 1), "fault", None)]
    more = [(5, 1, at(4, 1), "read", 1.5), (6, 1, at(4, 2), "ok", None), (7, 1, at(4, 3), "read", 9.0), (8, 2, at(0, 1), "ok", None), (9, 2, at(0, 2), "ok", None), (10, 2, at(0, 3), "ok", None)]
    source = str(tmp_path / "in")
    classes = {"fault": ("fault",), "ok": ("ok",), "unknown": ()}
    run = lambda: G.run_to_end(G.channel_changes(spark.readStream.schema(schema).parquet(source), classes, "read", 1.0, 3600.0, 3, "h"), str(tmp_path / "out"), str(tmp_path / "check"))
    spark.createDataFrame(rows, schema).write.parquet(source)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0
    spark.createDataFrame(more, schema).write.mode("append").parquet(source)
    run()
    got = sorted((r.channel_id, r.kind, r.start, r.end, r.strict, r.sustained) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "crossing", at(4, 1), at(4, 1), None, None), (1, "fault", at(0, 2), at(4, 2), True, 1), (1, "silence", at(1).replace(hour=0), at(3).replace(hour=0), None, None)]


def test_broken_bytes_and_a_byte_order_mark_are_read(spark, tmp_path):
    head = ",".join(R.JOURNAL_COLUMNS)
    (tmp_path / "j.csv").write_bytes(b"\xef\xbb\xbf" + head.encode() + b"\n1,2,2024-01-01,10:00:00,true,ab\xff\xfe\n")
    row = R.read_journal(spark, str(tmp_path / "j.csv")).head()
    assert (row.event_id, row.channel_id, row.alarm_raw) == ("1", "2", "true") and row.value_raw.startswith("ab")


def test_exports_in_parts_stay_in_order_and_too_many_rows_raise(spark, tmp_path):
    rows = [(i, 1, dt.datetime(2023 + i % 2, 5, 1) + dt.timedelta(hours=i)) for i in range(200)]
    R.export_journal(spark.createDataFrame(rows, "event_id long, channel_id long, event_time timestamp_ntz"), str(tmp_path / "out"), parts=3)
    for year in (2023, 2024):
        names = sorted((tmp_path / "out" / f"y={year}").glob("*.csv"))
        times = [line.split(",")[2] for n in names for line in n.read_text().splitlines()[1:]]
        assert len(times) == 100 and times == sorted(times)
    with pytest.raises(ValueError, match="more than 5 rows"):
        R.read_records(spark, str(tmp_path / "out"), "csv", ["event_id"], most=5)


def test_exact_percentiles_and_running_sums_in_pieces(spark, monkeypatch):
    import numpy as np

    from vigil.operators import ranks

    monkeypatch.setattr(ranks, "PIECES", 5)
    rng = random.Random(4)
    rows = [(g, rng.choice([None, float(rng.randrange(8)), rng.random() * 9])) for g in "ab" for _ in range(150)] + [("c", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in ranks.percentiles(df, ["g"], "v", {"a": (0.25, "cont"), "b": (0.9, "disc"), "c": (0.0, "cont"), "d": (1.0, "disc")}).collect()}
    for g in "abc":
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g].n == len(own) and got[g].a == pytest.approx(float(np.quantile(own, 0.25))) and (got[g].c, got[g].d) == (own[0], own[-1])
        assert got[g].b == own[max(0, -(-9 * len(own) // 10) - 1)]
    table = df.where("v is not null").groupBy("g", "v").count().withColumn("count", F.col("count").cast("double"))
    for r in ranks.running_sums(table, ["g"], "v", {"upto": "count"}).collect():
        assert r.upto == sum(1 for g, v in rows if g == r.g and v is not None and v >= r.v)


def test_snapshot_cap(spark):
    from vigil.operators import rules

    j = journal(spark, daily_ok(5))
    with pytest.raises(ValueError):
        rules.snapshot(j, F.lit(at(9)).cast("timestamp_ntz"), 30, 4)
    assert rules.snapshot(j, F.lit(at(9)).cast("timestamp_ntz"), 30, 5).count() == 5


def test_routing_gives_each_kind_to_its_sink(spark):
    seen = {}
    batch = spark.createDataFrame([("telemetry", 1), ("weather", 2), ("telemetry", 3)], "kind string, x int")
    G.routed({k: lambda b, n, k=k: seen.update({k: (b.count(), n)}) for k in ("telemetry", "weather")})(batch, 7)
    assert seen == {"telemetry": (2, 7), "weather": (1, 7)}
