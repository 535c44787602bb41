"""The panel in pieces: a busy channel, states and readings carried over days, and a plain scan of each channel."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from vigil.operators import panel
from vigil.operators.states import Stream
from vigil.plans import ORACLES, QUERIES

START = dt.datetime(2024, 1, 1)


def test_busy_channel_equals_the_query_in_sql(spark, tmp_path):
    """Half of all events belong to one channel."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    hot = events.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, 1).otherwise(F.col("user_id")))
    hot.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for t in ("customer", "nation", "orders"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    cursor = con.execute(ORACLES["event_panel"])
    names = [c[0] for c in cursor.description]
    frame = QUERIES["event_panel"](spark, str(tmp_path))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, frame.select(*names).collect())) == sorted(map(key, cursor.fetchall()))
    days = hot.select(F.col("user_id").alias("channel_id"), F.to_date("ts").alias("day")).repartition(16, "channel_id", "day")
    share = days.groupBy(F.spark_partition_id()).count().agg(F.max("count") / F.sum("count")).head()[0]
    assert share < 0.3
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(channel_id" in plan and "Join" not in plan


def scan(cells, tau, end):
    """Plain loop over one channel's cells in order: counts of each day, and the state at its end."""
    days, points = {}, []
    before, state = None, None
    for t, s, low, high in cells:
        day = days.setdefault(t.date(), dict.fromkeys(("strict", "ambiguous", "sustained", "transient", "censored", "blocks", "crossed", "unknown"), 0))
        if s and s != state:
            points.append((t, s, state))
            state = s
        if low is not None:
            mixed = before and before[0] < 1 <= before[1]
            day["crossed"] += bool(low >= 1 and before and before[1] < 1)
            day["unknown"] += bool(high >= 1 and (before is None or low < 1 or mixed))
            before = (low, high)
    for i, (t, s, was) in enumerate(points):
        after = points[i + 1] if i + 1 < len(points) else (end, None)
        day = days[t.date()]
        if s == "A":
            day["blocks"] += 1
        elif s == "F" and was != "O":
            day["ambiguous"] += 1
        elif s == "F":
            day["strict"] += 1
            exact = after[1] == "O"
            day["censored" if not exact else "sustained" if (after[0] - t).total_seconds() >= tau else "transient"] += 1
    return days, points


@pytest.mark.parametrize("seed", range(4))
def test_pieces_equal_a_scan(spark, seed):
    rng = random.Random(seed)
    rows, cells = [], {}
    for channel in range(12):
        t, rare = START, rng.choice([0.2, 3.0, 40.0])
        for _ in range(rng.choice([1, 5, 80])):
            t += dt.timedelta(minutes=int(rng.expovariate(1 / (rare * 60))) + 1)
            kind = rng.choice(["ok", "ok", "bad", "bad", "odd", "num", "none"])
            value = rng.choice([0.2, 0.9, 1.0, 1.7]) if kind == "num" else None
            extra = [(channel, t, False, rng.choice([0.5, 1.5]), "num")] if kind == "num" and rng.random() < 0.3 else []
            for row in [(channel, t, False, value, kind), *extra]:
                rows.append(row)
                f = cells.setdefault((channel, row[1]), ([], []))
                f[0].append(row[4])
                if row[3] is not None:
                    f[1].append(row[3])
    end = max(r[1] for r in rows) + dt.timedelta(days=1)
    events = spark.createDataFrame(rows, "channel_id long, event_time timestamp_ntz, alarm boolean, value_numeric double, value_state string")
    stream = Stream(("bad",), ("ok",), ("odd",))
    got = panel.event_panel(events, stream, F.col("value_state") == "num", 1.0, 3600.0, F.lit(end).cast("timestamp_ntz"), ["ok"], "minute").collect()
    by_channel = {}
    for (channel, t), (kinds, values) in sorted(cells.items()):
        f, o, u = "bad" in kinds, "ok" in kinds, "odd" in kinds
        state = "A" if (f and o) or u else "F" if f else "O" if o else None
        by_channel.setdefault(channel, []).append((t, state, min(values, default=None), max(values, default=None)))
    checked = 0
    for channel, own in by_channel.items():
        days, points = scan(own, 3600.0, end)
        grid = {d + dt.timedelta(days=k) for d in days for k in range(7)}
        found = {r.day: r for r in got if r.channel_id == channel}
        assert set(found) == {d for d in grid if d <= end.date()}
        for day, r in found.items():
            want = days.get(day, {})
            for name, column in (("strict", "link_strict"), ("ambiguous", "link_ambiguous"), ("sustained", "link_sustained"), ("transient", "link_transient"), ("censored", "link_censored"), ("blocks", "link_blocks"), ("crossed", "crossed"), ("unknown", "cross_unknown")):
                assert r[column] == want.get(name, 0), (channel, day, name)
            held = [p for p in points if p[0].date() <= day]
            assert (r.link_now, r.state_t) == ((held[-1][1], held[-1][0]) if held else (None, None))
            checked += 1
    assert checked > 50
