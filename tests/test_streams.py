"""Streams with timers: state that shrinks, cells that close, silences that last, late rows kept apart."""

from __future__ import annotations

import datetime as dt

import pytest

from vigil.streaming import stream as S
from vigil.streaming.heartbeat import Heartbeats, last_heartbeats

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def run(frame, at):
    """All there is; the last progress's number of keys in state."""
    query = frame.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def feed(spark, at, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema(schema).parquet(f"{at}/in")


def test_ids_are_forgotten_by_event_time(spark, tmp_path):
    schema, day = "external_id string, seen timestamp, payload string", dt.timedelta(days=1)
    at = str(tmp_path)
    stream = feed(spark, at, [(f"a{i}", START, "x") for i in range(20)] + [("a0", START + dt.timedelta(hours=1), "y")], schema)
    assert run(S.payload_verdicts(stream, day), at) == 20
    stream = feed(spark, at, [("b", START + 5 * day, "x"), ("a1", START + 5 * day, "z")], schema)
    assert run(S.payload_verdicts(stream, day), at) <= 2
    stream = feed(spark, at, [("b", START + 5 * day + dt.timedelta(hours=2), "w"), ("a2", START + 5 * day + dt.timedelta(hours=2), "v")], schema)
    run(S.payload_verdicts(stream, day), at)
    got = sorted((r.external_id, r.verdict) for r in spark.read.parquet(f"{at}/out").collect())
    # A timer fires behind the rows of its batch, so a1 is still known in the second one; a2 isn't in the third.
    assert got == sorted([(f"a{i}", "new") for i in range(20)] + [("a0", "conflict"), ("a1", "conflict"), ("a2", "new"), ("b", "new"), ("b", "conflict")])


def test_timers_close_cells_and_tell_of_silences(spark, tmp_path):
    schema = "channel_id long, event_id long, event_time timestamp, seen timestamp, value_numeric double, value_state string"
    at, hour = str(tmp_path), dt.timedelta(hours=1)
    classes = {"fault": ("bad",), "ok": ("ok",), "unknown": ()}
    make = lambda rows: S.channel_changes(feed(spark, at, rows, schema), classes, "num", 1.0, 3600.0, 2, "h", 2 * hour)
    row = lambda i, channel, hours, state, value=None, later=0: (channel, i, START + hours * hour, START + (hours + later) * hour, value, state)
    run(make([row(1, 1, 0, "ok"), row(2, 1, 1, "bad"), row(3, 2, 1, "num", 0.5)]), at)
    out = lambda: sorted((r.channel_id, r.kind, int((r.start.replace(tzinfo=dt.timezone.utc) - START) / hour), r.event_id) for r in spark.read.parquet(f"{at}/out").collect())
    assert out() == []
    # Channel 2's cell of hour 30 crosses; nothing follows it but other channels' rows, so a timer closes it.
    run(make([row(4, 2, 30, "num", 2.0), row(5, 3, 40, "ok")]), at)
    assert out() == [(2, "crossing", 30, None)]
    # Behind the closed cell: late. Channel 1's fault ends at hour 100, after a silence of two whole days and more that had been told of.
    run(make([row(6, 2, 29, "num", 0.1, 60), row(7, 2, 30, "num", 0.1, 60), row(8, 3, 95, "ok")]), at)
    assert (2, "late", 29, 6) in out() and (2, "late", 30, 7) in out() and (1, "lasting", 24, None) in out()
    run(make([row(9, 1, 100, "ok")]), at)
    run(make([row(10, 3, 110, "ok")]), at)
    got = out()
    assert (1, "silence", 24, None) in got and (1, "fault", 1, None) in got
    assert sum(r[1] == "lasting" and r[0] == 1 for r in got) == 1 and sum(r[1] == "crossing" for r in got) == 1


def test_heartbeats_are_stored_and_tell_of_failures(spark, tmp_path):
    schema, at = "event_id long, x int", str(tmp_path)
    good = feed(spark, f"{at}/good", [(i, i) for i in range(5)], schema)

    def fails(batch, number):
        raise ValueError("no sink")

    for run in range(2):
        with Heartbeats(spark, f"{at}/beats"):
            S.run_batches(good, lambda batch, number: batch.write.format("noop").mode("overwrite").save(), f"{at}/check-good", "append", "good")
            if run == 0:
                with pytest.raises(Exception, match="no sink"):
                    S.run_batches(feed(spark, f"{at}/bad", [(1, 1)], schema), fails, f"{at}/check-bad", "append", "bad")
        feed(spark, f"{at}/good", [(9, 9)], schema)
    got = {r.source: r for r in last_heartbeats(spark.read.parquet(f"{at}/beats")).collect()}
    assert (got["good"].rows, got["good"].healthy, got["good"].last_failure) == (6, True, None) and got["good"].last_success
    assert not got["bad"].healthy and "no sink" in got["bad"].last_error and got["bad"].rows == 0
