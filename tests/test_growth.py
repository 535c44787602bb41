"""Steps whose work must grow no faster than their rows."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import logistic as L
from vigil.operators import objects as O
from vigil.plans import ml as M
from vigil.plans.learned import cold_scores
from vigil.sources import files as R
from vigil.streaming import stream as S

T0 = dt.datetime(2024, 1, 1)


def test_neighbours_equal_a_plain_loop_and_join_no_pairs(spark):
    rng = random.Random(5)
    rows = [(c, rng.choice([1, 1, 1, 2]), T0 + dt.timedelta(minutes=15 * rng.randrange(300), microseconds=rng.choice([0, 0, 1]))) for c in range(30) for _ in range(4)]
    rows += [rows[0], (99, None, T0), (None, 1, rows[0][2])]
    low, high = dt.timedelta(hours=6), dt.timedelta(minutes=15)
    want = [(c, o, t, len({d for d, p, u in rows if d is not None and c is not None and p == o and o is not None and d != c and t - low <= u <= t + high})) for c, o, t in rows]
    frame = spark.createDataFrame(rows, "channel_id long, object_id long, t timestamp_ntz")
    out = O.neighbours(frame)
    order = lambda x: [(v is None, v) for v in x]
    assert sorted((tuple(r) for r in out.select("channel_id", "object_id", "t", "neighbours").collect()), key=order) == sorted(want, key=order)
    # 2,000 channels of one object that cross at once: 4 million pairs, but sums over three times.
    crowd = spark.range(2000).selectExpr("id AS channel_id", "1L AS object_id", "timestamp_ntz'2024-01-01 00:00:00' AS t")
    found = O.neighbours(crowd)
    assert found.select("neighbours").distinct().collect() == [(1999,)]
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" not in joins


def test_a_late_reading_undoes_a_silence_that_was_told_of(spark, tmp_path):
    schema, at, day = "channel_id long, event_id long, event_time timestamp, seen timestamp, value_numeric double, value_state string", str(tmp_path), dt.timedelta(days=1)
    t0, classes = T0.replace(tzinfo=dt.timezone.utc), {"fault": ("bad",), "ok": ("ok",), "unknown": ()}
    # Channel 1 is silent from day 1 on, as is told; then a reading of day 2 comes late, and its last one on day 4.
    batches = [[(1, 1, t0, t0, None, "ok"), (2, 2, t0 + 4 * day, t0 + 4 * day, None, "ok")], [(1, 3, t0 + 2 * day, t0 + 5 * day, None, "ok"), (1, 4, t0 + 4 * day, t0 + 5 * day, None, "bad")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in")
        S.run_to_end(S.channel_changes(stream, classes, "num", 1.0, 3600.0, 2, "h", dt.timedelta(hours=2)), f"{at}/out", f"{at}/checkpoint")
    got = [(r.kind, r.start.day) for r in spark.read.parquet(f"{at}/out").where("channel_id = 1").collect()]
    assert ("lasting", 2) in got and ("undone", 2) in got and not any(kind == "silence" for kind, _ in got)


def test_channel_states_take_rows_and_not_frames(spark, tmp_path):
    schema = "channel_id long, event_id long, event_time timestamp, value_numeric double, value_state string"
    spark.createDataFrame([(1, 1, T0, 1.0, "num")], schema).write.parquet(f"{tmp_path}/in")
    found = S.channel_changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), {"fault": (), "ok": (), "unknown": ()}, "num", 1.0, 1.0, 2)
    assert "python_row" in found._jdf.queryExecution().analyzed().toString()


def test_newton_reads_equal_rows_once(spark, monkeypatch):
    real = L._moments

    def spy(betas, size):
        run = real(betas, size)

        def few(batches):
            for pdf in batches:
                assert len(pdf) <= 4
                yield pdf

        return lambda batches: run(few(batches))

    monkeypatch.setattr(L, "_moments", spy)
    rows = spark.range(2000).selectExpr("'a' AS g", "array(1.0D, CAST(id % 2 AS DOUBLE)) AS x", "CAST(id % 5 = id % 2 AS INT) AS y", "1.0D AS w").coalesce(1)
    beta = L.newton(rows, ["a"], 2, ridge=1e-9)["a"]
    share = [rows.where(f"x[1] = {k}").selectExpr("avg(y)").head()[0] for k in (0, 1)]
    assert abs(1 / (1 + math.exp(-beta[0])) - share[0]) < 1e-6 and abs(1 / (1 + math.exp(-beta[0] - beta[1])) - share[1]) < 1e-6


def test_cold_scores_fit_no_boosted_model(spark, monkeypatch):
    monkeypatch.setattr(M, "boosted", lambda numeric: pytest.fail("a boosted model is fitted"))
    assert cold_scores(spark, "/root/testdata/sf0.001").columns == ["channel_id", "day", "is_cold", "score"]


def test_an_export_sorts_a_year_in_pieces_and_writes_one_file_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 100, raising=False)
    rng, held, real = random.Random(7), [], getattr(R, "checkpointed", None)

    def spy(rows):
        held.append([r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()])
        return real(rows)

    monkeypatch.setattr(R, "checkpointed", spy, raising=False)
    times = [T0 + dt.timedelta(days=366 * (i % 3 == 0), minutes=rng.randrange(600)) for i in range(3000)]
    rows = [(i, i % 7, t, None if i % 5 == 0 else i % 2 == 0) for i, t in enumerate(times)] + [(3000, None, None, True)]
    rng.shuffle(rows)
    out = tmp_path / "out"
    R.export_journal(spark.createDataFrame(rows, "event_id long, channel_id long, event_time timestamp_ntz, alarm boolean"), str(out))
    for part, year in (("2024", 2024), ("2025", 2025), ("__HIVE_DEFAULT_PARTITION__", None)):
        (name,) = (out / f"y={part}").glob("*.csv")
        header, *lines = name.read_text().splitlines()
        want = sorted((t, i) for i, _, t, _ in rows if (t and t.year) == year) if year else [(None, 3000)]
        assert header == "event_id,channel_id,event_time,alarm" and [int(x.split(",")[0]) for x in lines] == [i for _, i in want]
    assert (out / "_SUCCESS").exists()
    # No task sorts a year: about PIECE rows in each.
    assert [sum(n) for n in sorted(held, key=sum)] == [1, 1000, 2000] and max(map(max, held)) < 400
    with pytest.raises(Exception, match="exist"):
        R.export_journal(spark.createDataFrame(rows[:1], "event_id long, channel_id long, event_time timestamp_ntz, alarm boolean"), str(out))
    R.export_journal(spark.createDataFrame([], "event_id long, event_time timestamp_ntz"), str(tmp_path / "none"))
    assert [p.name for p in (tmp_path / "none").iterdir() if not p.name.startswith(".")] == ["_SUCCESS"]
