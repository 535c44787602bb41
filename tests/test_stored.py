"""Stored tables: what batches write, runs that are killed, and a polled source with retries."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigil.sources.stored import StoredTable
from vigil.streaming import cursor


def table(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, kind string, v int").schema
    return StoredTable(spark, str(tmp_path / "table"), schema, "id", F.pmod("id", F.lit(4)))


def rows(spark, ids, v=0):
    return spark.createDataFrame([(i, f"k{i % 3}" if i % 5 else None, v) for i in ids], "id long, kind string, v int")


def test_append_takes_a_key_once_and_a_second_run_writes_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0
    assert t.append(rows(spark, [*range(10), 3, 3])) == {"rows": 12, "inserted": 10, "skipped": 2, "parts": 4}
    assert t.append(rows(spark, range(10))) == {"rows": 10, "inserted": 0, "skipped": 10, "parts": 0}
    # Ids of one part: only that one is written.
    assert t.append(rows(spark, [4, 8, 12, 16])) == {"rows": 4, "inserted": 2, "skipped": 2, "parts": 1}
    assert sorted(r.id for r in t.read().collect()) == [*range(10), 12, 16]
    assert t.manifest().agg(F.sum("rows")).head()[0] == 12 and t.manifest().agg(F.max("version")).head()[0] == 2


def test_upsert_rewrites_only_parts_that_change(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(rows(spark, range(12)))
    batch = rows(spark, [4, 8, 9, 20]).withColumn("v", F.when(F.col("id") == 9, 0).otherwise(7)).withColumn("at", F.lit(1)).union(rows(spark, [4], 5).withColumn("at", F.lit(0)))
    assert t.upsert(batch, "at") == {"inserted": 1, "updated": 2, "unchanged": 1, "parts": 1}
    assert {r.id: r.v for r in t.read().collect()} == {i: 7 if i in (4, 8, 20) else 0 for i in [*range(12), 20]}
    assert t.upsert(batch, "at") == {"inserted": 0, "updated": 0, "unchanged": 4, "parts": 0}
    assert t.append(rows(spark, [20, 24], 1))["inserted"] == 1
    assert {r.id: r.v for r in t.read(["0"]).collect()} == {0: 0, 4: 7, 8: 7, 20: 7, 24: 1}


@pytest.mark.parametrize("kind", ["append", "upsert"])
def test_a_run_killed_before_the_switch_leaves_the_table(spark, tmp_path, monkeypatch, kind):
    t = table(spark, tmp_path)
    t.append(rows(spark, range(6)))
    before = sorted(map(tuple, t.read().collect()), key=str)

    def killed(rows):
        raise RuntimeError("killed")

    batch = rows(spark, range(3, 9), 9).withColumn("at", F.lit(1))
    go = (lambda: t.append(batch.drop("at"))) if kind == "append" else (lambda: t.upsert(batch, "at"))
    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_switch", lambda self, rows: killed(rows))
        with pytest.raises(RuntimeError):
            go()
    assert sorted(map(tuple, t.read().collect()), key=str) == before
    go()
    assert {r.id: r.v for r in t.read().collect()} == {i: 9 if i > 5 or (kind == "upsert" and i > 2) else 0 for i in range(9)}


def polled(spark, name, upto, asked=None):
    def fetch(after, upto):
        ids = list(range(after + 1, upto + 1))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f"r{i}" for i in ids])], ["cursor", "value"])

    return cursor.cursor_stream(spark, name, "cursor long, value string", lambda: upto, fetch, 10)


def test_a_failed_batch_is_taken_once_by_the_next_run(spark, tmp_path):
    at, check = str(tmp_path / "out"), str(tmp_path / "check")
    cursor.take(polled(spark, "polled_a", 24), cursor.ledgered(at), check)
    assert [tuple(r) for r in cursor.ledger(spark, at).orderBy("batch").collect()] == [(25, 0, 24, 0)]

    def fails(number):
        raise ValueError("half-way")

    with pytest.raises(Exception, match="half-way"):
        cursor.take(polled(spark, "polled_b", 40), cursor.ledgered(at, fails), check)
    # Records and cursor are as before, though the batch's records were written.
    assert cursor.accepted(spark, at).count() == 25 and cursor.ledger(spark, at).count() == 1
    cursor.take(polled(spark, "polled_c", 55), cursor.ledgered(at), check)
    got = sorted(r["cursor"] for r in cursor.accepted(spark, at).collect())
    assert got == list(range(56))
    assert cursor.ledger(spark, at).agg(F.sum("rows")).head()[0] == 56
    cursor.take(polled(spark, "polled_d", 55), cursor.ledgered(at), check)
    assert cursor.accepted(spark, at).count() == 56
