"""The forecast board's rules for daily and scenario rows."""

from __future__ import annotations

from vigil.operators import forecasts

CHANNELS = [(1, 10), (2, 10), (3, 20)]
DAILY = "id long, channel_id long, object_id long, score double, worker string, decision_status string"
SCENARIO = "id long, channel_id long, object_id long, score double, worker string, eligible boolean"


def board(spark, daily, scenario):
    channels = spark.createDataFrame(CHANNELS, "channel_id long, object_id long")
    got = forecasts.board(spark.createDataFrame(daily, DAILY), spark.createDataFrame(scenario, SCENARIO), channels, ["fire"])
    return {r.id: (r.bound, r.available, r.availability_reason, r.score) for r in got.collect()}


def test_daily_rows(spark):
    nan = float("nan")
    rows = [(1, 1, 10, 0.25, "gas", "experimental_shadow"), (2, None, 10, None, "gas", "abstain"), (3, 2, 10, 0.5, "gas", "abstain"), (4, 3, 10, 0.5, "gas", "experimental_shadow"), (5, None, 30, 0.5, "gas", "experimental_shadow"), (6, None, 20, 0.5, "gas", "experimental_shadow"), (7, 2, 10, nan, "gas", "experimental_shadow"), (8, 2, 10, 0.5, "gas", None), (9, 99, 10, 0.5, "gas", "experimental_shadow"), (10, 1, None, 0.5, "gas", "experimental_shadow")]
    assert board(spark, rows, []) == {
        1: (True, True, None, 0.25), 2: (True, False, "SCORE_UNAVAILABLE", None), 3: (True, False, "SCORE_UNAVAILABLE", None), 4: (False, False, "UNBOUND_CHANNEL", None), 5: (False, False, "UNBOUND_CHANNEL", None),
        6: (True, True, None, 0.5), 7: (True, False, "SCORE_UNAVAILABLE", None), 8: (True, False, "SCORE_UNAVAILABLE", None), 9: (False, False, "UNBOUND_CHANNEL", None), 10: (False, False, "UNBOUND_CHANNEL", None),
    }


def test_scenario_rows(spark):
    rows = [(1, 1, 10, 0.5, "fire", True), (2, 1, 10, 0.5, "fire", False), (3, 1, 10, 0.5, "fire", None), (4, 1, 10, 0.5, "flood", True), (5, 3, 10, 0.5, "flood", True), (6, None, 20, 0.5, "fire", True), (7, 1, 10, None, "fire", True), (8, 1, 10, 0.5, None, True)]
    assert board(spark, [], rows) == {
        1: (True, True, None, 0.5), 2: (True, False, "RESULT_UNAVAILABLE", None), 3: (True, False, "RESULT_UNAVAILABLE", None), 4: (True, False, "MODULE_DISABLED", None), 5: (False, False, "UNBOUND_CHANNEL", None),
        6: (True, True, None, 0.5), 7: (True, False, "RESULT_UNAVAILABLE", None), 8: (True, False, "MODULE_DISABLED", None),
    }
