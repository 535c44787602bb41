"""Fits by summed moments, bootstrap by vectors of weights, and the gates that follow from folds."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import alerts as A
from vigil.operators import logistic as L
from vigil.plans import ml as M


def plain_newton(x, y, w, use, ridge=L.RIDGE, steps=L.STEPS):
    beta, held = np.zeros(x.shape[1]), ridge * np.r_[0, np.ones(x.shape[1] - 1)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        left = (x * (w * p * (1 - p))[:, None]).T @ x / w.sum() + np.diag(held)
        right = x.T @ (w * (y - p)) / w.sum() - held * beta
        beta[use] += np.linalg.solve(left[np.ix_(use, use)], right[use])
    return beta


def test_fits_of_groups_and_masks_in_one_pass(spark):
    rng = np.random.default_rng(4)
    x = np.c_[np.ones(600), rng.normal(size=(600, 3))]
    y = (rng.random(600) < 1 / (1 + np.exp(-x @ [0.3, 1.5, -1.0, 0.0]))).astype(int)
    w, g = rng.uniform(0.5, 3, 600), np.where(np.arange(600) % 3 == 0, "a", "b")
    rows = spark.createDataFrame([(str(g[i]), x[i].tolist(), int(y[i]), float(w[i])) for i in range(600)], "g string, x array<double>, y int, w double").repartition(7)
    masks = {"all": np.ones(4, bool), "two": np.array([True, True, False, True])}
    got = L.newton(rows, ["a", "b", "none"], 4, masks)
    for group in ("a", "b"):
        for name, use in masks.items():
            own = g == group
            assert np.abs(got[f"{group}\t{name}"] - plain_newton(x[own], y[own], w[own], use)).max() < 1e-10
    assert got["a\ttwo"][2] == 0 and not got["none\tall"].any()


def test_design_fills_nulls_and_names_unknown_categories(spark):
    rows = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, "x"), (-8.0, None)], "v double, t string")
    design = L.Design.of(rows, ["v"], "t")
    assert design.known == ["x", "y"] and design.names() == ["intercept", "v", "t=x", "t=y"] and design.medians == [1.0]
    got = [r[0] for r in rows.select(design.vector()).collect()]
    assert got[0] == got[0] and got[0][1] == pytest.approx(got[1][1]) and got[3][2:] == [0, 0] and sum(v[1] for v in got) == pytest.approx(0)
    one = L.Design.of(rows.where("v = 1"), ["v"])
    assert rows.where("v = 1").select(one.vector()).head()[0] == [1.0, 0.0]


def plain_precision(rows):
    pos = sum(w for _, y, w in rows if y == 1)
    total = sum(w for _, _, w in rows)
    if not pos or pos == total:
        return None
    out = tp = n = 0
    for s in sorted({r[0] for r in rows}, reverse=True):
        here = [(y, w) for v, y, w in rows if v == s]
        gained = sum(w for y, w in here if y == 1)
        tp, n = tp + gained, n + sum(w for _, w in here)
        out += gained * tp / n if n else 0
    return out / pos


def test_resampled_precision_equals_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "SCORES_AT_ONCE", 5)
    rng = random.Random(3)
    rows = [(k, dt.date(2024, 1, 1 + rng.randrange(6)), rng.choice([0, 0, 1, None]), rng.choice([None, *[i / 20 for i in range(20)]])) for k in "ab" for _ in range(150)]
    got = A.resampled_precision(spark.createDataFrame(rows, "key string, block date, label int, score double"), 12)
    days = sorted({r[1] for r in rows})
    draws = A.drawn(len(days), 12, "s")
    assert (draws.sum(axis=0) == len(days)).all()
    for key in "ab":
        for rep in range(12):
            want = plain_precision([(s, y, draws[days.index(d), rep]) for k, d, y, s in rows if k == key and y is not None and s is not None])
            assert np.isnan(got[key][rep]) if want is None else got[key][rep] == pytest.approx(want, abs=1e-12)
    assert A.resampled_precision(spark.createDataFrame([], "key string, block date, label int, score double"), 5) == {}


def test_a_thousand_repeats_dont_repeat_rows(spark):
    rows = spark.range(4000).select(F.lit("a").alias("key"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("block"), (F.xxhash64("id") % 5 == 0).cast("int").alias("label"), F.rand(1).alias("score"))
    got = A.resampled_precision(rows, 1000)["a"]
    assert got.shape == (1000,) and 0 < got.min() < got.max() < 1


AP = {"all": (0.5, 0.5), "no_calendar": (0.49, 0.49), "no_catalogue": (0.48, 0.5), "core": (0.4, 0.4), "rule": (0.3, 0.2), "other": (0.2, 0.25)}
LOW = {"all": (0.1, 0.1), "no_calendar": (0.1, 0.1), "core": (-0.1, 0.1)}


def decided(spark, ap=None, low=None, positives=(50, 50), types=None):
    t = lambda rows, schema: spark.createDataFrame([("t", *r) for r in rows], f"target string, {schema}")
    metrics = [(f, k, v[i]) for k, v in (AP | (ap or {})).items() for i, f in enumerate("ab")]
    lows = [(f, k, v[i]) for k, v in (LOW | (low or {})).items() for i, f in enumerate("ab")]
    folds = [(f, positives[i], 0.6) for i, f in enumerate("ab")]
    roles = {"full": "all", "reduced": "no_calendar", "uncatalogued": "no_catalogue", "simple": "core"}
    return M.decide(t(metrics, "fold string, key string, ap double"), t(lows, "fold string, key string, low double"), t(folds, "fold string, positives int, known double"), t(types or [], "fold string, key string, type string, ap double"), ["target"], ["rule", "other"], roles, 20, 0.05, 0.5).head()


def test_gates_select_by_bounds_and_shortcuts(spark):
    r = decided(spark)
    assert (r.selected, r.evidence_level, r.beats_full, r.beats_simple, r.keeps_reduced, r.stable) == ("all", "validated_proxy_model", True, False, True, None)
    assert decided(spark, {"no_calendar": (0.3, 0.49)}).selected == "no_calendar"
    # What is lost without the calendar only counts if the rest beats the baselines by itself.
    assert decided(spark, {"no_calendar": (0.3, 0.49)}, {"no_calendar": (-0.1, 0.1)}).selected == "all"
    assert decided(spark, {"core": (0.496, 0.496)}, {"core": (0.1, 0.1)}).selected == "core"
    assert decided(spark, {"core": (0.49, 0.49)}, {"core": (0.1, 0.1)}).selected == "all"
    r = decided(spark, {}, {"all": (0.1, -0.1), "core": (0.1, 0.1)})
    assert (r.selected, r.evidence_level) == ("core", "validated_proxy_model")
    r = decided(spark, {}, {"all": (0.1, None)})
    assert (r.selected, r.evidence_level, r.stable) == ("rule", "baseline_only", None)
    r = decided(spark, {"other": (0.3, 0.25)}, {"all": (0.1, None)})
    assert r.selected == "other"
    r = decided(spark, positives=(50, 19))
    assert (r.enough, r.selected, r.evidence_level, r.beats_full) == (False, None, "insufficient_events", None)


@pytest.mark.parametrize(("better", "stable"), [(3, True), (2, True), (1, False)])
def test_stable_asks_for_two_thirds_of_types(spark, better, stable):
    types = [("a", k, f"type{i}", 0.5 if (k == "all") == (i < better) else 0.4) for k in ("all", "rule") for i in range(3)]
    types += [("b", k, "only", v) for k, v in (("all", 0.1), ("other", 0.9))]  # one type only: doesn't count
    assert decided(spark, types=types).stable is stable
