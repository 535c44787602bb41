"""Whitening against a dense eigendecomposition, and rows that take no part."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import types as T

from vigil.llm.whitening import Fit, whiten


def frame(spark, matrix):
    return spark.createDataFrame([(i, [float(z) for z in row]) for i, row in enumerate(matrix)], "vec_id long, embedding array<double>")


def compare(got, matrix, ids=None):
    """got against numpy; components up to sign."""
    x = np.floor(1024 * matrix.astype(np.float64)).astype(np.int64) + 100000
    n = len(x)
    off = n * x - x.sum(axis=0)
    centred = off / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = got["component"].max()
    assert len(got) == n * k and set(got["n"]) == {n}
    got = got.sort_values(["vec_id", "component"])
    white = got["whitened"].to_numpy().reshape(n, k)
    want = centred @ v[:, :k] / np.sqrt(e[:k])
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-9
    assert np.abs(got["explained"].to_numpy()[:k] / (e[:k] / e.sum()) - 1).max() < 1e-10
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    assert got["deviation"].to_numpy().reshape(n, k)[:, 0].tolist() == [int(d) for d in (off.astype(object) ** 2).sum(axis=1)]
    return k


def test_embeddings_equal_a_dense_decomposition(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = vectors.toPandas().sort_values("vec_id")
    assert compare(whiten(vectors).toPandas(), np.stack(rows["embedding"])) == 8


@pytest.mark.parametrize("decay", [0.7, 0.3])
def test_falling_spectra(spark, decay):
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(200, 40)) @ np.diag(decay ** np.arange(40)) * 100
    assert compare(whiten(frame(spark, matrix)).toPandas(), matrix) == 8


def test_equal_eigenvalues_and_fewer_components(spark):
    cross = np.vstack([np.eye(5), -np.eye(5)])
    got = whiten(frame(spark, cross)).toPandas()
    assert len(got) == 50 and np.allclose(got["explained"], 0.2) and got["identity_error"].max() < 1e-10
    line = np.outer(np.arange(6.0), [1.0, 2.0, 0.0])
    assert whiten(frame(spark, line)).toPandas()["component"].max() == 1
    assert whiten(frame(spark, np.ones((4, 6)))).count() == 0
    assert whiten(frame(spark, np.ones((1, 6)))).count() == 0


def test_rows_that_take_no_part_and_other_columns(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n", T.StringType()), T.StructField("steps", T.StringType())])
    good = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (None, [0.0, 3.0])]
    other = [(20, [1.0, 2.0, 3.0]), (21, [2.0, 2.0, 5.0])]
    bad = [(2, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (7, [float("inf"), 1.0])]
    vectors = spark.createDataFrame([(*r, "a", "b") for r in good + other + bad], schema)
    got = whiten(vectors).toPandas()
    assert sorted(got["vec_id"].dropna()) == [0, 0, 1, 1, 1, 1, 20, 21] and int(got["vec_id"].isna().sum()) == 2
    assert set(got[got["vec_id"] < 20]["n"]) == {4} and set(got[got["vec_id"] >= 20]["n"]) == {2}
    same = got[got["vec_id"] == 1].sort_values("component")["whitened"].tolist()
    assert same[0] == same[1] and same[2] == same[3]
    assert whiten(vectors.where("false")).count() == 0


def test_deviations_beyond_64_bits_are_kept_as_text(spark):
    got = whiten(frame(spark, [[1e30, 0.0], [0.0, 1.0], [1.0, 2.0]])).toPandas()
    assert got["deviation"].isna().all() and all(int(v) >= 1 << 63 for v in got["deviation_beyond_long"])
    x = np.array([[5, 1 << 40], [7, 3]], np.int64)
    fit = Fit(2, [12, (1 << 40) + 3])
    assert fit.deviations(x) == [4 + ((1 << 40) - 3) ** 2] * 2
