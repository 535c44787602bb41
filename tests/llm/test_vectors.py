"""Multiprobe search: recall on the driver's vectors, what a group multiplies, and groups dealt over a grid of tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tests.llm.test_operators import brute_distinct, vector_frame
from vigil.llm import nearest


def test_recall_and_scores_on_the_embeddings_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in frame.collect()}
    ids, all_vectors = np.array(list(rows)), np.stack(list(rows.values()))
    got = nearest.nearest(frame).collect()
    hit = 0
    for q in ids[ids % 50 == 0]:
        score = (all_vectors * rows[q]).sum(axis=1) / (np.sqrt((all_vectors**2).sum(axis=1)) * np.sqrt((rows[q] ** 2).sum()))
        score[ids == q] = -2
        top = ids[np.lexsort((ids, -score))[:5]]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        assert all(r.score == pytest.approx(float(score[ids == r.vec_id][0]), abs=1e-12) for r in own)
        hit += len(set(top) & {r.vec_id for r in own})
    assert hit / len(got) >= 0.9


def test_a_group_multiplies_only_rows_in_visited_buckets():
    rows = pd.DataFrame({"bucket": [1, 1, 2, 3], "vec_id": [10, 11, 12, 13], "embedding": [[1.0, 0.0], [0.0, 1.0], [1.0, 0.1], [1.0, 0.0]]})
    queries = pd.DataFrame({"query_id": [0, 13], "buckets": [[1, 9], [2, 3]], "embedding": [[1.0, 0.0], [1.0, 0.0]]})
    got = nearest._search(2)(rows, queries)
    assert got.values.tolist() == [[0, 10, 1.0], [0, 11, 0.0], [13, 12, pytest.approx(1 / np.sqrt(1.01))]]
    assert not len(nearest._search(2)(rows, queries.iloc[:0])) and not len(nearest._search(2)(rows.iloc[:0], queries))


@pytest.mark.parametrize(("rows_at_once", "queries_at_once", "plan"), [(40, 2, 500_000), (64, 1, 0)])
def test_hot_buckets_are_searched_whole_in_pieces(spark, monkeypatch, rows_at_once, queries_at_once, plan):
    monkeypatch.setattr(nearest, "GROUP_ROWS", rows_at_once)
    monkeypatch.setattr(nearest, "GROUP_QUERIES", queries_at_once)
    monkeypatch.setattr(nearest, "PLAN_ROWS", plan)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6)) for i in range(200)] + [(1000 + i, np.ones(6)) for i in range(150)]
    got = {}
    for r in sorted(nearest.nearest(vector_frame(spark, rows)).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_distinct(rows, 50, 5)
    assert set(got) == set(want) and got[1000] == want[1000] == [1001, 1002, 1003, 1004, 1005]
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 5 * len(want)
