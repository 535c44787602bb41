"""One row of each group of near duplicates, by row and not by id."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import near_dedup
from vigil.llm.hashing import mix
from vigil.llm.near_dedup import keep_one_of_each, near_duplicates

A, B = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")


def test_a_stage_keeps_a_row_of_each_group_whatever_ids_do(spark):
    rows = [(1, A, "x"), (5, A, "y"), (5, B, "z"), (None, A, "n"), (None, A, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component long_id".replace("component long_id", "component string"))
    marks = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert marks == {(1, 1, True), (5, 1, False), (5, 5, True), (None, 1, False)}
    assert sorted(map(tuple, keep_one_of_each(docs).collect())) == [(1, A, "x"), (5, B, "z")]


def test_groups_without_ids_and_repeated_rows_keep_one(spark):
    rows = [(None, A, 1), (None, A + " tail", 2), (None, A, 3), (7, B, 1), (7, B, 1), (8, None, 1), (8, None, 1), (9, " ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = keep_one_of_each(docs).collect()
    assert len([r for r in got if r.text and r.text.startswith("a0")]) == 1
    assert len([r for r in got if r.text == B]) == 1 and len([r for r in got if r.doc_id in (8, 9)]) == 3
    assert keep_one_of_each(docs.where("false")).count() == 0


def test_a_hot_repeated_row_meets_its_near_copy_once(spark):
    rows = [(1, A)] * 200 + [(2, A + " tail")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 201 and {r.component_id for r in got} == {1}


def classes_of(spark, sets, bucket=None):
    """Classes of sets of numbers; all in one bucket if there is one."""
    rows = []
    for i, own in enumerate(sets):
        signature = near_dedup.minmax_signature(mix(np.array(sorted(own), np.uint64)))
        keys = [bucket] if bucket is not None else near_dedup.band_keys(signature).tolist()
        rows.append((i, keys, near_dedup.sketch(signature).tolist()))
    return spark.createDataFrame(rows, "node long, keys array<long>, sketch array<long>")


def closed(ties):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for r in ties.collect():
        top[find(r.a)] = find(r.b)
    return find


@pytest.mark.parametrize("block", [1024, 7])
def test_links_are_tied_though_their_buckets_least_class_is_unlike_them(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_SKETCHES", block)
    rng = np.random.default_rng(3)
    fresh = iter(range(1, 10_000_000))
    take = lambda n: {next(fresh) for _ in range(n)}
    shared = take(200)
    sets = [shared | take(140)]
    for distance in rng.permutation(np.repeat([2, 8, 20, 40], 6)):
        middle = shared | take(140)
        kept = set(sorted(middle)[: len(middle) - int(distance)])
        sets += [middle, kept | take(int(distance) // 4)]
    linked = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(a & b) >= 80 * len(a | b)]
    assert len(linked) >= 20
    find = closed(near_dedup.candidate_ties(classes_of(spark, sets, bucket=5)))
    assert all(find(i) == find(j) for i, j in linked)
    assert len({find(i) for i in range(len(sets))}) >= 20


def test_sets_that_share_a_half_are_no_longer_one_group(spark):
    """Boilerplate of two thirds of each page: similarity a half, which shares a bucket nearly every other time."""
    sets = [set(range(200)) | set(range(1000 * i, 1000 * i + 100)) for i in range(1, 121)]
    classes = classes_of(spark, sets).cache()
    shared = classes.select(F.explode("keys").alias("bucket"), "node").groupBy("bucket").agg(F.min("node").alias("a"), F.collect_list("node").alias("all")).select("a", F.explode("all").alias("b"))
    before, after = (max(Counter(find(i) for i in range(len(sets))).values()) for find in (closed(shared), closed(near_dedup.candidate_ties(classes))))
    assert before >= 100 and after <= 12, (before, after)


def test_agreement_of_sketches_follows_similarity(spark):
    for shared, own in ((80, 10), (60, 20), (1, 1), (3, 0)):
        sets = [set(range(10**6 * i, 10**6 * i + shared)) | set(range(10**6 * i + 1000 * (j + 1), 10**6 * i + 1000 * (j + 1) + own)) for i in range(150) for j in (0, 1)]
        rows = classes_of(spark, sets)
        a, b = (rows.where(f"node % 2 = {j}").select((F.col("node") / 2).cast("long").alias("pair"), F.col("sketch").alias(f"s{j}")) for j in (0, 1))
        equal = [r[0] for r in a.join(b, "pair").select(near_dedup.agreement(F.col("s0"), F.col("s1"))).collect()]
        true = shared / (shared + 2 * own)
        assert abs(np.mean(equal) - near_dedup.expected(true)) <= 4 and min(equal) >= near_dedup.expected(true, -7), (shared, own, np.mean(equal), min(equal))
