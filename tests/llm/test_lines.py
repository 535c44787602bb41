"""Winnowed fingerprints of lines: what they select, and that they only propose."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_lines, docs_of
from vigil.llm import line_dedup


def texts_with_repeats(seed=5, n=60):
    rng = random.Random(seed)
    pool = [" ".join(f"p{k}w{j}" for j in range(rng.randrange(1, 40))) for k in range(25)]
    out = []
    for _ in range(n):
        start = rng.randrange(20)
        out.append("\n".join([*rng.sample(pool, 2), "", *pool[start : start + rng.randrange(1, 6)], f"own {rng.random()}"]))
    return out


def test_a_passage_selects_its_least_line(spark):
    lines = line_dedup.lines_of(docs_of(spark, texts_with_repeats(n=12)))
    by_row = {}
    for r in sorted(lines.collect(), key=lambda r: r.i):
        by_row.setdefault(r.row, []).append(r)
    got = {(r.row, p.i): (r.g, r.gi) for r in line_dedup.fingerprints(lines).collect() for p in r.passages}
    want = {}
    for row, own in by_row.items():
        for r in own:
            if inside := shortest(own, r.i - 1, line_dedup.PASSAGE_WORDS):
                least = min(inside, key=lambda x: (x.w < line_dedup.LINE_WORDS, x.h, x.i))
                want[row, r.i] = (least.h, least.i)
    assert got == want


def test_winnowing_selects_few_lines_of_a_long_text(spark):
    """Lines of nine words: a passage has six, so a window of six selects two in seven."""
    rng = random.Random(8)
    docs = docs_of(spark, ["\n".join(" ".join(f"w{rng.randrange(10**9)}" for _ in range(9)) for _ in range(2000)) for _ in range(3)])
    lines = line_dedup.lines_of(docs)
    assert 0.2 < line_dedup.fingerprints(lines).count() / lines.count() < 0.35
    assert line_dedup.candidates(line_dedup.fingerprints(lines)).count() == 0


def test_the_documents_table_is_thinned(spark):
    lines = line_dedup.staged(line_dedup.lines_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    marks = line_dedup.staged(line_dedup.fingerprints(lines))
    passages = marks.select(F.sum(F.size("passages"))).head()[0]
    kept = line_dedup.candidates(marks).count()
    constant = line_dedup.candidates(marks.withColumn("g", F.lit(1).cast("long"))).count()
    assert marks.count() < 0.75 * passages and 0 < kept < 0.5 * passages and constant == passages


def shortest(own, at, words):
    total = 0
    for j in range(at, len(own)):
        total += own[j].w
        if total >= words:
            return own[at : j + 1]
    return None


def test_a_constant_fingerprint_proposes_more_and_loses_nothing(spark, monkeypatch):
    texts = texts_with_repeats() + [f"only {i} " + " ".join(f"u{i}x{j}" for j in range(60)) for i in range(20)]
    docs = docs_of(spark, texts)
    real = line_dedup.fingerprints
    marks = real(line_dedup.lines_of(docs))
    passages = marks.select(F.sum(F.size("passages"))).head()[0]
    assert 0 < line_dedup.candidates(marks).count() < passages
    monkeypatch.setattr(line_dedup, "fingerprints", lambda lines: real(lines).withColumn("g", F.lit(1).cast("long")))
    assert line_dedup.candidates(line_dedup.fingerprints(line_dedup.lines_of(docs))).count() == passages
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()} == brute_lines(list(enumerate(texts)))


def test_repeats_are_lost_without_their_fingerprints(spark, monkeypatch):
    """Runs grow from selected lines only: with other lines selected at each place, nothing is found."""
    texts = texts_with_repeats()
    real = line_dedup.fingerprints
    monkeypatch.setattr(line_dedup, "fingerprints", lambda lines: real(lines).withColumn("g", F.xxhash64("row", "gi")))
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs_of(spark, texts)).collect()} == dict(enumerate(texts))


def test_equal_hashes_of_different_passages_cut_nothing(spark, monkeypatch):
    """Every passage has one hash: places are proposed wrongly, and lines that differ aren't cut."""
    real = line_dedup.fingerprints
    monkeypatch.setattr(line_dedup, "fingerprints", lambda lines: real(lines).withColumns({"passages": F.transform("passages", lambda p: F.struct(p["i"].alias("i"), F.lit(1).cast("long").alias("passage"))), "g": F.lit(1).cast("long")}))
    texts = ["\n".join(" ".join(f"t{i}l{k}w{j}" for j in range(30)) for k in range(4)) for i in range(8)]
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs_of(spark, texts)).collect()} == dict(enumerate(texts))


@pytest.mark.parametrize("hot", [3, 11])
def test_hot_keys_are_dealt_over_tasks_with_the_same_result(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot)
    texts = texts_with_repeats(seed=6)
    texts += ["\n".join(texts[0].split("\n") + [f"own tail {i}"]) for i in range(20)]
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs_of(spark, texts)).collect()} == brute_lines(list(enumerate(texts)))
