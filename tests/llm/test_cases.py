"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from vigil.llm import decontaminate, html_text, language_id, licenses, near_dedup, nearest, quality, secrets
from vigil.llm import sentencepiece as sp
from vigil.llm.line_dedup import drop_repeated_lines, line_dedup_digest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, g string, keys array<int>, items string, spans string"
PROSE = " ".join(f"the word number {i} of a quiet story" for i in range(40))
LONG = "\n".join(" ".join(f"w{(i * 7 + j) % 5003}" for j in range(30)) for i in range(4000))


def nasty(spark):
    texts = [PROSE, PROSE, "", None, " \n\t ", "é", LONG, LONG + " end", "x" * 100_000, "a\0b", PROSE.upper(), "\n" * 500]
    rows = [(i, t, "en" if i % 2 else None, "s", 1, i, 0.5, "g", [1], "i", "s") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, PROSE, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), (5, "another text with id five", "de", "s", 1, 1, 1.0, "g", [], "", "")]
    return spark.createDataFrame(rows, SCHEMA)


def bench(spark):
    return spark.createDataFrame([(1, "quiet story the word number 7"), (None, "x"), (2, None), (1, "é")], "item_id long, text string")


OPERATORS = {
    "language": lambda s, d: language_id.identify_language(d),
    "quality": lambda s, d: quality.classify_quality(d),
    "contamination": lambda s, d: decontaminate.find_contamination(d, bench(s)),
    "near": lambda s, d: near_dedup.near_duplicates(d, 4),
    "tokens": lambda s, d: sp.digest(d),
    "lines": lambda s, d: line_dedup_digest(d),
    "secrets": lambda s, d: secrets.find_secrets(d),
    "licenses": lambda s, d: licenses.scan_licenses(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_returns_a_row_for_each_row(spark, name):
    docs = nasty(spark)
    got = OPERATORS[name](spark, docs).collect()
    key = lambda r: (r.doc_id is None, r.doc_id)
    assert sorted(map(key, got)) == sorted(map(key, docs.collect()))
    repeated = [tuple(r) for r in got if r.doc_id == 0]
    assert len(repeated) == 3 and len(set(repeated)) == 1
    empty = OPERATORS[name](spark, docs.where("false"))
    assert empty.count() == 0 and empty.columns == OPERATORS[name](spark, docs).columns


def test_near_groups_of_nasty_rows(spark):
    got = near_dedup.near_duplicates(nasty(spark), 4).collect()
    assert {r.component_id for r in got if r.doc_id in (0, 1, 10)} == {0}
    assert all(r.kept and r.n_shingles == 0 for r in got if r.doc_id in (2, 3, 4, 11))
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}


def test_language_of_texts_without_letters(spark):
    got = {r.doc_id: r for r in language_id.identify_language(nasty(spark)).collect() if r.doc_id is not None}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 11))
    none = language_id.identify_language(nasty(spark), nasty(spark).where("lang is null")).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = nasty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.where("false")):
            out = stage(spark, rows, str(tmp_path))
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
            assert out.count() <= rows.count()
    assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == docs.count()
    assert drop_repeated_lines(nasty(spark)).columns == nasty(spark).columns


@pytest.mark.parametrize("block_bytes", [8_000_000, 40])
def test_stages_leave_columns_named_like_their_own_alone(spark, tmp_path, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = ["__row", "__cuts", "__lines", "row_key", "_ROW_KEY", "cuts", "salt", "row", "lines", "component", "chosen", "start", "passage", "g", "spans", "items", "good", "posterior", "pattern"]
    docs = nasty(spark).select("doc_id", "text", "lang", "source", "n_chars", *(F.concat(F.lit(f"{c} of "), F.xxhash64("doc_id", "text").cast("string")).alias(c) for c in extra))
    given = {tuple(r[c] for c in extra) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        assert out.columns == docs.columns and rows and {tuple(r[c] for c in extra) for r in rows} <= given
    assert corpus_pipeline.tokens(spark, docs, str(tmp_path)).count() == docs.count()


def test_pipeline_runs_end_to_end(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "round_trip", "tokens"] and out.where("not round_trip").count() == 0 and out.count() > 50


def test_vectors_that_take_no_part(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.StringType()), T.StructField("score", T.StringType())])
    rows = [(0, [1.0, 0.0], "a", "b"), (1, [1.0, 1.0], None, None), (1, [1.0, 1.0], None, None), (2, None, None, None), (3, [0.0, 0.0], None, None), (4, [float("nan"), 1.0], None, None), (5, [None, 1.0], None, None), (6, [], None, None), (7, [float("inf"), 1.0], None, None), (None, [1.0, 0.5], None, None), (50, [0.0, 1.0], None, None)]
    frame = spark.createDataFrame(rows, schema)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest.nearest(frame).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert nearest.nearest(frame.where("false")).count() == 0


def test_pages_of_an_empty_table_and_extra_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "t", 5), (1, "u", "<p>a</p>", "t", 5)], "page_id long, url string, html string, text string, n_chars long")
    assert [r.text for r in html_text.extract_main_text(pages).collect()] == ["a", "a"]
    assert html_text.extract_main_text(pages.where("false")).count() == 0
