"""Operators on tables some of whose tasks have no rows."""

from __future__ import annotations

from vigil.llm import licenses


def test_license_scan_with_tasks_without_documents(spark):
    one = spark.createDataFrame([(7, "under the MIT License")], "doc_id long, text string")
    got = licenses.scan_licenses(one.repartition(3)).collect()
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.base_labels) for r in got] == [(7, 4, 1, 2, "mit")]
    assert licenses.scan_licenses(one.where("doc_id < 0").repartition(3)).count() == 0
