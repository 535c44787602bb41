"""Collocations against plain loops: shards of all sizes, repeats inside a phrase, ties, and the index by itself."""

from __future__ import annotations

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from tests.llm.test_cases import nasty
from vigil.llm import collocations as co
from vigil.llm.oracles import OP13

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000, least=30):
    f, n, out = collections.defaultdict(collections.Counter), collections.Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang in n:
        found = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        inside = {q[i : i + k] for q, b in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 80 * found[q[i : i + k]]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, _, left, right = min((2000000 * a // (f[lang][p[:k]] + f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def rows_of(seed, texts, words):
    rng = random.Random(seed)
    known = ["a", "b", "Cc", "d\0", "é", "ΣΑΣ", "\xa0x", "e-f"] + [f"w{i}" for i in range(30)]
    ends = [" ", " ", " ", " ", " ", " ", "  ", "\t", ". ", "\n", ", ", " ; ", "?!", "\r\n", "\x0b"]
    weights = [1 / (i + 1) for i in range(len(known))]
    return [(rng.choice(["en", "en", "de", None]), "".join(rng.choices(known, weights)[0] + rng.choice(ends) for _ in range(rng.randint(0, words)))) for _ in range(texts)]


@pytest.mark.parametrize(("shard_words", "top"), [(1_000_000, 2000), (50, 2000), (1, 15)])
def test_phrases_equal_brute_force(spark, shard_words, top):
    rows = rows_of(shard_words, 120, 500) + [(None, None), ("xx", ""), ("en", "a a a a a a " * 60), ("en", "b " * 31 + "\n" + "B " * 35)]
    frame = spark.createDataFrame([(i, x, t, 1) for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string, n long").repartition(3)
    got = sorted(tuple(r) for r in co.collocations(frame, top, shard_words).collect())
    assert got == brute(rows, top) and len(got) > 20


def test_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}'")
    cursor = con.execute(OP13)
    want = sorted(cursor.fetchall())
    frame = co.collocations(spark.read.parquet(path))
    assert [c[0] for c in cursor.description] == frame.columns
    assert sorted(tuple(r) for r in frame.collect()) == want


def test_nasty_rows_and_empty_tables(spark):
    docs = nasty(spark)
    assert sorted(tuple(r) for r in co.collocations(docs).collect()) == brute([(r.lang, r.text) for r in docs.collect()])
    assert co.collocations(docs.where("false")).count() == 0


def test_both_ways_of_an_index_agree():
    rng = np.random.default_rng(2)
    ids = np.concatenate([[0], np.where(rng.random(3000) < 0.1, 0, rng.integers(1, 12, 3000)), [0]])
    index = co.Index(co.transform(ids), co.transform(ids[::-1]))
    words = index.words()
    pairs = index.right(words)
    for longer, k in ((pairs, 2), (index.left(words), 2), (index.right(pairs), 3), (index.both(pairs), 3), (index.both(index.both(pairs)), 4)):
        want = collections.Counter(tuple(ids[i : i + k]) for i in range(len(ids) - k + 1) if (ids[i : i + k] > 0).all())
        assert dict(zip(map(tuple, longer.words), longer.n, strict=True)) == want
    order = co._order(ids)
    for p in (pairs, index.both(pairs)):
        k = p.words.shape[1]
        for row, lo, n in zip(p.words, p.lo, p.n, strict=True):
            assert all((np.take(ids, range(at, at + k), mode="wrap") == row).all() for at in order[lo : lo + n])
