"""Wu-Manber search: an empty benchmark, the memory of a block, equal and colliding patterns."""

from __future__ import annotations

import random

import numpy as np

from tests.llm.test_operators import brute_hits, docs_of
from vigil.llm import decontaminate
from vigil.llm.hashing import ALNUM, words_of


def hashes_of(text):
    return next(words_of([text], ALNUM))[1]


def test_without_benchmark_nothing_is_hit(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, ["a b c", None, ""])
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.find_contamination(docs, none).collect()} == {(0, 3, 0, 0, False), (1, 0, 0, 0, False), (2, 0, 0, 0, False)}
    assert decontaminate.drop_contaminated(docs, none).count() == 3


def test_a_block_of_benchmark_text_takes_bounded_memory():
    rng = random.Random(4)
    items = [(str(i), " ".join(f"w{rng.randrange(30_000)}" for _ in range(500))) for i in range(300)]
    size = sum(len(t) for _, t in items)
    _, machines = decontaminate.searchers(items, 10)
    assert sum(m.held_bytes() for m in machines) < 12 * size


def test_many_items_with_one_passage_and_patterns_with_equal_ends():
    passage = " ".join(f"p{i}" for i in range(12))
    names, (machine,) = decontaminate.searchers([(str(i), passage) for i in range(50)] + [("x", "p0 p1 q q q q q q p8 p9"), ("y", "p0 p1 r r r r r r p8 p9")], 10)
    found = list(machine.search(hashes_of("z " + passage), "z " + passage))
    assert [s for s, _ in found] == [1, 2, 3] and all(sorted(names[i] for i in own) == sorted(map(str, range(50))) for _, own in found)
    text = "p0 p1 q q q q q q p8 p9 and p0 p1 s s s s s s p8 p9"
    assert [(s, [names[i] for i in own]) for s, own in machine.search(hashes_of(text), text)] == [(0, ["x"])]


def test_colliding_shift_slots_lose_nothing(monkeypatch):
    monkeypatch.setattr(decontaminate, "SLOTS", 0)
    rng = random.Random(9)
    items = [(str(i), " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 20)))) for i in range(200)]
    names, machines = decontaminate.searchers(items, 5)
    for _ in range(50):
        text = " ".join(rng.choice("abcdefgh") for _ in range(80))
        ids, hit = set(), set()
        for m in machines:
            for s, own in m.search(hashes_of(text), text):
                ids |= {names[i] for i in own}
                hit |= set(range(s, s + m.m))
        assert (80, len(hit), sorted(ids)) == brute_hits(text, items, 5)
    assert np.array_equal(machines[0].shift.shape, (256,))
