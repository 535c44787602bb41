"""Licence scans by a positional index of rare licence words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.decontaminate import words

#: Fixed phrases and their labels; a place of one is a base place.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices by label: text, and a phrase that must stand in the file near the notice.
TEMPLATES = (
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "permission is hereby granted free of charge"),
    ("apache", "Licensed under the Apache License, Version 2.0", "apache license"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "in compliance with the license"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "general public license"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "general public license"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public license"),
    ("agpl", "GNU Affero General Public License as published by the Free Software Foundation", "affero general public license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "attribution noncommercial"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "attribution sharealike"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal", "cc0"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("proprietary", "All rights reserved", "all rights reserved"),
)
#: Share of a template's weight that must align, words that may lie between it and its phrase.
LEAST_SHARE, NEAR = 0.6, 40


@dataclass
class RareWordIndex:
    """Postings (template, position) of template words, with each word's inverse document frequency."""

    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    sizes: list[list[bytes]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    phrases: list[list[bytes]] = field(default_factory=list)
    anchors: list[set[bytes]] = field(default_factory=list)
    base: list[tuple[list[bytes], str]] = field(default_factory=list)

    @classmethod
    def build(cls, frequency: dict[bytes, int], files: int) -> RareWordIndex:
        out = cls({w: math.log((files + 1) / (frequency.get(w, 0) + 1)) + 1e-3 for w in vocabulary()})
        for i, (_, text, phrase) in enumerate(TEMPLATES):
            own = words(text)
            for at, w in enumerate(own):
                out.postings[w].append((i, at))
            out.sizes.append(own)
            out.weights.append(sum(out.idf[w] for w in own))
            out.phrases.append(words(phrase))
            out.anchors.append(out.anchors_of(own, out.weights[-1]))
        out.base = [(words(p), label) for p, label in BASE]
        return out

    def anchors_of(self, own: list[bytes], weight: float) -> set[bytes]:
        """A template's rarest words, until the others alone can't carry LEAST_SHARE: an alignment that does has one of them."""
        out, rest = set(), weight
        for w in sorted(set(own), key=lambda w: (-self.idf[w], w)):
            if rest < LEAST_SHARE * weight * (1 - 1e-9):
                break
            out.add(w)
            rest -= self.idf[w] * own.count(w)
        return out

    def places(self, text: list[bytes], phrase: list[bytes], low: int = 0, high: int | None = None) -> list[int]:
        """Starts of a phrase in text[low:high], looked up by its rarest word."""
        k = max(range(len(phrase)), key=lambda i: self.idf.get(phrase[i], 0))
        out, at, high = [], low + k, len(text) if high is None else min(high, len(text))
        while True:
            try:
                at = text.index(phrase[k], at, high)
            except ValueError:
                return out
            if text[at - k : at - k + len(phrase)] == phrase:
                out.append(at - k)
            at += 1

    def scan(self, text: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """(base places, base labels, all labels, best aligned share)."""
        present = set(text) & self.idf.keys()
        found: list[int] = []
        base: set[str] = set()
        for phrase, label in self.base:
            if present.issuperset(phrase) and (at := self.places(text, phrase)):
                found += at
                base.add(label)
        labels, best = set(base), 1.0 if base else 0.0
        # A template whose key phrase has a word that the file lacks can't be verified.
        possible = {i for i, phrase in enumerate(self.phrases) if present.issuperset(phrase)}
        if not possible:
            return sorted(found), base, labels, best
        wanted: dict[bytes, list[tuple[int, int]]] = {}
        for i in possible:
            for w in self.anchors[i] & present:
                wanted.setdefault(w, []).extend(x for x in self.postings[w] if x[0] == i)
        votes: set[tuple[int, int]] = set()
        for at, w in enumerate(text):
            if w in wanted:
                votes.update((template, at - place) for template, place in wanted[w])
        for template, shift in votes:
            own = self.sizes[template]
            share = sum(self.idf[w] for i, w in enumerate(own) if 0 <= shift + i < len(text) and text[shift + i] == w) / self.weights[template]
            if share >= LEAST_SHARE and (share > best or TEMPLATES[template][0] not in labels) and self.places(text, self.phrases[template], max(0, shift - NEAR), shift + len(own) + NEAR):
                labels.add(TEMPLATES[template][0])
                best = max(best, share)
        return sorted(found), base, labels, min(best, 1.0)


def vocabulary() -> set[bytes]:
    return {w for _, text, phrase in TEMPLATES for w in words(text) + words(phrase)} | {w for p, _ in BASE for w in words(p)}


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = vocabulary()
    counts: Counter[bytes] = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            counts.update(known.intersection(words(text)))
            counts[b""] += 1
    if counts:  # an empty frame has no type of text, and a task without documents would fail by it
        yield pd.DataFrame({"word": [w.decode() for w in counts], "n": list(counts.values())})


def _scan(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = RareWordIndex.build(*shared.value)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                w = words(text)
                found, base, labels, score = index.scan(w)
                out.append((doc_id, len(w), len(found), found[0] if found else None, found[-1] if found else None, ",".join(sorted(base)), ",".join(sorted(labels)), score))
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pd.DataFrame(out, columns=names).astype({"first_word": "Int64", "last_word": "Int64"})

    return run


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs (doc_id, text).

    Words as in benchmark search. One pass counts, over all documents, in how many each licence word stands
    (the vocabulary is fixed, so these counts are bounded); another looks up, for each template whose key
    phrase a file may hold, the template's rarest words, aligns it by relative position, and takes it if its
    aligned words carry LEAST_SHARE of its inverse document frequencies and its key phrase stands near. Rarest
    words are as many as leave less than LEAST_SHARE to the others, so no such alignment is left out. Base phrases are looked up by their
    rarest word; their places are all counted, and their labels have score 1.

    Null texts have no words: no labels, score 0, null places. Repeated rows are scanned each; an empty table
    gives an empty result."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.select("text").mapInPandas(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = {r.word.encode(): r.n for r in counted}
    files = frequency.pop(b"", 0)
    shared = docs.sparkSession.sparkContext.broadcast((frequency, files))
    return rows.mapInPandas(_scan(shared), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
