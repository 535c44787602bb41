"""Byte-level BPE: parts of long texts against the library on whole texts, digests, and raw bytes back."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import public_tokenizers
from tests.llm.test_cases import nasty
from vigil.llm import byte_bpe


@pytest.fixture(scope="module")
def encoder():
    with open(byte_bpe.default_ranks(), "rb") as f:
        return byte_bpe.Encoder(f.read(), public_tokenizers.PATTERN)


def test_parts_have_the_matches_of_the_whole(encoder, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART", 7)
    monkeypatch.setattr(byte_bpe, "BLANKS", re.compile(rf"[{byte_bpe.SPACE}]{{5,}}"))
    rng = random.Random(1)
    letters = ["a", "B", "'s", "'", "1", " ", "  ", "\n", "\t", "é", "漢", "。", "，", "!", "?", " ", "🙂", "\x1c", "\x85", "don't", "ß", "ǅ", "٣", "²", "_", "-", "ab12", "　", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))).replace("B", " " * rng.randint(0, 9))
        ids = encoder.encode(text)
        assert ids == encoder.library.encode_ordinary(text), text
        assert "".join(p for p, _ in byte_bpe.parts(text)) == text and encoder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 300_000, "ab" * 300_000, "漢字" * 100_000, "a " * 300_000, "hello, world; " * 100_000])
def test_very_long_texts_are_encoded_whole(encoder, text):
    assert encoder.decode(encoder.encode(text)) == text.encode()


def test_queries_rows(spark, encoder):
    docs = nasty(spark)
    want = []
    for r in docs.collect():
        ids = encoder.library.encode_ordinary(r.text or "")
        want.append((r.doc_id is None, r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [(r.doc_id is None, *r) for r in byte_bpe.digest(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert byte_bpe.digest(docs.where("false")).count() == 0


def test_tokens_go_back_to_raw_bytes(spark, encoder):
    docs = nasty(spark)
    coded = byte_bpe.encode(docs)
    assert all(r.n_tokens == len(r.tokens) for r in coded.collect())
    texts = sorted((r.text or "").encode() for r in docs.collect())
    assert sorted(bytes(r.bytes) for r in byte_bpe.decode(coded).collect()) == texts
    half = encoder.encode("漢")[:1]
    rows = spark.createDataFrame([(1, half, "kept"), (2, None, None), (3, [], None)], "id long, tokens array<int>, bytes string")
    back = {r.id: bytes(r.bytes) for r in byte_bpe.decode(rows).collect()}
    assert back[1] == encoder.decode(half) and not back[2] and not back[3]
    assert byte_bpe.encode(docs.where("false")).count() == 0
