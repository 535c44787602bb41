"""Unigram scores: ids equal the sentencepiece library's on models that are put together here (none is trained)."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest

from vigil.llm import sentencepiece as sp

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a", "a  b", "<s> hi</s>", "日本語 😀 \0 tab\t\n\nnew", "x" * 500, " " * 40 + "z", "a" + " " * 17 + "b   ", "<0x41>", "<unk>", "\n a \n", "　a　", "é é ﬁ", "a▁b", "▁", "b▁ ", "%%% &&& %%%", "漢字 ҈҈"]


def varint(x):
    out = b""
    while True:
        out += bytes([x & 127 | (128 if x > 127 else 0)])
        x >>= 7
        if not x:
            return out


def field(n, v):
    if isinstance(v, bytes):
        return varint(n << 3 | 2) + varint(len(v)) + v
    return varint(n << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else varint(n << 3) + varint(v)


def unigram_model(pieces, remove_spaces, byte_fallback=True):
    """A unigram model file: the installed model's pieces with scores by rank and length."""
    out = b""
    for rank, (piece, _, kind) in enumerate(pieces):
        score = -math.log(rank + 2) - 2 / (1 + len(piece)) if kind == sp.NORMAL else 0.0
        out += field(1, field(1, piece.encode()) + field(2, float(score)) + field(3, kind))
    out += field(2, field(3, sp.UNIGRAM) + field(35, int(byte_fallback)) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, (1 << 64) - 1))
    return out + field(3, field(1, b"identity") + field(2, b"") + field(3, 1) + field(4, int(remove_spaces)) + field(5, 1))


@pytest.mark.parametrize("remove_spaces", [False, True])
@pytest.mark.parametrize("size", [32000, 800])
@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_ids_and_texts_equal_the_library(spark, remove_spaces, size, byte_fallback):
    import sentencepiece

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text] + ODD
    pieces = [x for x in sp.Model.parse(open(sp.default_model(), "rb").read()).pieces if byte_fallback or x[2] != sp.BYTE][:size]
    pieces += [(p, 0.0, sp.NORMAL) for p in (sp.SPACE, "a", "e") if p not in {x[0] for x in pieces}]
    raw = unigram_model(pieces, remove_spaces, byte_fallback)
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    encoder = sp.Encoder(raw)
    want = library.encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)] == want
    assert [encoder.lattice.encode(encoder.normalize(t)) for t in texts[:20]] == [np.array(x, "<i4").tobytes() for x in want[:20]]
    if byte_fallback:
        assert [encoder.decode(x) for x in want] == library.decode(want)


def test_pieces_that_span_words_are_segmented_by_the_lattice():
    import sentencepiece

    pieces = [("<unk>", 0.0, sp.UNKNOWN), ("<s>", 0.0, sp.CONTROL), ("</s>", 0.0, sp.CONTROL), *((p, 0.0, sp.NORMAL) for p in ("▁new▁york", "▁new", "▁", "n", "e", "w", "y", "o", "r", "k", "ork"))]
    raw = unigram_model(pieces, False, False)
    texts = ["new york", "york new york!", "new  york", "!!! ?"]
    assert [np.frombuffer(x, "<i4").tolist() for x in sp.Encoder(raw).encode(texts)] == sentencepiece.SentencePieceProcessor(model_proto=raw).encode(texts)
