"""Byte-level BPE through the tiktoken library: whole texts to token ids, and ids to raw bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a text that the library splits at once, about; and the length of a run of white space from which it's set apart.
PART, BLANK_RUN = 1 << 16, 256
# White space as the library's patterns know it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Places that no match of the pattern reaches over, whatever stands around them: the end of a run of other letters before
#: white space, and the ends of runs of plain letters, digits and Chinese characters.
SAFE = re.compile(rf"[^{SPACE}](?=[{SPACE}])|[A-Za-z](?=[\x21-\x40])|[0-9](?=[\x21-\x2f\x3a-\x7e])|[一-龥](?=[、。！，：；？])")
BLANKS = re.compile(rf"[{SPACE}]{{{BLANK_RUN},}}")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """text in parts whose matches are those of the whole, and whether a part is one match itself.

    A long run of white space is one match, but for its last letter where other letters follow: the library's matcher
    tries the shorter runs one inside the other, and its stack ends at long ones."""
    at = 0
    for run in BLANKS.finditer(text):
        yield from ((x, False) for x in _cut(text, at, run.start()))
        at = run.end() - (run.end() < len(text))
        yield text[run.start() : at], True
    yield from ((x, False) for x in _cut(text, at, len(text)))


def _cut(text: str, at: int, end: int) -> Iterator[str]:
    """text[at:end] cut at the first safe place behind each PART letters; a match is never cut, however long it is."""
    while end - at > PART:
        safe = SAFE.search(text, at + PART - 1, end)
        if not safe or safe.end() >= end:
            break
        yield text[at : safe.end()]
        at = safe.end()
    if at < end:
        yield text[at:end]


class Encoder:
    """Ids of texts and bytes of ids, by a file of ranks and the pattern that splits texts before."""

    def __init__(self, ranks: bytes, pattern: str):
        held = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=held, special_tokens={})

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part, one in parts(text):
            ids += self.library._encode_single_piece(part) if one else self.library.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


@lru_cache(1)
def held_encoder(ranks: bytes, pattern: str) -> Encoder:
    """One encoder for each worker."""
    return Encoder(ranks, pattern)


def _shared(df: DataFrame, ranks: str | None, pattern: str | None):
    """The rank file's bytes and the pattern, broadcast: their size doesn't depend on the documents."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(ranks or default_ranks(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, tokens for each row of docs (doc_id, text): whole texts, without special tokens.

    Null and empty texts have no tokens; names of special tokens in a text are ordinary text. Repeated rows are encoded each;
    columns of docs besides those two don't matter. An empty table gives an empty result. ranks: a local file that the driver reads."""
    shared = _shared(docs, ranks, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = held_encoder(*shared.value)
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.array(encoder.encode(text) if isinstance(text, str) else [], np.int32)
                yield pd.DataFrame({"doc_id": [doc_id], "n_tokens": [len(ids)], "tokens": [ids]})

    return docs.select("doc_id", "text").mapInPandas(_rows_at_once(run, "tokens"), "doc_id long, n_tokens long, tokens array<int>")


def _rows_at_once(run, heavy: str, entries: int = 1 << 20):
    """The frames of run, put together until their arrays hold about so many entries."""

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in run(batches):
            held.append(frame)
            size += len(frame[heavy].iloc[0]) + 64
            if size > entries:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return grouped


def decode(rows: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """rows with a column bytes: the raw bytes of their tokens, which needn't be whole characters; none for null or empty tokens.

    A column bytes of rows is replaced, others stay. Repeated rows are decoded each; an empty table gives an empty result."""
    shared = _shared(rows, ranks, pattern)

    @F.pandas_udf("binary")
    def raw(tokens: pd.Series) -> pd.Series:
        encoder = held_encoder(*shared.value)
        return pd.Series([b"" if x is None else encoder.decode([int(i) for i in x]) for x in tokens])

    return rows.withColumn("bytes", raw("tokens"))


def digest(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256 (of the bytes that they decode to).

    Rows as in encode; null counts as empty."""
    shared = _shared(docs, ranks, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = held_encoder(*shared.value)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                ids = encoder.encode(text) if isinstance(text, str) else []
                out.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=pdf["doc_id"].to_numpy())[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
