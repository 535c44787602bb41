"""SentencePiece encoding and decoding on the tokenizers library, from the model file alone."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters taken at once, words in one text for the tokenizer, words held, and threads in each Python worker.
BATCH_CHARS, GROUP_WORDS, WORDS, THREADS = 1_000_000, 2000, 120_000, 2


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message; length-delimited and fixed values as bytes."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


@dataclass
class Model:
    """What encoding needs of a model file: pieces with scores and kinds, model type and normaliser switches."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    normalizer: str = ""
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        m = cls()
        for number, value in _fields(raw):
            if number == 1:
                d = dict(_fields(value))
                m.pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif number == 2:
                d = dict(_fields(value))
                m.model_type, m.byte_fallback = d.get(3, UNIGRAM), bool(d.get(35, 0))
            elif number == 3:
                d = dict(_fields(value))
                m.normalizer, m.charsmap = d.get(1, b"").decode(), d.get(2, b"")
                m.dummy_prefix, m.remove_extra_spaces, m.escape_spaces = bool(d.get(3, 1)), bool(d.get(4, 1)), bool(d.get(5, 1))
        return m

    def merges(self) -> list[tuple[str, str]]:
        """All splits of each piece into two pieces, best score first. Runs of the space mark share one score and
        so grow from the left, for which the longest comes first."""
        known = {p for p, _, kind in self.pieces if kind in (NORMAL, USER, UNUSED)}
        out, runs = [], []
        for rank, (p, score, kind) in enumerate(self.pieces):
            if kind != NORMAL or len(p) < 2:
                continue
            if not p.strip(SPACE):
                runs += [(-len(p), -i, (p[:i], p[i:])) for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
                continue
            out += [(-score, rank, i, (p[:i], p[i:])) for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
        return [x[-1] for x in sorted(out)] + [x[-1] for x in sorted(runs)]

    def tokenizer(self) -> Tokenizer:
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        if self.model_type == BPE:
            t = Tokenizer(models.BPE(ids, self.merges(), unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback))
        elif self.model_type == UNIGRAM:
            t = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], unknown, self.byte_fallback))
        else:
            raise ValueError(f"model type {self.model_type} isn't supported")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra_spaces:
            steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(SPACE if self.escape_spaces else " "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", SPACE))
            if self.remove_extra_spaces:  # marks at the end go, a text's own among them
                steps.append(normalizers.Replace(Regex(f"{SPACE}+\\z"), ""))
        t.normalizer = normalizers.Sequence(steps)
        # No piece goes on past a space mark once it has begun with another character, so words can be cut before their marks.
        if not any(SPACE in p.lstrip(SPACE) for p, _, kind in self.pieces if kind == NORMAL):
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), "isolated")
        t.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return t


class Lattice:
    """Best segmentation by unigram scores, in single precision and with the ties of the library that models are made for.

    It decides where the tokenizers library, which adds in double precision, can't: near ties, and text that spells special pieces."""

    def __init__(self, model: Model):
        kinds = {kind: [s for _, s, k in model.pieces if k == kind] for kind in (NORMAL, USER)}
        most = max(kinds[NORMAL], default=0.0)
        self.scores = {p: (i, np.float32(len(p.encode()) * most - 0.1 if kind == USER else s)) for i, (p, s, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
        self.longest = max(map(len, self.scores), default=1)
        self.unknown = next((i for i, x in enumerate(model.pieces) if x[2] == UNKNOWN), 0)
        self.penalty = np.float32(np.float32(min(kinds[NORMAL], default=0.0)) - np.float32(10))
        self.bytes = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE} if model.byte_fallback else {}
        special = [p for p, _, kind in model.pieces if kind not in (NORMAL, UNUSED)]
        self.special = re.compile("|".join(re.escape(p) for p in special) or r"(?!)")

    def _steps(self, text: str, start: int) -> list[tuple[int, int, np.float32]]:
        found = [(start + n, *self.scores[p]) for n in range(1, min(self.longest, len(text) - start) + 1) if (p := text[start : start + n]) in self.scores]
        return found if found and found[0][0] == start + 1 else [*found, (start + 1, self.unknown, self.penalty)]

    def encode(self, text: str) -> bytes:
        best: list[tuple[np.float32, int, int] | None] = [(np.float32(0), 0, 0), *[None] * len(text)]
        for start in range(len(text)):
            for end, piece, score in self._steps(text, start):
                if best[end] is None or score + best[start][0] > best[end][0]:
                    best[end] = (score + best[start][0], start, piece)
        ids, end = [], len(text)
        while end:
            _, start, piece = best[end]
            if piece != self.unknown:
                ids.append(piece)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(text[start:end].encode("utf-8", "replace"))]
            elif not ids or ids[-1] != self.unknown:
                ids.append(piece)
            end = start
        return np.array(ids[::-1], "<i4").tobytes()

    def margin(self, text: str) -> tuple[float, float]:
        """The best score, and how far the second best segmentation lies behind it."""
        top = [(0.0, -np.inf), *[(-np.inf, -np.inf)] * len(text)]
        for start in range(len(text)):
            for end, _, score in self._steps(text, start):
                top[end] = tuple(sorted((*top[end], *(x + float(score) for x in top[start])))[:1:-1])
        return top[-1][0], top[-1][0] - top[-1][1]


class Encoder:
    """A tokenizer with the words that it has met.

    Unigram scores: a text in which a word's two best segmentations are nearer than single precision tells apart is
    decided by `Lattice`, as are texts that spell a special piece and models whose pieces span words.

    Where no piece spans words, texts are normalised and cut before their space marks, each new word is
    encoded once, and a text's ids are its words' ids joined. At most WORDS words are held."""

    def __init__(self, raw: bytes):
        self.model = Model.parse(raw)
        m, self.tokenizer = self.model, self.model.tokenizer()
        self.by_words = self.tokenizer.pre_tokenizer is not None
        self.plain = not m.charsmap and not m.remove_extra_spaces and m.dummy_prefix and m.escape_spaces
        # Texts are normalised before they are cut.
        self.normalizer, self.tokenizer.normalizer = (self.tokenizer.normalizer, normalizers.Sequence([])) if self.by_words or m.model_type == UNIGRAM else (None, self.tokenizer.normalizer)
        self.begins = np.array([p.startswith(SPACE) and kind != BYTE for p, _, kind in m.pieces])
        self.bytes = [bytes([int(p[3:-1], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, _, kind in m.pieces]
        self.held: dict[str, bytes] = {}
        self.lattice = Lattice(m) if m.model_type == UNIGRAM else None
        self.margins: dict[str, tuple[float, float]] = {}

    def normalize(self, text: str) -> str:
        if self.plain:
            return SPACE + text.replace(" ", SPACE) if text else ""
        return self.normalizer.normalize_str(text)

    def learn(self, words: set[str]) -> None:
        """Encode words: those with one leading mark many to a text, the others each by itself (all, for unigram scores)."""
        if self.lattice:
            for w, e in zip(words, self.tokenizer.encode_batch_fast(list(words), add_special_tokens=False), strict=True):
                self.held[w] = np.array(e.ids, "<i4").tobytes()
                self.margins[w] = (0.0, -np.inf) if self.lattice.special.search(w) else self.lattice.margin(w)
            return
        simple = [w for w in words if w[0] == SPACE and w[1:2] != SPACE]
        other = [w for w in words if w[0] != SPACE or w[1:2] == SPACE]
        groups = [simple[i : i + GROUP_WORDS] for i in range(0, len(simple), GROUP_WORDS)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<i4")
            cuts = np.flatnonzero(self.begins[ids])
            ends = np.append(cuts[1:], len(ids)) * 4
            joined = ids.tobytes()
            self.held.update(zip(group, (joined[a:b] for a, b in zip((cuts * 4).tolist(), ends.tolist(), strict=True)), strict=True))
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.held[w] = np.array(e.ids, "<i4").tobytes()

    def _sure(self, words: list[str]) -> bool:
        """Whether no word's best segmentation is as near to another as single precision is coarse over the text's score."""
        score = sum(self.margins[w][0] for w in words)
        return min((self.margins[w][1] for w in words), default=1.0) > 32 * float(np.spacing(np.float32(abs(score) + 1)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_words and self.lattice:
            return [self.lattice.encode(self.normalize(t)) for t in texts]
        if not self.by_words:
            return [np.array(e.ids, "<i4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        words = [_WORDS.findall(self.normalize(t)) for t in texts]
        new = set().union(*words) - self.held.keys()
        if len(self.held) + len(new) > WORDS:
            self.held.clear()
            self.margins.clear()
            new = set().union(*words)
        self.learn(new)
        joined = [b"".join(map(self.held.__getitem__, w)) for w in words]
        return [x if self._sure(w) else self.lattice.encode("".join(w)) for x, w in zip(joined, words, strict=True)] if self.lattice else joined

    def decode(self, ids: bytes | np.ndarray | list[int]) -> str:
        """The text of ids: pieces with marks as spaces, byte pieces as bytes, without the leading space that encoding adds."""
        ids = np.frombuffer(ids, "<i4") if isinstance(ids, bytes) else np.asarray(ids, np.int64)
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw[1 if self.model.dummy_prefix and raw[:1] == b" " else 0 :].decode("utf-8", "replace")


_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_held: dict[str, Encoder] = {}


def held_encoder(raw: bytes) -> Encoder:
    """The encoder of a model, built once in each Python worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _held:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        _held[key] = Encoder(raw)
    return _held[key]


def default_model() -> str:
    """The installed public BPE model with byte fallback; pass another path to use another model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of BATCH_CHARS characters together, or of one text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > BATCH_CHARS:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _encode(shared, check: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = held_encoder(shared.value)
        for pdf in batches:
            texts = [x if isinstance(x, str) else "" for x in pdf["text"]]
            for a, b in _groups(texts):
                ids = encoder.encode(texts[a:b])
                out = pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].to_numpy(), "n_tokens": [len(x) // 4 for x in ids]})
                out["round_trip"] = [encoder.decode(x) == y for x, y in zip(ids, texts[a:b], strict=True)]
                if check:
                    out["tokens_sha256"] = [hashlib.sha256(x).hexdigest() for x in ids]
                else:
                    out["tokens"] = [np.frombuffer(x, "<i4") for x in ids]
                yield out
        encoder.held.clear()  # the worker may go on with other work

    return run


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, round_trip, tokens for each row of docs (doc_id, text): whole texts, no special tokens.

    round_trip: decoding the tokens gives the text back.

    Null and empty texts have no tokens. Special tokens' names in a text are ordinary text. Repeated rows are
    encoded each; an empty table gives an empty result. The driver reads the model file and broadcasts it
    (its size doesn't depend on the documents)."""
    raw = open(model or default_model(), "rb").read()
    return docs.select("doc_id", "text").mapInPandas(_encode(docs.sparkSession.sparkContext.broadcast(raw), False), "doc_id long, n_tokens long, round_trip boolean, tokens array<int>")


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, tokens_sha256 (of little-endian 32-bit ids), round_trip: decoding gives the text back."""
    raw = open(model or default_model(), "rb").read()
    return docs.select("doc_id", "text").mapInPandas(_encode(docs.sparkSession.sparkContext.broadcast(raw), True), "doc_id long, n_tokens long, round_trip boolean, tokens_sha256 string")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """rows with a column text decoded from tokens; null or empty tokens give an empty text.

    A column text of rows is replaced; other columns stay. Repeated rows are decoded each; an empty table gives an empty result."""
    raw = open(model or default_model(), "rb").read()
    shared = rows.sparkSession.sparkContext.broadcast(raw)

    @F.pandas_udf("string")
    def text(tokens: pd.Series) -> pd.Series:
        return pd.Series([held_encoder(shared.value).decode([] if x is None else x) for x in tokens])

    return rows.withColumn("text", text("tokens"))
