"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import hashed_share

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 16, 192
#: Bounds of the training sample: labelled documents of each language (lowest hashes), and windows of each, drawn from its whole text.
TRAIN_DOCS, TRAIN_WINDOWS = 1000, 3
EPOCHS, BATCH, RATE = 12, 64, 0.01
_CHUNK = 512
#: Upper-case ASCII is folded; control characters and digits carry no language and become blanks.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else 32 if b < 32 or 48 <= b <= 57 else b for b in range(256)], np.uint8)
_LETTER = np.array([b >= 128 or 97 <= b <= 122 for b in range(256)])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: str) -> np.ndarray:
    """(n, WINDOW) folded bytes of the whole text, the last window filled with blanks."""
    raw = _FOLD[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    out = np.full(max(1, -(-len(raw) // WINDOW)) * WINDOW, 32, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(-1, WINDOW)


@dataclass
class ByteConvNet:
    """Filters of several widths over bytes, their maximum over a window, and a softmax layer.

    A filter over one-hot bytes is a table: filters[w][k, byte] is what a byte at offset k adds to each filter of width w."""

    langs: list[str]
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fit(cls, windows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 7) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        p = {("f", w): rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS} | {("b", w): np.zeros(FILTERS, np.float32) for w in WIDTHS}
        p |= {"o": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32), "ob": np.zeros(len(langs), np.float32)}
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v2 = {k: np.zeros_like(v) for k, v in p.items()}
        share = np.bincount(labels, minlength=len(langs)) / len(labels)
        weight = (1 / np.maximum(share, 1e-9) / len(langs)).astype(np.float32)
        step, columns = 0, np.arange(FILTERS)
        for epoch in range(EPOCHS):
            rate = RATE * 0.8**epoch
            for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
                x, y = windows[rows], labels[rows]
                pooled, places = [], []
                for w in WIDTHS:
                    f = p["f", w]
                    n = WINDOW - w + 1
                    z = f[0][x[:, :n]]
                    for k in range(1, w):
                        z += f[k][x[:, k : k + n]]
                    at = z.argmax(axis=1)
                    places.append(at)
                    pooled.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0] + p["b", w])
                hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
                logits = hidden @ p["o"] + p["ob"]
                prob = softmax(logits)
                prob[np.arange(len(y)), y] -= 1
                delta = prob * (weight[y] / len(y))[:, None]
                grad = {"o": hidden.T @ delta, "ob": delta.sum(axis=0)}
                back = (delta @ p["o"].T) * (hidden > 0)
                for i, w in enumerate(WIDTHS):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    table = np.zeros_like(p["f", w])
                    for k in range(w):
                        np.add.at(table[k], (np.take_along_axis(x, places[i] + k, 1), columns[None, :]), g)
                    grad["f", w], grad["b", w] = table, g.sum(axis=0)
                step += 1
                for key, g in grad.items():
                    m[key] += 0.1 * (g - m[key])
                    v2[key] += 0.001 * (g * g - v2[key])
                    p[key] -= rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v2[key] / (1 - 0.999**step)) + 1e-8)
        return cls(langs, {w: p["f", w] for w in WIDTHS}, {w: p["b", w] for w in WIDTHS}, p["o"], p["ob"])

    def prepared(self) -> list[list[np.ndarray]]:
        """Tables over byte pairs (and a last single byte for odd widths): half the look-ups of the plain filters."""
        return [[(f[k][:, None] + f[k + 1][None]).reshape(65536, FILTERS) if k + 1 < w else f[k] for k in range(0, w, 2)] for w, f in self.filters.items()]

    def logits(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pairs = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
        pooled = []
        for w, parts in zip(self.filters, tables, strict=True):
            n = WINDOW - w + 1
            z = parts[0].take(pairs[:, :n], axis=0)
            for j, t in enumerate(parts[1:], 1):
                z += t.take(pairs[:, 2 * j : 2 * j + n] if len(t) > 256 else x[:, 2 * j : 2 * j + n], axis=0)
            pooled.append(z.max(axis=1) + self.bias[w])
        return np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.out_bias


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _draw_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """TRAIN_WINDOWS windows of each whole text, drawn by its hash among those with letters."""
    for pdf in batches:
        out = []
        for key, text in zip(pdf["key"], pdf["text"], strict=True):
            w = windows_of(text)
            own = np.flatnonzero(_LETTER[w].any(axis=1))
            own = np.random.default_rng(int(key) & (1 << 63) - 1).permutation(own)[:TRAIN_WINDOWS]
            out.append(w[np.sort(own)].tobytes())
        yield pd.DataFrame({"key": pdf["key"], "lang": pdf["lang"], "windows": out})


def train(docs: DataFrame) -> ByteConvNet | None:
    """Fit on at most TRAIN_DOCS labelled documents of each language outside the held-out quarter; None if there are none.

    A rare language is learnt from all its documents. Only the drawn windows reach the driver."""
    known = docs.where(~held_out() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    counts = known.groupBy("lang").count()
    few = known.join(F.broadcast(counts), "lang").where(hashed_share(F.col("key"), TRAIN_DOCS, F.col("count"))).where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("key", 33), "key")
    drawn = few.select("key", "lang", "text").dropDuplicates(["lang", "key"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= TRAIN_DOCS)
    sample = drawn.select("key", "lang", "text").mapInPandas(_draw_windows, "key long, lang string, windows binary").orderBy("lang", "key").collect()
    if not sample:
        return None
    langs = sorted({r.lang for r in sample})
    windows = [np.frombuffer(r.windows, np.uint8).reshape(-1, WINDOW) for r in sample]
    labels = np.repeat([langs.index(r.lang) for r in sample], [len(w) for w in windows])
    return ByteConvNet.fit(np.concatenate(windows), labels, langs)


def _predict(net: ByteConvNet):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = net.prepared()
        for pdf in batches:
            sums = np.zeros((len(pdf), len(net.langs)))
            held: list[np.ndarray] = []
            owner: list[np.ndarray] = []

            def flush(held=held, owner=owner, sums=sums):
                x, of = np.concatenate(held), np.concatenate(owner)
                for at in range(0, len(x), _CHUNK):
                    part = x[at : at + _CHUNK]
                    np.add.at(sums, of[at : at + _CHUNK], softmax(net.logits(part, tables)) * _LETTER[part].mean(axis=1)[:, None])
                held.clear()
                owner.clear()

            weights = np.zeros(len(pdf))
            for i, (text, letters) in enumerate(zip(pdf["text"], pdf["letters"], strict=True)):
                if letters:
                    w = windows_of(text)
                    weights[i] = _LETTER[w].mean(axis=1).sum()
                    held.append(w)
                    owner.append(np.full(len(w), i))
                    if sum(map(len, held)) >= 4 * _CHUNK:
                        flush()
            if held:
                flush()
            prob = np.minimum(sums / np.maximum(weights, 1e-9)[:, None], 1.0)
            best = prob.argmax(axis=1)
            known = pdf["letters"].to_numpy(dtype=bool)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": np.where(known, np.array(net.langs, object)[best], "und"), "score": np.where(known, prob[np.arange(len(pdf)), best], 0.0)})

    return run


def identify_language(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text); other columns aren't read.

    labelled (doc_id, text, lang; docs itself if None) gives the bounded training sample. Every window of a
    text is scored; score is the mean of the windows' softmax values, weighted by their shares of letters. Null texts and
    texts without a letter: `und` with score 0, as all texts are if there is no labelled row. A null doc_id
    isn't held out. Repeated rows are scored each; an empty table gives an empty result. Scores of a long text
    are summed in pieces, so memory doesn't grow with its length beyond the text itself."""
    net = train(docs if labelled is None else labelled)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", "text", letters.alias("letters"), held_out().alias("held_out"))
    if net is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInPandas(_predict(net), "doc_id long, held_out boolean, lang_pred string, score double")
