"""Quality classification from weak labellers, expectation-maximisation and a hashed linear scorer."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import hashed_share, row_key, staged
from vigil.llm.hashing import BLANK_SPLIT, mix, words_of

#: Rounds of expectation-maximisation, the share of good texts to start from, and how often a labeller's right and wrong votes come at the start.
ROUNDS, START_GOOD, START_RIGHT, START_WRONG = 40, 0.85, 0.3, 0.02
#: Hash buckets of the scorer, and the bound of its training sample: whole texts (lowest hashes, half of them likely bad).
BUCKETS, TRAIN_TEXTS, EPOCHS, RATE, DECAY = 1 << 15, 4000, 8, 0.5, 1e-5
#: A text goes if the scorer and the labellers' posterior, averaged as log-odds, make it bad.
GOOD = 0.5

#: Labellers in order; each votes good (1), bad (0) or abstains (-1).
LABELLERS = ("marks", "letters", "capitals", "stutter", "longest_run", "word_length", "bars", "commonest", "prose")


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, 0, np.where(good, 1, -1)).astype(np.int8)


_SYMBOL = np.array([33 <= b <= 47 and b not in (39, 44, 45, 46) or 58 <= b <= 64 and b not in (58, 59, 63) or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_BLANK = ~BLANK_SPLIT


def measure(text: str, words: np.ndarray) -> list[float]:
    """What labellers judge, over the whole text: eight shares and lengths in the order of LABELLERS, then the number of words."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n, size = len(words), max(1, int((~_BLANK[raw]).sum()))
    letters = max(1, int(_LETTER[raw].sum()))
    same = np.flatnonzero(np.r_[True, words[1:] != words[:-1], True]) if n else np.array([0, 0])
    counts = np.unique(words, return_counts=True)[1] if n else np.array([0])
    symbol = _SYMBOL[raw]
    return [float(symbol.sum()) / size, float(letters) / size, float(_UPPER[raw].sum()) / letters, 1 - (len(same) - 1) / max(1, n), float(np.diff(same).max()) / max(1, n), size / max(1, n), float((raw == 124).sum()) / max(1, n), float(counts.max()) / max(1, n), float(n)]


def measured(texts: list[str]) -> np.ndarray:
    """(texts, 9): the measures of each text."""
    words = [np.empty(0, np.uint64)] * len(texts)
    for i, w in words_of(texts, BLANK_SPLIT):
        words[i] = w
    return np.array([measure(t, w) for t, w in zip(texts, words, strict=True)]).reshape(-1, 9)


def votes(m: np.ndarray) -> np.ndarray:
    """(texts, labellers) of -1, 0, 1 from measures. A text of few words tells labellers of repetition and of letters nothing.

    All but the last know one fault each and abstain where they don't see it: its absence says little."""
    few = m[:, 8] < 20
    no = np.zeros(len(m), bool)
    marks, letters, capitals, stutter, run, length, bars, common = (m[:, i] for i in range(8))
    return np.stack([
        _vote(no, marks > 0.10),
        _vote(no, (letters < 0.70) & ~few),
        _vote(no, capitals > 0.40),
        _vote(no, (stutter > 0.25) & ~few),
        _vote(no, (run > 0.15) & ~few),
        _vote(no, ((length < 1.8) | (length > 14)) & ~few),
        _vote(no, bars > 0.15),
        _vote(no, (common > 0.25) & ~few),
        _vote((marks < 0.03) & (capitals < 0.12) & (stutter < 0.05) & (bars < 0.02) & ((letters > 0.80) | few), no),
    ], axis=1)


@dataclass
class LabelModel:
    """The share of good texts, and how often each labeller votes bad or good on bad and on good texts."""

    prior: float
    rates: np.ndarray  # (labellers, class, vote)

    @classmethod
    def start(cls) -> LabelModel:
        rates = np.full((len(LABELLERS), 2, 2), START_WRONG)
        rates[:, [0, 1], [0, 1]] = START_RIGHT
        return cls(START_GOOD, rates)

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        """Expectation-maximisation over vote patterns and how many texts have each."""
        now = cls.start()
        for _ in range(ROUNDS):
            good = now.posterior(patterns)
            prior = float(np.clip((counts * good).sum() / counts.sum(), 0.01, 0.99))
            rates = np.zeros_like(now.rates)
            for c, share in ((0, counts * (1 - good)), (1, counts * good)):
                for v in (0, 1):
                    # Pseudo-texts at the start rates keep labellers that never vote where they began.
                    rates[:, c, v] = ((share[:, None] * (patterns == v)).sum(axis=0) + 10 * cls.start().rates[:, c, v]) / (share.sum() + 10)
            now = cls(prior, rates)
        return now

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that texts are good; a labeller that abstains tells nothing."""
        odds = np.full(len(patterns), math.log(self.prior / (1 - self.prior)))
        for v in (0, 1):
            odds += (patterns == v) @ np.log(self.rates[:, 1, v] / self.rates[:, 0, v])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def features(text: str, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of a text: shares of hashed character shapes, and steps of its measures m.

    Shapes (letter, capital, digit, mark, blank of three bytes in turn) carry over languages."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    shape = _SHAPES[raw]
    grams = shape[:-2].astype(np.int64) * 40000 + shape[1:-1].astype(np.int64) * 200 + shape[2:] if len(raw) > 2 else np.zeros(0, np.int64)
    ids, counts = np.unique(grams, return_counts=True)
    shares = np.sqrt(counts / max(1, len(grams)))
    steps = np.floor(np.r_[m[:8] * [40, 20, 20, 20, 20, 2, 20, 20], np.log2(m[8] + 1)]).astype(np.int64)
    own = mix((np.r_[ids, 10_000_000 + np.arange(9) * 1000 + steps]).astype(np.uint64) + np.uint64(1)) % np.uint64(BUCKETS)
    return own.astype(np.int64), np.r_[shares, np.full(9, 0.3)]


#: Marks keep their byte; other bytes stand for their class.
_SHAPES = np.array([1 if b >= 128 or 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b <= 32 else b for b in range(256)], np.uint8)


@dataclass
class HashedScorer:
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, seed: int = 3) -> HashedScorer:
        """Logistic regression by stochastic gradient on soft labels."""
        w, b, rng = np.zeros(BUCKETS), 0.0, np.random.default_rng(seed)
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch)
            for i in rng.permutation(len(rows)):
                at, value = rows[i]
                error = target[i] - 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[at] @ value) + b))))
                np.add.at(w, at, rate * error * value)
                b += 0.1 * rate * error
            w *= 1 - DECAY * len(rows)
        return cls(w, b)

    def score(self, row: tuple[np.ndarray, np.ndarray]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights[row[0]] @ row[1]) + self.bias))))


def _vote_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [x if isinstance(x, str) else "" for x in pdf["text"]]
        m = measured(texts)
        v = votes(m)
        yield pd.DataFrame({"row": pdf["row"], "pattern": ["".join("ng"[x] if x >= 0 else "-" for x in r) for r in v], "n_words": m[:, 8].astype(np.int64)})


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf["text"].tolist()
        found = [features(t, x) for t, x in zip(texts, measured(texts), strict=True)]
        yield pd.DataFrame({"row": pdf["row"], "pattern": pdf["pattern"], "at": [a.astype(np.int32) for a, _ in found], "value": [v.astype(np.float32) for _, v in found]})


def pattern_votes(pattern: str) -> list[int]:
    return [{"n": 0, "g": 1}.get(c, -1) for c in pattern]


def _scores(model: tuple[LabelModel, HashedScorer], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(posterior, score) of each text; 0 for a text without words."""
    labels, scorer = model
    m = measured(texts)
    some = m[:, 8] > 0
    score = np.array([scorer.score(features(t, x)) if x[8] else 0.0 for t, x in zip(texts, m, strict=True)])
    return np.where(some, labels.posterior(votes(m)), 0.0), score


def is_good(posterior: np.ndarray, score: np.ndarray) -> np.ndarray:
    odds = lambda p: np.log(np.maximum(p, 1e-12) / np.maximum(1 - p, 1e-12))
    return odds(posterior) + odds(score) >= 2 * math.log(GOOD / (1 - GOOD))


def _score_rows(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            posterior, score = _scores(shared.value, [x if isinstance(x, str) else "" for x in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "posterior": posterior, "score": score, "good": is_good(posterior, score)})

    return run


def _keep_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array(is_good(*_scores(shared.value, [x or "" for x in batch.column(at).to_pylist()]))))

    return run


def fit(docs: DataFrame) -> tuple[LabelModel, HashedScorer]:
    """Label model from the vote patterns of all documents; scorer from a bounded sample with posterior labels.

    Patterns are counted with partial aggregation: there are at most 3**9 of them, however many documents."""
    rows = docs.select(row_key("doc_id").alias("row"), "text")
    voted = staged(rows.mapInPandas(_vote_rows, "row long, pattern string, n_words long"))
    counted = voted.where("n_words > 0").groupBy("pattern").count().orderBy("pattern").collect()
    if not counted:
        return LabelModel.start(), HashedScorer(np.zeros(BUCKETS), 0.0)
    patterns = np.array([pattern_votes(r.pattern) for r in counted])
    labels = LabelModel.fit(patterns, np.array([r["count"] for r in counted], float))
    good = labels.posterior(patterns)
    # As many likely bad texts as likely good ones; both bounded, and chosen by hash alone.
    bad = [r.pattern for r, g in zip(counted, good, strict=True) if g < 0.5]
    known = voted.where("n_words > 0").withColumn("bad", F.col("pattern").isin(bad) if bad else F.lit(False)).withColumn("at", F.xxhash64("row", F.lit(5)))
    half = TRAIN_TEXTS // 2
    total = {b: sum(r["count"] for r, g in zip(counted, good, strict=True) if (g < 0.5) == b) for b in (True, False)}
    order = (F.shiftrightunsigned("at", 33), "at", "row")
    lowest = [known.where(F.col("bad") == b).where(hashed_share(F.col("at"), half, total[b])).orderBy(*order).limit(half) for b in (True, False)]
    picked = lowest[0].union(lowest[1]).select("row", "pattern")
    sample = rows.join(F.broadcast(picked), "row").dropDuplicates(["row"]).select("row", "text", "pattern")
    # Features of whole texts, the same that the votes were taken from; only these reach the driver.
    sample = sample.mapInPandas(_feature_rows, "row long, pattern string, at array<int>, value array<float>").orderBy("row").collect()
    target = labels.posterior(np.array([pattern_votes(r.pattern) for r in sample]))
    return labels, HashedScorer.fit([(np.array(r.at, np.int64), np.array(r.value)) for r in sample], target)


def classify_quality(docs: DataFrame, model: tuple[LabelModel, HashedScorer] | None = None) -> DataFrame:
    """doc_id, posterior, score, good for each row of docs (doc_id, text).

    Nine heuristic labellers vote or abstain on whole texts; expectation-maximisation estimates their
    accuracies from all documents' vote patterns; posteriors of a bounded sample train the hashed linear
    scorer, which scores every whole text. good: the sum of both log-odds is not below twice GOOD's.

    Null and wordless texts have posterior and score 0 and are not good. Repeated rows are scored each; other
    columns aren't read. With no documents the result is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    return docs.select("doc_id", "text").mapInPandas(_score_rows(shared), "doc_id long, posterior double, score double, good boolean")


def keep_good(docs: DataFrame, model: tuple[LabelModel, HashedScorer] | None = None) -> DataFrame:
    """The rows of docs that are good, with all their columns as they are.

    Null and wordless texts go; repeated rows are judged alike, so all or none of them stay. An empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    return docs.mapInArrow(_keep_rows(shared), docs.schema)
