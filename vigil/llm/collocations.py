"""Collocations: phrases of two to four words, counted by an index for each shard of texts and scored over all of them."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import LOWER, UPPER, staged

#: Words of a phrase at most, and occurrences of a candidate at least.
DEPTH, LEAST = 4, 30
#: Words of a shard, about (and one text more); hashes that a task sums at once, about.
SHARD_WORDS, SUMMED = 300_000, 1_000_000
#: Parts in which a language's phrases are ranked before they are ranked together.
PARTS = 32
#: Bits of the table of phrases that may be frequent: 2^27 bits, 16 MB, however many phrases there are.
TABLE_BITS = 27
#: Lowest bits of a hash, which hold a count of up to LEAST instead.
COUNT_BITS = 5
#: What separates pieces, and what separates words.
ENDS, BLANK = ".,;:!?\n\x0b\x0c\r", "\t"
LETTERS = str.maketrans(dict(zip(UPPER, LOWER, strict=True)) | {c: " \n " for c in ENDS} | {BLANK: " "})
SHARD = "lang string, n long, words string, before binary, after binary, wide boolean"
MIX = np.uint64(0x9E3779B97F4A7C15)


def _order(ids: np.ndarray) -> np.ndarray:
    """Places of ids, sorted by the DEPTH words from there on, the text taken as a ring: two rounds of doubling."""
    size = int(ids.max()) + 1
    two = ids * size + np.roll(ids, -1)
    rank = np.unique(two, return_inverse=True)[1].astype(np.int64)
    four = rank * (int(rank.max()) + 1) + np.roll(rank, -2)
    return np.argsort(four, kind="stable")


def transform(ids: np.ndarray) -> np.ndarray:
    """The word before each place, places sorted by the DEPTH words from there on."""
    return ids[_order(ids) - 1]


@dataclass
class Phrases:
    """Phrases of one length in a shard. Their occurrences are n rows from lo of the sorted places, and n rows from rlo of
    the sorted places of the reversed text. words: a row of word ids for each."""

    words: np.ndarray
    lo: np.ndarray
    rlo: np.ndarray
    n: np.ndarray

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.words[keep], self.lo[keep], self.rlo[keep], self.n[keep])


class Index:
    """An FM-index over the word ids of a shard and one over the reversed text. Word 0 ends a piece and extends no phrase.

    before: the word before each place, places sorted by the words that follow; after: the same of the reversed text."""

    def __init__(self, before: np.ndarray, after: np.ndarray):
        self.before, self.after, self.size = before, after, int(before.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(before, minlength=self.size))])

    def words(self) -> Phrases:
        """Each word as a phrase."""
        n = np.diff(self.first)[1:]
        return Phrases(np.arange(1, self.size)[:, None], self.first[1:-1], self.first[1:-1], n)

    def _extend(self, lo: np.ndarray, other: np.ndarray, n: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each interval lo, n of an index whose preceding words are row, and each word that precedes it: number of the
        interval, the word, count, new interval in this index and in the other one."""
        step = np.empty(len(row), np.int32)
        step[np.argsort(row, kind="stable")] = np.arange(len(row), dtype=np.int32)
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int32) + np.repeat((lo - begin).astype(np.int32), n)
        key = np.repeat(np.arange(len(n)) * self.size, n) + row[place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        which, word = key[start] // self.size, key[start] % self.size
        count = np.diff(start, append=len(key))
        real = word > 0
        return tuple(x[real] for x in (which, word, count, step[place[order[start]]], other[which] + start - begin[which]))

    def right(self, p: Phrases) -> Phrases:
        """All phrases of a phrase and a word behind it."""
        which, word, count, rlo, lo = self._extend(p.rlo, p.lo, p.n, self.after)
        return Phrases(np.column_stack([p.words[which], word]), lo, rlo, count)

    def left(self, p: Phrases) -> Phrases:
        """All phrases of a word and a phrase behind it."""
        which, word, count, lo, rlo = self._extend(p.lo, p.rlo, p.n, self.before)
        return Phrases(np.column_stack([word, p.words[which]]), lo, rlo, count)

    def both(self, p: Phrases) -> Phrases:
        """Phrases one word longer that begin and end with one of p. Phrases of one length have intervals apart, so lo names them."""
        right = self.right(p)
        return right.where(np.isin(right.lo, self.left(p).lo, assume_unique=True))


def _shards(batches: Iterator[pd.DataFrame], shard_words: int) -> Iterator[pd.DataFrame]:
    """Indexes over the texts of a task, for each language apart."""
    held: dict[str, tuple[dict[str, int], array]] = {}

    def built(lang: str) -> pd.DataFrame:
        known, words = held.pop(lang)
        ids = np.frombuffer(words, np.int32).astype(np.int64)
        ids = ids[ids != 1]  # nothing between two blanks
        ids = np.where(ids > 1, ids - 1, 0)
        ids = ids[np.concatenate([[True], (ids[1:] > 0) | (ids[:-1] > 0)])]  # one end for each piece
        n = int((ids > 0).sum())
        wide = len(known) > 1 << 16
        kind = "<i4" if wide else "<u2"
        rows = [transform(x).astype(kind).tobytes() for x in (ids, ids[::-1])] if n else [b"", b""]
        return pd.DataFrame({"lang": [lang], "n": [n], "words": ["\n".join(list(known)[2:])], "before": rows[:1], "after": rows[1:], "wide": [wide]})

    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            known, words = held.setdefault(lang, ({"\n": 0, "": 1}, array("i", [0])))
            number = known.setdefault
            words.extend([number(w, len(known)) for w in text.translate(LETTERS).split(" ")])
            words.append(0)
            if len(words) >= shard_words:
                yield built(lang)
        while sum(len(x[1]) for x in held.values()) > 4 * shard_words:  # many languages: the largest goes first
            yield built(max(held, key=lambda x: len(held[x][1])))
    for lang in list(held):
        yield built(lang)


def _indexes(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray, Index]]:
    """lang, words by number and index of each shard that has words."""
    for pdf in batches:
        for r in pdf.itertuples():
            if r.n:
                kind = "<i4" if r.wide else "<u2"
                yield r.lang, np.array(["", *r.words.split("\n")], object), Index(*(np.frombuffer(x, kind).astype(np.int32) for x in (r.before, r.after)))


def _hashes(p: Phrases, words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each phrase from those of its words."""
    h = np.full(len(p.n), p.words.shape[1], np.uint64)
    for k in range(p.words.shape[1]):
        h = (h ^ words[p.words[:, k]]) * MIX
        h ^= h >> np.uint64(29)
    return h * MIX


def _word_hashes(lang: str, words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(np.array([f"{lang}\n{w}" for w in words], object), categorize=False)


def _frequent(shards: DataFrame, phrases: Callable[[Index, Callable[[Phrases], Phrases]], list[Phrases]], tables: list[Broadcast], total: int) -> Broadcast:
    """A table of bits, set where a phrase that phrases gives for each shard may occur LEAST times in all shards.

    Shards send hashes, with their counts in the lowest bits, to the task of their range; it adds equal ones. A clash of
    hashes can only set a bit too many, so nothing frequent is lost; exact counts follow later."""
    parts = min(TABLE_BITS - 3, max(0, int(np.ceil(np.log2(max(1, 2 * total / SUMMED))))))
    low = np.uint64((1 << COUNT_BITS) - 1)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, words, index in _indexes(batches):
            word = _word_hashes(lang, words)
            hashed = []
            for p in phrases(index, _kept(word, tables)):
                hashed.append((_hashes(p, word) & ~low) | np.minimum(p.n, LEAST).astype(np.uint64))
            keys = np.sort(np.concatenate(hashed))
            bounds = np.searchsorted(keys, np.arange(1 << parts, dtype=np.uint64) << np.uint64(64 - parts)) if parts else np.zeros(1, np.int64)
            bounds = np.append(bounds, len(keys))
            some = np.flatnonzero(np.diff(bounds))
            yield pd.DataFrame({"part": some.astype(np.int32), "hashes": [keys[bounds[i] : bounds[i + 1]].tobytes() for i in some]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hashes"]]))
        start = np.flatnonzero(np.diff(keys >> np.uint64(COUNT_BITS), prepend=np.uint64(1 << 63)))
        often = keys[start][np.add.reduceat((keys & low).astype(np.int64), start) >= LEAST]
        bits = np.zeros(1 << (TABLE_BITS - parts), np.uint8)
        bits[((often >> np.uint64(64 - TABLE_BITS)) & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    sent = shards.select("lang", "n", "words", "before", "after", "wide").mapInPandas(send, "part int, hashes binary")
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    width = len(table) >> parts
    for r in sent.groupBy("part").applyInPandas(add, "part int, bits binary").toLocalIterator():  # 16 MB in all, whatever the shards hold
        table[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return shards.sparkSession.sparkContext.broadcast(table)


def _kept(word: np.ndarray, tables: list[Broadcast]) -> Callable[[Phrases], Phrases]:
    """Drops phrases whose bit is in none of the tables."""

    def kept(p: Phrases) -> Phrases:
        slot = (_hashes(p, word) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        table = tables[0 if p.words.shape[1] < 3 else 1].value
        return p.where((table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1)

    return kept


def phrase_counts(docs: DataFrame, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, f of every phrase of up to DEPTH words with f >= LEAST; and lang, n (all words).

    Three passes over staged shards: words and pairs by hash, triples of frequent pairs by hash, then phrases as text."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    shards = staged(rows.mapInPandas(lambda batches: _shards(batches, shard_words), SHARD))
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    total = shards.agg(F.sum("n")).first()[0] or 0

    def short(index: Index, kept: Callable) -> list[Phrases]:
        words = index.words()
        return [words, index.right(words)]

    def triples(index: Index, kept: Callable) -> list[Phrases]:
        return [index.both(kept(index.right(kept(index.words()))))]

    pairs = _frequent(shards, short, [], total)
    longer = _frequent(shards, triples, [pairs], total)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, words, index in _indexes(batches):
            kept = _kept(_word_hashes(lang, words), [pairs, longer])
            found = [kept(index.words())]
            found.append(kept(index.right(found[0])))
            found.append(kept(index.both(found[1])))
            found.append(index.both(found[2]))
            for k, p in enumerate(found, 1):
                for at in range(0, len(p.n), 100_000):
                    some = p.where(slice(at, at + 100_000))
                    text = words[some.words[:, 0]]
                    for j in range(1, k):
                        text = text + " " + words[some.words[:, j]]
                    yield pd.DataFrame({"lang": lang, "phrase": text, "words": np.int32(k), "f": some.n})

    found = shards.mapInPandas(texts, "lang string, phrase string, words int, f long").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return found.where(F.col("f") >= LEAST), totals


def collocations(docs: DataFrame, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's top collocations of docs (doc_id, lang, text).

    Words are what blanks and tabs separate in the pieces between punctuation marks and line ends. a, l and r count the phrase and
    the parts of its lowest-scoring cut, n all words of the language. A phrase inside a longer one that has 80 % of its occurrences
    is left out. Null texts count as empty, null languages as und; repeated rows count each. Other columns don't matter.
    Ties are settled by a, then the phrase in byte order, so ranks are definite. A language without a phrase of LEAST
    occurrences has no rows, as has an empty table. Very long texts make a larger shard. Lost tasks are done again from staged shards."""
    counts, totals = phrase_counts(docs, shard_words)
    counts = staged(counts)
    whole = F.col("a").cast("decimal(38,0)")
    longer = counts.where("words > 1")
    pieces = F.split("phrase", " ")
    inside = longer.where("words > 2").select("lang", F.explode(F.array(F.array_join(F.slice(pieces, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(pieces, F.lit(2), F.col("words") - 1), " "))).alias("phrase"), "f")
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    # A phrase two words longer lies around one that is one word longer and occurs no less often: that one decides.
    left = longer.withColumnRenamed("f", "a").join(inside, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * F.col("within").cast("decimal(38,0)") < 80 * whole))
    cuts = left.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    first, rest = F.array_join(F.slice(pieces, F.lit(1), F.col("k")), " "), F.array_join(F.slice(pieces, F.col("k") + 1, F.col("words") - F.col("k")), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", first.alias("first"), rest.alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(38,0)) * a) div (cast(l as decimal(38,0)) + r)")
    cut = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # A language's first ones are among the first of its parts, so no task takes more than PARTS times top of them.
    order = (F.desc("score"), F.desc("a"), "phrase")
    ranked = cut.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n"), "score")
