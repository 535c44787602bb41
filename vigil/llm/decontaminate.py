"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import lower_ascii, row_key, staged, unused
from vigil.llm.hashing import ALNUM, mix, words_of

WINDOW = 10
#: Bytes of benchmark text whose windows one search holds (about 50 bytes of tables for each); a larger benchmark is searched for in blocks of this size.
BLOCK_BYTES = 4_000_000
#: Slots of a shift table for each pattern.
SLOTS = 8

#: A-Z lower-cased; digits, a-z and bytes beyond ASCII stay; all else parts words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").translate(_WORD_BYTES).split()


def _blocks(hashes: np.ndarray, b: int) -> np.ndarray:
    """A hash of each b neighbouring words."""
    return hashes if b == 1 else mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:])


class WuManber:
    """Search for word sequences of one length m, in flat arrays.

    shift: by the hash of a block of words, how far the search may move when that block ends at a place; 0 for the last
    block of a pattern. Patterns are in buckets by their last block and, within it, by their first (key holds both, sorted);
    equal patterns are one. The words of a pattern stand in text between two of offsets and are compared in full."""

    def __init__(self, items: list[tuple[int, list[bytes]]], m: int):
        self.m, self.block = m, min(2, m)
        flat = [w for _, own in items for w in own]
        self.text = b" ".join(flat) + b" "
        self.offsets = np.zeros(len(flat) + 1, np.int32)
        np.cumsum([len(w) + 1 for w in flat], out=self.offsets[1:])
        sizes = [len(own) for _, own in items]
        first = np.cumsum([0, *sizes[:-1]])
        at = np.concatenate([np.arange(f, f + n - m + 1, dtype=np.int32) for f, n in zip(first, sizes, strict=True)])
        item = np.repeat(np.array([i for i, _ in items], np.int32), [n - m + 1 for n in sizes])
        hashes = next(words_of([self.text.decode("utf-8", "replace")], ALNUM))[1]
        blocks = _blocks(hashes, self.block)
        self.mask = np.uint64((1 << max(8, int(SLOTS * len(at)).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, min(255, m - self.block + 1), np.uint8)
        for end in range(self.block, m + 1):
            np.minimum.at(self.shift, blocks[at + end - self.block] & self.mask, min(255, m - end))
        key, whole = self._keys(blocks, at), np.zeros(len(at), np.uint64)
        for j in range(m):
            whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) ^ hashes[at + j])
        order = np.lexsort((item, whole, key))
        key, whole, at, item = key[order], whole[order], at[order], item[order]
        new = np.ones(len(at), bool)
        for i in np.flatnonzero((key[1:] == key[:-1]) & (whole[1:] == whole[:-1])) + 1:
            new[i] = self.pattern(at[i]) != self.pattern(at[i - 1])
        start = np.flatnonzero(new)
        self.key, self.at, self.item, self.start = key[start], at[start], item, np.append(start, len(item)).astype(np.int32)

    def _keys(self, blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
        return mix(blocks[at + self.m - self.block] * np.uint64(3) ^ blocks[at])

    def pattern(self, at: int) -> bytes:
        return self.text[self.offsets[at] : self.offsets[at + self.m] - 1]

    def search(self, hashes: np.ndarray, text: str) -> Iterator[tuple[int, np.ndarray]]:
        """(start, item numbers) of each occurrence in a text, of which the words' hashes are given, by start."""
        m, n = self.m, len(hashes)
        if n < m:
            return
        blocks = _blocks(hashes, self.block)
        shift = self.shift[blocks & self.mask].tobytes()
        ends, end, back = [], m, self.block
        while end <= n:
            move = shift[end - back]
            if not move:
                ends.append(end)
                move = 1
            end += move
        if not ends:
            return
        starts = np.array(ends) - m
        keys = self._keys(blocks, starts)
        low, high = np.searchsorted(self.key, keys), np.searchsorted(self.key, keys, side="right")
        own: list[bytes] | None = None
        for i in np.flatnonzero(low < high):
            own = words(text) if own is None else own
            start = int(starts[i])
            joined = b" ".join(own[start : start + m])
            for p in range(low[i], high[i]):
                if self.pattern(self.at[p]) == joined:
                    yield start, self.item[self.start[p] : self.start[p + 1]]

    def held_bytes(self) -> int:
        return len(self.text) + sum(a.nbytes for a in (self.offsets, self.shift, self.key, self.at, self.item, self.start))


def searchers(items: list[tuple[str, str]], window: int) -> tuple[list[str], list[WuManber]]:
    """Item ids, and a searcher for each length of window: whole items shorter than `window`, and `window`."""
    names, by_length = [], {}
    for item, text in items:
        if w := words(text):
            by_length.setdefault(min(window, len(w)), []).append((len(names), w))
            names.append(item)
    return names, [WuManber(own, m) for m, own in sorted(by_length.items())]


def _found(shared, texts: list[str | None]) -> Iterator[tuple[int, int, list[list[int]], list[str]]]:
    """(index, words, merged spans of hit words, sorted item ids) of each text."""
    names, machines = shared.value
    for i, hashes in words_of(texts, ALNUM):
        hits, items = [], set()
        for machine in machines:
            for start, own in machine.search(hashes, texts[i]):
                hits.append((start, start + machine.m))
                items.update(own.tolist())
        spans: list[list[int]] = []
        for a, b in sorted(hits):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        yield i, len(hashes), spans, sorted(names[x] for x in items)


def _texts(column) -> list[str | None]:
    return [x if isinstance(x, str) else None for x in column]


def _scan(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = sorted(_found(shared, _texts(pdf["text"])))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": [x[1] for x in found], "spans": [x[2] for x in found], "items": [x[3] for x in found]})

    return run


def _hits(shared):
    """Only the texts with an occurrence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if found := [x for x in _found(shared, _texts(pdf["text"])) if x[2]]:
                yield pd.DataFrame({"row": pdf["row"].iloc[[x[0] for x in found]].to_numpy(), "spans": [x[2] for x in found], "items": [x[3] for x in found]})

    return run


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted(_found(shared, batch.column(batch.schema.get_field_index("text")).to_pylist()))
            yield batch.filter(pa.array([not x[2] for x in found], pa.bool_()))

    return run


def benchmark_blocks(benchmark: DataFrame, window: int) -> tuple[int, Iterator[Broadcast]]:
    """How many blocks of about BLOCK_BYTES the benchmark has, and the searchers of each, built and broadcast when it is asked for."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // BLOCK_BYTES))
    block = lambda b: items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "text").collect()
    return blocks, (benchmark.sparkSession.sparkContext.broadcast(searchers([(r.item, r.text) for r in block(b)], window)) for b in range(blocks))


def _hits_of_blocks(docs: DataFrame, machines: Iterator[Broadcast]) -> DataFrame:
    """row, spans, items of the texts with occurrences in any block. One block after another is built, broadcast, searched for and let go."""
    rows, out = docs.select(row_key().alias("row"), "text"), None
    for b, shared in enumerate(machines):
        found = staged(rows.mapInPandas(_hits(shared), "row long, spans array<array<int>>, items array<string>")).withColumn("block", F.lit(b))
        out = found if out is None else out.unionByName(found)
        shared.destroy()
    # Repeated rows have one key and one result.
    once = out.groupBy("row", "block").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
    return once.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _covered(spans: Column | str) -> Column:
    """Words inside any of the spans (sorted by start first)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x[1]).alias("end"), (a["n"] + F.greatest(x[1] - F.greatest(x[0], a["end"]), F.lit(0))).alias("n"))
    return F.aggregate(F.array_sort(spans), start, step)["n"].cast("long")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text).

    benchmark: item_id, text. Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII.
    Every run of `window` words of an item, or a shorter item as a whole, is searched for in every whole
    text; n_hit counts the words inside any occurrence. The benchmark's size is taken first: beyond BLOCK_BYTES it is
    searched for in blocks, one pass over the texts after another; the driver and a worker hold one block at a time.

    Null texts have no words; items without id or words match nothing; an item id that comes twice counts
    once; repeated rows are returned each. Without benchmark or documents: no hits, or no rows."""
    blocks, machines = benchmark_blocks(benchmark, window)
    if blocks == 1:
        rows = docs.select("doc_id", "text").mapInPandas(_scan(next(machines)), "doc_id long, n_words long, spans array<array<int>>, items array<string>")
    else:
        n_words = F.coalesce(F.regexp_count(lower_ascii(F.col("text")), F.lit(WORD)), F.lit(0)).cast("long")
        rows = docs.select("doc_id", row_key().alias("row"), n_words.alias("n_words")).join(_hits_of_blocks(docs, machines), "row", "left")
        rows = rows.withColumns({"spans": F.coalesce("spans", F.expr("cast(array() as array<array<int>>)")), "items": F.coalesce("items", F.expr("cast(array() as array<string>)"))})
    return rows.select("doc_id", "n_words", _covered("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all their columns; other cases as in find_contamination."""
    blocks, machines = benchmark_blocks(benchmark, window)
    if blocks == 1:
        return docs.mapInArrow(_clean(next(machines)), docs.schema)
    (key,) = unused(docs, "row_key")
    hit = _hits_of_blocks(docs, machines).select(F.col("row").alias(key))
    return docs.withColumn(key, row_key()).join(hit, key, "left_anti").select(docs.columns)
