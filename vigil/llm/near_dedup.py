"""Near-duplicate groups by min-max hashing, banding and exact confirmation."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import one_of_each_row, row_key, staged, unused
from vigil.llm.graph import connected_components
from vigil.llm.hashing import BLANK_SPLIT, mix, shingles, words_of

#: 120 permutations give 240 signature values: 40 bands of three permutations' minimum and maximum.
#: A pair at similarity 0.8 misses every band with probability (1 - 0.8**6)**40 = 5e-6.
PERMUTATIONS, PER_BAND = 120, 3
#: Shingles and sets in a block of one candidate group; a pair of blocks is what one task confirms at once.
BLOCK_SHINGLES, BLOCK_SETS = 400_000, 2048
#: Sketches in a block of one bucket; a pair of blocks is what one task compares at once.
BLOCK_SKETCHES = 1024

_SEEDS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
_MULTIPLY = (_SEEDS[:PERMUTATIONS] | np.uint64(1)).astype(np.uint32)[:, None]
_ADD = _SEEDS[PERMUTATIONS:].astype(np.uint32)[:, None]


def minmax_signature(hashes: np.ndarray) -> np.ndarray:
    """(permutations, 2): the smallest and the largest value under each permutation x -> a*x + b modulo 2**32."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(x), 2048):
        y = _MULTIPLY * x[None, at : at + 2048] + _ADD
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    return np.stack([low, high], axis=1)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of its number and its values."""
    values = signature.reshape(-1, 2 * PER_BAND).astype(np.uint64)
    out = np.arange(1, len(values) + 1, dtype=np.uint64)
    for j in range(values.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ values[:, j])
    return out.view(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """Four bits of each signature value, sixteen values to a long."""
    bits = (mix(signature.astype(np.uint64).ravel()) & np.uint64(15)).reshape(-1, 16)
    return np.bitwise_or.reduce(bits << np.arange(0, 64, 4, dtype=np.uint64), axis=1).view(np.int64)


def agreement(a: Column, b: Column) -> Column:
    """How many values of two sketches are equal."""
    quarter = F.lit(0x1111111111111111)

    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseOR(F.shiftrightunsigned(z, 3)).bitwiseAND(quarter))

    return F.lit(2 * PERMUTATIONS) - F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda x, y: x + y)


def expected(similarity: float, deviations: float = 0.0) -> int:
    """Equal sketch values of two sets of that similarity, so many standard deviations off. Different values agree in one of 16."""
    share, n = similarity + (1 - similarity) / 16, 2 * PERMUTATIONS
    return math.floor(n * share + deviations * math.sqrt(n * share * (1 - share)))


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two hashes of the whole set, 128 bits together: of its sum, and of the exclusive-or and the sum of its mixed members."""
    mixed, again = mix(hashes), mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    n = np.uint64(len(hashes))
    a, b = mix(np.array([hashes.sum(dtype=np.uint64) ^ mix(np.array([np.bitwise_xor.reduce(mixed) + n]))[0], again.sum(dtype=np.uint64) ^ mix(np.array([np.bitwise_xor.reduce(again) - n]))[0]])).view(np.int64)
    return int(a), int(b)


def _sign(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, digests, keys, sketches = np.zeros(len(pdf), np.int64), [(None, None)] * len(pdf), [None] * len(pdf), [None] * len(pdf)
            for i, words in words_of(pdf["text"].tolist(), BLANK_SPLIT):
                if len(found := shingles(words, k)):
                    signature = minmax_signature(found)
                    n[i], digests[i], keys[i], sketches[i] = len(found), _digest(found), band_keys(signature), sketch(signature)
            first, second = (pd.array([d[j] for d in digests], dtype="Int64") for j in (0, 1))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row": pdf["row"], "n_shingles": n, "d1": first, "d2": second, "keys": keys, "sketch": sketches})

    return run


def linked_sets(sets: list[np.ndarray], percent: int, across: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the sets' components under 100 * common >= percent * union, each confirmed on full sets.

    Sets come in order of size. A set's rarest hashes (its prefix) must meet the prefix of any set it links
    to, so only those are looked up; sets already in one component aren't compared again. across: the block
    of each set, if only pairs over two blocks count."""
    ids, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(ids), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(ids), dtype=np.int32)
    tokens = np.split(np.take(rank, inverse), np.cumsum([len(s) for s in sets])[:-1])
    del ids, inverse, counts, rank
    top, links = list(range(len(sets))), []

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    index: dict[int, list[int]] = defaultdict(list)
    held = np.zeros(sum(map(len, tokens)), bool)  # which hashes the set at hand has
    for i, own in enumerate(tokens):
        n = len(own)
        prefix = np.sort(own)[: n - -(-percent * n // 100) + 1].tolist()
        held[own] = True
        for j in {j for t in prefix for j in index.get(t, ())}:
            m = len(tokens[j])
            if 100 * m < percent * n or find(i) == find(j) or (across is not None and across[i] == across[j]):
                continue
            common = int(np.count_nonzero(held[tokens[j]]))
            if 100 * common >= percent * (n + m - common):
                links.append((i, j))
                top[find(i)] = find(j)
        held[own] = False
        for t in prefix:
            index[t].append(i)
    return links


def _confirm(k: int, percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_shingles", "node"], ignore_index=True)
        sets: list[np.ndarray] = [np.empty(0, np.uint64)] * len(pdf)
        for i, words in words_of(pdf["text"].tolist(), BLANK_SPLIT):
            sets[i] = shingles(words, k)
        one = pdf["low"].iat[0] == pdf["high"].iat[0]
        links = linked_sets(sets, percent, None if one else pdf["block"].to_numpy()) if len(pdf) > 1 else []
        d = pdf["node"].tolist()
        return pd.DataFrame({"a": [d[i] for i, _ in links], "b": [d[j] for _, j in links]}, dtype="int64")

    return run


def _compare(tie: int):
    """Ties of each left sketch to the right ones that agree with it: every component of a pair of blocks as a star, not as pairs."""

    def values(rows: pd.DataFrame) -> np.ndarray:
        packed = np.stack(rows["sketch"].to_numpy()).view(np.uint8)
        return np.concatenate([packed & 15, packed >> 4], axis=1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["is_left"]], pdf[~pdf["is_left"]]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        own, others = values(left), values(right)
        alike = np.stack([(others == x).sum(axis=1) >= tie for x in own])
        left_ids, right_ids = left["node"].to_numpy(), right["node"].to_numpy()
        left_free, right_free, links = np.ones(len(left), bool), np.ones(len(right), bool), []
        for i in range(len(left)):
            step = np.array([i]) if left_free[i] else np.empty(0, np.int64)
            while len(step):
                left_free[step] = False
                met = np.flatnonzero(right_free & alike[step].any(axis=0))
                right_free[met] = False
                step = np.flatnonzero(left_free & alike[:, met].any(axis=1))
                links += [(left_ids[i], x) for x in (*right_ids[met], *left_ids[step]) if x != left_ids[i]]
        return pd.DataFrame({"a": [x for x, _ in links], "b": [x for _, x in links]}, dtype="int64")

    return run


def candidate_ties(classes: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b): ties of classes (node, keys, sketch) whose closure joins any two that share a bucket and may be linked.

    Two classes are tied if their sketches agree as those of a link do, less six deviations. A bucket's classes are first compared with its smallest one, each pair once however many buckets
    it shares; near copies are all tied by that, and the bucket is done. In the others the strays, which aren't tied,
    are compared with each other and with the rest, in pairs of blocks of bounded size. So any two of a bucket are tied
    to one class or are compared themselves."""
    tie = expected(percent / 100, -6)
    sketches = classes.select("node", "sketch")
    banded = classes.select("node", F.explode("keys").alias("bucket"))
    least = banded.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("bucket", "a")
    meet = staged(banded.join(least, "bucket").where("a <> node"))
    both = meet.select("a", "node").distinct().join(sketches, "node").join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("other")), "a")
    pairs = staged(both.select("a", "node", agreement(F.col("sketch"), F.col("other")).alias("equal")))
    left = staged(meet.join(pairs, ["a", "node"]).select("bucket", "node", (F.col("equal") < tie).alias("stray")))
    blocks = left.groupBy("bucket").agg(F.count_if("stray").alias("strays"), F.count("*").alias("all")).where("strays > 0 and all > 1").select("bucket", *(F.ceil(F.col(c) / BLOCK_SKETCHES).cast("int").alias(c) for c in ("strays", "all")))
    open_ = left.join(blocks, "bucket").withColumns({"low": F.pmod(F.xxhash64("node", F.lit(11)), "strays").cast("int"), "high": F.pmod(F.xxhash64("node", F.lit(13)), "all").cast("int")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = open_.where("stray").select("bucket", "low", every("all").alias("high"), "node", F.lit(True).alias("is_left")).union(open_.select("bucket", every("strays").alias("low"), "high", "node", F.lit(False).alias("is_left")))
    compared = dealt.join(sketches, "node").groupBy("bucket", "low", "high").applyInPandas(_compare(tie), "a long, b long")
    return pairs.where(F.col("equal") >= tie).select("a", F.col("node").alias("b")).union(compared).distinct()


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row (its key), n_shingles, node (the class of its set, null without words) and component (of classes) for each row of docs.

    Equal sets are one class from the start (grouped by 128-bit digest, with partial aggregation), so copies meet
    in no join. Classes that share a bucket of any band and whose sketches agree (see `candidate_ties`) form candidate
    groups; nothing is decided by them. Each group is then confirmed on full sets from whole texts. A group beyond BLOCK_SHINGLES or BLOCK_SETS is dealt over blocks
    by hash, and every pair of blocks is one task: its size is bounded and no pair is left out."""
    rows = docs.select("doc_id", row_key().alias("row"), "text")
    signed = staged(rows.mapInPandas(_sign(k), "doc_id long, row long, n_shingles long, d1 long, d2 long, keys array<long>, sketch array<long>"))
    classes = signed.where("d1 is not null").groupBy("d1", "d2").agg(F.min("row").alias("row"), F.min("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    # The number of a class is fixed once it is written.
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()))
    tied = connected_components(candidate_ties(classes, percent))
    members = classes.join(tied, "node").select("node", "row", "n_shingles", "component")
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    # A set goes to its block's pair with every block, and with itself where there is one block only.
    block = F.pmod(F.xxhash64("node", F.lit(7)), "blocks").cast("int")
    dealt = members.join(sizes, "component").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", "node", "row", "n_shingles", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    dealt = dealt.join(one_of_each_row(rows.select("row", "text"), signed), "row")
    links = dealt.groupBy("component", "low", "high").applyInPandas(_confirm(k, percent), "a long, b long")
    linked = connected_components(links)
    of = classes.select("d1", "d2", "node").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return staged(signed.select("doc_id", "row", "n_shingles", "d1", "d2").join(of, ["d1", "d2"], "left").drop("d1", "d2"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are ignored).

    Two texts are linked if 100 * |common shingles| >= percent * |all shingles|, over distinct shingles of k
    words; a component's id is its smallest doc_id, and the row of that id is kept. How: see `groups`.

    Null or wordless texts: n_shingles 0, their own component, kept. Rows without doc_id get the smallest id
    of their component, or null and kept if there is none. Repeated rows are returned as often as they come,
    with one result. An empty table gives an empty result."""
    found = groups(docs, k, percent)
    least = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = found.join(least, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs of each component, with all its columns: the one of the smallest doc_id (rows without one come last) and row key.

    It is a row that stays, not an id: of two texts under one doc_id each is judged by itself. Repeated rows (one doc_id
    and text, whatever the other columns) are one document, of which one row stays. Null and wordless texts all stay.
    An empty table gives an empty result."""
    found = groups(docs, k, percent).where("component is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    chosen = found.groupBy("component").agg(F.min(order)["row"].alias("chosen"))
    (key,) = unused(docs, "row_key")
    gone = found.join(chosen, "component").where("row <> chosen").select(F.col("row").alias(key)).distinct()
    again = staged(found.groupBy(F.col("row").alias(key)).count().where("count > 1").select(key))
    left = docs.withColumn(key, row_key()).join(gone, key, "left_anti")
    if not again.isEmpty():
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates([key]))
    return left.select(docs.columns)
