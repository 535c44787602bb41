"""Approximate nearest neighbours by multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import staged

#: Tables, projections in each, bucket width on unit vectors, and buckets visited in each table for a query.
TABLES, PROJECTIONS, WIDTH, PROBES = 5, 14, 3.0, 900
#: Queries hashed at once.
QUERIES_AT_ONCE = 256
#: Rows and queries that meet in one task at most, and rows of the plan of groups that are broadcast at most.
GROUP_ROWS, GROUP_QUERIES, PLAN_ROWS = 8192, 1024, 500_000

def probe_sets(k: int, count: int) -> list[list[int]]:
    """Perturbation sets over the 2k bucket sides ranked by distance, in order of expected squared distance.

    Sides of one projection hold ranks that sum to 2k - 1; a set never has both."""
    side = [j * (j + 1) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(1, 2 * k + 1)]
    out: list[list[int]] = [[]]
    heap = [(side[0], [0])]
    while heap and len(out) < count:
        score, chosen = heapq.heappop(heap)
        if all(2 * k - 1 - x not in chosen for x in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (score - side[last] + side[last + 1], [*chosen[:-1], last + 1]))
            heapq.heappush(heap, (score + side[last + 1], [*chosen, last + 1]))
    return out


@dataclass
class PStableIndex:
    """TABLES hash functions: each a vector of floor((projection + offset) / width), kept as one mixed key."""

    directions: np.ndarray  # (tables, projections, dimension)
    offsets: np.ndarray
    multipliers: np.ndarray

    @classmethod
    def make(cls, dimension: int, seed: int = 11) -> PStableIndex:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(size=(TABLES, PROJECTIONS, dimension)), rng.uniform(0, WIDTH, (TABLES, PROJECTIONS)), rng.integers(1, 1 << 62, (TABLES, PROJECTIONS)) | 1)

    def places(self, unit: np.ndarray, table: int) -> np.ndarray:
        return (unit @ self.directions[table].T + self.offsets[table]) / WIDTH

    def keys(self, places: np.ndarray, table: int) -> np.ndarray:
        return (np.floor(places).astype(np.int64) * self.multipliers[table]).sum(axis=1)

    def probes(self, unit: np.ndarray, table: int, sets: list[list[int]]) -> np.ndarray:
        """(queries, probes) keys: the own bucket and its neighbours, likeliest first."""
        places = self.places(unit, table)
        below = places - np.floor(places)
        order = np.argsort(np.concatenate([below, 1 - below], axis=1), axis=1, kind="stable")
        step = np.where(order < PROJECTIONS, -1, 1) * self.multipliers[table][order % PROJECTIONS]
        base = self.keys(places, table)
        return np.stack([base + step[:, s].sum(axis=1) if s else base for s in sets], axis=1)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best ids of each query, each once with its best score; ties to the smaller id."""
    order = np.lexsort((-score, ids, q))
    q, ids, score = q[order], ids[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, score = q[new], ids[new], score[new]
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return q[place < k], ids[place < k], score[place < k]


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _by_size(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for size, part in pdf.groupby("size"):
        yield int(size), part, _vectors(part["embedding"])


def _hash_rows(groups: int):
    """Each row once for each table, with its bucket and the group that the bucket falls in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part, vectors in _by_size(pdf):
                once = list({(i, v.tobytes()): at for at, (i, v) in enumerate(zip(part["vec_id"].tolist(), vectors, strict=True))}.values())
                part, unit, index = part.iloc[once], _unit(vectors[once]), PStableIndex.make(size)
                for t in range(TABLES):
                    keys = index.keys(index.places(unit, t), t)
                    yield pd.DataFrame({"size": size, "part": t * groups + keys % groups, "bucket": keys, "vec_id": part["vec_id"].to_numpy(), "embedding": part["embedding"].to_numpy()})

    return run


def _hash_queries(groups: int):
    """Each query once for each group that it probes, with the buckets that it visits there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = probe_sets(PROJECTIONS, PROBES)
        for pdf in batches:
            for size, part, vectors in _by_size(pdf):
                index, unit = PStableIndex.make(size), _unit(vectors)
                ids, held = part["vec_id"].to_numpy(), part["embedding"].to_numpy()
                for at in range(0, len(part), QUERIES_AT_ONCE):
                    for t in range(TABLES):
                        probes = index.probes(unit[at : at + QUERIES_AT_ONCE], t, sets)
                        order = np.argsort(probes % groups, axis=1, kind="stable")
                        flat = np.take_along_axis(probes, order, axis=1).ravel()
                        group, owner = flat % groups, at + np.repeat(np.arange(len(probes)), probes.shape[1])
                        start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])])
                        own = owner[start]
                        yield pd.DataFrame({"size": size, "part": t * groups + group[start], "query_id": ids[own], "buckets": np.split(flat, start[1:]), "embedding": held[own]})

    return run


def _search(k: int):
    """The k best rows of a group for each of its queries, among those in buckets that the query visits. No other pair is multiplied."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)}
        if not len(rows) or not len(queries):
            return pd.DataFrame(out)
        rows = rows.sort_values(["bucket", "vec_id"], ignore_index=True)
        vectors, wanted = _vectors(rows["embedding"]), _vectors(queries["embedding"])
        unit, unit_queries = _unit(vectors), _unit(wanted)
        ids, query_ids = rows["vec_id"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64)
        probed = np.concatenate(queries["buckets"].to_numpy()).astype(np.int64)
        owner = np.repeat(np.arange(len(queries)), queries["buckets"].map(len))
        order = np.argsort(probed, kind="stable")
        probed, owner = probed[order], owner[order]
        buckets, start = np.unique(rows["bucket"].to_numpy(np.int64), return_index=True)
        low, high = np.searchsorted(probed, buckets), np.searchsorted(probed, buckets, side="right")
        near = np.full((len(queries), len(rows)), -np.inf)
        for b, (a, z) in enumerate(zip(start, np.r_[start[1:], len(rows)], strict=True)):
            if low[b] < high[b]:
                q = np.unique(owner[low[b] : high[b]])
                near[q, a:z] = unit_queries[q] @ unit[a:z].T
        near[query_ids[:, None] == ids[None, :]] = -np.inf
        # What can be among the k best ids, with room for rounding; only these are measured exactly and ranked.
        distinct, of = np.unique(ids, return_inverse=True)
        per_id = near
        if len(distinct) < len(ids):
            by = np.argsort(of, kind="stable")
            per_id = np.maximum.reduceat(near[:, by], np.flatnonzero(np.r_[True, np.diff(of[by]) > 0]), axis=1)
        least = np.partition(per_id, -k, axis=1)[:, -k] if per_id.shape[1] > k else np.full(len(queries), -np.inf)
        q, r = np.nonzero((near > -np.inf) & (near >= least[:, None] - 1e-9))
        q, best, score = _best(q, ids[r], _cosine(wanted[q], vectors[r]), k)
        return pd.DataFrame({"query_id": query_ids[q], "vec_id": best, "score": score})

    return run


def _met(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of the k best in each task, where rows and queries of one (size, part) meet.

    A group of more than GROUP_ROWS rows or GROUP_QUERIES queries is dealt over a grid of tasks by hash, so a bucket of any size is
    searched whole and no task grows with it. The plan of groups is broadcast behind a check of its size, or else joined."""
    on = ["size", "part"]
    pieces = lambda n, most: F.ceil(F.count("*") / most).cast("long").alias(n)
    plan = staged(rows.groupBy(on).agg(pieces("rs", GROUP_ROWS)).join(queries.groupBy(on).agg(pieces("qs", GROUP_QUERIES)), on))
    known = F.broadcast(plan) if plan.count() <= PLAN_ROWS else plan
    dealt = lambda *by: F.xxhash64(*by, F.lit(3))
    left = rows.join(known, on).withColumns({"r": F.pmod(dealt("vec_id", "embedding"), "rs"), "q": F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1))})
    right = queries.join(known, on).withColumns({"q": F.pmod(dealt("query_id"), "qs"), "r": F.explode(F.sequence(F.lit(0).cast("long"), F.col("rs") - 1))})
    keys = [*on, "r", "q"]
    left, right = left.select(*keys, "bucket", "vec_id", "embedding"), right.select(*keys, "buckets", "query_id", "embedding")
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(_search(k), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose vec_id is divisible by `every`.

    vectors: vec_id, embedding (array of numbers). Every row is hashed into a bucket of each table, every query into the PROBES
    buckets of each table that likely hold its neighbours; buckets fall into groups of about GROUP_ROWS rows by key, and rows and
    queries of one group meet by a join on it. A query is multiplied with the rows of the buckets that it visits, and no others; the
    k best of each group go on, and those of all tables are merged. Nothing is collected, and no bucket is capped (`_met`). Cosines
    are taken in double precision on the original vectors. Queries whose probes found fewer than k rows are then compared with all rows.

    Rows without vec_id, null, empty or zero vectors, and those with null or non-finite components take no part.
    Vectors are compared with those of their own length, whatever lengths there are, in the same pass. Ties go
    to the smaller vec_id; repeated rows of one vec_id count as one row (their best cosine). With no queries, or no other row, there are no results."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    e = F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    fine = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"), F.size(e).alias("size")).where(F.col("vec_id").isNotNull() & fine)
    # A query for each id and length; only ids that come again are shuffled to find one.
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    again = staged(queries.groupBy("vec_id", "size").count().where("count > 1").select("vec_id", "size"))
    if not again.isEmpty():
        of = ["vec_id", "size"]
        queries = queries.join(again, of, "left_anti").select(rows.columns).union(queries.join(again, of).dropDuplicates(of).select(rows.columns))
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    vector = f"embedding {rows.schema['embedding'].dataType.simpleString()}"
    hashed = rows.mapInPandas(_hash_rows(groups), f"size int, part long, bucket long, vec_id long, {vector}")
    probing = staged(queries.mapInPandas(_hash_queries(groups), f"size int, part long, query_id long, buckets array<long>, {vector}"))

    def ranked(met: DataFrame) -> DataFrame:
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = staged(ranked(_met(hashed, probing, k)))
    full = found.groupBy(F.col("query_id").alias("vec_id")).count().where(F.col("count") >= k)
    short = staged(queries.join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return found
    # Every row in bucket 0 of its group by id, and every such query in each group.
    everywhere = rows.select("size", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("part"), F.lit(0).cast("long").alias("bucket"), "vec_id", "embedding")
    asked = short.select("size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), F.col("vec_id").alias("query_id"), F.array(F.lit(0).cast("long")).alias("buckets"), "embedding")
    rest = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").select(found.columns)
    return rest.union(ranked(_met(everywhere, asked, k)))
