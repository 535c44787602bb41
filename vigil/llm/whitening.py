"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import staged

#: Components returned at most, and rows of a staged block at most.
COMPONENTS, BLOCK_ROWS = 8, 4096
#: Entries are counted in steps of 1/SCALE from -SHIFT on.
SCALE, SHIFT = 1024, 100_000
#: Steps are kept below this size, so that sums over a block fit 64 bits.
LARGEST = 1 << 44
#: Share of the table's norm under which a product counts as zero, part of a product that is orthogonal by roundoff only, residual of
#: a component that counts as found, and share of the first deviation under which a component has none.
ZERO, ORTHOGONAL, FOUND, FLAT = 1e-12, 1e-10, 1e-14, 1e-9
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_beyond_long string"


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of one length: their ids, entries as whole steps, and sums by dimension."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        lengths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        for d in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == d)
            for at in range(0, len(rows), BLOCK_ROWS):
                some = rows[at : at + BLOCK_ROWS]
                c = values[offsets[some][:, None] + np.arange(d)].astype(np.float64)
                fit = np.isfinite(c).all(axis=1)
                if not fit.any():
                    continue
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(c[fit] * SCALE) + SHIFT, -LARGEST, LARGEST).astype(np.int64)
                narrow = np.abs(x).max() < 1 << 31
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(d)], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([ids.take(pa.array(some[fit])).to_pylist()], pa.list_(pa.int64())),
                    pa.array([bool(narrow)]), pa.array([(x.astype("<i4") if narrow else x.astype("<i8")).tobytes()], pa.binary()), pa.array([x.sum(axis=0)], pa.list_(pa.int64())),
                ], ["dimension", "rows", "vec_ids", "narrow", "steps", "sums"])


@dataclass
class Fit:
    """What all rows of one length have in common: how many, and their exact sums."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean: whole steps first, which is exact, then the rest of the mean."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum)^2, exact: in 64 bits where they hold it."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        near = x - whole  # n * x - sum = n * near - rest
        rest = np.array([s % self.n for s in self.sums], np.int64)
        bound = (int(np.abs(near).max()) + 1) * self.n
        if bound**2 * x.shape[1] < 1 << 63:
            return ((near * self.n - rest) ** 2).sum(axis=1).tolist()
        return [int(v) for v in ((near.astype(object) * self.n - rest.astype(object)) ** 2).sum(axis=1)]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Scalar]]:
    for batch in batches:
        for r in range(batch.num_rows):
            kind = "<i4" if batch.column("narrow")[r].as_py() else "<i8"
            d = batch.column("dimension")[r].as_py()
            yield np.frombuffer(batch.column("steps")[r].as_buffer(), kind).astype(np.int64).reshape(-1, d), batch.column("vec_ids")[r] if "vec_ids" in batch.schema.names else None


def _summed(blocks: DataFrame, of_rows: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what of_rows gives for a matrix of rows: each task sums its own, Spark adds the tasks by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x, _ in _matrices(batches):
            total += of_rows(x)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["parts"])

    parts = blocks.select("dimension", "narrow", "steps").mapInArrow(run, "parts array<double>").select(F.posexplode("parts").alias("at", "part"))
    out = np.zeros(size)
    for row in parts.groupBy("at").agg(F.sum("part").alias("part")).collect():  # size rows, whatever the table holds
        out[row["at"]] = row["part"]
    return out


def bidiagonal(blocks: DataFrame, fit: Fit, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Singular values of the centred rows X, their right vectors as columns, and the squared norm of X.

    Each step is one pass that takes p = Xv and X'p. The left vectors u, as long as the table, aren't stored: each is X
    times a short vector w, so a pass finds them again and with them every product u'p. Both sides are orthogonalised
    against all before. X V = U B then holds, with B upper bidiagonal. A start that is used up, or that has found the wanted
    vectors, is followed by a new one, orthogonal to all before, which finds equal values again: of at most as many steps as the first."""
    d = len(fit.sums)
    rng = np.random.default_rng(seed)
    v_all, w_all, q_all = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    b = np.zeros((0, 0))
    beta, norm, first, ends = 0.0, 0.0, None, []

    def fresh() -> np.ndarray:
        while True:
            v = rng.normal(size=d)
            for _ in range(3):
                v /= np.linalg.norm(v)
                v -= v_all @ (v_all.T @ v)
            if np.linalg.norm(v) > ZERO:
                return v / np.linalg.norm(v)

    v = fresh()
    while True:
        k = v_all.shape[1]
        column = np.zeros(k + 1)
        a = v
        if beta:
            a, column[k - 1] = v - beta * w_all[:, -1], beta
        while True:

            def products(x: np.ndarray, a=a, w=w_all) -> np.ndarray:
                x = fit.centred(x)
                p = x @ a
                return np.concatenate([x.T @ p, (x @ w).T @ p, [p @ p, np.einsum("ij,ij->", x, x)]])

            sums = _summed(blocks, products, d + k + 2)
            q, c, length, norm = sums[:d], sums[d : d + k], sums[-2], sums[-1]
            column[:k] += c
            a, q = a - w_all @ c, q - q_all @ c
            if c @ c <= ORTHOGONAL**2 * length or length <= ZERO**2 * norm:
                break
        alpha = np.sqrt(max(length - c @ c, 0.0))
        if alpha <= ZERO * np.sqrt(norm):
            alpha, a, q = 0.0, np.zeros(d), np.zeros(d)
        else:
            a, q = a / alpha, q / alpha
        column[k] = alpha
        b = np.column_stack([np.vstack([b, np.zeros((1, k))]), column])
        v_all, w_all, q_all = np.column_stack([v_all, v]), np.column_stack([w_all, a]), np.column_stack([q_all, q])
        left, values, right = np.linalg.svd(b)
        if k + 1 == d:
            break
        v = q - alpha * v
        for _ in range(2):
            v = v - v_all @ (v_all.T @ v)
        beta = np.linalg.norm(v)
        top = min(wanted, k + 1)
        left_over = [(k, beta), *ends]
        residual = np.sqrt(sum((size * left[at, :top]) ** 2 for at, size in left_over))
        if first is None and k + 1 >= wanted and (residual <= FOUND * values[0]).all():
            first = k + 1
            ends.append((k, beta))
            beta = 0.0
        elif first is not None and k + 1 >= 2 * first and (residual <= FOUND * values[0]).all():
            break
        if beta <= ZERO * np.sqrt(norm):
            beta, v = 0.0, fresh()
        else:
            v = v / beta
    return values, v_all @ right.T, norm


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of vectors and each component.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out. Entries become whole steps
    floor(1024 * c) + 100000 (kept within 2^44). n rows and their exact sums S give deviation, the sum over dimensions of
    (n * x - S)^2: null where 64 bits don't hold it, and then in deviation_beyond_long as text. Components are unit
    eigenvectors of the covariance (divisor n) by falling eigenvalue e, those with e of zero left out: equal vectors and a
    single row have none and so no rows, and where fewer dimensions vary there are fewer components. explained is e over the trace.
    identity_error is the largest entry of the whitened rows' covariance minus the identity.

    Vectors of different lengths are fitted apart, each among its own length. Repeated rows and ids all count and all
    return; ties between eigenvalues give some basis of their space, the same for all rows. Other columns don't matter. Blocks of steps are
    staged once; each of the passes over them (as many as dimensions at most) sends the driver one number for each dimension and step."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    blocks = staged(rows.mapInArrow(_steps, "dimension int, rows long, vec_ids array<long>, narrow boolean, steps binary, sums array<long>"))
    totals: dict[int, Fit] = {}
    counted = dict(blocks.groupBy("dimension").agg(F.sum("rows")).collect())
    exact = blocks.select("dimension", F.posexplode("sums").alias("at", "s")).groupBy("dimension", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    for r in exact.orderBy("dimension", "at").collect():  # a row for each dimension
        totals.setdefault(r["dimension"], Fit(counted[r["dimension"]], [])).sums.append(int(r["s"]))
    out = [_whitened(blocks.where(F.col("dimension") == d), fit, components) for d, fit in sorted(totals.items())]
    out = [df for df in out if df is not None]
    if not out:
        return spark.createDataFrame([], SCHEMA)
    for df in out[1:]:
        out[0] = out[0].union(df)
    return out[0]


def _whitened(blocks: DataFrame, fit: Fit, components: int) -> DataFrame | None:
    values, vectors, norm = bidiagonal(blocks, fit, components)
    keep = int((values[:components] > max(FLAT * values[0], ZERO * np.sqrt(norm))).sum()) if norm else 0
    if not keep:
        return None
    to_white = vectors[:, :keep] * (np.sqrt(fit.n) / values[:keep])

    def moments(x: np.ndarray) -> np.ndarray:
        z = fit.centred(x) @ to_white
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    sums = _summed(blocks, moments, keep + keep**2) / fit.n
    error = float(np.abs(sums[keep:].reshape(keep, keep) - np.outer(sums[:keep], sums[:keep]) - np.eye(keep)).max())
    explained = values[:keep] ** 2 / norm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids in _matrices(batches):
            z, exact = fit.centred(x) @ to_white, fit.deviations(x)
            fits = [v if v < 1 << 63 else None for v in exact]
            beyond = [None if v < 1 << 63 else str(v) for v in exact]
            m = len(x)
            each = lambda values, kind: pa.array(values, kind).take(pa.array(np.repeat(np.arange(m), keep)))
            yield pa.RecordBatch.from_arrays([
                ids.values.take(pa.array(np.repeat(np.arange(m), keep))), pa.array(np.tile(np.arange(1, keep + 1), m), pa.int32()), pa.array(np.full(m * keep, fit.n), pa.int64()),
                each(fits, pa.int64()), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * keep, error)), each(beyond, pa.string()),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_beyond_long"])

    return blocks.select("dimension", "narrow", "steps", "vec_ids").mapInArrow(run, SCHEMA)
