"""Logistic regression by Newton steps on summed moments: exact whatever the partitions, for many groups and feature sets in one pass a step."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.ranks import percentiles

#: Newton steps, the weight of the squared coefficients (the intercept's left out) by unit of weight, and categories with a column of their own.
STEPS, RIDGE, CATEGORIES = 8, 0.01, 50


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


@dataclass(frozen=True)
class Design:
    """How a row becomes numbers: medians for nulls, signed logarithms, mean and deviation of the fitted rows, the commonest categories."""

    numeric: list[str]
    medians: list[float]
    means: list[float]
    deviations: list[float]
    category: str | None
    known: list[str]

    @classmethod
    def of(cls, rows: DataFrame, numeric: list[str], category: str | None = None) -> Design:
        medians = [float((percentiles(rows.select(F.col(c).cast("double").alias("v")), [], "v", {"m": (0.5, "cont")}).head() or [0, 0.0])[1]) for c in numeric]
        filled = [signed_log(F.coalesce(F.col(c).cast("double"), F.lit(m))) for c, m in zip(numeric, medians, strict=True)]
        m = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(filled)), *(F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(filled))).head()
        known: list[str] = []
        if category:  # CATEGORIES rows at most
            known = [r[0] for r in rows.where(F.col(category).isNotNull()).groupBy(category).count().orderBy(F.desc("count"), category).limit(CATEGORIES).collect()]
        return cls(numeric, medians, [m[f"m{i}"] or 0.0 for i in range(len(numeric))], [m[f"s{i}"] or 1.0 for i in range(len(numeric))], category, known)

    def standardised(self) -> list[Column]:
        each = zip(self.numeric, self.medians, self.means, self.deviations, strict=True)
        return [(signed_log(F.coalesce(F.col(c).cast("double"), F.lit(m))) - F.lit(mean)) / F.lit(s) for c, m, mean, s in each]

    def vector(self) -> Column:
        """1, the standardised numbers, and one column for each known category."""
        hot = [F.coalesce((F.col(self.category) == k).cast("double"), F.lit(0.0)) for k in self.known] if self.category else []
        return F.array(F.lit(1.0), *self.standardised(), *hot)

    def names(self) -> list[str]:
        return ["intercept", *self.numeric, *(f"{self.category}={k}" for k in self.known)]


def _moments(betas: dict[str, np.ndarray], size: int):
    """For each group the sums of w p (1 - p) x x', w (y - p) x and w over a task's rows, as one vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {g: np.zeros((size, size + 1)) for g in betas}
        weight = dict.fromkeys(betas, 0.0)
        for pdf in batches:
            for group, own in pdf.groupby("g"):
                x, y, w = np.stack(own["x"]), own["y"].to_numpy(float), own["w"].to_numpy(float)
                for g, beta in betas.items():
                    if g.split("\t")[0] == group:
                        p = 1 / (1 + np.exp(-np.clip(x @ beta, -700, 700)))
                        sums[g][:, :size] += (x * (w * p * (1 - p))[:, None]).T @ x
                        sums[g][:, size] += x.T @ (w * (y - p))
                        weight[g] += w.sum()
        yield pd.DataFrame({"g": list(sums), "parts": [np.append(s.ravel(), weight[g]) for g, s in sums.items()]})

    return run


def newton(rows: DataFrame, groups: list[str], size: int, masks: dict[str, np.ndarray] | None = None, ridge: float = RIDGE, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Coefficients of each group and mask ("group<tab>mask", or the group alone without masks).

    rows: g (group), x (array of size numbers, the first of them 1), y (0 or 1), w (weight). masks: which numbers a fit may use. A step is
    one aggregate: tasks sum their rows' moments, Spark adds them by place, and the driver solves a system of size equations for
    each fit. A group without rows keeps zeros."""
    fits = {g if masks is None else f"{g}\t{name}": np.ones(size, bool) if masks is None else masks[name] for g in groups for name in (masks or {"": None})}
    betas = {g: np.zeros(size) for g in fits}
    # Equal rows are one row of their summed weight. They are read once a step; what an executor loses is made again.
    held_rows = rows.groupBy("g", "x", "y").agg(F.sum("w").alias("w")).persist()
    for _ in range(steps):
        parts = held_rows.mapInPandas(_moments(betas, size), "g string, parts array<double>").select("g", F.posexplode("parts").alias("at", "v"))
        found: dict[str, np.ndarray] = {g: np.zeros(size * (size + 1) + 1) for g in fits}
        for r in parts.groupBy("g", "at").agg(F.sum("v").alias("v")).collect():  # size * (size + 1) + 1 numbers for each fit
            found[r["g"]][r["at"]] = r["v"]
        for g, use in fits.items():
            total = found[g][-1]
            if not total:
                continue
            m = found[g][:-1].reshape(size, size + 1) / total
            held = ridge * np.r_[0.0, np.ones(size - 1)]
            left, right = m[:, :size] + np.diag(held), m[:, size] - held * betas[g]
            betas[g] = betas[g].copy()
            betas[g][use] += np.linalg.solve(left[np.ix_(use, use)], right[use])
    held_rows.unpersist()
    return betas


def score(vector: Column, beta: np.ndarray) -> Column:
    """The probability of a row's vector, as one expression."""
    logit = F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(b)) for b in beta)), lambda x, b: x * b), F.lit(0.0), lambda a, x: a + x)
    return 1 / (1 + F.exp(-logit))


def logit(c: Column) -> Column:
    p = F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def platt(rows: DataFrame) -> tuple[float, float]:
    """Intercept and slope on the logits of score that fit label (nulls left out); the identity if a class is missing."""
    known = rows.where("label is not null").select(F.lit("all").alias("g"), F.array(F.lit(1.0), logit(F.col("score"))).alias("x"), F.col("label").alias("y"), F.lit(1.0).alias("w"))
    if known.select("y").distinct().count() < 2:
        return 0.0, 1.0
    intercept, slope = newton(known, ["all"], 2, ridge=1e-6)["all"]
    return float(intercept), float(slope)


def top_factors(design: Design, beta: np.ndarray, n: int = 3) -> Column:
    """Names of the numbers that push a row's logit up most, at most n, the strongest first."""
    pushes = F.array(*(F.struct((x * F.lit(float(b))).alias("push"), F.lit(name).alias("name")) for x, b, name in zip(design.standardised(), beta[1:], design.numeric, strict=False)))
    best = F.slice(F.sort_array(F.filter(pushes, lambda p: p["push"] > 0), asc=False), 1, n)
    return F.transform(best, lambda p: p["name"])


def newton_sql(name: str, rows: str, ridge: float, steps: int = STEPS) -> str:
    """The same fit as DuckDB SQL, to hold the queries to: common tables that end in <name>(g, b). rows: a table (g, x, y, w) whose arrays
    are of one length. A system is solved by elimination, one pivot a row of a recursive table."""
    out = f"{name}_b0 AS (SELECT g, list_transform(any_value(x), lambda v: CAST(0 AS DOUBLE)) AS b, sum(w) AS total, len(any_value(x)) AS size FROM {rows} GROUP BY g)"
    for k in range(1, steps + 1):
        b, step = f"{name}_b{k - 1}", f"{name}_{k}"
        out += f""", {step}p AS (SELECT r.g, x, w, y, total, size, b, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM {rows} r JOIN {b} USING (g)),
{step}h AS (SELECT g, i, j, sum(CASE WHEN j <= size THEN w * p * (1 - p) * x[i] * x[least(j, size)] ELSE w * (y - p) * x[i] END) / any_value(total) AS h FROM {step}p, range(1, 60) AS ti(i), range(1, 61) AS tj(j) WHERE i <= size AND j <= size + 1 GROUP BY g, i, j),
{step}r AS (SELECT h.g, i, list(h + CASE WHEN i > 1 AND j = i THEN {ridge} WHEN i > 1 AND j = size + 1 THEN -{ridge} * b[i] ELSE 0 END ORDER BY j) AS r FROM {step}h h JOIN {b} USING (g) GROUP BY h.g, i),
{step}e AS (SELECT g, list(r ORDER BY i) AS m, CAST(1 AS BIGINT) AS k FROM {step}r GROUP BY g UNION ALL SELECT g, list_transform(m, lambda r, j: CASE WHEN j = k THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, i: v - m[j][k] / m[k][k] * m[k][i]) END), k + 1 FROM {step}e WHERE k <= len(m)),
{name}_b{k} AS (SELECT g, list_transform(range(1, size + 1), lambda i: b[i] + m[i][size + 1]) AS b, total, size FROM {step}e JOIN {b} USING (g) WHERE k = len(m) + 1)"""
    return out + f", {name} AS (SELECT g, b FROM {name}_b{steps})"
