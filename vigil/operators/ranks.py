"""Exact ranks without one task for all: percentiles and running sums over a total order, cut into pieces by approximate bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pieces that a group's values are cut into, and the accuracy of the bounds (bounded memory for each group).
PIECES, ACCURACY = 64, 2000


def _on(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return a.join(b, by) if by else a.crossJoin(F.broadcast(b))


def cut(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows (value not null) with piece: how many of the group's approximate bounds lie below the value. Equal values share a piece."""
    bounds = rows.groupBy(*by).agg(F.percentile_approx(value, [i / PIECES for i in range(1, PIECES)], ACCURACY).alias("__bounds"))
    return _on(rows, bounds, by).withColumn("piece", F.size(F.filter("__bounds", lambda b: b < F.col(value)))).drop("__bounds")


def running_sums(table: DataFrame, by: list[str], value: str, sums: dict[str, str]) -> DataFrame:
    """table with running sums (new name: column) from the highest value of each group down, its own row included; values are distinct in a group.

    Pieces are summed first; a row's sum is that of the higher pieces, of which a group has PIECES, and that inside its own piece."""
    pieces = cut(table, by, value)
    above = Window.partitionBy(*by).orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    totals = pieces.groupBy(*by, "piece").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    offsets = totals.select(*by, "piece", *(F.coalesce(F.sum(f"__{n}").over(above), F.lit(0.0)).alias(f"__{n}") for n in sums))
    down = Window.partitionBy(*by, "piece").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    return pieces.join(offsets, [*by, "piece"]).withColumns({n: F.sum(c).over(down) + F.col(f"__{n}") for n, c in sums.items()}).drop("piece", *(f"__{n}" for n in sums))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, tuple[float, str]]) -> DataFrame:
    """by, n and one column for each name in shares: the exact percentile of its share, "cont" (between neighbours) or "disc" (the
    least value with that share of rows at or below it). Null values are left out; a group without values has no row.

    Values are counted by piece first, so only the pieces that hold a wanted rank are looked at value by value."""
    known = cut(rows.where(F.col(value).isNotNull()).select(*by, value), by, value).groupBy(*by, "piece", value).agg(F.count("*").alias("k"))
    upto = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = known.groupBy(*by, "piece").agg(F.sum("k").alias("k")).withColumns({"before": F.coalesce(F.sum("k").over(upto), F.lit(0)), "n": F.sum("k").over(Window.partitionBy(*by))})

    def wanted(share: float, how: str) -> tuple[Column, Column, Column]:
        """The ranks from 0 of the values below and above, and the part of the way between them."""
        if how == "disc":
            rank = F.greatest(F.ceil(F.col("n") * share) - 1, F.lit(0))
            return rank, rank, F.lit(0.0)
        at = (F.col("n") - 1) * F.lit(float(share))
        return F.floor(at), F.ceil(at), at - F.floor(at)

    each = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), wanted(*spec)[side].cast("long").alias("rank"), wanted(*spec)[2].alias("way")) for name, spec in shares.items() for side in (0, 1)))
    asked = pieces.select(*by, "piece", "before", "k", "n", F.explode(each).alias("x")).where((F.col("x.rank") >= F.col("before")) & (F.col("x.rank") < F.col("before") + F.col("k")))
    asked = asked.select(*by, "piece", "before", "n", "x.*")
    inside = Window.partitionBy(*by, "piece").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    values = known.join(asked.select(*by, "piece").distinct(), [*by, "piece"], "left_semi").select(*by, "piece", value, "k", F.sum("k").over(inside).alias("upto"))
    found = asked.join(values, [*by, "piece"]).where((F.col("rank") - F.col("before") < F.col("upto")) & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("k")))
    at = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col(value)))
    way = lambda name: F.max(F.when(F.col("name") == name, F.col("way")))
    return found.groupBy(*by).agg(F.max("n").alias("n"), *((at(name, 0) + (at(name, 1) - at(name, 0)) * way(name) if how == "cont" else at(name, 0)).alias(name) for name, (_, how) in shares.items()))
