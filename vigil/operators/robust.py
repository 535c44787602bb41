"""Robust statistics by type, and causal propensity of channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators.ranks import percentiles

#: A quartile range below this counts as none.
NO_RANGE = 1e-9


def robust_fit(rows: DataFrame, key: str, measures: list[str], least: int) -> DataFrame:
    """key, own, measure, center, scale: median and quartile range (1 if there is none) of each measure for each value of key; those of
    all rows (own false) for values with fewer than `least` rows. Null keys are a value of their own, null and NaN measures are left out."""
    kind = F.coalesce(F.col(key).cast("string"), F.lit("__MISSING__"))
    parts = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures))
    long = rows.select(kind.alias(key), F.explode(parts).alias("x")).select(key, "x.*").where("v is not null and not isnan(v)")
    shares = {"q1": (0.25, "cont"), "center": (0.5, "cont"), "q3": (0.75, "cont")}
    whole, each = percentiles(long, ["measure"], "v", shares), percentiles(long, [key, "measure"], "v", shares)
    spread = lambda t: F.when(t["q3"] - t["q1"] > NO_RANGE, t["q3"] - t["q1"]).otherwise(1.0)
    sizes = rows.groupBy(kind.alias(key)).agg((F.count("*") >= least).alias("own"))
    whole = whole.select("measure", F.col("center").alias("all_center"), spread(whole).alias("all_scale"))
    each = each.select(key, "measure", "center", spread(each).alias("scale"))
    out = sizes.crossJoin(F.broadcast(whole)).join(each, [key, "measure"], "left")
    return out.select(key, "own", "measure", F.when(F.col("own"), F.col("center")).otherwise(F.col("all_center")).alias("center"), F.when(F.col("own"), F.col("scale")).otherwise(F.col("all_scale")).alias("scale"))


def robust_apply(rows: DataFrame, fitted: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """rows with z_<measure>, its distance from the median in ranges (0 where it is missing), clipped at 20, and deviation, the mean
    of the absolute distances that are known, each 20 at most (0 if none is)."""
    wide = fitted.groupBy(key).agg(*(F.max(F.when(F.col("measure") == m, F.struct("center", "scale"))).alias(f"__{m}") for m in measures))
    out = rows.withColumn("__key", F.coalesce(F.col(key).cast("string"), F.lit("__MISSING__"))).join(wide.withColumnRenamed(key, "__key"), "__key", "left")
    distance = {m: F.when(~F.isnan(F.col(m).cast("double")), (F.col(m) - F.col(f"__{m}.center")) / F.col(f"__{m}.scale")) for m in measures}
    known = F.array_compact(F.array(*(F.least(F.abs(x), F.lit(20.0)) for x in distance.values())))
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)
    clipped = {f"z_{m}": F.coalesce(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x)), F.lit(0.0)) for m, x in distance.items()}
    return out.withColumns(clipped | {"deviation": mean}).drop("__key", *(f"__{m}" for m in measures))


def propensity(rows: DataFrame, kind: str, windows: tuple[int, ...], weights: tuple[int, ...], least_prior: int) -> DataFrame:
    """channel_id, day with what was known of the channel's outcomes at the end of the day: rows (channel_id, kind, day, y, end) count if
    their window ended by then (end <= day + 1). Days and positives of each window and in all, their rates (null without days), the
    prior (the kind's rate from least_prior rows on, else the global one) with its source, and a smoothed rate for each weight.

    History is summed by (channel, end), (kind, end) and end first; then cumulated, and looked up as of each day."""
    probe = rows.select("channel_id", kind, "day", F.unix_date(F.date_add("day", 1)).alias("at"))
    ends = rows.withColumn("at", F.unix_date("end"))

    def asof(by: list[str], shift: int, name: str, probes: DataFrame) -> DataFrame:
        """probes with the number of rows and positives whose window ended by `at` - shift."""
        facts = ends.groupBy(*by, "at").agg(F.count("*").alias("n"), F.sum("y").alias("p")).select(*by, (F.col("at") + shift).alias("at"), F.lit(0).alias("probe"), "n", "p")
        asked = probes.select(*by, "at").distinct().select(*by, "at", F.lit(1).alias("probe"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("p"))
        over = Window.partitionBy(*by).orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
        both = facts.unionByName(asked).withColumns({f"n_{name}": F.sum("n").over(over), f"p_{name}": F.sum("p").over(over)}).where("probe = 1")
        return probes.join(both.select(*by, "at", f"n_{name}", f"p_{name}"), [*by, "at"], "left")

    out = asof(["channel_id"], 0, "all", probe)
    for w in windows:
        out = asof(["channel_id"], w, f"before_{w}", out)
    # By kind and over all there is a row for each day at most.
    out = asof([], 0, "global", asof([kind], 0, "kind", out))
    source = F.when(F.col("n_kind") >= least_prior, "type").when(F.col("n_global") > 0, "global").otherwise("none")
    prior = F.when(source == "type", F.col("p_kind") / F.col("n_kind")).when(source == "global", F.col("p_global") / F.col("n_global"))
    out = out.withColumns({"prior_source": source, "prior": prior})
    parts = []
    for w in windows:
        n, p = F.col("n_all") - F.col(f"n_before_{w}"), F.col("p_all") - F.col(f"p_before_{w}")
        parts += [n.alias(f"days_{w}d"), p.alias(f"positives_{w}d"), F.when(n > 0, p / n).alias(f"rate_{w}d")]
    smoothed = [((F.col("p_all") + m * F.col("prior")) / (F.col("n_all") + m)).alias(f"rate_m{m}") for m in weights]
    return out.select("channel_id", "day", *parts, F.col("n_all").alias("days_all"), F.col("p_all").alias("positives_all"), "prior_source", "prior", *smoothed)
