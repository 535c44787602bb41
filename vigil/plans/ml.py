"""Splits, sampling, models, calibration and scoring on pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators.panel import assert_leakage_safe


def temporal_split(rows: DataFrame, train_end: str, calibration_end: str, validation_end: str, lead: int = 2) -> DataFrame:
    """rows with split; those whose label window (day + 1 .. day + lead) reaches over a boundary are purged."""
    start, end = F.col("day"), F.date_add("day", lead)
    bounds = [("train", "1900-01-01", train_end), ("calibration", train_end, calibration_end), ("validation", calibration_end, validation_end), ("stress", validation_end, "2999-01-01")]
    split = F.lit(None).cast("string")
    for name, a, b in bounds:
        split = F.when((start >= F.lit(a).cast("date")) & (end < F.lit(b).cast("date")), name).otherwise(split)
    return rows.withColumn("split", split).where("split is not null")


def sampled(rows: DataFrame, ratio: int, seed: str = "s") -> DataFrame:
    """All positives and `ratio` negatives for each, those with the lowest hashes, with weights that restore the totals.

    Negatives are counted by the first four digits of their hash. All of the lower buckets are taken, and only
    the bucket at the bound is ranked, so the sample may be large without passing through one task."""
    counts = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).head()
    take = min(counts.n, max(1, ratio * counts.p))
    hashed = rows.where("label = 0").withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "channel_id", "day"))).withColumn("bucket", F.substring("h", 1, 4))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over 65,536 counts at most
    before = hashed.groupBy("bucket").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(upto), F.lit(0))).where(F.col("before") < take)
    known = hashed.join(F.broadcast(before), "bucket")
    whole = known.where(F.col("before") + F.col("k") <= take)
    edge = known.where(F.col("before") + F.col("k") > take).withColumn("i", F.row_number().over(Window.partitionBy("bucket").orderBy("h", "channel_id", "day"))).where(F.col("before") + F.col("i") <= take)
    negatives = whole.select(rows.columns).unionByName(edge.select(rows.columns))
    return rows.where("label = 1").withColumn("weight", F.lit(1.0)).unionByName(negatives.withColumn("weight", F.lit(counts.n / max(1, take))))


def boosted(numeric: list[str]) -> Pipeline:
    return Pipeline(stages=[Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}_m" for c in numeric]), VectorAssembler(inputCols=[f"{c}_m" for c in numeric], outputCol="features"), GBTClassifier(labelCol="label", weightCol="weight", maxIter=20, maxDepth=4, seed=1)])


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def tree_nodes(model: PipelineModel) -> DataFrame:
    """The fitted ensemble as a table: tree, node, feature, threshold, left, right (null at leaves), value, weight. A row goes left where its feature
    is at most the threshold."""
    fitted, out = model.stages[-1], []
    names = model.stages[-2].getInputCols()

    def walk(tree: int, weight: float, node, number: int) -> None:
        if node.subtreeDepth() == 0:
            out.append((tree, number, None, None, None, None, float(node.prediction()), weight))
            return
        split = node.split()
        out.append((tree, number, names[split.featureIndex()], float(split.threshold()), 2 * number, 2 * number + 1, float(node.prediction()), weight))
        walk(tree, weight, node.leftChild(), 2 * number)
        walk(tree, weight, node.rightChild(), 2 * number + 1)

    for i, (tree, weight) in enumerate(zip(fitted.trees, fitted.treeWeights, strict=True)):
        walk(i, float(weight), tree._java_obj.rootNode(), 1)
    return SparkSession.active().createDataFrame(out, "tree int, node int, feature string, threshold double, left int, right int, value double, weight double")


def tree_score(nodes: DataFrame) -> Column:
    """The probability of a row by a table of nodes, as one expression of its features: nested choices, without a model or a join.

    The table has as many rows as the ensemble has nodes, however many rows were fitted."""
    by: dict[int, dict[int, tuple]] = {}
    for r in nodes.collect():
        by.setdefault(r["tree"], {})[r["node"]] = r

    def value(tree: dict[int, tuple], number: int) -> Column:
        r = tree[number]
        if r["feature"] is None:
            return F.lit(r["value"])
        return F.when(F.col(r["feature"]) <= r["threshold"], value(tree, r["left"])).otherwise(value(tree, r["right"]))

    margin = F.lit(0.0)
    for i in sorted(by):
        margin = margin + F.lit(by[i][1]["weight"]) * value(by[i], 1)
    return 1 / (1 + F.exp(-2 * margin))


def filled(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with the columns that the ensemble's nodes name: its inputs without nulls."""
    return model.stages[0].transform(rows)


def score_day(rows: DataFrame, score: Column, day: Column, reasons: dict[str, Column]) -> DataFrame:
    """Every channel of a day with its window: scored, or abstaining with the codes whose condition holds."""
    codes = F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in reasons.items())))
    fine = F.size("reasons") == 0
    return rows.withColumns({"reasons": codes, "day": day}).withColumns({"status": F.when(fine, "scored").otherwise("abstain"), "score": F.when(fine, score), "window_start": F.date_add("day", 2), "window_end": F.date_add("day", 3)})


#: What a preset leaves out of the features, by parts of their names.
PRESETS = {"all": (), "core": ("previous", "gap_days", "days_since"), "no_same_day_failure": ("failure", "days_since"), "no_calendar": ("weekday", "month"), "no_catalogue": ("catalogue", "sensor_type", "system")}


def preset(features: list[str], name: str) -> list[str]:
    """The features of a preset; "recurrence" has only those that "core" leaves out."""
    if name == "recurrence":
        return [f for f in features if any(x in f for x in PRESETS["core"])]
    return [f for f in features if not any(x in f for x in PRESETS[name])]


def checked(columns: list[str], features: list[str]) -> list[str]:
    """The features, after the leakage guard."""
    assert_leakage_safe(columns, features)
    return features


def decide(metrics: DataFrame, lows: DataFrame, folds: DataFrame, types: DataFrame, by: list[str], baselines: list[str], models: dict[str, str], least_positives: int, tolerance: float, least_known: float, tie: float = 0.005) -> DataFrame:
    """Gates over all folds and the model that follows from them, for each value of by.

    metrics: by, fold, key, ap. lows: by, fold, key, low, the lower bound of the difference to the fold's best baseline. folds: by,
    fold, positives, known. types: by, fold, key, type, ap, for types with support. models: which key is "full", "reduced" (without
    what may be a shortcut), "uncatalogued" and "simple". A model beats the baselines if its bound is above 0 in each fold. The full model
    gives way to the reduced one if that loses more than the tolerance in a fold and beats the baselines too, and either to the simple one if that beats
    them and its mean is less than `tie` behind. stable: in each fold with two types or more, the selected model is better than the best baseline for two
    thirds of them; null if no fold has so many. Too few positives in a fold end it: insufficient_events, nothing is selected."""
    rank = F.coalesce(*(F.when(F.col("key") == k, -i) for i, k in enumerate(baselines)))
    best = metrics.where(F.col("key").isin(*baselines)).groupBy(*by, "fold").agg(F.max_by("key", F.struct(F.coalesce("ap", F.lit(-1.0)), rank)).alias("best"))
    full = metrics.where(F.col("key") == models["full"]).select(*by, "fold", F.col("ap").alias("full"))
    rows = metrics.join(lows, [*by, "fold", "key"], "left").join(full, [*by, "fold"])
    of = lambda k, c: F.when(F.col("key") == k, c)
    beats = {n: F.bool_and(of(k, F.coalesce("low", F.lit(-1.0)) > 0)).alias(f"beats_{n}") for n, k in models.items()}
    ratio = {n: (F.min(of(k, F.col("ap") / F.greatest("full", F.lit(1e-12)))) >= 1 - tolerance).alias(f"keeps_{n}") for n, k in models.items() if n in ("reduced", "uncatalogued")}
    mean = {n: F.avg(of(k, F.col("ap"))).alias(f"mean_{n}") for n, k in models.items()}
    simple_best = F.greatest(*(F.struct(F.avg(of(k, F.col("ap"))).alias("m"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(baselines)))["k"].alias("baseline")
    out = rows.groupBy(*by).agg(*beats.values(), *ratio.values(), *mean.values(), simple_best)
    counted = folds.groupBy(*by).agg(F.bool_and(F.col("positives") >= least_positives).alias("enough"), F.bool_and(F.col("known") >= least_known).alias("known_share"))
    out = out.join(counted, by)
    c = F.col
    first = F.when(~c("keeps_reduced") & c("beats_reduced"), F.lit("reduced")).otherwise(F.lit("full"))
    simple = c("beats_simple") & (c("mean_simple") >= F.when(first == "reduced", c("mean_reduced")).otherwise(c("mean_full")) - tie)
    name = F.when(c("beats_full"), F.when(simple, "simple").otherwise(first)).when(c("beats_simple"), "simple")
    chosen = F.coalesce(*(F.when(name == n, F.lit(k)) for n, k in models.items()), c("baseline"))
    level = F.when(~c("enough"), "insufficient_events").when(c("beats_full") | c("beats_simple"), "validated_proxy_model").otherwise("baseline_only")
    out = out.withColumns({"evidence_level": level, "selected": F.when(c("enough"), chosen)})
    mine = types.join(out.select(*by, "selected"), by).where(c("key") == c("selected")).select(*by, "fold", "type", c("ap").alias("mine"))
    base = types.join(best, [*by, "fold"]).where(c("key") == c("best")).select(*by, "fold", "type", c("ap").alias("base"))
    common = mine.join(base, [*by, "fold", "type"]).groupBy(*by, "fold").agg(F.count("*").alias("n"), F.count_if(c("mine") > c("base")).alias("better")).where("n >= 2")
    stable = common.groupBy(*by).agg(F.bool_and(3 * c("better") >= 2 * c("n")).alias("stable"))
    gates = ["beats_full", "beats_reduced", "beats_simple", "keeps_reduced", "keeps_uncatalogued", "known_share"]
    out = out.join(stable, by, "left").withColumns({g: F.when(c("enough"), c(g)) for g in gates})
    return out.select(*by, "enough", *gates, F.when(level == "validated_proxy_model", c("stable")).alias("stable"), "evidence_level", "selected")


def decision(metrics: DataFrame, least: float) -> DataFrame:
    """use, abstain or unknown by the lower bound of an interval."""
    return metrics.withColumn("decision", F.when(F.col("low").isNull(), "unknown").when(F.col("low") > least, "use").otherwise("abstain"))


def last_rows(rows: DataFrame, length: int, values: list[str]) -> DataFrame:
    """For each row the last `length` rows of its channel as arrays, left-padded with nulls, and a mask."""
    by = Window.partitionBy("channel_id").orderBy("day").rowsBetween(-(length - 1), 0)
    seen = F.collect_list(F.struct(*values)).over(by)
    out = rows.withColumn("seen", seen)
    pad = F.array_repeat(F.lit(None).cast(out.schema["seen"].dataType.elementType), F.lit(length) - F.size("seen"))
    return out.select("channel_id", "day", F.concat(pad, F.col("seen")).alias("sequence"), F.concat(F.array_repeat(F.lit(0), F.lit(length) - F.size("seen")), F.array_repeat(F.lit(1), F.size("seen"))).alias("mask"))
