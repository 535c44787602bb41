"""Alert budgets, cooldowns, matching, and metrics of scores."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators.ranks import cut, running_sums


def ranked(scores: DataFrame, *by: str) -> DataFrame:
    """scores with the rank of each day, ties by channel."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or ("day",))).orderBy(F.desc("score"), "channel_id")))


def select_day(scores: DataFrame, past: DataFrame, day: str, k: int, cooldown: int) -> DataFrame:
    """The k best of one day among channels without an alert in the `cooldown` - 1 days before."""
    at = F.lit(day).cast("date")
    recent = past.where((F.col("day") < at) & (F.col("day") > F.date_sub(at, cooldown))).select("channel_id").distinct()
    return ranked(scores.where(F.col("day") == at).join(recent, "channel_id", "left_anti")).where(F.col("rank") <= k)


def cooled(alerts: DataFrame, cooldown: int) -> DataFrame:
    """Budget first, then cooldown: an alert stays if its channel's last alert that stayed is `cooldown` days back. A fold over each channel's alerts."""
    listed = alerts.groupBy("channel_id").agg(F.array_sort(F.collect_list(F.struct("day", "score"))).alias("all"))
    kept = F.aggregate("all", F.expr("cast(array() as array<struct<day:date,score:double>>)"), lambda a, x: F.when((F.size(a) == 0) | (F.date_diff(x["day"], F.element_at(a, F.greatest(F.size(a), F.lit(1)))["day"]) >= cooldown), F.concat(a, F.array(x))).otherwise(a))
    # Each element is the struct (day, score); a fold keeps its order.
    return listed.select("channel_id", F.explode(kept).alias("x")).select("channel_id", "x.day", "x.score")


def refilled(scores: DataFrame, k: int, cooldown: int) -> DataFrame:
    """Budget and cooldown together: the day's slots of cooling channels go to the next best.

    Days depend on each other, so one group folds over them; it gets the k * cooldown best rows of each day
    only, which is enough: at most k * (cooldown - 1) channels can be cooling. So it holds k * cooldown rows for
    each day of the calendar, however many channels there are."""
    few = ranked(scores).where(F.col("rank") <= k * cooldown).select("channel_id", "day", "score")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        last: dict[int, object] = {}
        out = []
        for day, rows in pdf.sort_values(["day", "score", "channel_id"], ascending=[True, False, True]).groupby("day", sort=True):
            free = [r for r in rows.itertuples() if r.channel_id not in last or (day - last[r.channel_id]).days >= cooldown][:k]
            for r in free:
                last[r.channel_id] = day
                out.append((r.channel_id, day, r.score))
        return pd.DataFrame(out, columns=["channel_id", "day", "score"])

    return few.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fold, few.schema)


def matched(alerts: DataFrame, events: DataFrame, lead: int = 2, length: int = 1) -> DataFrame:
    """One-to-one matches of alerts (channel_id, day) with events (channel_id, event_day) in [day + lead, day + lead
    + length), each alert in turn with the earliest free event. Windows of one length in the order of days make
    that a fold over each channel's candidates."""
    near = alerts.select("channel_id", "day").join(events.select("channel_id", "event_day").distinct(), "channel_id").where((F.col("event_day") >= F.date_add("day", lead)) & (F.col("event_day") < F.date_add("day", lead + length)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for day, rows in pdf.sort_values(["day", "event_day"]).groupby("day", sort=True):
            for event in rows["event_day"]:
                if event not in used:
                    used.add(event)
                    out.append((rows["channel_id"].iat[0], day, event))
                    break
        return pd.DataFrame(out, columns=["channel_id", "day", "event_day"])

    return near.groupBy("channel_id").applyInPandas(fold, near.schema)


def matched_on_start(alerts: DataFrame, events: DataFrame, key: str, start: str) -> DataFrame:
    """Alerts, events, and events that an alert of the same key and start meets."""
    a, e = alerts.select(key, start).distinct(), events.select(key, start).distinct()
    both = a.withColumn("a", F.lit(1)).join(e.withColumn("e", F.lit(1)), [key, start], "full")
    return both.agg(F.count("a").alias("alerts"), F.count("e").alias("events"), F.count_if(F.col("a").isNotNull() & F.col("e").isNotNull()).alias("hits"))


def score_table(rows: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """Positives and negatives of each distinct score (weighted), with running sums from the highest score. Rows without score are left out."""
    w = F.col(weight) if weight else F.lit(1.0)
    table = rows.where("label is not null").groupBy(*by, "score").agg(F.sum(F.when(F.col("label") == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("label") == 0, w).otherwise(0.0)).alias("neg"))
    return running_sums(table.where("score is not null"), list(by), "score", {"tp": "pos", "fp": "neg"})


def average_precision(rows: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """n, positives, average precision with ties grouped, and area under the ROC curve, for each group."""
    t = score_table(rows, *by, weight=weight)
    pos, neg = F.sum("pos"), F.sum("neg")
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return t.groupBy(*by).agg((pos + neg).alias("n"), pos.alias("positives"), (F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(pos, F.lit(0.0))).alias("ap"), (area / F.nullif(pos * neg, F.lit(0.0))).alias("auc"))


def point_metrics(rows: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Precision, recall, Brier score and false alerts in 1000 rows at a threshold."""
    known = rows.where("label is not null")
    hit, true = F.col("score") >= threshold, F.col("label") == 1
    tp, alerts, pos = F.count_if(hit & true), F.count_if(hit), F.count_if(true)
    return known.groupBy(*by).agg(F.count("*").alias("n"), (tp / F.nullif(alerts, F.lit(0))).alias("precision"), (tp / F.nullif(pos, F.lit(0))).alias("recall"), F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2.0))).alias("brier"), (1000 * (alerts - tp) / F.count("*")).alias("false_in_1000"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Rows, mean score and label rate of equal-width bins; the expected calibration error is their weighted gap."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return rows.where("label is not null").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("rate"))


def expected_calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    return calibration(rows, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))


def threshold_for_precision(rows: DataFrame, least: float) -> DataFrame:
    """The score with the highest recall whose precision reaches `least` (the highest score of ties)."""
    t = score_table(rows).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).where(F.col("precision") >= least)
    return t.orderBy(F.desc("tp"), F.desc("score")).limit(1).select(F.col("score").alias("threshold"), "precision", "tp")


def best_f1(rows: DataFrame) -> DataFrame:
    whole = rows.agg(F.count_if(F.col("label") == 1).alias("all_pos"))
    t = score_table(rows).crossJoin(F.broadcast(whole)).withColumn("f1", 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_pos")))
    return t.orderBy(F.desc("f1"), F.desc("score")).limit(1).select(F.col("score").alias("threshold"), "f1")


def budget_curve(rows: DataFrame, budgets: list[int]) -> DataFrame:
    """For k alerts a day: alerts, known and positive ones, precision on known, and bounds with unknown outcomes all wrong or all right."""
    r = ranked(rows)
    pos, known = F.col("label") == 1, F.col("label").isNotNull()
    parts = []
    for k in budgets:
        own = F.col("rank") <= k
        parts += [F.count_if(own).alias(f"alerts_{k}"), F.count_if(own & known).alias(f"known_{k}"), F.count_if(own & pos).alias(f"hits_{k}")]
    one = r.agg(F.count_if(pos).alias("positives"), *parts)
    each = F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"{n}_{k}").alias(n) for n in ("alerts", "known", "hits"))) for k in budgets))
    out = one.select("positives", F.explode(each).alias("x")).select("positives", "x.*")
    return out.withColumns({"precision": F.col("hits") / F.nullif(F.col("known"), F.lit(0)), "precision_low": F.col("hits") / F.col("alerts"), "precision_high": (F.col("hits") + F.col("alerts") - F.col("known")) / F.col("alerts"), "recall": F.col("hits") / F.nullif(F.col("positives"), F.lit(0))})


def budget_threshold(rows: DataFrame, k: int) -> DataFrame:
    """The lowest score that a daily budget selects."""
    return ranked(rows).where(F.col("rank") <= k).agg(F.min("score").alias("threshold"))


def saturation(rows: DataFrame, k: int) -> DataFrame:
    """Mean over days of the share of active channels that a budget alerts."""
    days = rows.groupBy("day").agg(F.count_distinct("channel_id").alias("n"))
    return days.agg(F.avg(F.least(F.col("n"), F.lit(k)) / F.col("n")).alias("saturation"))


def block_bootstrap(rows: DataFrame, block: Column, a: str, b: str, repeats: int, seed: str = "s") -> DataFrame:
    """Difference of mean squared errors of two scores, its 2.5th and 97.5th percentile over resampled blocks.

    Sums are taken once in each block. The blocks (days or weeks, so their number is bounded by the calendar)
    are drawn by hash, and only block sums are repeated."""
    err = lambda s: F.sum(F.pow(F.col(s) - F.col("label"), F.lit(2.0)))
    sums = rows.where("label is not null").groupBy(block.alias("block")).agg(F.count("*").alias("n"), (err(a) - err(b)).alias("d"))
    sums = sums.withColumn("i", F.row_number().over(Window.orderBy("block")) - 1)
    size = sums.agg(F.count("*").alias("size"))
    draws = rows.sparkSession.range(repeats).select(F.col("id").alias("rep")).crossJoin(F.broadcast(size)).select("rep", "size", F.explode(F.sequence(F.lit(0), F.col("size").cast("int") - 1)).alias("draw"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rep", "draw")), 1, 8), 16, 10).cast("long") % F.col("size")
    drawn = draws.select("rep", pick.alias("i")).groupBy("rep", "i").agg(F.count("*").alias("times")).join(sums.withColumn("i", F.col("i").cast("long")), "i")
    each = drawn.groupBy("rep").agg((F.sum(F.col("d") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("difference"))
    return each.agg(F.count("*").alias("repeats"), F.expr("percentile(difference, 0.025)").alias("low"), F.expr("percentile(difference, 0.5)").alias("middle"), F.expr("percentile(difference, 0.975)").alias("high"))


def drawn(blocks: int, repeats: int, seed: str) -> np.ndarray:
    """How often each block (row) is drawn in each repeat (column), by hash."""
    out = np.zeros((blocks, repeats))
    for rep in range(repeats):
        picks = [int(hashlib.md5(f"{seed}:{rep}:{i}".encode()).hexdigest()[:8], 16) % blocks for i in range(blocks)]
        out[:, rep] = np.bincount(picks, minlength=blocks)
    return out


#: Scores whose weights in all repeats are held at once.
SCORES_AT_ONCE = 2048


def resampled_precision(rows: DataFrame, repeats: int, seed: str = "s") -> dict[str, np.ndarray]:
    """Average precision (ties grouped) of each key in each repeat; not a number where a repeat lacks a class.

    rows: key, block, label (nulls are left out), score. Blocks are days or weeks, so their number and the table of draws (blocks times
    repeats) are bounded by the calendar. Rows are summed to cells of key, block and score once; a cell's weights in all repeats
    are one vector, so nothing else grows with repeats. Scores are cut into pieces; vectors of what lies above a piece are its offsets."""
    known = rows.where("label is not null and score is not null")
    days = sorted(r[0] for r in known.select("block").distinct().collect())
    if not days:
        return {}
    draws = drawn(len(days), repeats, seed)
    number = rows.sparkSession.createDataFrame(list(enumerate(days)), known.select(F.lit(0).cast("long").alias("i"), "block").schema)
    cells = known.join(F.broadcast(number), "block").groupBy("key", "i", "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count("*").alias("n"))
    pieces = cut(cells.withColumn("score", F.col("score").cast("double")), ["key"], "score").persist()
    totals: dict[tuple[str, int], np.ndarray] = {}
    for r in pieces.groupBy("key", "piece", "i").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).collect():  # keys * pieces * blocks rows
        totals.setdefault((r["key"], r["piece"]), np.zeros((2, repeats)))
        totals[r["key"], r["piece"]] += np.outer([r["pos"], r["n"]], draws[r["i"]])
    above, whole = {}, {}
    for key, piece in sorted(totals, reverse=True):
        above[key, piece] = whole.get(key, np.zeros((2, repeats)))
        whole[key] = above[key, piece] + totals[key, piece]
    shared = rows.sparkSession.sparkContext.broadcast((draws, above))

    def gained(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The piece's part of the sum over scores of positives times precision."""
        draws, above = shared.value
        before, out = above[key[0], key[1]].copy(), np.zeros(draws.shape[1])
        pdf = pdf.sort_values("score", ascending=False)
        score = pdf["score"].to_numpy()
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        ends = np.r_[starts[1:], len(score)]
        for at in range(0, len(starts), SCORES_AT_ONCE):
            first, last = starts[at], ends[min(at + SCORES_AT_ONCE, len(starts)) - 1]
            weight = draws[pdf["i"].to_numpy()[first:last]]
            pos, n = (np.add.reduceat(weight * pdf[c].to_numpy()[first:last, None], starts[at : at + SCORES_AT_ONCE] - first) for c in ("pos", "n"))
            up = np.cumsum(pos, axis=0) + before[0], np.cumsum(n, axis=0) + before[1]
            out += (pos * up[0] / np.maximum(up[1], 1e-300)).sum(axis=0)
            before = np.stack([up[0][-1], up[1][-1]])
        return pd.DataFrame({"key": [key[0]], "gain": [out]})

    found: dict[str, np.ndarray] = {key: np.zeros(repeats) for key in whole}
    for r in pieces.groupBy("key", "piece").applyInPandas(gained, "key string, gain array<double>").collect():  # a row for each piece
        found[r["key"]] += np.array(r["gain"])
    pieces.unpersist()
    fine = {key: (w[0] > 0) & (w[1] > w[0]) for key, w in whole.items()}
    return {key: np.where(fine[key], gain / np.maximum(whole[key][0], 1), np.nan) for key, gain in found.items()}


def paired_bootstrap(rows: DataFrame, block: Column, a: str, b: str, repeats: int, seed: str = "s") -> DataFrame:
    """Difference of the average precision of two scores over resampled blocks (days or weeks): its mean, 2.5th and 97.5th
    percentile and the share of repeats in which a is better. Blocks are drawn by hash, the same for both scores. Repeats without
    positives or negatives are left out. Rows don't grow with repeats: see `resampled_precision`."""
    both = F.explode(F.array(F.struct(F.lit("a").alias("key"), F.col(a).cast("double").alias("score")), F.struct(F.lit("b").alias("key"), F.col(b).cast("double").alias("score")))).alias("x")
    found = resampled_precision(rows.select(block.alias("block"), "label", both).select("block", "label", "x.*"), repeats, seed)
    difference = found["a"] - found["b"] if len(found) == 2 else np.zeros(0)
    each = rows.sparkSession.createDataFrame([(float(x),) for x in difference if x == x], "difference double")
    return each.agg(F.count("*").alias("repeats"), F.avg("difference").alias("mean"), F.expr("percentile(difference, 0.025)").alias("low"), F.expr("percentile(difference, 0.975)").alias("high"), F.avg((F.col("difference") > 0).cast("double")).alias("better"))


def episode_metrics(alerts: DataFrame, events: DataFrame, matches: DataFrame, category: str) -> DataFrame:
    """Alert episodes, events, matched alerts, precision and recall over all (category null) and for each category.

    alerts: channel_id, day; events: channel_id, event_day; both with the category; matches: channel_id, day, event_day, one to one."""
    a = alerts.join(matches.select("channel_id", "day", F.lit(1).alias("hit")), ["channel_id", "day"], "left").select(category, F.lit(1).alias("alert"), F.coalesce("hit", F.lit(0)).alias("hit"), F.lit(0).alias("event"), F.lit(0).alias("met"))
    e = events.join(matches.select("channel_id", "event_day", F.lit(1).alias("met")), ["channel_id", "event_day"], "left").select(category, F.lit(0).alias("alert"), F.lit(0).alias("hit"), F.lit(1).alias("event"), F.coalesce("met", F.lit(0)).alias("met"))
    out = a.unionByName(e).rollup(category).agg(F.grouping(category).alias("overall"), *(F.sum(c).alias(n) for c, n in (("alert", "alert_episodes"), ("event", "proxy_events"), ("hit", "matched_alerts"), ("met", "matched_events"))))
    out = out.where(F.col(category).isNotNull() | (F.col("overall") == 1))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.select(category, "alert_episodes", "proxy_events", "matched_alerts", share("matched_alerts", "alert_episodes").alias("precision"), share("matched_events", "proxy_events").alias("recall"))


def contract(rows: DataFrame) -> DataFrame:
    """Violations of a score table: null, NaN and out-of-range scores, repeated keys."""
    s = F.col("score")
    one = rows.agg(F.count("*").alias("rows"), F.count_if(s.isNull()).alias("nulls"), F.count_if(F.isnan(s)).alias("nans"), F.count_if((s < 0) | (s > 1)).alias("out_of_range"))
    again = rows.groupBy("channel_id", "day").count().where("count > 1").agg(F.count("*").alias("repeated"))
    return one.crossJoin(again)


def parity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Largest difference of two scorings and rows that only one scores."""
    both = a.select(*keys, F.col("score").alias("a")).join(b.select(*keys, F.col("score").alias("b")), keys, "full")
    return both.agg(F.count("*").alias("rows"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("one_sided"))


def enrichment(rows: DataFrame, inside: Column) -> DataFrame:
    """Positive rates inside and outside windows, and their ratio."""
    rate = lambda c: F.avg(F.when(c, F.col("label")))
    out = rows.agg(F.count_if(inside).alias("n_inside"), rate(inside).alias("rate_inside"), rate(~inside).alias("rate_outside"))
    return out.withColumn("lift", F.col("rate_inside") / F.col("rate_outside"))


def suppressed(alerts: DataFrame, days: int) -> DataFrame:
    """alerts with attention: no alert of the channel in the `days` days before."""
    before = Window.partitionBy("channel_id").orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    return alerts.withColumn("attention", F.count("*").over(before) == 0)
