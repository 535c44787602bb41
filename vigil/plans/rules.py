"""Queries on object roll-ups, rule scores, robust statistics, cadence, propensity, strata, gates and episode metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.functions import scalars as S
from vigil.operators import alerts as A
from vigil.operators import bindings as B
from vigil.operators import boards as O
from vigil.operators import forecasts as P
from vigil.operators import objects as J
from vigil.operators import robust as R
from vigil.operators.states import day_range
from vigil.plans.evaluation import CD, RK, SC, TR, channel_days, rounded, scores_of, triage_of
from vigil.plans.operational import SCORES
from vigil.plans.operational import scores_of as saved_scores
from vigil.plans.registry import query
from vigil.plans.temporal import PANEL, panel_of

#: Groups of the driver's sensor types, and the columns of the channel panel that are summed for an object: over all, and by group.
PATTERNS = {"fire": "auto|build", "flood": "house", "access": "furn"}
SUMS = {"n_events": "n_events", "n_alarm": "n_alarm", "n_error": "n_error", "n_view": "n_view", "n_click": "n_click", "n_signup": "n_signup", "n_purchase": "n_purchase", "num_n": "num_n", "num_above": "num_above", "link_strict": "st", "link_ambiguous": "am", "link_sustained": "su", "link_transient": "tr", "link_censored": "ce", "link_blocks": "bl", "crossed": "c", "cross_unknown": "cu"}
GROUP_SUMS = ["n_alarm", "n_events", "num_n", "link_strict", "crossed"]
ROLLED = ", ".join(f"CAST(coalesce(sum({c}), 0) AS DOUBLE) AS obj__{n}" for n, c in SUMS.items())
GROUPED = ", ".join(f"count(*) FILTER (WHERE g = '{g}') AS grp_{g}__n_channels, " + ", ".join(f"CAST(coalesce(sum({SUMS[n]}) FILTER (WHERE g = '{g}'), 0) AS DOUBLE) AS grp_{g}__{n}" for n in GROUP_SUMS) for g in [*PATTERNS, "other"])
ROLL = PANEL + f", rz AS (SELECT p.channel_id, p.day, object_id, now, coalesce(d.n_events, 0) AS n_events, d.n_alarm, d.n_error, d.n_view, d.n_click, d.n_signup, d.n_purchase, d.num_n, d.num_above, d.num_max, st, am, su, tr, ce, bl, c, cu, CASE WHEN regexp_matches(lower(sensor_type), 'auto|build') THEN 'fire' WHEN regexp_matches(lower(sensor_type), 'house') THEN 'flood' WHEN regexp_matches(lower(sensor_type), 'furn') THEN 'access' ELSE 'other' END AS g FROM p2 p JOIN channels USING (channel_id) LEFT JOIN daily d USING (channel_id, day)), ru AS (SELECT object_id, day, count(*) AS obj__n_channels, {ROLLED}, {GROUPED}, round(avg(CAST(now <> 'O' AS INTEGER)), 6) AS obj__share_link_not_ok, max(num_max) AS obj__reading_max, count(*) FILTER (WHERE num_max >= 100) AS above, CAST(month(day) AS INTEGER) AS d_month FROM rz GROUP BY 1, 2)"


def rolled(spark: SparkSession, d: str) -> DataFrame:
    rows = panel_of(spark, d).join(B.channels(spark, d).select("channel_id", "object_id", "sensor_type"), "channel_id")
    return J.roll_up(rows, list(SUMS), GROUP_SUMS, PATTERNS, threshold=100.0)


@query(ROLL + " SELECT * EXCLUDE (above), grp_fire__n_alarm + above AS _fp_fire, grp_flood__n_alarm AS _fp_flood, grp_access__n_alarm AS _fp_access FROM ru")
def object_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Groups by pattern, 17 sums of all channels, five of each group, shares and the largest reading"""
    return rounded(rolled(spark, d), "obj__share_link_not_ok")


@query(ROLL + " SELECT object_id, day, grp_fire__n_alarm + obj__num_above AS fire, grp_flood__n_alarm + obj__crossed AS flood, grp_access__n_alarm AS access FROM ru")
def incident_rules(spark: SparkSession, d: str) -> DataFrame:
    """What each incident type's rule sums"""
    own = {"fire": ["grp_fire__n_alarm", "obj__num_above"], "flood": ["grp_flood__n_alarm", "obj__crossed"], "access": ["grp_access__n_alarm"]}
    return rolled(spark, d).select("object_id", "day", *(sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0))).alias(kind) for kind, columns in own.items()))


@query(f"{CD}, x AS (SELECT *, n_alarm / n_events AS share, lag(n_alarm / n_events) OVER w AS before, lag(n_events) OVER w AS n_before, day - lag(day) OVER w AS gap, day - last_value(CASE WHEN n_alarm > 0 THEN day END IGNORE NULLS) OVER w AS since FROM cd WINDOW w AS (PARTITION BY channel_id ORDER BY day)), y AS (SELECT *, coalesce(1.0 / (1 + since), 0) AS rec, greatest(coalesce(n_before, 0) - n_events, 0) / (1 + coalesce(n_before, 0)) AS fall FROM x) SELECT channel_id, day, round(greatest(share, 0.5 * coalesce(before, 0), 0.75 * CAST(n_alarm >= 3 AS DOUBLE)), 6) AS alarm_rule, CAST(n_alarm + 0.5 * n_events AS DOUBLE) AS weighted, round(1 / (1 + exp(-(0.9 * ln(1 + coalesce(gap, 0)) + 1.4 * fall - 1.8))), 6) AS dropout, round(1 / (1 + exp(-least(20, greatest(n_alarm + 0.5 * greatest(n_events, share), share, 0.7 * abs(share - share) + 0.3 * (n_alarm + coalesce(gap, 0)))))), 6) AS flood, round(1 - exp(-(n_events + n_alarm + coalesce(gap, 0) - least(n_events, n_alarm, coalesce(gap, 0))) / 5), 6) AS scenario, round(1 - exp(-sqrt(least(n_events, 10) ** 2 + least(n_alarm, 10) ** 2 + least(coalesce(gap, 0), 10) ** 2) / 3), 6) AS anomaly, round(rec, 6) AS recurrence, round(greatest(least(n_alarm / 2, 1), 0.25 * CAST(n_alarm >= 1 AS INTEGER), 0.5 * rec), 6) AS multi_signal FROM y")
def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    """alarm rule, weighted counts, dropout, flood, scenario and anomaly rules, recurrence, several signals"""
    by = Window.partitionBy("channel_id").orderBy("day")
    share = F.col("n_alarm") / F.col("n_events")
    rows = channel_days(spark, d).withColumn("share", share)
    since = F.date_diff("day", F.last(F.when(F.col("n_alarm") > 0, F.col("day")), ignorenulls=True).over(by))
    rows = rows.withColumns({"before": F.lag("share").over(by), "n_before": F.lag("n_events").over(by), "gap": F.date_diff("day", F.lag("day").over(by)), "since": since})
    n, e, gap = F.col("n_alarm"), F.col("n_events"), F.coalesce("gap", F.lit(0))
    recurrence = S.recurrence_score(F.col("since"))
    scores = {
        "alarm_rule": S.rule_score(F.col("share"), F.col("before"), (n >= 3).cast("double")), "dropout": S.dropout_rule(F.col("gap"), e, F.col("n_before")), "flood": S.flood_rule(n, e, n, F.col("share"), F.col("share"), gap),
        "scenario": S.scenario_rule(e, n, gap), "anomaly": S.scenario_anomaly(e, n, gap), "recurrence": recurrence, "multi_signal": S.multi_signal(n, n >= 1, recurrence),
    }
    return rows.select("channel_id", "day", S.weighted_recent(n, e).alias("weighted"), *(F.round(c, 6).alias(k) for k, c in scores.items()))


ROBUST = ", rj AS (SELECT event_id, channel_id, sensor_type, value_numeric AS v, CAST(channel_id % 10 AS DOUBLE) AS w FROM journal JOIN channels USING (channel_id)), rg AS (SELECT quantile_cont(v, 0.5) AS vm, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS vi, quantile_cont(w, 0.5) AS wm, quantile_cont(w, 0.75) - quantile_cont(w, 0.25) AS wi FROM rj), rt AS (SELECT sensor_type, count(*) AS rows, quantile_cont(v, 0.5) AS vm, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS vi, quantile_cont(w, 0.5) AS wm, quantile_cont(w, 0.75) - quantile_cont(w, 0.25) AS wi FROM rj GROUP BY 1), rs AS (SELECT sensor_type, rows >= 1000 AS own, CASE WHEN rows >= 1000 THEN rt.vm ELSE rg.vm END AS vm, CASE WHEN rows >= 1000 THEN rt.vi ELSE rg.vi END AS vi, CASE WHEN rows >= 1000 THEN rt.wm ELSE rg.wm END AS wm, CASE WHEN rows >= 1000 THEN rt.wi ELSE rg.wi END AS wi FROM rt, rg), rf AS (SELECT sensor_type, own, vm, CASE WHEN vi > 1e-9 THEN vi ELSE 1 END AS vs, wm, CASE WHEN wi > 1e-9 THEN wi ELSE 1 END AS ws FROM rs)"


def typed_values(spark: SparkSession, d: str) -> DataFrame:
    return B.journal(spark, d).join(B.channels(spark, d).select("channel_id", "sensor_type"), "channel_id").select("event_id", "channel_id", "sensor_type", F.col("value_numeric").alias("v"), (F.col("channel_id") % 10).cast("double").alias("w"))


@query(f"{ROBUST} SELECT sensor_type, own, m AS measure, round(CASE m WHEN 'v' THEN vm ELSE wm END, 6) AS center, round(CASE m WHEN 'v' THEN vs ELSE ws END, 6) AS scale FROM rf, (SELECT unnest(['v', 'w']) AS m)")
def robust_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Median and quartile range by type, 1 for a range of 0, the whole table's for types of fewer than 1000 rows"""
    return rounded(R.robust_fit(typed_values(spark, d), "sensor_type", ["v", "w"], 1000), "center", "scale")


@query(f"{ROBUST} SELECT event_id, round(greatest(-20, least(20, (v - vm) / vs)), 6) AS z, round((least(20, abs((v - vm) / vs)) + least(20, abs((w - wm) / ws))) / 2, 6) AS deviation FROM rj JOIN rf USING (sensor_type)")
def robust_scores(spark: SparkSession, d: str) -> DataFrame:
    """clipped distance from the type's median, and the mean of absolute ones"""
    rows = typed_values(spark, d)
    return rounded(R.robust_apply(rows, R.robust_fit(rows, "sensor_type", ["v", "w"], 1000), "sensor_type", ["v", "w"]).select("event_id", F.col("z_v").alias("z"), "deviation"), "z", "deviation")


@query(f"{CD}, g AS (SELECT *, CAST(day - lag(day) OVER (PARTITION BY channel_id ORDER BY day) AS INTEGER) AS gap FROM cd) SELECT channel_id, day, " + ", ".join(f"CAST(count(*) OVER w{w} AS BIGINT) AS active_days_{w}d, CAST(sum(n_events) OVER w{w} AS BIGINT) AS event_sum_{w}d, CAST(sum(n_alarm) OVER w{w} AS BIGINT) AS alarm_sum_{w}d, CAST(count(*) FILTER (WHERE n_alarm > 0) OVER w{w} AS BIGINT) AS alarm_days_{w}d" for w in (7, 30)) + ", gap, quantile_cont(gap, 0.5) OVER w30 AS gap_median_30d, round(gap / greatest(quantile_cont(gap, 0.5) OVER w30, 1), 6) AS gap_ratio_30d, CAST(day - min(day) OVER (PARTITION BY channel_id) AS INTEGER) AS observed_age_days FROM g WINDOW w7 AS (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)")
def cadence_features(spark: SparkSession, d: str) -> DataFrame:
    """Sums over 7 and 30 days, median and ratio of gaps, observed age"""
    by = Window.partitionBy("channel_id").orderBy("day")
    rows = channel_days(spark, d).withColumn("gap", F.date_diff("day", F.lag("day").over(by)))
    sums = {}
    for w in (7, 30):
        over = day_range(w, "channel_id")
        sums |= {f"active_days_{w}d": F.count("*").over(over), f"event_sum_{w}d": F.sum("n_events").over(over), f"alarm_sum_{w}d": F.sum("n_alarm").over(over), f"alarm_days_{w}d": F.count_if(F.col("n_alarm") > 0).over(over)}
    sums |= {"gap_median_30d": F.percentile("gap", F.lit(0.5)).over(day_range(30, "channel_id")), "observed_age_days": F.date_diff("day", F.first("day").over(by))}
    rows = rows.withColumns(sums)
    return rows.select("channel_id", "day", "gap", *sums, F.round(F.col("gap") / F.greatest("gap_median_30d", F.lit(1.0)), 6).alias("gap_ratio_30d"))


PROP = CD + ", pr AS (SELECT a.channel_id, a.sensor_type, a.day, CAST(b.n_alarm > 0 AS INTEGER) AS y FROM cd a JOIN cd b ON b.channel_id = a.channel_id AND b.day = a.day + 2)"


@query(PROP + ", hs AS (SELECT channel_id, sensor_type, day, count(*) OVER c AS na, coalesce(sum(y) OVER c, 0) AS pa, count(*) OVER c5 AS n5, coalesce(sum(y) OVER c5, 0) AS p5, count(*) OVER c10 AS n10, coalesce(sum(y) OVER c10, 0) AS p10, count(*) OVER t AS nt, sum(y) OVER t AS pt, count(*) OVER g AS ng, sum(y) OVER g AS pg FROM pr WINDOW c AS (PARTITION BY channel_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 2 DAY PRECEDING), c5 AS (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND INTERVAL 2 DAY PRECEDING), c10 AS (PARTITION BY channel_id ORDER BY day RANGE BETWEEN INTERVAL 11 DAY PRECEDING AND INTERVAL 2 DAY PRECEDING), t AS (PARTITION BY sensor_type ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 2 DAY PRECEDING), g AS (ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 2 DAY PRECEDING)), hp AS (SELECT *, CASE WHEN nt >= 100 THEN 'type' WHEN ng > 0 THEN 'global' ELSE 'none' END AS prior_source, CASE WHEN nt >= 100 THEN pt / nt WHEN ng > 0 THEN pg / ng END AS prior FROM hs) SELECT channel_id, day, n5 AS days_5d, CAST(p5 AS BIGINT) AS positives_5d, round(CASE WHEN n5 > 0 THEN p5 / n5 END, 6) AS rate_5d, n10 AS days_10d, CAST(p10 AS BIGINT) AS positives_10d, round(CASE WHEN n10 > 0 THEN p10 / n10 END, 6) AS rate_10d, na AS days_all, CAST(pa AS BIGINT) AS positives_all, prior_source, round(prior, 6) AS prior, round((pa + 5 * prior) / (na + 5), 6) AS rate_m5, round((pa + 20 * prior) / (na + 20), 6) AS rate_m20 FROM hp")
def channel_propensity(spark: SparkSession, d: str) -> DataFrame:
    """History whose windows have ended, over windows and in all, with the type's rate or else the global one as prior, and a grid of weights"""
    days = channel_days(spark, d)
    later = days.select("channel_id", F.date_sub("day", 2).alias("day"), (F.col("n_alarm") > 0).cast("int").alias("y"))
    rows = days.join(later, ["channel_id", "day"]).select("channel_id", "sensor_type", "day", "y", F.date_add("day", 3).alias("end"))
    out = R.propensity(rows, "sensor_type", (5, 10), (5, 20), 100)
    return rounded(out, *(c for c in out.columns if c.startswith("rate_") or c == "prior"))


@query(f"{TR}, sx AS (SELECT CASE WHEN day < DATE '2024-01-16' THEN 'first' ELSE 'second' END AS half, * FROM tr), b AS (SELECT half, 'peak' AS measure, CASE WHEN peak < 150 THEN 'lt150' WHEN peak < 250 THEN '150_250' WHEN peak < 350 THEN '250_350' ELSE 'ge350' END AS bin FROM sx UNION ALL SELECT half, 'age', CASE WHEN age_minutes < 60 THEN 'lt1h' WHEN age_minutes < 1440 THEN 'lt1d' ELSE 'ge1d' END FROM sx UNION ALL SELECT half, 'neighbours', CASE WHEN neighbours < 1 THEN '0' WHEN neighbours < 3 THEN '1_2' ELSE 'ge3' END FROM sx UNION ALL SELECT half, 'hour', CAST(hour(t) AS VARCHAR) FROM sx UNION ALL SELECT half, 'day', CASE WHEN isodow(t) >= 6 THEN 'weekend' ELSE 'weekday' END FROM sx) SELECT half, measure, bin, count(*) AS n FROM b GROUP BY 1, 2, 3")
def crossing_strata(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of crossings by half of the month"""
    rows = triage_of(spark, d).withColumn("half", F.when(F.col("day") < F.lit("2024-01-16").cast("date"), "first").otherwise("second"))
    return J.strata(rows, ["half"], {"peak": ([150, 250, 350], ["lt150", "150_250", "250_350", "ge350"]), "age_minutes": ([60, 1440], ["lt1h", "lt1d", "ge1d"]), "neighbours": ([1, 3], ["0", "1_2", "ge3"])}, "t").withColumn("measure", F.when(F.col("measure") == "age_minutes", "age").otherwise(F.col("measure")))


@query(f"{TR}, qx AS (SELECT state, 'peak' AS measure, CAST(peak AS DOUBLE) AS v FROM tr UNION ALL SELECT state, 'age_minutes', CAST(age_minutes AS DOUBLE) FROM tr) SELECT state, measure, count(v) AS n, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3 FROM qx GROUP BY 1, 2")
def crossing_quartiles(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles by state"""
    return rounded(J.quartiles(triage_of(spark, d), ["state"], ["peak", "age_minutes"]), "q1", "median", "q3")


POWER = TR + ", pp AS (SELECT object_id, 'w' || CAST((day - DATE '2024-01-01') // 10 AS VARCHAR) AS period, coalesce(EXISTS (SELECT 1 FROM runs r WHERE r.object_id = tr.object_id AND tr.day BETWEEN r.start - 3 AND r.\"end\" + 21) AND after_silence <> 'unknown', false) AS inside FROM tr WHERE live = 'needs_attention'), pk AS (SELECT period, object_id, count(*) AS k FROM pp WHERE NOT inside GROUP BY 1, 2), pr_ AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY k DESC, object_id) AS r FROM pk), ps AS (SELECT period, CAST(sum(k) AS BIGINT) AS outside, count(*) AS objects, max(k) / sum(k) AS top1_share, sum(k) FILTER (WHERE r <= 3) / sum(k) AS top3_share FROM pr_ GROUP BY 1), per AS (SELECT period, count(*) AS positives, count(*) FILTER (WHERE inside) AS in_window FROM pp GROUP BY 1), po AS (SELECT period, positives, in_window, coalesce(outside, 0) AS outside, coalesce(objects, 0) AS objects, top1_share, top3_share FROM per LEFT JOIN ps USING (period))"


def power_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    period = F.concat(F.lit("w"), F.floor(F.date_diff("day", F.lit("2024-01-01").cast("date")) / 10).cast("string"))
    rows = triage_of(spark, d).where("live = 'needs_attention'").select("object_id", period.alias("period"), F.col("in_posthoc").alias("inside"))
    return J.power(rows, 10, 60)


@query(f"{POWER} SELECT period, positives, in_window, outside, objects, round(top1_share, 6) AS top1_share, round(top3_share, 6) AS top3_share FROM po")
def power_periods(spark: SparkSession, d: str) -> DataFrame:
    """Positives inside and outside maintenance windows, and how few objects hold them"""
    return rounded(power_of(spark, d)[0], "top1_share", "top3_share")


@query(f"{POWER}, ob AS (SELECT object_id, count(*) AS k FROM pp WHERE NOT inside GROUP BY 1), gt AS (SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS dev_positives, max(k) / sum(k) AS top1, (SELECT coalesce(min(outside), 0) >= 10 FROM po) AS each_enough FROM ob) SELECT dev_positives, round(top1, 6) AS dev_top1_share, each_enough, dev_positives >= 60 AS sum_enough, coalesce(top1 <= 0.5, false) AS top1_fine, each_enough AND dev_positives >= 60 AND coalesce(top1 <= 0.5, false) AS proceed, CASE WHEN each_enough AND dev_positives >= 60 AND coalesce(top1 <= 0.5, false) THEN 'eligible_for_stage20_spec' ELSE 'insufficient_labels_keep_v3' END AS decision FROM gt")
def power_gate(spark: SparkSession, d: str) -> DataFrame:
    """The decision"""
    return rounded(power_of(spark, d)[1], "dev_top1_share")


EPI = RK + ", al AS (SELECT channel_id, day, sensor_type FROM rk JOIN channels USING (channel_id) WHERE rank <= 10), ev AS (SELECT DISTINCT channel_id, CAST(event_time AS DATE) AS event_day, sensor_type FROM journal JOIN channels USING (channel_id) WHERE alarm), ah AS (SELECT al.*, ev.event_day IS NOT NULL AS hit FROM al LEFT JOIN ev ON ev.channel_id = al.channel_id AND ev.event_day = al.day + 2), eh AS (SELECT ev.*, al.day IS NOT NULL AS met FROM ev LEFT JOIN al ON ev.channel_id = al.channel_id AND ev.event_day = al.day + 2)"


@query(f"{EPI}, s AS (SELECT sensor_type, 1 AS a, CAST(hit AS INTEGER) AS h, 0 AS e, 0 AS m FROM ah UNION ALL SELECT sensor_type, 0, 0, 1, CAST(met AS INTEGER) FROM eh), g AS (SELECT sensor_type, sum(a) AS a, sum(h) AS h, sum(e) AS e, sum(m) AS m FROM s GROUP BY 1 UNION ALL SELECT NULL, sum(a), sum(h), sum(e), sum(m) FROM s) SELECT sensor_type, CAST(a AS BIGINT) AS alert_episodes, CAST(e AS BIGINT) AS proxy_events, CAST(h AS BIGINT) AS matched_alerts, round(h / greatest(a, 1), 6) AS precision, round(m / greatest(e, 1), 6) AS recall FROM g")
def alert_episodes(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one matches of alerts and events, over all and for each sensor type"""
    types = B.channels(spark, d).select("channel_id", "sensor_type")
    alerts = A.ranked(scores_of(spark, d)).where("rank <= 10").select("channel_id", "day").join(types, "channel_id")
    events = B.journal(spark, d).where("alarm").select("channel_id", F.to_date("event_time").alias("event_day")).distinct().join(types, "channel_id")
    return rounded(A.episode_metrics(alerts, events, A.matched(alerts, events, 2, 1), "sensor_type"), "precision", "recall")


@query(f"{SC}, k0 AS (SELECT *, 1.0 / (2 + channel_id % 5) AS other FROM scores WHERE label IS NOT NULL), bl AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS i FROM (SELECT DISTINCT day AS block FROM k0)), sz AS (SELECT count(*) AS size FROM bl), dr AS (SELECT rep, CAST('0x' || substr(md5('s:' || rep || ':' || dr), 1, 8) AS BIGINT) % size AS i FROM (SELECT unnest(range(0, 20)) AS rep), sz, LATERAL (SELECT unnest(range(0, size)) AS dr)), tm AS (SELECT rep, block, count(*) AS w FROM dr JOIN bl USING (i) GROUP BY 1, 2), lg AS (SELECT rep, w, label, m, CASE m WHEN 'a' THEN score ELSE other END AS s FROM k0 JOIN tm ON tm.block = k0.day, (SELECT unnest(['a', 'b']) AS m)), st AS (SELECT rep, m, s, sum(w) FILTER (WHERE label = 1) AS pos, sum(w) FILTER (WHERE label = 0) AS neg FROM lg GROUP BY 1, 2, 3), cu AS (SELECT rep, m, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, sum(coalesce(pos, 0)) OVER v AS tp, sum(coalesce(neg, 0)) OVER v AS fp FROM st WINDOW v AS (PARTITION BY rep, m ORDER BY s DESC)), ap AS (SELECT rep, m, sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) AS ap, sum(pos) AS p, sum(neg) AS n FROM cu GROUP BY 1, 2), df AS (SELECT a.ap - b.ap AS x FROM ap a JOIN ap b ON a.rep = b.rep AND a.m = 'a' AND b.m = 'b' WHERE a.p > 0 AND a.n > 0) SELECT count(*) AS repeats, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, round(avg(CAST(x > 0 AS INTEGER)), 6) AS better FROM df")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Difference of average precision of two scores over resampled days"""
    rows = scores_of(spark, d).withColumn("other", 1.0 / (2 + F.col("channel_id") % 5))
    return rounded(A.paired_bootstrap(rows, F.col("day"), "score", "other", 20), "mean", "low", "high", "better")


BOARD = """, g0 AS (SELECT max(as_of_date) AS day FROM scores),
g1 AS (SELECT id, CASE WHEN id % 11 > 0 THEN s.channel_id END AS channel_id, CASE WHEN id % 11 = 5 THEN 999 ELSE object_id END AS object_id, score, CASE WHEN id % 6 = 0 THEN 'abstain' ELSE 'experimental_shadow' END AS decision_status FROM scores s JOIN channels USING (channel_id) WHERE as_of_date = (SELECT day FROM g0)),
gs AS (SELECT id, channel_id, object_id, score, 'gas' AS worker, decision_status = 'experimental_shadow' AS fit, true AS enabled FROM g1 QUALIFY row_number() OVER (PARTITION BY object_id, channel_id ORDER BY id DESC) = 1),
sc AS (SELECT request_id AS id, CASE WHEN request_id % 13 > 0 THEN channel_id END AS channel_id, CASE WHEN request_id % 4 = 0 THEN object_id + 1 ELSE object_id END AS object_id, CASE WHEN request_id % 5 > 0 THEN round((request_id % 100) / 100.0, 6) END AS score, CASE WHEN request_id % 2 = 0 THEN 'fire' ELSE 'flood' END AS worker, CASE WHEN request_id % 7 > 1 THEN true WHEN request_id % 7 = 1 THEN false END AS fit FROM requests JOIN channels USING (channel_id) WHERE created_at >= (SELECT max(created_at) - INTERVAL 3 DAY FROM requests)),
al AS (SELECT * FROM gs UNION ALL SELECT *, worker = 'fire' FROM sc),
bd AS (SELECT al.*, coalesce(al.object_id IN (SELECT object_id FROM channels) AND (al.channel_id IS NULL OR c.object_id = al.object_id), false) AS bound FROM al LEFT JOIN channels c ON c.channel_id = al.channel_id),
rs AS (SELECT *, CASE WHEN NOT bound THEN 'UNBOUND_CHANNEL' WHEN NOT enabled THEN 'MODULE_DISABLED' WHEN score IS NULL OR fit IS DISTINCT FROM true THEN CASE WHEN worker = 'gas' THEN 'SCORE_UNAVAILABLE' ELSE 'RESULT_UNAVAILABLE' END END AS reason FROM bd)
"""


@query(f", {SCORES}{BOARD} SELECT worker, id, channel_id, object_id, bound, reason IS NULL AS available, reason AS availability_reason, CASE WHEN reason IS NULL THEN score END AS score FROM rs")
def two_source_board(spark: SparkSession, d: str) -> DataFrame:
    """Newest scores of the day and forecasts of the newest scenario run, once for each object and channel. Some rows abstain, are
    not eligible, or are for an object as a whole"""
    channels = B.channels(spark, d).select("channel_id", "object_id")
    scores, i = saved_scores(spark, d), F.col("id")
    newest = scores.agg(F.max("as_of_date").alias("as_of_date"))
    day = scores.join(newest, "as_of_date", "left_semi").join(channels, "channel_id").select("id", F.when(i % 11 > 0, F.col("channel_id")).alias("channel_id"), F.when(i % 11 == 5, 999).otherwise(F.col("object_id")).alias("object_id"), "score", F.lit("gas").alias("worker"), F.when(i % 6 == 0, "abstain").otherwise("experimental_shadow").alias("decision_status"))
    gas = O.latest_per_key(day, ["object_id", "channel_id"], F.desc("id"))
    requests = B.requests(spark, d)
    last = requests.agg((F.max("created_at") - F.expr("interval 3 days")).alias("from"))
    r = F.col("request_id")
    fit = F.when(r % 7 > 1, True).when(r % 7 == 1, False)
    scenario = requests.join(channels, "channel_id").crossJoin(F.broadcast(last)).where("created_at >= from").select(r.alias("id"), F.when(r % 13 > 0, F.col("channel_id")).alias("channel_id"), F.when(r % 4 == 0, F.col("object_id") + 1).otherwise(F.col("object_id")).alias("object_id"), F.when(r % 5 > 0, F.round((r % 100) / 100.0, 6)).alias("score"), F.when(r % 2 == 0, "fire").otherwise("flood").alias("worker"), fit.alias("eligible"))
    return P.board(gas, scenario, channels, ["fire"])
