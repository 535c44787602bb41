"""Queries on fitted models that SQL can follow: scores with their factors, a day's scores, ablations and the gates that follow from them."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators import alerts as A
from vigil.operators import bindings as B
from vigil.operators import logistic as L
from vigil.plans import ml as M
from vigil.plans.evaluation import CD, channel_days
from vigil.plans.models import ROWS, rows_of
from vigil.plans.registry import query


def design_sql(name: str, rows: str, numeric: list[str], category: str | None = None) -> str:
    """Tables of what a design takes from rows (g, columns): <name>q (medians), <name>s (means and deviations), <name>c (categories)."""
    value = lambda c: f"sign(coalesce({c}, q.m_{c})) * ln(1 + abs(coalesce({c}, q.m_{c})))"
    out = f"{name}q AS (SELECT g, " + ", ".join(f"coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), 0) AS m_{c}" for c in numeric) + f" FROM {rows} GROUP BY g)"
    out += f", {name}s AS (SELECT g, " + ", ".join(f"avg({value(c)}) AS a_{c}, coalesce(nullif(stddev_samp({value(c)}), 0), 1) AS d_{c}" for c in numeric) + f" FROM {rows} JOIN {name}q q USING (g) GROUP BY g)"
    if not category:
        return out + f", {name}c AS (SELECT DISTINCT g, CAST([] AS VARCHAR[]) AS cats FROM {rows})"
    return out + f", {name}k AS (SELECT g, {category} AS cat, count(*) AS k FROM {rows} WHERE {category} IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, {category}) <= 50), {name}c AS (SELECT g, list(cat ORDER BY k DESC, cat) AS cats FROM {name}k GROUP BY g)"


def z_sql(c: str) -> str:
    return f"((sign(coalesce({c}, q.m_{c})) * ln(1 + abs(coalesce({c}, q.m_{c}))) - s.a_{c}) / s.d_{c})"


def vector_sql(numeric: list[str], category: str | None, keep: dict[str, str] | None = None) -> str:
    """The vector of a row joined with q, s and c; keep: an SQL condition for each number that only counts where it holds."""
    keep = keep or {}
    held = lambda c, v: f"CASE WHEN {keep[c]} THEN {v} ELSE 0 END" if c in keep else v
    hot = f"list_transform(c.cats, lambda k: CAST({held(category, f'CASE WHEN {category} = k THEN 1 ELSE 0 END')} AS DOUBLE))" if category else "CAST([] AS DOUBLE[])"
    return "list_concat(CAST([1, " + ", ".join(held(c, z_sql(c)) for c in numeric) + f"] AS DOUBLE[]), {hot})"


TWO = ["n_events", "n_alarm"]
LOGIT = "ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6)))"
FITTED = f"""{ROWS}, tn AS (SELECT * FROM rows WHERE day + 2 < DATE '2024-01-15' AND label IS NOT NULL), tc AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM tn),
ng AS (SELECT * FROM tn WHERE label = 0 ORDER BY md5('s:' || channel_id || ':' || day), channel_id, day LIMIT (SELECT least(n, greatest(1, 3 * p)) FROM tc)),
ts AS (SELECT 'all' AS g, *, CAST(1 AS DOUBLE) AS w FROM tn WHERE label = 1 UNION ALL SELECT 'all', *, (SELECT n / greatest(1, least(n, greatest(1, 3 * p))) FROM tc) FROM ng),
{design_sql("d", "ts", TWO, "sensor_type")}, tr AS (SELECT g, {vector_sql(TWO, "sensor_type")} AS x, label AS y, w FROM ts JOIN dq q USING (g) JOIN ds s USING (g) JOIN dc c USING (g)), {L.newton_sql("fit", "tr", L.RIDGE)},
al AS (SELECT rows.*, f.b, 1 / (1 + exp(-list_dot_product({vector_sql(TWO, "sensor_type")}, f.b))) AS score, {z_sql("n_events")} * f.b[2] AS push_events, {z_sql("n_alarm")} * f.b[3] AS push_alarm FROM rows, dq q, ds s, dc c, fit f),
pc AS (SELECT 'all' AS g, CAST([1, {LOGIT}] AS DOUBLE[]) AS x, label AS y, CAST(1 AS DOUBLE) AS w FROM al WHERE day >= DATE '2024-01-15' AND day + 2 < DATE '2024-01-20' AND label IS NOT NULL), {L.newton_sql("pl", "pc", 1e-6)},
pb AS (SELECT CASE WHEN (SELECT count(DISTINCT y) FROM pc) < 2 THEN CAST([0, 1] AS DOUBLE[]) ELSE (SELECT b FROM pl) END AS b)
SELECT channel_id, day, label, round(1 / (1 + exp(-(pb.b[1] + pb.b[2] * {LOGIT}))), 6) AS score,
array_to_string(list_transform(list_reverse_sort(list_filter([{{'push': push_events, 'name': 'n_events'}}, {{'push': push_alarm, 'name': 'n_alarm'}}], lambda f: f.push > 0)), lambda f: f.name), '|') AS factors
FROM al, pb WHERE (day >= DATE '2024-01-20' AND day + 2 < DATE '2024-01-26') OR day >= DATE '2024-01-26'"""


@query(FITTED)
def logistic_scores(spark: SparkSession, d: str) -> DataFrame:
    """Train before the 15th, calibrate before the 20th, score the rest, with the factors that push a score up"""
    parts = M.temporal_split(rows_of(spark, d), "2024-01-15", "2024-01-20", "2024-01-26")
    train = M.sampled(parts.where("split = 'train' and label is not null"), 3).persist()
    design = L.Design.of(train, M.checked(train.columns, TWO), "sensor_type")
    beta = L.newton(train.select(F.lit("all").alias("g"), design.vector().alias("x"), F.col("label").alias("y"), F.col("weight").alias("w")), ["all"], len(design.names()))["all"]
    train.unpersist()
    scored = parts.withColumn("score", L.score(design.vector(), beta))
    intercept, slope = L.platt(scored.where("split = 'calibration'"))
    calibrated = 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * L.logit(F.col("score")))))
    out = scored.where("split in ('validation', 'stress')")
    return out.select("channel_id", "day", "label", F.round(calibrated, 6).alias("score"), F.array_join(L.top_factors(design, beta), "|").alias("factors"))


def fitted_cold(train: DataFrame) -> tuple[L.Design, np.ndarray]:
    """The logistic model for cold channels: design and coefficients."""
    design = L.Design.of(train, ["n_events"], "sensor_type")
    beta = L.newton(train.select(F.lit("all").alias("g"), design.vector().alias("x"), F.col("label").alias("y"), F.col("weight").alias("w")), ["all"], len(design.names()))["all"]
    return design, beta


def split_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the last days, and the sample of earlier ones that models are fitted on."""
    by = Window.partitionBy("channel_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows_of(spark, d).withColumns({c: F.col(c).cast("double") for c in TWO}).withColumn("observed_days", F.count("*").over(by))
    parts = M.temporal_split(rows, "2024-01-15", "2024-01-20", "2024-01-26")
    return parts.where("split = 'stress'"), M.sampled(parts.where("split = 'train' and label is not null"), 3)


def fitted_pair(spark: SparkSession, d: str) -> tuple[DataFrame, PipelineModel, L.Design, np.ndarray]:
    """Rows of the last days, a boosted model for warm channels, and a logistic one (design, coefficients) for cold ones."""
    rows, train = split_rows(spark, d)
    train = train.persist()
    warm = M.boosted(M.checked(train.columns, TWO)).fit(train)
    design, beta = fitted_cold(train)
    train.unpersist()
    return rows, warm, design, beta


@query()
def boosted_scores(spark: SparkSession, d: str) -> DataFrame:
    """A boosted model, scored by its table of nodes, for warm channels and a logistic one for cold ones"""
    rows, warm, design, beta = fitted_pair(spark, d)
    is_cold = F.col("observed_days") < 10
    score = F.when(is_cold, L.score(design.vector(), beta)).otherwise(M.tree_score(M.tree_nodes(warm)))
    return M.filled(warm, rows).select("channel_id", "day", is_cold.alias("is_cold"), F.round(score, 6).alias("score"))


@query(f"{ROWS} SELECT count(*) AS rows, CAST(0 AS DOUBLE) AS largest, CAST(0 AS BIGINT) AS one_sided FROM rows WHERE day >= DATE '2024-01-26'")
def tree_parity(spark: SparkSession, d: str) -> DataFrame:
    """The largest difference of scores by the table of nodes and by the fitted model itself"""
    rows, warm, _, _ = fitted_pair(spark, d)
    by_table = M.filled(warm, rows).select("channel_id", "day", M.tree_score(M.tree_nodes(warm)).alias("score"))
    return A.parity(by_table, M.scored(warm, rows), ["channel_id", "day"]).select("rows", F.round("largest", 9).alias("largest"), F.col("one_sided").cast("long").alias("one_sided"))


@query(f"""{FITTED[: FITTED.index(", tr AS (")].replace(design_sql("d", "ts", TWO, "sensor_type"), design_sql("d", "ts", TWO[:1], "sensor_type"))}, tr AS (SELECT g, {vector_sql(TWO[:1], "sensor_type")} AS x, label AS y, w FROM ts JOIN dq q USING (g) JOIN ds s USING (g) JOIN dc c USING (g)), {L.newton_sql("fit", "tr", L.RIDGE)},
ob AS (SELECT *, count(*) OVER (PARTITION BY channel_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS observed_days FROM rows)
SELECT channel_id, day, observed_days < 10 AS is_cold, CASE WHEN observed_days < 10 THEN round(1 / (1 + exp(-list_dot_product({vector_sql(TWO[:1], "sensor_type")}, f.b))), 6) END AS score FROM ob, dq q, ds s, dc c, fit f WHERE day >= DATE '2024-01-26'""")
def cold_scores(spark: SparkSession, d: str) -> DataFrame:
    """Which rows go to the cold model, and its scores of them"""
    rows, train = split_rows(spark, d)
    train = train.persist()
    design, beta = fitted_cold(train)
    train.unpersist()
    is_cold = F.col("observed_days") < 10
    return rows.select("channel_id", "day", is_cold.alias("is_cold"), F.when(is_cold, F.round(L.score(design.vector(), beta), 6)).alias("score"))


SAFE = ["n_events", "n_alarm", "n_events_previous", "gap_days"]
DAYS = CD + ", dd AS (SELECT *, lag(n_events) OVER v AS n_events_previous, day - lag(day) OVER v AS gap_days, lag(day) OVER v AS before FROM cd WINDOW v AS (PARTITION BY channel_id ORDER BY day))"


@query(f"""{DAYS}, ts AS (SELECT 'all' AS g, a.*, CAST(b.n_alarm > 0 AS INTEGER) AS label FROM dd a JOIN cd b ON b.channel_id = a.channel_id AND b.day = a.day + 2 WHERE a.day < DATE '2024-01-20'), {design_sql("d", "ts", SAFE)},
tr AS (SELECT g, {vector_sql(SAFE, None)} AS x, label AS y, CAST(1 AS DOUBLE) AS w FROM ts JOIN dq q USING (g) JOIN ds s USING (g)), {L.newton_sql("fit", "tr", L.RIDGE)},
aq AS (SELECT ch.channel_id, n_events, n_alarm, n_events_previous, gap_days, before FROM channels ch LEFT JOIN dd ON dd.channel_id = ch.channel_id AND dd.day = DATE '2024-01-25'),
y AS (SELECT aq.*, 1 / (1 + exp(-list_dot_product({vector_sql(SAFE, None)}, f.b))) AS p, array_to_string(list_filter([CASE WHEN n_events IS NULL THEN 'NO_READING_AT_D' END, CASE WHEN n_events IS NOT NULL AND before IS NULL THEN 'NO_HISTORY' END, CASE WHEN n_alarm >= 2 THEN 'ABOVE_THRESHOLD_AT_D' END], lambda z: z IS NOT NULL), '|') AS reasons FROM aq, dq q, ds s, fit f)
SELECT channel_id, DATE '2024-01-25' AS day, CASE WHEN reasons = '' THEN 'scored' ELSE 'abstain' END AS status, reasons, CAST(DATE '2024-01-27' AS DATE) AS window_start, CAST(DATE '2024-01-28' AS DATE) AS window_end, CASE WHEN reasons = '' THEN round(p, 6) END AS score FROM y""")
def day_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every channel of a day, scored by a model of safe features or abstaining with reasons"""
    days = channel_days(spark, d)
    by = Window.partitionBy("channel_id").orderBy("day")
    rows = days.withColumns({"n_events_previous": F.lag("n_events").over(by), "gap_days": F.date_diff("day", F.lag("day").over(by)), "before": F.lag("day").over(by)})
    later = days.select("channel_id", F.date_sub("day", 2).alias("day"), (F.col("n_alarm") > 0).cast("int").alias("label"))
    labelled = rows.join(later, ["channel_id", "day"]).where("day < date'2024-01-20'").persist()
    design = L.Design.of(labelled, M.checked(labelled.columns, M.preset(SAFE, "all")))
    beta = L.newton(labelled.select(F.lit("all").alias("g"), design.vector().alias("x"), F.col("label").alias("y"), F.lit(1.0).alias("w")), ["all"], len(design.names()))["all"]
    labelled.unpersist()
    at = B.channels(spark, d).select("channel_id").join(rows.where("day = date'2024-01-25'"), "channel_id", "left")
    reasons = {"NO_READING_AT_D": F.col("n_events").isNull(), "NO_HISTORY": F.col("n_events").isNotNull() & F.col("before").isNull(), "ABOVE_THRESHOLD_AT_D": F.col("n_alarm") >= 2}
    out = M.score_day(at, L.score(design.vector(), beta), F.lit("2024-01-25").cast("date"), reasons)
    return out.select("channel_id", "day", "status", F.array_join("reasons", "|").alias("reasons"), "window_start", "window_end", F.round("score", 6).alias("score"))


#: Features of the ablations, the presets that are fitted, the rules that they must beat, and the days at which folds train and validate.
FEATURES, BASELINES, REPEATS, SUPPORT = ["n_events", "n_failure", "n_events_previous", "gap_days", "weekday"], ["rule_failures", "rule_activity"], 20, 3
FOLDS = {"a": ("2024-01-13", "2024-01-21"), "b": ("2024-01-21", "2024-01-29")}
ROLES = {"full": "all", "reduced": "no_calendar", "uncatalogued": "no_catalogue", "simple": "core"}
LIMITS = {"least_positives": 10, "tolerance": 0.05, "least_known": 0.05}


def ablation_rows(spark: SparkSession, d: str) -> DataFrame:
    days = channel_days(spark, d).withColumnRenamed("n_alarm", "n_failure")
    by = Window.partitionBy("channel_id").orderBy("day")
    rows = days.withColumns({"n_events_previous": F.lag("n_events").over(by), "gap_days": F.date_diff("day", F.lag("day").over(by)), "weekday": F.weekday("day") + 1})
    later = days.select("channel_id", F.date_sub("day", 2).alias("day"), (F.col("n_failure") > 0).cast("int").alias("label"))
    return rows.join(later, ["channel_id", "day"], "left")


def ablation_scores(spark: SparkSession, d: str) -> DataFrame:
    """fold, channel_id, day, sensor_type, label, key, score of validation rows: five presets, fitted at once in each fold, and the rules."""
    rows, out = ablation_rows(spark, d).persist(), []
    for fold, (start, end) in FOLDS.items():
        train = rows.where(f"date_add(day, 2) < date'{start}' and label is not null")
        design = L.Design.of(train, M.checked(train.columns, FEATURES), "sensor_type")
        names = design.names()
        masks = {p: np.array([n == "intercept" or n in M.preset(names, p) for n in names]) for p in M.PRESETS}
        betas = L.newton(train.select(F.lit(fold).alias("g"), design.vector().alias("x"), F.col("label").alias("y"), F.lit(1.0).alias("w")), [fold], len(names), masks)
        keys = {p: L.score(design.vector(), betas[f"{fold}\t{p}"]) for p in M.PRESETS} | {"rule_failures": F.col("n_failure").cast("double"), "rule_activity": F.col("n_events").cast("double")}
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.round(s, 9).alias("score")) for k, s in keys.items()))).alias("x")
        held = rows.where(f"day >= date'{start}' and day < date'{end}'")
        out.append(held.select(F.lit(fold).alias("fold"), "channel_id", "day", "sensor_type", "label", each).select("fold", "channel_id", "day", "sensor_type", "label", "x.*"))
    return out[0].unionByName(out[1])


_DROPS = {p: [c for c in [*FEATURES, "sensor_type"] if c not in M.preset([*FEATURES, "sensor_type"], p)] for p in M.PRESETS}
_KEEP = {c: "preset NOT IN (" + ", ".join(f"'{p}'" for p, gone in _DROPS.items() if c in gone) + ")" for c in [*FEATURES, "sensor_type"] if any(c in gone for gone in _DROPS.values())}
ABLATED = f"""{CD}, ar AS (SELECT channel_id, day, object_id, sensor_type, n_events, n_alarm AS n_failure, lag(n_events) OVER v AS n_events_previous, day - lag(day) OVER v AS gap_days, isodow(day) AS weekday FROM cd WINDOW v AS (PARTITION BY channel_id ORDER BY day)),
ay AS (SELECT ar.*, CAST(b.n_alarm > 0 AS INTEGER) AS label FROM ar LEFT JOIN cd b ON b.channel_id = ar.channel_id AND b.day = ar.day + 2),
fo AS (SELECT * FROM (VALUES {", ".join(f"('{f}', DATE '{s}', DATE '{e}')" for f, (s, e) in FOLDS.items())}) AS t(g, start, stop)), ps AS (SELECT unnest([{", ".join(f"'{p}'" for p in M.PRESETS)}]) AS preset),
ts AS (SELECT fo.g, ay.* FROM ay, fo WHERE day + 2 < start AND label IS NOT NULL), {design_sql("d", "ts", FEATURES, "sensor_type")},
tr AS (SELECT g || ':' || preset AS g, {vector_sql(FEATURES, "sensor_type", _KEEP)} AS x, label AS y, CAST(1 AS DOUBLE) AS w FROM ts JOIN dq q USING (g) JOIN ds s USING (g) JOIN dc c USING (g), ps), {L.newton_sql("fit", "tr", L.RIDGE)},
hv AS (SELECT fo.g, ay.* FROM ay, fo WHERE day >= start AND day < stop),
sx AS (SELECT h.g AS fold, channel_id, day, sensor_type, label, preset AS key, round(1 / (1 + exp(-list_dot_product({vector_sql(FEATURES, "sensor_type", _KEEP)}, f.b))), 9) AS score FROM hv h JOIN dq q USING (g) JOIN ds s USING (g) JOIN dc c USING (g), ps, fit f WHERE f.g = h.g || ':' || preset),
al AS (SELECT * FROM sx UNION ALL SELECT g, channel_id, day, sensor_type, label, 'rule_failures', CAST(n_failure AS DOUBLE) FROM hv UNION ALL SELECT g, channel_id, day, sensor_type, label, 'rule_activity', CAST(n_events AS DOUBLE) FROM hv)"""


def precision_sql(rows: str, by: str) -> str:
    """Average precision, ties grouped, and positives of each group of rows (by, label, score)."""
    return f"SELECT {by}, sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) AS ap, sum(pos) AS positives FROM (SELECT *, sum(pos) OVER v AS tp, sum(neg) OVER v AS fp FROM (SELECT {by}, score, coalesce(sum(w) FILTER (WHERE label = 1), 0) AS pos, coalesce(sum(w) FILTER (WHERE label = 0), 0) AS neg FROM (SELECT *, 1 AS w FROM {rows}) WHERE label IS NOT NULL GROUP BY {by}, score) WINDOW v AS (PARTITION BY {by} ORDER BY score DESC)) GROUP BY {by}"


@query(f"{ABLATED}, ap AS ({precision_sql('al', 'fold, key')}), tp AS ({precision_sql('al', 'fold, key, sensor_type')}) SELECT fold, key, CAST(NULL AS VARCHAR) AS sensor_type, CAST(positives AS DOUBLE) AS positives, round(ap, 6) AS ap FROM ap UNION ALL SELECT fold, key, sensor_type, CAST(positives AS DOUBLE), round(ap, 6) FROM tp")
def ablations(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of five feature presets and two rules in each fold, over all and by sensor type"""
    # Equal scores are counted once, for both tables.
    rows = ablation_scores(spark, d).where("label is not null").groupBy("fold", "key", "sensor_type", "label", "score").agg(F.count("*").cast("double").alias("rows")).persist()
    whole = A.average_precision(rows, "fold", "key", weight="rows").withColumn("sensor_type", F.lit(None).cast("string"))
    each = A.average_precision(rows, "fold", "key", "sensor_type", weight="rows")
    return whole.unionByName(each).select("fold", "key", "sensor_type", F.col("positives").cast("double").alias("positives"), F.round("ap", 6).alias("ap"))


GATES = f"""{ABLATED}, ap AS ({precision_sql('al', 'fold, key')}), tp AS (SELECT * FROM ({precision_sql('al', 'fold, key, sensor_type')}) WHERE positives >= {SUPPORT}),
bb AS (SELECT fold, key AS best FROM ap WHERE key IN ('rule_failures', 'rule_activity') QUALIFY row_number() OVER (PARTITION BY fold ORDER BY coalesce(ap, -1) DESC, key = 'rule_activity') = 1),
k0 AS (SELECT * FROM al WHERE label IS NOT NULL AND score IS NOT NULL), bl AS (SELECT fold, day, row_number() OVER (PARTITION BY fold ORDER BY day) - 1 AS i FROM (SELECT DISTINCT fold, day FROM k0)), sz AS (SELECT fold, count(*) AS size FROM bl GROUP BY 1),
dr AS (SELECT fold, rep, CAST('0x' || substr(md5('s:' || rep || ':' || dr), 1, 8) AS BIGINT) % size AS i FROM (SELECT unnest(range(0, {REPEATS})) AS rep), sz, LATERAL (SELECT unnest(range(0, size)) AS dr)), tm AS (SELECT fold, rep, day, count(*) AS w FROM dr JOIN bl USING (fold, i) GROUP BY 1, 2, 3),
lg AS (SELECT k0.fold, key, rep, w, label, score FROM k0 JOIN tm ON tm.fold = k0.fold AND tm.day = k0.day), st AS (SELECT fold, key, rep, score, coalesce(sum(w) FILTER (WHERE label = 1), 0) AS pos, coalesce(sum(w) FILTER (WHERE label = 0), 0) AS neg FROM lg GROUP BY 1, 2, 3, 4),
cu AS (SELECT *, sum(pos) OVER v AS up, sum(neg) OVER v AS down FROM st WINDOW v AS (PARTITION BY fold, key, rep ORDER BY score DESC)), rp AS (SELECT fold, key, rep, sum(pos * up / (up + down)) / nullif(sum(pos), 0) AS ap FROM cu GROUP BY 1, 2, 3 HAVING sum(pos) > 0 AND sum(neg) > 0),
lw AS (SELECT a.fold, a.key, quantile_cont(a.ap - b.ap, 0.025) AS low FROM rp a JOIN bb ON bb.fold = a.fold JOIN rp b ON b.fold = a.fold AND b.key = bb.best AND b.rep = a.rep GROUP BY 1, 2),
mm AS (SELECT ap.fold, ap.key, ap.ap, lw.low, f.ap AS fullap FROM ap LEFT JOIN lw ON lw.fold = ap.fold AND lw.key = ap.key JOIN ap f ON f.fold = ap.fold AND f.key = 'all'),
fd AS (SELECT bool_and(positives >= {LIMITS["least_positives"]}) AS enough, bool_and(known >= {LIMITS["least_known"]}) AS known_share FROM (SELECT fold, count(*) FILTER (WHERE label = 1) AS positives, count(label) / count(*) AS known FROM al WHERE key = 'all' GROUP BY 1)),
gg AS (SELECT {", ".join(f"bool_and(coalesce(low, -1) > 0) FILTER (WHERE key = '{k}') AS beats_{n}, avg(ap) FILTER (WHERE key = '{k}') AS mean_{n}" for n, k in ROLES.items() if n != "uncatalogued")},
min(ap / greatest(fullap, 1e-12)) FILTER (WHERE key = 'no_calendar') >= {1 - LIMITS["tolerance"]} AS keeps_reduced, min(ap / greatest(fullap, 1e-12)) FILTER (WHERE key = 'no_catalogue') >= {1 - LIMITS["tolerance"]} AS keeps_uncatalogued,
CASE WHEN avg(ap) FILTER (WHERE key = 'rule_failures') >= avg(ap) FILTER (WHERE key = 'rule_activity') THEN 'rule_failures' ELSE 'rule_activity' END AS baseline FROM mm),
ch AS (SELECT *, CASE WHEN NOT keeps_reduced AND beats_reduced THEN 'no_calendar' ELSE 'all' END AS one, CASE WHEN NOT keeps_reduced AND beats_reduced THEN mean_reduced ELSE mean_full END AS mean_one FROM gg, fd),
se AS (SELECT *, CASE WHEN NOT enough THEN NULL WHEN beats_full THEN CASE WHEN beats_simple AND mean_simple >= mean_one - 0.005 THEN 'core' ELSE one END WHEN beats_simple THEN 'core' ELSE baseline END AS selected, CASE WHEN NOT enough THEN 'insufficient_events' WHEN beats_full OR beats_simple THEN 'validated_proxy_model' ELSE 'baseline_only' END AS evidence_level FROM ch),
cm AS (SELECT m.fold, count(*) AS n, count(*) FILTER (WHERE m.ap > b.ap) AS better FROM se JOIN tp m ON m.key = se.selected JOIN bb ON bb.fold = m.fold JOIN tp b ON b.fold = m.fold AND b.key = bb.best AND b.sensor_type = m.sensor_type GROUP BY 1 HAVING count(*) >= 2)
SELECT 'alarm' AS target, enough, {", ".join(f"CASE WHEN enough THEN {c} END AS {c}" for c in ("beats_full", "beats_reduced", "beats_simple", "keeps_reduced", "keeps_uncatalogued", "known_share"))},
CASE WHEN evidence_level = 'validated_proxy_model' THEN (SELECT bool_and(3 * better >= 2 * n) FROM cm) END AS stable, evidence_level, selected FROM se"""


@query(GATES)
def decision_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gates over all folds and types by the figures of the ablations, and the model that follows from them"""
    rows = ablation_scores(spark, d).persist()
    target = F.lit("alarm").alias("target")
    metrics = A.average_precision(rows, "fold", "key").select(target, "fold", "key", "ap").persist()
    found = {(r["fold"], r["key"]): r["ap"] for r in metrics.collect()}  # a row for each fold and model
    lows = []
    for fold in FOLDS:
        best = max(BASELINES, key=lambda k, fold=fold: -1.0 if found.get((fold, k)) is None else found[fold, k])
        ap = A.resampled_precision(rows.where(F.col("fold") == fold).select("key", F.col("day").alias("block"), "label", "score"), REPEATS)
        for key in ap:
            difference = ap[key] - ap[best]
            if (difference == difference).any():
                lows.append(("alarm", fold, key, float(np.nanquantile(difference, 0.025))))
    bounds = spark.createDataFrame(lows, "target string, fold string, key string, low double")
    folds = rows.where("key = 'all'").groupBy("fold").agg(F.count_if(F.col("label") == 1).alias("positives"), (F.count("label") / F.count("*")).alias("known")).withColumn("target", target)
    types = A.average_precision(rows, "fold", "key", "sensor_type").where(F.col("positives") >= SUPPORT).select(target, "fold", "key", F.col("sensor_type").alias("type"), "ap")
    return M.decide(metrics, bounds, folds, types, ["target"], BASELINES, ROLES, **LIMITS)
