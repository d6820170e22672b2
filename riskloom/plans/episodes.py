"""Registered queries on episode tables made of events, and their SQL.

scenario = event type, replicate = user, method = greatest value, least value or number of events of a day; a look
per day with events, unavailable on every seventh; two event types are null scenarios; even users calibrate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import checks, episodes, intervals, report
from riskloom.sources import feeds

METHODS = ["scan", "low", "count"]
ROW = ["scenario", "family", "null_family", "method", "replicate", "split", "stage", "status", "true_change", "true_change_day", "horizon", "risk_ratio"]


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).cast("int")
    base = events.groupBy(F.col("event_type").alias("scenario"), F.col("user_id").alias("replicate"), day.alias("day")).agg(F.max("value").alias("scan"), F.min("value").alias("low"), F.count("*").cast("double").alias("count"))
    long = base.unpivot(["scenario", "replicate", "day"], METHODS, "method", "statistic")
    null = F.col("scenario").isin("view", "click")
    even = F.col("replicate") % 2 == 0
    return long.select(
        "scenario", F.when(null, "quiet").otherwise("loud").alias("family"), F.when(null, "f1").otherwise("f2").alias("null_family"), "method", "replicate",
        F.when(even, "calibration").otherwise("evaluation").alias("split"), F.when(even, "calibration").otherwise("evaluation").alias("stage"),
        F.when(F.col("replicate") % 37 == 5, "failed").otherwise("success").alias("row_status"), F.lit(15).alias("true_change"), F.lit(16).alias("true_change_day"), F.lit(30).alias("horizon"),
        F.when(null, 1.0).otherwise(1.5).alias("risk_ratio"), "day", "statistic", F.lit(None).cast("double").alias("boundary"), F.greatest(F.lit(1), F.col("day") - 3).alias("tau_hat"),
        F.lit(1).alias("direction"), F.when(F.col("day") % 7 == 3, "unavailable").otherwise("available").alias("status"), F.col("day").alias("look"),
    )


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [c if c != "status" else "row_status" for c in ROW]
    fields = ["look", "day", "statistic", "boundary", "tau_hat", "direction", "status"]
    return episodes.nest_trace(looks(spark, sf_dir), keys, fields).withColumnRenamed("row_status", "status")


_KEYS_SQL = """scenario, CASE WHEN scenario IN ('view', 'click') THEN 'quiet' ELSE 'loud' END AS family, CASE WHEN scenario IN ('view', 'click') THEN 'f1' ELSE 'f2' END AS null_family, method, replicate,
  CASE WHEN replicate % 2 = 0 THEN 'calibration' ELSE 'evaluation' END AS split, CASE WHEN replicate % 2 = 0 THEN 'calibration' ELSE 'evaluation' END AS stage,
  CASE WHEN replicate % 37 = 5 THEN 'failed' ELSE 'success' END AS row_status, 15 AS true_change, 16 AS true_change_day, 30 AS horizon, CASE WHEN scenario IN ('view', 'click') THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS risk_ratio"""
LOOKS = f"""
b0 AS (SELECT event_type AS scenario, user_id AS replicate, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS day, max(value) AS mx, min(value) AS mn, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL),
b1 AS (SELECT scenario, replicate, day, 'scan' AS method, mx AS statistic FROM b0 UNION ALL SELECT scenario, replicate, day, 'low', mn FROM b0 UNION ALL SELECT scenario, replicate, day, 'count', n FROM b0),
lk AS (SELECT {_KEYS_SQL}, day, statistic, greatest(1, day - 3) AS tau_hat, CASE WHEN day % 7 = 3 THEN 'unavailable' ELSE 'available' END AS status FROM b1)"""
_GROUP = "scenario, family, null_family, method, replicate, split, stage, row_status, true_change, true_change_day, horizon, risk_ratio"
MAXIMA = f"""{LOOKS},
mx AS (SELECT {_GROUP}, max(statistic) FILTER (status = 'available') AS episode_statistic, min(day) FILTER (status = 'available') AS any_day, count(*) FILTER (status <> 'available') AS unavailable_looks FROM lk GROUP BY ALL),
th AS (SELECT null_family, method, count(*) AS n_calibration, CAST(ceil((count(*) + 1) * 0.95::DOUBLE) AS BIGINT) AS order_rank,
  list_sort(list(coalesce(episode_statistic, '-inf'::DOUBLE)))[CAST(ceil((count(*) + 1) * 0.95::DOUBLE) AS BIGINT)] AS critical_value FROM mx WHERE split = 'calibration' AND row_status = 'success' GROUP BY ALL)"""
APPLIED = f"""{MAXIMA},
ap AS (SELECT {_GROUP}, th.critical_value, min(day) FILTER (status = 'available' AND statistic > th.critical_value) AS alarm_day, count(*) FILTER (status <> 'available') AS unavailable_looks
  FROM lk JOIN th USING (null_family, method) GROUP BY ALL),
oc AS (SELECT *, CASE WHEN alarm_day IS NOT NULL THEN greatest(1, alarm_day - 3) END AS tau_hat_at_alarm, alarm_day IS NOT NULL AS alarm,
  coalesce(alarm_day < true_change, false) AS premature, coalesce(alarm_day >= true_change, false) AS postchange, coalesce(alarm_day BETWEEN true_change AND true_change + 5, false) AS within_window FROM ap),
fl AS (SELECT *, row_status <> 'success' AS failed, alarm_day IS NOT NULL AND row_status = 'success' AS any_alarm, abs(risk_ratio - 1) > 1e-9 AS alternative,
  coalesce(alarm_day IS NOT NULL AND row_status = 'success' AND abs(risk_ratio - 1) > 1e-9 AND alarm_day + 1 < true_change_day, false) AS prem, coalesce(alarm_day IS NOT NULL AND row_status = 'success' AND abs(risk_ratio - 1) > 1e-9 AND alarm_day + 1 >= true_change_day, false) AS useful FROM oc)"""


def r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


def as_double(column: str):
    return F.col(column).cast("double").alias(column)


def _maxima(spark, sf_dir):
    return episodes.episode_maximum(nested(spark, sf_dir))


def _thresholds(spark, sf_dir):
    rows = episodes.select_stage(_maxima(spark, sf_dir), "calibration").where("status = 'success'")
    return episodes.calibrate(rows, status="status", unit=["scenario", "replicate"])


def applied(spark, sf_dir):
    return episodes.apply_thresholds(nested(spark, sf_dir), _thresholds(spark, sf_dir))


def _flags(spark, sf_dir):
    rows = applied(spark, sf_dir).withColumn("unavailable_looks", F.size(F.expr("filter(trace, x -> x.status <> 'available')")))
    return report.derive_flags(rows)


def a4(spark, sf_dir):
    text = episodes.trace_to_json(nested(spark, sf_dir).select("scenario", "method", "replicate", "trace"))
    return episodes.flatten_trace(episodes.read_traces(text)).select("scenario", "method", "replicate", "look", "statistic", "tau_hat", "status")


def e2(spark, sf_dir):
    again = episodes.nest_trace(episodes.flatten_trace(nested(spark, sf_dir).select("scenario", "method", "replicate", "trace")), ["scenario", "method", "replicate"], ["look", "statistic", "status"])
    return again.select("scenario", "method", "replicate", F.size("trace").cast("long").alias("looks"), F.array_join(F.transform("trace", lambda x: x["look"].cast("string")), ",").alias("days"))


def e3(spark, sf_dir):
    return _maxima(spark, sf_dir).select("scenario", "method", "replicate", "episode_statistic", "day_max", F.col("unavailable_looks").cast("long").alias("unavailable_looks"), "all_looks_unavailable")


def e4(spark, sf_dir):
    return _thresholds(spark, sf_dir)


def e5(spark, sf_dir):
    return episodes.threshold_version(_thresholds(spark, sf_dir)).select("null_family", "method", "threshold_version")


def e6(spark, sf_dir):
    return applied(spark, sf_dir).select("scenario", "method", "replicate", as_double("alarm_day"), as_double("tau_hat_at_alarm"))


def e7(spark, sf_dir):
    rows = episodes.alarm_outcomes(applied(spark, sf_dir), 5)
    return rows.select("scenario", "method", "replicate", "alarm", "premature", "postchange", "no_postchange", "no_alarm", "within_window", as_double("localization_error"), "restricted_delay")


def e8(spark, sf_dir):
    return episodes.size_gate(episodes.select_stage(applied(spark, sf_dir), "evaluation")).select("null_family", "method", "n", "alarms", r("size"), r("lower", 5), r("upper", 5), "passes")


def e9(spark, sf_dir):
    out = episodes.episode_metrics(applied(spark, sf_dir), ["scenario", "method"], 5)
    return out.select("scenario", "method", "n", *(r(c) for c in out.columns[3:]))


def e10(spark, sf_dir):
    rows = episodes.select_stage(nested(spark, sf_dir), "evaluation")
    return rows.groupBy("scenario", "method").agg(F.count("*").alias("episodes"), F.sum(F.size("trace")).alias("looks"))


def e11(spark, sf_dir):
    return episodes.relabel_null(nested(spark, sf_dir)).groupBy("split", "scenario").agg(F.count("*").alias("episodes"))


def e12(spark, sf_dir):
    fits = looks(spark, sf_dir).where("method = 'scan' and replicate % 3 <> 0").groupBy("scenario", "replicate").agg(F.max("statistic").alias("fit_level"))
    return episodes.attach_fits(nested(spark, sf_dir).where("method = 'low'").select("scenario", "replicate", "split"), fits)


def _trace(spark, sf_dir):
    rows = looks(spark, sf_dir).where("method = 'scan'").join(F.broadcast(_thresholds(spark, sf_dir)), ["null_family", "method"])
    return rows.select("scenario", "replicate", "look", F.col("day").alias("prefix"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("day") - 1).alias("date"), F.lit("2024-01-01").cast("date").alias("start_date"), "statistic", F.col("critical_value").alias("boundary"), "tau_hat", F.coalesce((F.col("statistic") > F.col("critical_value")) & (F.col("status") == "available"), F.lit(False)).alias("crossed"))


TRACE = f"""{MAXIMA},
tr AS (SELECT scenario, replicate, day AS look, day AS prefix, statistic, th.critical_value AS boundary, tau_hat, coalesce(statistic > th.critical_value AND status = 'available', false) AS crossed FROM lk JOIN th USING (null_family, method) WHERE method = 'scan'),
fa AS (SELECT scenario, replicate, min(look) AS first_look FROM tr WHERE crossed GROUP BY ALL)"""


def m2(spark, sf_dir):
    return episodes.first_alarm(_trace(spark, sf_dir), ["scenario", "replicate"]).select("scenario", "replicate", "look", "statistic", "tau_hat")


def m3(spark, sf_dir):
    out = episodes.monitor_summary(_trace(spark, sf_dir), ["scenario", "replicate"])
    return out.select("scenario", "replicate", "n_observations", "n_looks", "alarm", F.date_format("alarm_date", "yyyy-MM-dd").alias("alarm_date"), as_double("change"), r("alpha_spent", 9))


def m6(spark, sf_dir):
    return episodes.monitor_until_alarm(_trace(spark, sf_dir), ["scenario", "replicate"]).select("scenario", "replicate", "look", "statistic", "crossed")


def i1(spark, sf_dir):
    out = report.summarize_binary(episodes.alarm_outcomes(applied(spark, sf_dir), 5), ["scenario", "method"], "premature")
    return out.select("scenario", "method", "n", "events", r("estimate"), r("mcse"), r("lower", 5), r("upper", 5))


def i3(spark, sf_dir):
    out = intervals.mean_t_interval(looks(spark, sf_dir), ["scenario", "method"], "statistic")
    return out.select("scenario", "method", "n", r("mean"), r("lower"), r("upper"))


def i4(spark, sf_dir):
    out = intervals.median_bootstrap_interval(_maxima(spark, sf_dir), ["scenario", "method"], "episode_statistic")
    return out.select("scenario", "method", "n", "median", "lower", "upper")


def _wide(spark, sf_dir):
    rows = _maxima(spark, sf_dir)
    return rows.groupBy("scenario", "replicate").pivot("method", METHODS).agg(F.max("episode_statistic"))


_WIDE_SQL = "wd AS (SELECT scenario, replicate, max(episode_statistic) FILTER (method = 'scan') AS scan, max(episode_statistic) FILTER (method = 'low') AS low FROM mx GROUP BY ALL)"


def i5(spark, sf_dir):
    out = intervals.paired_difference_interval(_wide(spark, sf_dir), ["scenario"], "scan", "low")
    return out.select("scenario", "n", r("difference"), r("lower"), r("upper"))


def i6(spark, sf_dir):
    out = intervals.relative_error_scores(_wide(spark, sf_dir).withColumn("truth", F.lit(50.0)), ["scenario"], "scan", "truth")
    return out.select("scenario", "n", r("relative_mse"), r("relative_rmse"), r("rmse_mcse"))


def i7(spark, sf_dir):
    return intervals.null_quantile_bracket(_maxima(spark, sf_dir).where("episode_statistic is not null"), ["null_family", "method"], "episode_statistic")


def _roots(spark, sf_dir):
    rows = _maxima(spark, sf_dir).where("episode_statistic is not null")
    return rows.select(F.col("method").alias("target"), F.col("scenario").alias("cell"), (F.col("replicate") % 5 != 0).alias("alarm"), F.lit(True).alias("available"), F.col("episode_statistic").alias("root"))


def i8(spark, sf_dir):
    rows = _roots(spark, sf_dir)
    counts = rows.groupBy("target", "cell").agg(F.count("*").alias("n_alarms"))
    return intervals.shortest_interval(rows, counts, ["target"], share=0.9).select("target", "lower", "upper", "infeasible")


I8_SQL = f"""WITH {MAXIMA}, rt AS (SELECT method AS target, scenario AS cell, episode_statistic AS root FROM mx WHERE episode_statistic IS NOT NULL),
cl AS (SELECT target, cell, list_sort(list(root)) AS rs, CAST(ceil(count(*) * 0.9::DOUBLE) AS BIGINT) AS m FROM rt GROUP BY ALL),
cd AS (SELECT DISTINCT target, root AS lo FROM rt),
en AS (SELECT cd.target, lo, rs[len(list_filter(rs, lambda x: x < lo)) + m] AS hi FROM cd JOIN cl USING (target)),
sp AS (SELECT target, lo, max(hi) AS hi FROM en GROUP BY ALL HAVING count(*) = count(hi))
SELECT target, arg_min(lo, (hi - lo, lo)) AS lower, arg_min(hi, (hi - lo, lo)) AS upper, false AS infeasible FROM sp GROUP BY target"""


def c3(spark, sf_dir):
    return intervals.critical_value(_maxima(spark, sf_dir).where("episode_statistic is not null"), ["scenario", "method"], "episode_statistic", 0.1)


def c7(spark, sf_dir):
    rows = looks(spark, sf_dir).where("status = 'available' and method = 'scan'")
    return intervals.legacy_boundary(rows, ["scenario", "look"], "statistic", 0.5, 5)


def r1(spark, sf_dir):
    return applied(spark, sf_dir).where(report.timely_flag(5)).select("scenario", "method", "replicate", "alarm_day")


def r2(spark, sf_dir):
    out = report.summarize_binary(episodes.alarm_outcomes(applied(spark, sf_dir), 5), ["scenario", "method"], "within_window")
    return out.select("scenario", "method", "n", "events", r("estimate"), r("mcse"))


def r3(spark, sf_dir):
    rows = _maxima(spark, sf_dir).where("episode_statistic is not null").withColumn("p", F.col("unavailable_looks") / 10).withColumn("lower", F.col("episode_statistic") - 30).withColumn("upper", F.col("episode_statistic") + 30).withColumn("truth", F.lit(60.0))
    out = report.rejection_and_coverage(rows, ["scenario", "method"], "p", [0.1, 0.3], "lower", "upper", "truth", "episode_statistic")
    return out.select("scenario", "method", "measure", "level", "n", as_double("events"), r("estimate"))


R3_SQL = f"""WITH {MAXIMA}, q AS (SELECT *, unavailable_looks / 10 AS p FROM mx WHERE episode_statistic IS NOT NULL)
SELECT scenario, method, 'rejection' AS measure, a AS level, count(*) AS n, (count(*) FILTER (p <= a))::DOUBLE AS events, round(count(*) FILTER (p <= a) / count(*), 6) AS estimate FROM q, (VALUES (0.1::DOUBLE), (0.3::DOUBLE)) v(a) GROUP BY scenario, method, a
UNION ALL SELECT scenario, method, 'coverage', NULL, count(*), (count(*) FILTER (60 BETWEEN episode_statistic - 30 AND episode_statistic + 30))::DOUBLE, round(count(*) FILTER (60 BETWEEN episode_statistic - 30 AND episode_statistic + 30) / count(*), 6) FROM q GROUP BY scenario, method
UNION ALL SELECT scenario, method, 'relative_bias', NULL, count(*), NULL, round(avg(episode_statistic / 60 - 1), 6) FROM q GROUP BY scenario, method"""


def _paths(spark, sf_dir):
    rows = looks(spark, sf_dir).join(F.broadcast(_thresholds(spark, sf_dir)), ["null_family", "method"]).withColumn("crossed", F.coalesce((F.col("statistic") > F.col("critical_value")) & (F.col("status") == "available"), F.lit(False)))
    return report.cumulative_error_paths(rows, ["scenario", "method"])


PATHS = f"""{MAXIMA}, cr AS (SELECT scenario, method, replicate, day AS look, coalesce(statistic > critical_value AND status = 'available', false) AS crossed FROM lk JOIN th USING (null_family, method)),
ev AS (SELECT scenario, method, replicate, look, bool_or(crossed) OVER (PARTITION BY scenario, method, replicate ORDER BY look) AS e FROM cr),
pa AS (SELECT scenario, method, look, count(*) AS n, count(*) FILTER (e) AS events, count(*) FILTER (e) / count(*) AS probability FROM ev GROUP BY ALL)"""


def r4(spark, sf_dir):
    return _paths(spark, sf_dir).select("scenario", "method", "look", "n", "events", r("probability"))


def r5(spark, sf_dir):
    out = report.pooled_paths(_paths(spark, sf_dir), ["method"], "scenario")
    return out.select("method", "look", "n", r("probability"), r("least"), r("most"), "paths")


def r6(spark, sf_dir):
    rows = applied(spark, sf_dir)
    cells = rows.select("scenario", "method").union(spark.createDataFrame([("none", "scan")], "scenario string, method string"))
    out = report.operating_table(rows, cells, ["scenario", "method"], 5)
    return out.select("scenario", "method", "n", r("timely"), "median_localization", "median_delay")


def r7(spark, sf_dir):
    rows = episodes.alarm_outcomes(applied(spark, sf_dir), 5)
    out = report.comparison_table(rows, ["scenario"], "alarm", "scan", METHODS)
    return out.select("scenario", "comparator", "n", r("difference"), r("sd"))


R7_SQL = f"""WITH {APPLIED}, wd AS (SELECT scenario, replicate, max(alarm::INT) FILTER (method = 'scan') AS s, max(alarm::INT) FILTER (method = 'low') AS l, max(alarm::INT) FILTER (method = 'count') AS c FROM oc GROUP BY ALL)
SELECT scenario, 'low' AS comparator, count(s - l) AS n, round(avg(s - l), 6) AS difference, round(stddev_samp(s - l), 6) AS sd FROM wd GROUP BY scenario
UNION ALL SELECT scenario, 'count', count(s - c), round(avg(s - c), 6), round(stddev_samp(s - c), 6) FROM wd GROUP BY scenario"""


def r8(spark, sf_dir):
    rows = episodes.alarm_outcomes(applied(spark, sf_dir), 5).withColumn("purpose", F.when(F.col("family") == "quiet", "null").otherwise("alternative")).withColumn("place", F.length("scenario").cast("long"))
    out = report.tolerance_table(rows, "scenario", "place", F.col("within_window"), F.col("alarm"))
    return out.select("place", "scenario", "purpose", "n", "events", r("estimate"))


def r9(spark, sf_dir):
    shares = episodes.alarm_outcomes(applied(spark, sf_dir), 5).groupBy("scenario", "method").agg(F.round(F.avg(F.col("alarm").cast("double")), 6).alias("share"))
    return report.method_matrix(shares, "share", METHODS)


def r10(spark, sf_dir):
    return _flags(spark, sf_dir).select("scenario", "method", "replicate", "failed", "any_alarm", "alternative", "premature", "useful", as_double("delay"))


def r11(spark, sf_dir):
    return report.episode_summary(_flags(spark, sf_dir)).select("stage", "scenario", "method", "metric", "n", "events", r("estimate"))


R11_SQL = f"""WITH {APPLIED}, q AS (SELECT stage, scenario, method, count(*) AS n, bool_or(alternative) AS alt, count(*) FILTER (any_alarm) AS alarm_probability, count(*) FILTER (useful) AS useful_power, count(*) FILTER (prem) AS premature_probability, count(*) FILTER (failed) AS failed, count(*) FILTER (NOT any_alarm) AS absent FROM fl GROUP BY ALL),
u AS (UNPIVOT q ON alarm_probability, useful_power, premature_probability, failed, absent INTO NAME metric VALUE events)
SELECT stage, scenario, method, metric, n, events, round(events / n, 6) AS estimate FROM u WHERE alt OR metric NOT IN ('useful_power', 'premature_probability')"""


def r12(spark, sf_dir):
    return report.cumulative_detection_curve(_flags(spark, sf_dir)).select("stage", "scenario", "method", "delay", "n", "events", r("estimate"))


R12_SQL = f"""WITH {APPLIED}, g AS (SELECT stage, scenario, method, count(*) AS n FROM fl WHERE alternative GROUP BY ALL),
d AS (SELECT stage, scenario, method, n, CAST(unnest(range(0, 15)) AS BIGINT) AS delay FROM g)
SELECT d.stage, d.scenario, d.method, d.delay, d.n, count(*) FILTER (useful AND alarm_day + 1 - true_change_day <= d.delay) AS events, round(count(*) FILTER (useful AND alarm_day + 1 - true_change_day <= d.delay) / d.n, 6) AS estimate
FROM d JOIN fl ON fl.stage = d.stage AND fl.scenario = d.scenario AND fl.method = d.method GROUP BY d.stage, d.scenario, d.method, d.delay, d.n"""


def r13(spark, sf_dir):
    return report.failure_table(_flags(spark, sf_dir))


def r14(spark, sf_dir):
    out = report.paired_contrasts(_flags(spark, sf_dir), METHODS, "any_alarm")
    return out.select("stage", "scenario", "a", "b", "n", r("difference"), r("mcse"), "a_only", "b_only")


R14_SQL = f"""WITH {APPLIED}, p AS (SELECT x.stage, x.scenario, x.method AS a, y.method AS b, x.any_alarm::INT - y.any_alarm::INT AS d FROM fl x JOIN fl y ON y.stage = x.stage AND y.scenario = x.scenario AND y.replicate = x.replicate
  AND (x.method, y.method) IN (('scan', 'low'), ('scan', 'count'), ('low', 'count')))
SELECT stage, scenario, a, b, count(*) AS n, round(avg(d), 6) AS difference, round(stddev_samp(d) / sqrt(count(*)), 6) AS mcse, count(*) FILTER (d = 1) AS a_only, count(*) FILTER (d = -1) AS b_only FROM p GROUP BY ALL"""


def r15(spark, sf_dir):
    return report.localization_summary(_flags(spark, sf_dir)).select("stage", "scenario", "method", "n", r("mean"))


def r16(spark, sf_dir):
    return report.trace_maxima(looks(spark, sf_dir), ["scenario", "method", "replicate"])


R16_SQL = f"WITH {LOOKS} SELECT scenario, method, replicate, max(statistic) FILTER (status = 'available' AND day < true_change) AS before, max(statistic) FILTER (status = 'available' AND day >= true_change) AS after, count(*) FILTER (status <> 'available') AS unavailable FROM lk GROUP BY ALL"


def r17(spark, sf_dir):
    maxima = report.trace_maxima(looks(spark, sf_dir), ["scenario", "null_family", "method", "replicate"])
    null = _maxima(spark, sf_dir).where("episode_statistic is not null")
    return report.standardized_power(maxima, null, "episode_statistic", ["scenario", "method"], ["null_family", "method"]).select("scenario", "method", "n", "events")


R17_SQL = f"""WITH {MAXIMA}, ct AS (SELECT null_family, method, list_sort(list(episode_statistic))[CAST(ceil(count(*) * 0.95 - 1e-12) AS BIGINT)] AS c FROM mx WHERE episode_statistic IS NOT NULL GROUP BY ALL),
tm AS (SELECT scenario, null_family, method, replicate, max(statistic) FILTER (status = 'available' AND day < true_change) AS bf, max(statistic) FILTER (status = 'available' AND day >= true_change) AS af FROM lk GROUP BY ALL)
SELECT scenario, method, count(*) AS n, count(*) FILTER (coalesce(bf, '-inf'::DOUBLE) <= c AND coalesce(af, '-inf'::DOUBLE) > c) AS events FROM tm JOIN ct USING (null_family, method) GROUP BY ALL"""


def _banks(spark, sf_dir):
    rows = nested(spark, sf_dir).drop("trace").withColumn("misspecification", F.when(F.col("scenario") == "error", "ascertainment").when(F.col("method") == "low", "delay").otherwise("none"))
    return [rows.where("split = 'calibration'"), rows.where("split = 'evaluation'")]


def r18(spark, sf_dir):
    return report.sensitivity_union(_banks(spark, sf_dir), ["first", "second"])[1]


def r19(spark, sf_dir):
    rows = feeds.union_banks(_banks(spark, sf_dir), ["first", "second"], "all", "0" * 16)
    named = rows.withColumn("scenario", F.concat(F.lit("delay_"), F.col("scenario")))
    return report.sensitivity_selection(named).groupBy("delay_setting", "misspecification").agg(F.count("*").alias("n"))


def r20(spark, sf_dir):
    rows = nested(spark, sf_dir).select("family", (F.col("replicate") % 4).alias("true_change"), "risk_ratio")
    return report.cell_index(rows, ["quiet", "loud"])


def a7(spark, sf_dir):
    rows = feeds.union_banks(_banks(spark, sf_dir), ["first", "second"], "study", "0" * 16)
    return rows.groupBy("evidence_source", "evidence_stage", "producer_scientific_digest").agg(F.count("*").alias("n"))


def k1(spark, sf_dir):
    rows = _maxima(spark, sf_dir).withColumn("experiment", F.col("scenario"))
    required = {x: ["episode_statistic", "method"] for x in ("view", "click", "error", "absent")}
    return checks.check_contract(rows, required)


K1_SQL = f"""WITH {MAXIMA} SELECT 'absent' AS experiment, '*' AS column, 1::BIGINT AS n_bad
UNION ALL SELECT scenario, 'episode_statistic', count(*) FILTER (episode_statistic IS NULL AND scenario IN ('view', 'click', 'error')) FROM mx GROUP BY scenario HAVING count(*) FILTER (episode_statistic IS NULL AND scenario IN ('view', 'click', 'error')) > 0
UNION ALL SELECT scenario, 'status!', count(*) FILTER (row_status <> 'success') FROM mx GROUP BY scenario HAVING count(*) FILTER (row_status <> 'success') > 0"""


def k2(spark, sf_dir):
    rows = looks(spark, sf_dir).where("method = 'count'").withColumn("flag", F.col("statistic").cast("int"))
    return checks.check_binary(rows, ["flag"], ["scenario", "replicate", "day"])


def k3(spark, sf_dir):
    rows = nested(spark, sf_dir).where("not (method = 'low' and replicate % 11 = 0)").withColumn("stream_hash", F.sha2(F.concat("scenario", F.when(F.col("replicate") % 13 == 0, F.col("method")).otherwise("x")), 256))
    return checks.check_shared_streams(rows, ["scenario", "replicate"])


K3_SQL = f"""WITH {MAXIMA}, q AS (SELECT *, CASE WHEN replicate % 13 = 0 THEN method ELSE 'x' END AS h FROM mx WHERE NOT (method = 'low' AND replicate % 11 = 0)),
c AS (SELECT scenario, replicate, count(DISTINCT h) AS nh, list_sort(list(DISTINCT method)) AS ms FROM q GROUP BY ALL), s AS (SELECT scenario, count(DISTINCT ms) AS sets FROM c GROUP BY ALL)
SELECT scenario, replicate, 'several hashes' AS problem FROM c WHERE nh > 1 UNION ALL SELECT scenario, replicate, 'methods differ' FROM c JOIN s USING (scenario) WHERE sets > 1"""


def k4(spark, sf_dir):
    return checks.check_grid(nested(spark, sf_dir), 100, METHODS, ["risk_ratio", "split"]).withColumn("replicate", F.col("replicate").cast("double"))


K4_SQL = f"""WITH {MAXIMA}, g AS (SELECT scenario, method, unnest(range(0, 100)) AS replicate FROM (SELECT DISTINCT scenario FROM mx), (VALUES ('scan'), ('low'), ('count')) v(method))
SELECT coalesce(g.scenario, mx.scenario) AS scenario, coalesce(g.method, mx.method) AS method, coalesce(g.replicate, mx.replicate)::DOUBLE AS replicate, CASE WHEN mx.scenario IS NULL THEN 'missing' ELSE 'extra' END AS problem
FROM g FULL JOIN mx ON mx.scenario = g.scenario AND mx.method = g.method AND mx.replicate = g.replicate WHERE mx.scenario IS NULL OR g.scenario IS NULL
UNION ALL SELECT scenario, NULL, NULL, 'split varies' FROM mx GROUP BY scenario HAVING count(DISTINCT split) > 1"""


def k5(spark, sf_dir):
    rows = applied(spark, sf_dir).withColumn("all_looks_unavailable", F.lit(False)).withColumn("horizon", F.lit(20))
    return checks.check_alarms(rows, ["scenario", "method", "replicate"])


def k6(spark, sf_dir):
    rows = applied(spark, sf_dir).where("method = 'scan'").select("scenario", "replicate", "alarm_day")
    point = F.col("alarm_day").isNotNull() | (F.col("replicate") % 17 == 0)
    made = rows.where("replicate % 19 <> 0").withColumn("x_point_valid", point).withColumn("x_interval_valid", F.col("replicate") % 23 == 0).withColumn("x_estimate", F.when(point, 1.0))
    return checks.check_estimation_cohort(made, rows, ["scenario", "replicate"], ["x"])


K6_SQL = f"""WITH {APPLIED}, q AS (SELECT scenario, replicate, alarm_day, alarm_day IS NOT NULL OR replicate % 17 = 0 AS p, replicate % 23 = 0 AS i FROM ap WHERE method = 'scan')
SELECT scenario, replicate, 'missing' AS problem FROM q WHERE replicate % 19 = 0 UNION ALL SELECT scenario, replicate, 'x interval without point' FROM q WHERE replicate % 19 <> 0 AND i AND NOT p
UNION ALL SELECT scenario, replicate, 'x point without alarm' FROM q WHERE replicate % 19 <> 0 AND p AND alarm_day IS NULL"""


def k7(spark, sf_dir):
    rows = _maxima(spark, sf_dir).select("scenario", "method", "replicate", "episode_statistic", "split")
    other = rows.where("replicate % 29 <> 0").withColumn("episode_statistic", F.when(F.col("replicate") % 31 == 0, F.col("episode_statistic") * 1.001).otherwise(F.col("episode_statistic")))
    return checks.check_frozen_columns(rows, other, ["scenario", "method", "replicate"], ["episode_statistic", "split"])


def k8(spark, sf_dir):
    rows = _maxima(spark, sf_dir).where("method = 'count'").withColumn("digest", F.sha2(F.col("episode_statistic").cast("int").cast("string"), 256))
    second = rows.withColumn("replicate", F.col("replicate") + 1)
    return checks.check_disjoint_banks(rows, second, ["scenario", "replicate"], "digest").select("scenario", "replicate")


def k9(spark, sf_dir):
    rows = applied(spark, sf_dir).withColumn("alarm_day", F.when(F.col("replicate") % 9 == 0, F.col("alarm_day") + 1).otherwise(F.col("alarm_day")))
    return checks.check_trace_replay(rows, list(range(1, 31)), ["scenario", "method", "replicate"]).where("problem = 'alarm'")


def k11(spark, sf_dir):
    rows = nested(spark, sf_dir).withColumn("scientific_digest", F.left(F.sha2("family", 256), F.lit(8)))
    return checks.check_digest(rows, "0000")


def k12(spark, sf_dir):
    return checks.check_thresholds(_thresholds(spark, sf_dir), nested(spark, sf_dir), [*METHODS, "other"], alpha=0.05)


def i2(spark, sf_dir):
    """Shares of episodes with an alarm, with their Monte Carlo errors and exact intervals."""
    out = intervals.probability_summary(applied(spark, sf_dir), ["scenario", "method"], F.col("alarm_day").isNotNull())
    return out.select("scenario", "method", "n", "events", r("estimate"), r("mcse"), r("lower", 5), r("upper", 5))


def _tail(first: str, last: str) -> str:
    """P(first <= X <= last) of X binomial(n, m)."""
    return f"coalesce(list_sum(list_transform(range({first}, {last} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(m) + (n - i) * ln(1 - m)))), 0)"


def exact_interval_sql(source: str, confidence: float) -> str:
    """CTEs up to ci(k, n, lower, upper) of the pairs (k, n) in source: tails of half the error, found by 50 bisections."""
    half = f"{(1 - confidence) / 2!r}::DOUBLE"
    step = lambda name, test: f"""{name}(k, n, a, z, step) AS (SELECT DISTINCT k, n, 0::DOUBLE, 1::DOUBLE, 0 FROM {source}
  UNION ALL SELECT k, n, CASE WHEN {test} THEN m ELSE a END, CASE WHEN {test} THEN z ELSE m END, step + 1 FROM (SELECT *, (a + z) / 2 AS m FROM {name} WHERE step < 50))"""  # noqa: E731
    return f"""{step("lw", f"{_tail('k', 'n')} < {half}")}, {step("up", f"{_tail('0', 'k')} > {half}")},
ci AS (SELECT k, n, CASE WHEN k = 0 THEN 0 ELSE (lw.a + lw.z) / 2 END AS lower, CASE WHEN k = n THEN 1 ELSE (up.a + up.z) / 2 END AS upper FROM lw JOIN up USING (k, n, step) WHERE step = 50)"""


def _share_sql(event: str) -> str:
    return f"""WITH RECURSIVE {APPLIED}, sr AS (SELECT scenario, method, count(*) AS n, count(*) FILTER ({event}) AS k FROM oc GROUP BY ALL), {exact_interval_sql("sr", 0.95)}
SELECT scenario, method, n, k AS events, round(k / n, 6) AS estimate, round(sqrt(k / n * (1 - k / n) / n), 6) AS mcse, round(lower, 5) AS lower, round(upper, 5) AS upper FROM sr JOIN ci USING (k, n)"""


E8_SQL = f"""WITH RECURSIVE {APPLIED}, sr AS (SELECT null_family, method, count(*) AS n, count(*) FILTER (alarm) AS k FROM oc WHERE stage = 'evaluation' GROUP BY ALL), {exact_interval_sql("sr", 0.9)}
SELECT null_family, method, n, k AS alarms, round(k / n, 6) AS size, round(lower, 5) AS lower, round(upper, 5) AS upper, lower >= 0.04 AND upper <= 0.06 AS passes FROM sr JOIN ci USING (k, n)"""
I7_SQL = f"""WITH {MAXIMA}, v AS (SELECT null_family, method, list_sort(list(episode_statistic)) AS vs, count(*) AS n FROM mx WHERE episode_statistic IS NOT NULL GROUP BY ALL),
k AS (SELECT DISTINCT n, unnest(range(1, n + 1)) AS k, 0.95::DOUBLE AS m FROM v),
b AS (SELECT n, k, {_tail('0', '(k - 1)')} AS below FROM k),
g AS (SELECT n, count(*) FILTER (1 - below >= 0.99) AS low_rank, coalesce(min(k) FILTER (below >= 0.99), n + 1) AS high_rank FROM b GROUP BY n)
SELECT null_family, method, n, CAST(ceil(0.95::DOUBLE * n - 1e-12) AS INTEGER) AS rank, CAST(low_rank AS INTEGER) AS low_rank, CAST(high_rank AS INTEGER) AS high_rank,
  vs[CAST(ceil(0.95::DOUBLE * n - 1e-12) AS INTEGER)] AS cutoff, CASE WHEN low_rank > 0 THEN vs[low_rank] END AS low, vs[high_rank] AS high FROM v JOIN g USING (n)"""


QUERIES = {
    "i2_probability_summary": i2,
    "a4_read_traces": a4, "a7_union_banks": a7, "e2_nest_trace": e2, "e3_episode_maximum": e3, "e4_calibrate": e4, "e5_threshold_version": e5, "e6_apply_thresholds": e6, "e7_alarm_outcomes": e7,
    "e8_size_gate": e8, "e9_episode_metrics": e9, "e10_select_stage": e10, "e11_relabel_null": e11, "e12_attach_fits": e12, "m2_first_alarm": m2, "m3_monitor_summary": m3, "m6_until_alarm": m6,
    "i1_binomial_interval": i1, "i3_mean_t_interval": i3, "i4_median_bootstrap": i4, "i5_paired_difference": i5, "i6_relative_error": i6, "i7_quantile_bracket": i7, "i8_shortest_interval": i8,
    "c3_critical_value": c3, "c7_legacy_boundary": c7, "r1_timely_flag": r1, "r2_summarize_binary": r2, "r3_rejection_and_coverage": r3, "r4_error_paths": r4, "r5_pooled_paths": r5, "r6_operating_table": r6,
    "r7_comparison_table": r7, "r8_tolerance_table": r8, "r9_method_matrix": r9, "r10_derive_flags": r10, "r11_episode_summary": r11, "r12_detection_curve": r12, "r13_failure_table": r13,
    "r14_paired_contrasts": r14, "r15_localization": r15, "r16_trace_maxima": r16, "r17_standardized_power": r17, "r18_sensitivity_union": r18, "r19_sensitivity_selection": r19, "r20_cell_index": r20,
    "k1_contract": k1, "k2_binary": k2, "k3_shared_streams": k3, "k4_grid": k4, "k5_alarms": k5, "k6_estimation_cohort": k6, "k7_frozen_columns": k7, "k8_disjoint_banks": k8, "k9_trace_replay": k9,
    "k11_digest": k11, "k12_thresholds": k12,
}

_BANK = "q AS (SELECT *, CASE WHEN scenario = 'error' THEN 'ascertainment' WHEN method = 'low' THEN 'delay' ELSE 'none' END AS misspecification, CASE WHEN split = 'calibration' THEN 'first' ELSE 'second' END AS src FROM mx)"

def _t_sql(q: str) -> str:
    """P(0 < T < q) of Student's t with n - 1 degrees of freedom: Simpson's rule on 2,000 panels."""
    density = f"pow(1 + pow({q} * i / 2000, 2) / (n - 1), -n / 2::DOUBLE)"
    return f"(exp(lgamma(n / 2::DOUBLE) - lgamma((n - 1) / 2::DOUBLE)) / sqrt(pi() * (n - 1)) * {q} / 6000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density})))"


I3_SQL = f"""WITH RECURSIVE {LOOKS}, st AS (SELECT scenario, method, count(statistic) AS n, avg(statistic) AS mean, stddev_samp(statistic) AS sd FROM lk GROUP BY ALL),
bs(scenario, method, n, mean, sd, lo, hi, step) AS (SELECT scenario, method, n, mean, sd, 0::DOUBLE, 16::DOUBLE, 0 FROM st
  UNION ALL SELECT scenario, method, n, mean, sd, CASE WHEN p < 0.475 THEN mid ELSE lo END, CASE WHEN p < 0.475 THEN hi ELSE mid END, step + 1 FROM (
    SELECT *, (lo + hi) / 2 AS mid, {_t_sql("((lo + hi) / 2)")} AS p FROM bs WHERE step < 45 AND n > 1))
SELECT scenario, method, n, round(mean, 6) AS mean, round(mean - hi * sd / sqrt(n), 6) AS lower, round(mean + hi * sd / sqrt(n), 6) AS upper FROM bs WHERE step = 45 OR n < 2"""

ORACLE_SQL = {
    "i3_mean_t_interval": I3_SQL,
    "i1_binomial_interval": _share_sql("premature"), "i2_probability_summary": _share_sql("alarm"), "e8_size_gate": E8_SQL, "i7_quantile_bracket": I7_SQL,
    "a4_read_traces": f"WITH {LOOKS} SELECT scenario, method, replicate, day AS look, statistic, tau_hat, status FROM lk",
    "a7_union_banks": f"WITH {MAXIMA}, {_BANK} SELECT src AS evidence_source, 'study' AS evidence_stage, '0000000000000000' AS producer_scientific_digest, count(*) AS n FROM q GROUP BY src",
    "e2_nest_trace": f"WITH {LOOKS} SELECT scenario, method, replicate, count(*) AS looks, string_agg(day, ',' ORDER BY day) AS days FROM lk GROUP BY ALL",
    "e3_episode_maximum": f"WITH {LOOKS} SELECT scenario, method, replicate, max(statistic) FILTER (status = 'available') AS episode_statistic, arg_max(day, (statistic, -day)) FILTER (status = 'available') AS day_max, count(*) FILTER (status <> 'available') AS unavailable_looks, count(*) FILTER (status = 'available') = 0 AS all_looks_unavailable FROM lk GROUP BY ALL",
    "e4_calibrate": f"WITH {MAXIMA} SELECT * FROM th",
    "e5_threshold_version": f"WITH {MAXIMA} SELECT null_family, method, left(sha256(null_family || '|' || method || '|' || n_calibration || '|' || order_rank || '|' || coalesce(printf('%.6f', critical_value), 'none')), 16) AS threshold_version FROM th",
    "e6_apply_thresholds": f"WITH {APPLIED} SELECT scenario, method, replicate, alarm_day::DOUBLE AS alarm_day, tau_hat_at_alarm::DOUBLE AS tau_hat_at_alarm FROM oc",
    "e7_alarm_outcomes": f"WITH {APPLIED} SELECT scenario, method, replicate, alarm, premature, postchange, NOT postchange AS no_postchange, NOT alarm AS no_alarm, within_window, CASE WHEN postchange THEN abs(tau_hat_at_alarm - true_change)::DOUBLE END AS localization_error, CASE WHEN postchange THEN alarm_day - true_change ELSE horizon - true_change END AS restricted_delay FROM oc",
    "e9_episode_metrics": f"WITH {APPLIED} SELECT scenario, method, count(*) AS n, round(avg(premature::INT), 6) AS premature_probability, round(avg(postchange::INT), 6) AS post_probability, round(avg(within_window::INT), 6) AS timely_probability, round(avg(CASE WHEN postchange THEN alarm_day - true_change ELSE horizon - true_change + 1 END), 6) AS restricted_mean_delay, round(quantile_cont(alarm_day - true_change, 0.5) FILTER (postchange), 6) AS median_delay, round(quantile_cont(abs(tau_hat_at_alarm - true_change), 0.5) FILTER (postchange), 6) AS median_localization, round(quantile_cont(abs(tau_hat_at_alarm - true_change), 0.9) FILTER (postchange), 6) AS p90_localization, round(avg(tau_hat_at_alarm - true_change) FILTER (postchange), 6) AS localization_bias FROM oc GROUP BY ALL",
    "e10_select_stage": f"WITH {LOOKS} SELECT scenario, method, count(DISTINCT replicate) AS episodes, count(*) AS looks FROM lk WHERE split = 'evaluation' GROUP BY ALL",
    "e11_relabel_null": f"WITH {MAXIMA} SELECT CASE WHEN risk_ratio = 1 THEN 'null' ELSE split END AS split, scenario, count(*) AS episodes FROM mx GROUP BY ALL",
    "e12_attach_fits": f"WITH {MAXIMA}, ft AS (SELECT scenario, replicate, max(mx) AS fit_level FROM b0 WHERE replicate % 3 <> 0 GROUP BY ALL) SELECT mx.scenario, mx.replicate, split, fit_level FROM mx LEFT JOIN ft USING (scenario, replicate) WHERE method = 'low'",
    "m2_first_alarm": f"WITH {TRACE} SELECT scenario, replicate, look, statistic, tau_hat FROM tr JOIN fa USING (scenario, replicate) WHERE look = first_look",
    "m3_monitor_summary": f"WITH {TRACE} SELECT scenario, replicate, max(prefix) AS n_observations, count(*) AS n_looks, first_look IS NOT NULL AS alarm, CAST(DATE '2024-01-01' + CAST(first_look - 1 AS INTEGER) AS VARCHAR) AS alarm_date, CASE WHEN first_look IS NOT NULL THEN greatest(1, first_look - 3)::DOUBLE END AS change, round(0.05 * first_look / count(*), 9) AS alpha_spent FROM tr LEFT JOIN fa USING (scenario, replicate) GROUP BY scenario, replicate, first_look",
    "m6_until_alarm": f"WITH {TRACE} SELECT scenario, replicate, look, statistic, crossed FROM tr LEFT JOIN fa USING (scenario, replicate) WHERE first_look IS NULL OR look <= first_look",
    "i5_paired_difference": f"WITH {MAXIMA}, {_WIDE_SQL} SELECT scenario, count(scan - low) AS n, round(avg(scan - low), 6) AS difference, round(avg(scan - low) - 1.959963984540054 * stddev_samp(scan - low) / sqrt(count(scan - low)), 6) AS lower, round(avg(scan - low) + 1.959963984540054 * stddev_samp(scan - low) / sqrt(count(scan - low)), 6) AS upper FROM wd GROUP BY scenario",
    "i6_relative_error": f"WITH {MAXIMA}, {_WIDE_SQL}, e AS (SELECT scenario, (scan / 50 - 1) ** 2 AS e FROM wd) SELECT scenario, count(e) AS n, round(avg(e), 6) AS relative_mse, round(sqrt(avg(e)), 6) AS relative_rmse, round(stddev_samp(e) / sqrt(count(e)) / (2 * sqrt(avg(e))), 6) AS rmse_mcse FROM e GROUP BY scenario",
    "i8_shortest_interval": I8_SQL,
    "c3_critical_value": f"WITH {MAXIMA} SELECT scenario, method, count(*) AS n, CAST(ceil((count(*) + 1) * 0.9::DOUBLE) AS BIGINT) AS rank, list_sort(list(episode_statistic))[CAST(ceil((count(*) + 1) * 0.9::DOUBLE) AS BIGINT)] AS critical_value FROM mx WHERE episode_statistic IS NOT NULL GROUP BY ALL",
    "c7_legacy_boundary": f"WITH {LOOKS} SELECT scenario, day AS look, count(*) AS n, CAST(ceil((count(*) + 1) * 0.9::DOUBLE) AS BIGINT) AS rank, list_sort(list(statistic))[CAST(ceil((count(*) + 1) * 0.9::DOUBLE) AS BIGINT)] AS critical_value FROM lk WHERE status = 'available' AND method = 'scan' GROUP BY ALL",
    "r1_timely_flag": f"WITH {APPLIED} SELECT scenario, method, replicate, alarm_day FROM oc WHERE within_window",
    "r2_summarize_binary": f"WITH {APPLIED}, q AS (SELECT scenario, method, count(*) AS n, count(*) FILTER (within_window) AS events FROM oc GROUP BY ALL) SELECT scenario, method, n, events, round(events / n, 6) AS estimate, round(sqrt(events / n * (1 - events / n) / n), 6) AS mcse FROM q",
    "r3_rejection_and_coverage": R3_SQL,
    "r4_error_paths": f"WITH {PATHS} SELECT scenario, method, look, n, events, round(probability, 6) AS probability FROM pa",
    "r5_pooled_paths": f"WITH {PATHS} SELECT method, look, CAST(sum(n) AS BIGINT) AS n, round(sum(n * probability) / sum(n), 6) AS probability, round(min(probability), 6) AS least, round(max(probability), 6) AS most, count(*) AS paths FROM pa GROUP BY method, look",
    "r6_operating_table": f"WITH {APPLIED} SELECT scenario, method, count(*) AS n, round(avg(within_window::INT), 6) AS timely, quantile_cont(abs(tau_hat_at_alarm - true_change), 0.5) FILTER (within_window) AS median_localization, quantile_cont(alarm_day - true_change, 0.5) FILTER (within_window) AS median_delay FROM oc GROUP BY ALL UNION ALL SELECT 'none', 'scan', 0, NULL, NULL, NULL",
    "r7_comparison_table": R7_SQL,
    "r8_tolerance_table": f"WITH {APPLIED}, q AS (SELECT length(scenario) AS place, scenario, CASE WHEN family = 'quiet' THEN 'null' ELSE 'alternative' END AS purpose, CASE WHEN family = 'quiet' THEN alarm ELSE within_window END AS v FROM oc) SELECT place, scenario, purpose, count(*) AS n, count(*) FILTER (v) AS events, round(count(*) FILTER (v) / count(*), 6) AS estimate FROM q GROUP BY ALL",
    "r9_method_matrix": f"WITH {APPLIED} SELECT scenario, round(avg(alarm::INT) FILTER (method = 'scan'), 6) AS scan, round(avg(alarm::INT) FILTER (method = 'low'), 6) AS low, round(avg(alarm::INT) FILTER (method = 'count'), 6) AS count FROM oc GROUP BY scenario",
    "r10_derive_flags": f"WITH {APPLIED} SELECT scenario, method, replicate, failed, any_alarm, alternative, prem AS premature, useful, CASE WHEN useful THEN (alarm_day + 1 - true_change_day)::DOUBLE END AS delay FROM fl",
    "r11_episode_summary": R11_SQL, "r12_detection_curve": R12_SQL,
    "r13_failure_table": f"WITH {APPLIED} SELECT stage, scenario, method, row_status AS status, count(*) AS n, CAST(sum(unavailable_looks) AS BIGINT) AS invalid_looks FROM ap GROUP BY ALL",
    "r14_paired_contrasts": R14_SQL,
    "r15_localization": f"WITH {APPLIED} SELECT stage, scenario, method, count(*) AS n, round(avg(abs(tau_hat_at_alarm - true_change)), 6) AS mean FROM fl WHERE useful GROUP BY ALL",
    "r16_trace_maxima": R16_SQL, "r17_standardized_power": R17_SQL,
    "r18_sensitivity_union": f"WITH {MAXIMA}, {_BANK} SELECT src AS evidence_source, scenario, count(*) AS rows FROM q WHERE misspecification <> 'ascertainment' GROUP BY ALL",
    "r19_sensitivity_selection": f"WITH {MAXIMA}, {_BANK} SELECT scenario AS delay_setting, misspecification, count(*) AS n FROM q WHERE misspecification IN ('none', 'delay') GROUP BY ALL",
    "r20_cell_index": f"WITH {MAXIMA}, q AS (SELECT DISTINCT family, replicate % 4 AS true_change, risk_ratio FROM mx) SELECT *, CAST(row_number() OVER (ORDER BY CASE family WHEN 'quiet' THEN 1 ELSE 2 END, true_change, risk_ratio) AS INTEGER) AS cell FROM q",
    "k1_contract": K1_SQL,
    "k2_binary": f"WITH {LOOKS} SELECT scenario, replicate, day, CAST(statistic AS INTEGER) AS flag FROM lk WHERE method = 'count' AND statistic > 1",
    "k3_shared_streams": K3_SQL, "k4_grid": K4_SQL,
    "k5_alarms": f"WITH {APPLIED} SELECT scenario, method, replicate, alarm_day, tau_hat_at_alarm FROM oc WHERE alarm_day > 20 OR (alarm_day IS NOT NULL AND row_status <> 'success')",
    "k6_estimation_cohort": K6_SQL,
    "k7_frozen_columns": f"WITH {MAXIMA} SELECT scenario, method, replicate, CASE WHEN replicate % 29 = 0 THEN '*' ELSE 'episode_statistic' END AS column FROM mx WHERE replicate % 29 = 0 OR (replicate % 31 = 0 AND episode_statistic IS NOT NULL AND episode_statistic <> 0)",
    "k8_disjoint_banks": f"WITH {MAXIMA}, q AS (SELECT scenario, replicate, CAST(episode_statistic AS INTEGER) AS d FROM mx WHERE method = 'count' AND episode_statistic IS NOT NULL) SELECT DISTINCT a.scenario, a.replicate FROM q a JOIN q b ON b.scenario = a.scenario AND b.replicate + 1 = a.replicate AND b.d = a.d",
    "k9_trace_replay": f"WITH {APPLIED} SELECT scenario, method, replicate, 'alarm' AS problem FROM oc WHERE replicate % 9 = 0 AND alarm_day IS NOT NULL",
    "k11_digest": f"WITH {MAXIMA} SELECT left(sha256(family), 8) AS scientific_digest, count(*) AS n FROM mx GROUP BY family",
    "k12_thresholds": "SELECT f AS null_family, 'other' AS method, 'missing' AS problem FROM (SELECT DISTINCT CASE WHEN event_type IN ('view', 'click') THEN 'f1' ELSE 'f2' END AS f FROM events)",
}
