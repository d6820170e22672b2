"""Registered queries on fits, boundaries, monitoring, estimates and streams, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.shared import shared_path
from riskloom.operators import boundary, checks, estimation, exposure, fit, monitor, prepare, scan
from riskloom.operators.episodes import first_alarm
from riskloom.plans.series import EXPOSED, FITTED, LAW, RESIDUALS, WEEKLY, _residuals, weekly
from riskloom.sources import feeds
from riskloom.streaming import online

TAU = 100
K = ["series"]


def r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


def design(spark, sf_dir):
    return exposure.two_rate_design(weekly(spark, sf_dir), LAW, TAU)


DESIGN = f"""{EXPOSED},
late AS (SELECT a.series, a.t, sum(coalesce(b.cases * f.p, 0)) AS b FROM w a CROSS JOIN f LEFT JOIN w b ON b.series = a.series AND b.t = a.t - f.lag AND b.t >= {TAU} GROUP BY ALL),
dg AS (SELECT x.series, x.t, x.x, x.x - late.b AS a, late.b AS b, x.deaths FROM x JOIN late USING (series, t) WHERE x > 1e-12),
sm AS (SELECT series, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * deaths) AS ay, sum(b * deaths) AS bb_y, sum(deaths * deaths) AS yy, count(*) AS n FROM dg GROUP BY series),
ls AS (SELECT *, (bb * ay - ab * bb_y) / (aa * bb - ab * ab) AS l, (aa * bb_y - ab * ay) / (aa * bb - ab * ab) AS r FROM sm)"""


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 10).alias("series"), "ts", "event_type")
    return prepare.daily_counts(events, K, "ts", F.col("event_type").isin("view", "click"), F.col("event_type") == "error", "day")


ONLINE = monitor.MonitorConfig(law=(0.5, 0.3, 0.2), looks=(10, 17, 24, 30), paths=399, alpha=0.2)
WEEKS = monitor.MonitorConfig(law=tuple(LAW), looks=(60, 120, 180, 240, 300), paths=999, every=60)


def _shown(fits, *risks):
    """Fits by digits that any exact maximiser agrees on; phi has none towards the Poisson limit."""
    limit = F.col("phi") >= fit.POISSON
    return fits.select("series", *(r(c) for c in risks), F.when(~limit, F.round(F.log("phi"), 3)).alias("log_phi"), limit.alias("poisson"), r("loglik", 4), "success", "status")


def f1(spark, sf_dir):
    return _shown(fit.fit_null(exposure.total_exposure(weekly(spark, sf_dir), LAW), K), "pi")


def f1_days(spark, sf_dir):
    """Mean and variance of every day under the series' fit."""
    out = fit.null_days(exposure.total_exposure(weekly(spark, sf_dir), LAW), K, observation_start=10)
    return out.select("series", "t", r("mean", 4), F.when((F.col("phi") < fit.POISSON) & (F.col("mean") > 1e-3), F.round((F.col("variance") - F.col("mean")) / F.col("mean") / F.col("mean"), 4)).alias("excess"))


def f3(spark, sf_dir):
    return _shown(fit.fit_two_rate(design(spark, sf_dir), K), "left", "right")


def f4(spark, sf_dir):
    out = fit.fit_two_rate(design(spark, sf_dir), K, phi=25.0)
    return out.select("series", r("left"), r("right"), "phi", r("loglik", 4), "success", "status")


def f5(spark, sf_dir):
    return _shown(fit.fit_two_rate(design(spark, sf_dir), K, precision=1.0), "left", "right")


def f6(spark, sf_dir):
    out = fit.fit_two_rate_poisson(design(spark, sf_dir), K, precision=1.0)
    return out.select("series", r("left"), r("right"), r("loglik", 4), "success", "status")


def f7(spark, sf_dir):
    out = estimation.fit_two_rate_ls(estimation.design_sums(design(spark, sf_dir), K))
    return out.select("series", r("left", 9), r("right", 9), r("rss", 4), "active_set", "status")


def f8(spark, sf_dir):
    rows = design(spark, sf_dir)
    out = estimation.two_stage_moments(rows, K, F.lit(TAU))
    return out.select("series", r("left", 9), r("right", 9), r("ratio", 9), "status", "point_valid", "admissible")


def _info(spark, sf_dir):
    rows = design(spark, sf_dir)
    fits = estimation.fit_two_rate_ls(estimation.design_sums(rows, K)).select("series", "left", "right", F.lit(25.0).alias("phi"))
    return estimation.information_sums(rows, fits, K)


INFO = f"""{DESIGN}, inf AS (SELECT dg.series, l, r, sum(a * a / v) AS iaa, sum(a * b / v) AS iab, sum(b * b / v) AS ibb FROM (
  SELECT dg.*, l, r, greatest(l * a + r * b, 1e-12) + greatest(l * a + r * b, 1e-12) ** 2 / 25 AS v FROM dg JOIN ls USING (series)) dg GROUP BY ALL),
va AS (SELECT *, ibb / (iaa * ibb - iab * iab) AS vl, iaa / (iaa * ibb - iab * iab) AS vr, -iab / (iaa * ibb - iab * iab) AS c FROM inf)"""
_Z = "1.959963984540054"


def f9(spark, sf_dir):
    out = estimation.wald_intervals(_info(spark, sf_dir))
    return out.select("series", "interval_valid", *(r(f"{t}_{e}") for t in ("left", "right", "ratio") for e in ("lower", "upper")))


def _logit_sql(p, v, sign):
    return f"round(1 / (1 + exp(-(ln({p} / (1 - {p})) {sign} {_Z} * sqrt({v}) / ({p} * (1 - {p}))))), 6)"


F9_SQL = f"""WITH {INFO} SELECT series, true AS interval_valid, {_logit_sql('l', 'vl', '-')} AS left_lower, {_logit_sql('l', 'vl', '+')} AS left_upper, {_logit_sql('r', 'vr', '-')} AS right_lower, {_logit_sql('r', 'vr', '+')} AS right_upper,
round(exp(ln(r / l) - {_Z} * sqrt(vl / l ** 2 + vr / r ** 2 - 2 * c / (l * r))), 6) AS ratio_lower, round(exp(ln(r / l) + {_Z} * sqrt(vl / l ** 2 + vr / r ** 2 - 2 * c / (l * r))), 6) AS ratio_upper FROM va"""


def f10(spark, sf_dir):
    out = estimation.stabilized_intervals(_info(spark, sf_dir), 1.0)
    return out.select("series", *(r(f"{t}_{e}") for t in ("left", "right", "ratio") for e in ("lower", "upper")))


F10_SQL = f"""WITH {INFO}, i AS (SELECT series, l, r, iaa * l * l AS i11, iab * l * r AS i12, ibb * r * r AS i22 FROM inf),
b AS (SELECT *, (i22 + 1) / ((i11 + 1) * (i22 + 1) - (i12 - 1) ** 2) AS b11, (1 - i12) / ((i11 + 1) * (i22 + 1) - (i12 - 1) ** 2) AS b12, (i11 + 1) / ((i11 + 1) * (i22 + 1) - (i12 - 1) ** 2) AS b22 FROM i),
v AS (SELECT series, l, r, b11 * b11 * i11 + 2 * b11 * b12 * i12 + b12 * b12 * i22 AS v11, b12 * b12 * i11 + 2 * b12 * b22 * i12 + b22 * b22 * i22 AS v22, b11 * b12 * i11 + (b11 * b22 + b12 * b12) * i12 + b12 * b22 * i22 AS v12 FROM b)
SELECT series, round(exp(ln(l) - {_Z} * sqrt(v11)), 6) AS left_lower, round(exp(ln(l) + {_Z} * sqrt(v11)), 6) AS left_upper, round(exp(ln(r) - {_Z} * sqrt(v22)), 6) AS right_lower, round(exp(ln(r) + {_Z} * sqrt(v22)), 6) AS right_upper,
round(exp(ln(r / l) - {_Z} * sqrt(v11 + v22 - 2 * v12)), 6) AS ratio_lower, round(exp(ln(r / l) + {_Z} * sqrt(v11 + v22 - 2 * v12)), 6) AS ratio_upper FROM v"""


def f11(spark, sf_dir):
    rows = scan.poisson_null(exposure.total_exposure(weekly(spark, sf_dir), LAW)).where("active")
    value = fit.nb_loglik_column(F.col("deaths"), F.col("mean"), F.lit(12.5))
    return rows.withColumn("ll", value).groupBy("series").agg(F.round(F.sum("ll"), 5).alias("loglik"), F.round(F.sum(estimation.nb_variance(F.col("mean"), F.lit(12.5))), 5).alias("variance"))


F11_SQL = f"""WITH {FITTED} SELECT series, round(sum(lgamma(deaths + 12.5) - lgamma(12.5) - lgamma(deaths + 1) + 12.5 * ln(12.5 / (12.5 + mean)) + deaths * ln(mean / (12.5 + mean))), 5) AS loglik,
round(sum(mean + mean * mean / 12.5), 5) AS variance FROM m WHERE active GROUP BY series"""


def f12(spark, sf_dir):
    rows = scan.poisson_null(exposure.total_exposure(weekly(spark, sf_dir), LAW)).where("active")
    return estimation.moment_phi(rows, K).select("series", r("phi"))


def h4(spark, sf_dir):
    rows = _residuals(spark, sf_dir).withColumn("phi", F.lit(30.0))
    return fit.glr_scan_nb(rows, K, 52)


def f13_nb(spark, sf_dir):
    return fit.baseline_residuals(exposure.total_exposure(weekly(spark, sf_dir), LAW), K, 52).select("series", "t", "mean", "variance", "v")


def h5_nb(spark, sf_dir):
    rows = fit.baseline_residuals(exposure.total_exposure(weekly(spark, sf_dir), LAW), K, 52)
    return fit.chart_traces_nb(rows, K, [*range(102, 345, 50)], 52)


def c1(spark, sf_dir):
    """Every series' standardised residuals projected on each path's normals of its days: paths whose projection is greatest, and the moments."""
    import numpy as np
    import pandas as pd

    rows = _residuals(spark, sf_dir).select("series", "t", "v")
    paths, seed = WEEKS.paths, WEEKS.seed

    def one(pdf):
        v = pdf.sort_values("t").v.fillna(0.0).to_numpy()
        score = boundary.path_normals(seed, paths, len(v)) @ v / max(float(np.sqrt(v @ v)), 1e-12)
        return pd.DataFrame({"series": [pdf.series.iloc[0]], "n": [len(v)], "path": [int(np.argmax(score**2))], "greatest": [float((score**2).max())], "mean": [float(score.mean())], "second": [float((score**2).mean())]})

    return rows.groupBy("series").applyInPandas(one, "series string, n int, path int, greatest double, mean double, second double")


def c2(spark, sf_dir):
    """Path maxima at the end of every series, as quantiles."""
    import numpy as np
    import pandas as pd

    def one(pdf):
        rows = pdf.sort_values("t")
        found = monitor.scan_prefix(rows.cases.to_numpy(), rows.deaths.to_numpy(), WEEKS)
        maxima = found.maxima(boundary.path_normals(WEEKS.seed, WEEKS.paths, len(rows))) if found.n_candidates else np.full(1, np.nan)
        return pd.DataFrame({"series": [pdf.series.iloc[0]], "n": [len(rows)], "median": [float(np.median(maxima))], "q95": [float(np.quantile(maxima, 0.95))]})

    return weekly(spark, sf_dir).groupBy("series").applyInPandas(one, "series string, n int, median double, q95 double")


GIVEN = 40


def c2_given(spark, sf_dir):
    """Path maxima of every series' Poisson scan for given numbers in place of normals: (7919 path + 104729 t) % 2003 / 1001 - 1."""
    import numpy as np
    import pandas as pd

    config = monitor.with_looks(WEEKS, [400])

    def one(pdf):
        rows = pdf.sort_values("t")
        bank = (7919 * np.arange(GIVEN)[:, None] + 104729 * np.arange(len(rows))) % 2003 / 1001 - 1
        found = monitor.scan_prefix(rows.cases.to_numpy(), rows.deaths.to_numpy(), config, poisson=True)
        return pd.DataFrame({"series": pdf.series.iloc[0], "path": np.arange(GIVEN), "value": found.maxima(bank) if found.n_candidates else np.nan})

    return weekly(spark, sf_dir).groupBy("series").applyInPandas(one, "series string, path int, value double").select("series", "path", r("value"))


def c6_blocks(spark, sf_dir):
    """The monitor of weekly orders with its bank in four blocks of paths."""
    out = monitor.monitor_in_blocks(weekly(spark, sf_dir), K, WEEKS, 4)
    return out.select("series", "look", "prefix", "statistic", "boundary", "tau_hat", "crossed", "eligible_after")


def c4(spark, sf_dir):
    return monitor.fixed_look_test(weekly(spark, sf_dir), K, monitor.with_looks(WEEKS, [400]))


def c5(spark, sf_dir):
    cut, _, tests = boundary.bonferroni_boundary(345, 0.05, 7)
    found = scan.scan_winner(scan.scanned(weekly(spark, sf_dir), LAW))
    return found.select("series", r("statistic"), F.lit(tests).alias("tests"), (F.col("statistic") > cut).alias("crossed"))


def c6(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("series"), (F.dayofmonth("ts") % 4 + 1).alias("look"), (F.col("event_id") % 399).alias("path"), "value")
    maxima = rows.groupBy("series", "path", "look").agg(F.max("value").alias("value"))
    grid = maxima.select("series", "path").distinct().crossJoin(F.broadcast(spark.range(1, 5).select(F.col("id").cast("int").alias("look"))))
    filled = grid.join(maxima, ["series", "path", "look"], "left").select("series", "path", "look", F.coalesce("value", F.lit(0.0)).alias("value"))
    out = boundary.spending_boundary(filled, K, 4, 0.2)
    return out.withColumns({c: F.round(c, 6) for c in ("cumulative_alpha", "crossing_fraction")})


def m1(spark, sf_dir):
    return monitor.monitor(weekly(spark, sf_dir), K, WEEKS)


def m4(spark, sf_dir):
    """Weekly orders whose deaths rise by half from week 80 on: alarms, and the risks before and after."""
    rows = weekly(spark, sf_dir).withColumn("deaths", F.when(F.col("t") >= 80, F.rint(F.col("deaths") * 1.5)).otherwise(F.col("deaths")))
    alarms = first_alarm(monitor.monitor(rows, K, WEEKS), K)
    return monitor.post_alarm_estimates(rows, alarms, K, WEEKS)


def m5(spark, sf_dir):
    rows = events_daily(spark, sf_dir).withColumn("series", F.col("series").cast("string")).withColumn("kind", F.lit("daily")).select("kind", "series", "t", "cases", "deaths")
    rows = rows.union(weekly(spark, sf_dir).withColumn("kind", F.lit("weekly")).select("kind", "series", "t", "cases", "deaths"))
    return monitor.monitor_many(rows, K, "kind", {"daily": ONLINE, "weekly": WEEKS})


def e1(spark, sf_dir):
    return monitor.evaluate_episodes(events_daily(spark, sf_dir), K, ONLINE).select("series", F.size("trace").alias("looks"), "episode_statistic", "unavailable_looks", "alarm_day")


def e1_methods(spark, sf_dir):
    """The charts' rows of the nested traces of weekly orders, with a Poisson reference fit."""
    rows = weekly(spark, sf_dir)
    config = replace(WEEKS, looks=(102,), every=50, paths=99)
    found = monitor.evaluate_methods(rows, K, config, 52, poisson=True).where("method <> 'score_scan'")
    return found.select("series", "method", F.inline("trace")).select("series", "method", "look", "prefix", r("statistic"), "direction", "status")


def _feed(spark, sf_dir, parts: int) -> str:
    """Line items as a CSV feed of some files: a day and return flag is a report."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.to_date("l_shipdate").alias("Date_reported"), F.col("l_returnflag").alias("Country_code")).agg(
        F.count("*").cast("double").alias("New_cases"), F.when(F.count_if(F.col("l_quantity") >= 45) > 0, F.count_if(F.col("l_quantity") >= 45).cast("double")).alias("New_deaths")
    )
    path = shared_path(spark, "feed")
    rows.select("Date_reported", "Country_code", F.col("Country_code").alias("Country"), "New_cases", "New_deaths", F.lit("x").alias("Other")).repartition(parts, "Date_reported").write.csv(path, header=True)
    return path


def a1(spark, sf_dir):
    out = feeds.read_case_feed(spark, _feed(spark, sf_dir, 4), ["A", "R"], "1996-01-01", "1997-12-31")
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def a1_stream(spark, sf_dir):
    """The same feed as a stream, a file a batch."""
    stream = feeds.stream_case_feed(spark, _feed(spark, sf_dir, 4), ["A", "R"], "1996-01-01", "1997-12-31", files=1)
    out = shared_path(spark, "stream-out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "stream-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("series string, date date, cases double, deaths double").parquet(out).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


A1_SQL = """SELECT l_returnflag AS series, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, count(*)::DOUBLE AS cases, (count(*) FILTER (l_quantity >= 45))::DOUBLE AS deaths FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY ALL"""


CHART = {"cases": "Affected (Admitted)", "deaths": "Death"}


def _chart_pages(spark, sf_dir, broken: bool = False):
    """A chart written into each page's html from its own numbers; if asked for, every fifth page's is broken in one of three ways."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    n = F.length("html") % 5 + 4
    data = lambda k: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: ((F.col("page_id") * k + i * 7) % 50).cast("string")), ","), F.lit("]"))
    deaths = data(5)
    if broken:
        kind = F.col("page_id") % 15
        deaths = F.when(kind == 3, F.lit("[1,2]")).when(kind == 8, F.lit("[1,-2,3,4]")).when(kind == 13, F.lit("[1,oops,3]")).otherwise(deaths)
    chart = F.concat(F.lit("<script>Highcharts.chart('weekly_chart', {series: [{name: 'Affected (Admitted)', data: "), data(3), F.lit("}, {name: 'Death', data: "), deaths, F.lit("}]});</script>"))
    return pages.withColumn("html", F.concat("html", chart))


def a2(spark, sf_dir):
    """A chart written into each page's html from its own numbers, then read out again."""
    return feeds.read_chart_series(_chart_pages(spark, sf_dir), "weekly_chart", CHART, "2024-01-01", keys=["page_id"]).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def a2_malformed(spark, sf_dir):
    """Pages with broken charts, beside how many weeks the others have."""
    pages = _chart_pages(spark, sf_dir, True)
    good = feeds.read_chart_series(pages, "weekly_chart", CHART, "2024-01-01", keys=["page_id"], strict=False).groupBy("page_id").agg(F.count("*").alias("weeks"))
    bad = feeds.malformed_charts(pages, "weekly_chart", CHART, keys=["page_id"]).groupBy("page_id").agg(F.max(F.when(F.col("name") == "Death", F.col("values"))).cast("long").alias("deaths_read"))
    return good.join(bad, "page_id", "full").select("page_id", F.coalesce("weeks", F.lit(-1)).alias("weeks"), F.coalesce("deaths_read", F.lit(-1)).alias("deaths_read"))


A2_MALFORMED_SQL = """SELECT page_id, CASE WHEN page_id % 5 = 3 THEN -1 ELSE length(html) % 5 + 2 END::BIGINT AS weeks, CASE page_id % 15 WHEN 3 THEN 2 WHEN 8 THEN 3 WHEN 13 THEN 0 ELSE -1 END::BIGINT AS deaths_read FROM pages"""
A2_SQL = """WITH p AS (SELECT page_id, length(html) % 5 + 4 AS n FROM pages), q AS (SELECT page_id, n, unnest(range(2, n)) AS i FROM p)
SELECT page_id, 'W' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS reporting_week, CAST(DATE '2024-01-01' + CAST(7 * (i - 2) AS INTEGER) AS VARCHAR) AS date, CAST((page_id * 3 + i * 7) % 50 AS INTEGER) AS cases, CAST((page_id * 5 + i * 7) % 50 AS INTEGER) AS deaths FROM q"""


def a3(spark, sf_dir):
    from riskloom.plans import episodes

    rows = episodes._maxima(spark, sf_dir).withColumn("episode_seed", prepare.episode_seed("episode", "v1", "scenario", 7, "replicate", "all")).withColumn("wide_text", F.repeat(F.lit("x"), 100))
    path = shared_path(spark, "episodes")
    feeds.write_episodes(rows, path)
    schema = spark.read.parquet(path).schema
    return feeds.read_episodes(spark, path, schema, ["scenario", "method", "replicate", "episode_statistic", "episode_seed"]).drop("episode_seed")


def a6(spark, sf_dir):
    trace = monitor.monitor(events_daily(spark, sf_dir), K, ONLINE)
    path = shared_path(spark, "monitoring")
    feeds.write_monitoring(first_alarm(trace, K), trace, trace.groupBy("series").agg(F.max("statistic").alias("greatest")), path)
    return spark.read.parquet(f"{path}/trace").groupBy("series").agg(F.count("*").alias("looks"))


def t_long(spark, sf_dir) -> DataFrame:
    """Estimates of customers' mean order value: three estimators with flags, per order priority and customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.groupBy(F.col("o_orderpriority").alias("scenario"), F.col("o_custkey").alias("replicate")).agg(
        F.avg("o_totalprice").alias("_a"), F.min("o_totalprice").alias("_b"), F.max("o_totalprice").alias("_c"), F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("_f")
    )
    k = F.col("replicate")
    out = rows.withColumn("truth", F.lit(100000.0)).withColumn("alarm", k % 7 != 0)
    for p, (c, m) in {"x_": ("_a", 5), "y_": ("_b", 11), "z_": ("_c", 13)}.items():
        valid = (k % m != 0) & F.col("alarm")
        out = out.withColumn(f"{p}v_estimate", F.when(valid, F.col(c))).withColumn(f"{p}v_lower", F.when(valid & (F.col("n") > 1), F.col(c) * 0.8)).withColumn(f"{p}v_upper", F.when(valid & (F.col("n") > 1), F.col(c) * 1.2))
        out = out.withColumn(f"{p}v_point_valid", valid).withColumn(f"{p}v_interval_valid", valid & (F.col("n") > 1))
    return out.drop("_a", "_b", "_c", "_f")


def _valid(m):
    return f"(replicate % {m} <> 0 AND replicate % 7 <> 0)"


EST = f"""o AS (SELECT o_orderpriority AS scenario, o_custkey AS replicate, avg(o_totalprice) AS a, min(o_totalprice) AS b, max(o_totalprice) AS c, count(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT scenario, replicate, n, 100000.0::DOUBLE AS truth, replicate % 7 <> 0 AS alarm, CASE WHEN {_valid(5)} THEN a END AS x, CASE WHEN {_valid(11)} THEN b END AS y, CASE WHEN {_valid(13)} THEN c END AS z FROM o),
g AS (SELECT scenario, replicate, n, truth, alarm, 'x' AS method, x AS e FROM t UNION ALL SELECT scenario, replicate, n, truth, alarm, 'y', y FROM t UNION ALL SELECT scenario, replicate, n, truth, alarm, 'z', z FROM t)"""
PREFIXES = {"x": "x_", "y": "y_", "z": "z_"}


def _long(spark, sf_dir):
    return estimation.to_long(t_long(spark, sf_dir), ["scenario", "replicate", "truth", "alarm"], PREFIXES, ["v"])


def t1(spark, sf_dir):
    return _long(spark, sf_dir).select("scenario", "replicate", "method", r("estimate", 4), "point_valid", "interval_valid")


def t2(spark, sf_dir):
    out = estimation.estimation_summary(_long(spark, sf_dir), ["scenario", "method"])
    return out.select("scenario", "method", "episodes", "alarms", "points", "intervals", *(r(c, 4) for c in ("bias", "rmse", "relative_bias", "relative_rmse", "coverage", "valid_coverage", "width_median", "width_max")))


T2_SQL = f"""WITH {EST} SELECT scenario, method, count(*) AS episodes, count(*) FILTER (alarm) AS alarms, count(e) AS points, count(e) FILTER (n > 1) AS intervals, round(avg(e - truth), 4) AS bias, round(sqrt(avg((e - truth) ** 2)), 4) AS rmse,
round(avg(e / truth - 1), 4) AS relative_bias, round(sqrt(avg((e / truth - 1) ** 2)), 4) AS relative_rmse, round(count(*) FILTER (n > 1 AND e * 0.8 <= truth AND truth <= e * 1.2) / count(*) FILTER (alarm), 4) AS coverage,
round(count(*) FILTER (n > 1 AND e * 0.8 <= truth AND truth <= e * 1.2) / count(e) FILTER (n > 1), 4) AS valid_coverage, round(quantile_cont(e * 1.2 - e * 0.8, 0.5) FILTER (n > 1), 4) AS width_median, round(max(e * 1.2 - e * 0.8) FILTER (n > 1), 4) AS width_max FROM g GROUP BY ALL"""


def t3(spark, sf_dir):
    rows = t_long(spark, sf_dir).withColumn("tau_hat_at_alarm", F.col("replicate") % 40).withColumn("true_change", F.lit(20))
    return estimation.location_summary(rows, ["scenario"]).select("scenario", "alarms", r("mae"), r("bias"))


def t4(spark, sf_dir):
    out = estimation.reference_comparison(t_long(spark, sf_dir), ["scenario"], "v", "x_", "y_", "truth")
    return out.select("scenario", "n_a", "n_b", "n_common", *(r(c) for c in ("rmse_a", "rmse_b", "difference", "mcse")))


T4_SQL = f"""WITH {EST}, s AS (SELECT scenario, (x / truth - 1) ** 2 AS a, (y / truth - 1) ** 2 AS b FROM t)
SELECT scenario, count(a) AS n_a, count(b) AS n_b, count(a - b) AS n_common, round(sqrt(avg(a)), 6) AS rmse_a, round(sqrt(avg(b)), 6) AS rmse_b, round(avg(a - b), 6) AS difference, round(stddev_samp(a - b) / sqrt(count(a - b)), 6) AS mcse FROM s GROUP BY scenario"""


def t5(spark, sf_dir):
    return estimation.common_cohort(t_long(spark, sf_dir), ["scenario"], "v", PREFIXES, "truth").select("scenario", "method", "n", r("rmse"), r("bias"))


T5_SQL = f"""WITH {EST}, s AS (SELECT scenario, method, e / truth - 1 AS d FROM g JOIN (SELECT scenario, replicate FROM t WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL) USING (scenario, replicate))
SELECT scenario, method, count(*) AS n, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(d), 6) AS bias FROM s GROUP BY ALL"""


def t6(spark, sf_dir):
    rows = t_long(spark, sf_dir).withColumn("bank", F.when(F.col("replicate") % 2 == 0, "even").otherwise("odd"))
    cells = estimation.common_cohort(rows, ["bank", "scenario"], "v", PREFIXES, "truth", ["x", "y"]).withColumnRenamed("scenario", "cell")
    return estimation.equal_cell_aggregate(cells, ["bank"], 5).select("bank", "method", "cells", r("rmse"), "wins", "ties")


T6_SQL = f"""WITH {EST}, s AS (SELECT CASE WHEN replicate % 2 = 0 THEN 'even' ELSE 'odd' END AS bank, scenario, method, sqrt(avg((e / truth - 1) ** 2)) AS rmse FROM g JOIN (SELECT scenario, replicate FROM t WHERE x IS NOT NULL AND y IS NOT NULL) USING (scenario, replicate) GROUP BY ALL),
w AS (SELECT *, abs(rmse - min(rmse) OVER (PARTITION BY bank, scenario)) <= 1e-12 AS best FROM s), u AS (SELECT *, sum(best::INT) OVER (PARTITION BY bank, scenario) AS k FROM w)
SELECT bank, method, count(rmse) AS cells, CASE WHEN count(rmse) = 5 THEN round(sqrt(avg(rmse * rmse)), 6) END AS rmse, count(*) FILTER (best AND k = 1) AS wins, count(*) FILTER (best AND k > 1) AS ties FROM u GROUP BY ALL"""


def t7(spark, sf_dir):
    rows = t_long(spark, sf_dir)
    return estimation.common_cohort(rows, ["scenario"], "v", PREFIXES, "truth", ["x", "z"]).select("scenario", "method", "n", r("rmse"), r("bias"))


T7_SQL = T5_SQL.replace("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL", "x IS NOT NULL AND z IS NOT NULL").replace("SELECT scenario, method, count(*) AS n", "SELECT scenario, method, count(d) AS n")


def t8(spark, sf_dir):
    rows = _long(spark, sf_dir)
    return estimation.stability_validation(rows, ["method"], "scenario").select("method", r("mse"), r("rmse"), r("mse_se", 8))


T8_SQL = f"""WITH {EST}, s AS (SELECT *, (e / truth - 1) ** 2 AS q FROM g), c AS (SELECT method, scenario, avg(q) AS mq, count(*) AS n, count(q) AS good FROM s GROUP BY ALL), k AS (SELECT method, count(*) AS cells, avg(mq) AS mse FROM c GROUP BY ALL),
i AS (SELECT s.method, s.replicate, sum(coalesce(c.n / c.good * (q - mq) / cells, 0)) AS v FROM s JOIN c USING (method, scenario) JOIN k USING (method) GROUP BY ALL)
SELECT k.method, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(se, 8) AS mse_se FROM k JOIN (SELECT method, stddev_samp(v) / sqrt(count(*)) AS se FROM i GROUP BY ALL) USING (method)"""


def _rooted(spark, sf_dir):
    rows = _long(spark, sf_dir).select("scenario", "replicate", F.col("method").alias("cell"), "alarm", F.lit("risk_ratio").alias("target"), F.col("estimate"), "truth", F.lit(0.25).alias("se"))
    return estimation.transform_roots(rows)


ROOT = f"{EST}, q AS (SELECT scenario, replicate, method, alarm, truth, ln(e) AS center, (ln(e) - ln(truth)) / 0.25 AS root FROM g)"


def t9(spark, sf_dir):
    return _rooted(spark, sf_dir).select("scenario", "replicate", F.col("cell").alias("method"), r("center"), r("root"), "available")


def _cutoffs(spark, sf_dir):
    return estimation.calibrate_cutoffs(_rooted(spark, sf_dir).where("replicate % 2 = 0"), 0.6)


def t10(spark, sf_dir):
    return _cutoffs(spark, sf_dir).select("target", r("lower"), r("upper"), "infeasible")


_T10 = """rt AS (SELECT method AS cell, root FROM q WHERE replicate % 2 = 0 AND alarm AND root IS NOT NULL), al AS (SELECT method AS cell, CAST(ceil(count(*) * 0.6::DOUBLE) AS BIGINT) AS m FROM q WHERE replicate % 2 = 0 AND alarm GROUP BY ALL),
cl AS (SELECT cell, any_value(m) AS m, list_sort(list(root)) AS rs FROM rt JOIN al USING (cell) GROUP BY ALL), cd AS (SELECT DISTINCT root AS lo FROM rt),
en AS (SELECT lo, rs[len(list_filter(rs, lambda x: x < lo)) + m] AS hi FROM cd, cl), sp AS (SELECT lo, max(hi) AS hi FROM en GROUP BY lo HAVING count(*) = count(hi)),
ct AS (SELECT arg_min(lo, (hi - lo, lo)) AS lower, arg_min(hi, (hi - lo, lo)) AS upper FROM sp)"""


def t11(spark, sf_dir):
    out = estimation.apply_cutoffs(_rooted(spark, sf_dir), _cutoffs(spark, sf_dir))
    return out.select("scenario", "replicate", F.col("cell").alias("method"), r("lower", 3), r("upper", 3), "interval_valid")


def t12(spark, sf_dir):
    rows = estimation.apply_cutoffs(_rooted(spark, sf_dir), _cutoffs(spark, sf_dir)).withColumn("plain_lower", F.col("estimate") * 0.6).withColumn("plain_upper", F.col("estimate") * 1.6)
    out = estimation.interval_report(rows, ["cell"], {"plain": ("plain_lower", "plain_upper"), "calibrated": ("lower", "upper")})
    return out.select("cell", "rule", "alarms", "available", "infinite", "covered", r("coverage"), r("width_mean", 3), r("width_median", 3))


T12_SQL = f"""WITH {ROOT}, {_T10}, u AS (SELECT method AS cell, 'plain' AS rule, exp(center) * 0.6 AS lo, exp(center) * 1.6 AS hi, truth FROM q WHERE alarm UNION ALL SELECT method, 'calibrated', exp(center - upper * 0.25), exp(center - lower * 0.25), truth FROM q, ct WHERE alarm)
SELECT cell, rule, count(*) AS alarms, count(lo) AS available, 0::BIGINT AS infinite, count(*) FILTER (lo <= truth AND truth <= hi) AS covered, round(count(*) FILTER (lo <= truth AND truth <= hi) / count(*), 6) AS coverage, round(avg(hi - lo), 3) AS width_mean, round(quantile_cont(hi - lo, 0.5), 3) AS width_median FROM u GROUP BY ALL"""


def k10(spark, sf_dir):
    """Stored interval ends that do not replay from centers and standard errors; every 41st customer's were changed."""
    made = estimation.apply_cutoffs(_rooted(spark, sf_dir), _cutoffs(spark, sf_dir)).withColumnRenamed("cell", "method")
    stored = made.withColumn("lower", F.when(F.col("replicate") % 41 == 0, F.col("lower") * 1.01).otherwise(F.col("lower")))
    return checks.check_frozen_columns(stored, made, ["scenario", "replicate", "method"], ["lower", "upper", "interval_valid"], rtol=1e-9)


def z1(spark, sf_dir):
    """The day counts of events as a stream of files, monitored online to the end; equal to the batch monitor's first looks."""
    counts = events_daily(spark, sf_dir).select("series", "t", "cases", "deaths")
    source, out, state = (shared_path(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    counts.where("t < 15").repartition("series").write.parquet(source)
    counts.where("t >= 15").repartition("series").write.mode("append").parquet(source)
    stream = spark.readStream.schema(counts.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = online.online_monitor(stream, K, ONLINE).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select("series", "look", "prefix", "statistic", "boundary", "tau_hat", "crossed", "status")


def z2(spark, sf_dir):
    """Events as a stream, counted by day once the watermark has passed it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 10).alias("series"), "ts", "event_type")
    source, out, state = (shared_path(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    counts = online.online_counts(stream, K, "ts", F.col("event_type").isin("view", "click"), F.col("event_type") == "error")
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("series long, date date, cases double, deaths double").parquet(out).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


Z2_SQL = """WITH l AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT user_id % 10 AS series, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, (count(*) FILTER (event_type IN ('view', 'click')))::DOUBLE AS cases, (count(*) FILTER (event_type = 'error'))::DOUBLE AS deaths
FROM events, l GROUP BY user_id % 10, CAST(ts AS DATE), mark HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= mark"""


def z3(spark, sf_dir):
    rows = _residuals(spark, sf_dir).where("t >= 52").select("series", "t", "v")
    source, out, state = (shared_path(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    rows.where("t < 200").repartition("series").write.parquet(source)
    rows.where("t >= 200").repartition("series").write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    online.online_page_cusum(stream, K).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("series", "t", r("statistic"), "start", "direction")


def _streamed(spark, rows: DataFrame, cut: int) -> DataFrame:
    """rows as a stream of files, those before day `cut` first, a file a batch."""
    source = shared_path(spark, "stream-in")
    rows.where(F.col("t") < cut).repartition("series").write.parquet(source)
    rows.where(F.col("t") >= cut).repartition("series").write.mode("append").parquet(source)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)


def z4(spark, sf_dir):
    """Weekly orders whose deaths rise by half from week 80 on, monitored as a stream: the first alarm of each series."""
    rows = weekly(spark, sf_dir).withColumn("deaths", F.when(F.col("t") >= 80, F.rint(F.col("deaths") * 1.5)).otherwise(F.col("deaths")))
    stream = _streamed(spark, rows.select("series", "t", "cases", "deaths"), 150)
    table = online.AlarmTable(spark, shared_path(spark, "alarms"), K, "series string", every=2)
    online.online_alarm_table(online.online_monitor(stream, K, WEEKS), table, shared_path(spark, "stream-state")).awaitTermination()
    return table.read()


def z5(spark, sf_dir):
    """Mean change of the weekly residuals as a stream, day by day."""
    stream = _streamed(spark, _residuals(spark, sf_dir).where("t >= 52").select("series", "t", "v"), 200)
    out = shared_path(spark, "stream-out")
    online.online_focus(stream, K).writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "stream-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("series", "t", r("statistic"), "direction")


Z5_SQL = f"""WITH {RESIDUALS}, fo AS (SELECT b.series, b.t, sum(a.v) OVER (PARTITION BY b.series, b.t ORDER BY a.t DESC) AS s, b.t - a.t + 1 AS n FROM rs a JOIN rs b ON b.series = a.series AND a.t BETWEEN 52 AND b.t)
SELECT series, t, round(max(s * s / n), 6) AS statistic, CAST(sign(arg_max(s, s * s / n)) AS INTEGER) AS direction FROM fo GROUP BY series, t"""


def _scoring_sql(variance: str, precision: float) -> str:
    """CTEs up to fitted(series, a, b, y, l, r): 60 Fisher scoring steps from the common risk, on lists of the design's days."""
    total = lambda e: f"list_sum(list_transform(range(1, len(y) + 1), lambda i: {e}))"
    mu, v = "(l * a[i] + r * b[i])", f"({variance.format(mu='(l * a[i] + r * b[i])')})"
    residual = f"(y[i] - {mu}) / {v}"
    return f"""ar AS (SELECT series, list(a ORDER BY t) AS a, list(b ORDER BY t) AS b, list(deaths ORDER BY t) AS y FROM dg GROUP BY series),
fs(series, a, b, y, l, r, step) AS (SELECT series, a, b, y, list_sum(y) / (list_sum(a) + list_sum(b)), list_sum(y) / (list_sum(a) + list_sum(b)), 0 FROM ar
  UNION ALL SELECT series, a, b, y, l + (i22 * g1 - i12 * g2) / (i11 * i22 - i12 * i12), r + (i11 * g2 - i12 * g1) / (i11 * i22 - i12 * i12), step + 1 FROM (
    SELECT *, {total(f"a[i] * {residual}")} + {precision} * ln(r / l) / l AS g1, {total(f"b[i] * {residual}")} - {precision} * ln(r / l) / r AS g2,
      {total(f"a[i] * a[i] / {v}")} + {precision} / (l * l) AS i11, {total(f"a[i] * b[i] / {v}")} - {precision} / (l * r) AS i12, {total(f"b[i] * b[i] / {v}")} + {precision} / (r * r) AS i22 FROM fs WHERE step < 60)),
fitted AS (SELECT * FROM fs WHERE step = 60)"""


def _nb_sql(two: bool, precision: float, rows: str = "dg", steps: int = 120) -> str:
    """CTEs up to fitted(series, y, l, r, s, value, limit): the NB maximum in the risks and s = log phi. Each step is a scoring
    step of the risks and a Newton step of s by differences of the log likelihood, one unit of s at most."""
    total = lambda e: f"list_sum(list_transform(range(1, len(y) + 1), lambda i: {e}))"
    mu = "(l * a[i] + r * b[i])" if two else "(l * a[i])"
    log1 = lambda z: f"(CASE WHEN {z} < 1e-4 THEN {z} - {z} * {z} / 2 + pow({z}, 3) / 3 ELSE ln(1 + {z}) END)"

    def value(s: str) -> str:
        steps_up = f"coalesce(list_sum(list_transform(range(0, CAST(y[i] AS BIGINT)), lambda k: {log1(f'(k / exp({s}))')})), 0)"
        return total(f"{steps_up} + y[i] * ln({mu}) - (y[i] + exp({s})) * {log1(f'({mu} / exp({s}))')} - lgamma(y[i] + 1)")

    v = f"({mu} + {mu} * {mu} / exp(s))"
    residual = f"(y[i] - {mu}) / {v}"
    pen = lambda k: k if precision else "0"
    start = "list_sum(y) / (list_sum(a) + list_sum(b))"
    risks = "l + (i22 * g1 - i12 * g2) / (i11 * i22 - i12 * i12), r + (i11 * g2 - i12 * g1) / (i11 * i22 - i12 * i12)" if two else "l + g1 / i11, r"
    push = f"- {precision} / 2 * ln(r / l) ** 2" if precision else ""
    return f"""ar AS (SELECT series, list(a ORDER BY t) AS a, list(b ORDER BY t) AS b, list(deaths ORDER BY t) AS y FROM {rows} GROUP BY series),
fs(series, a, b, y, l, r, s, step) AS (SELECT series, a, b, y, {start}, {start}, 2.0::DOUBLE, 0 FROM ar
  UNION ALL SELECT series, a, b, y, {risks}, least(18.4::DOUBLE, greatest(-6.0::DOUBLE, s + CASE WHEN up + down - 2 * mid < 0 THEN greatest(-1, least(1, -0.5 * 1e-3::DOUBLE * (up - down) / (up + down - 2 * mid))) ELSE sign(up - down) END)), step + 1 FROM (
    SELECT *, {value("s")} AS mid, {value("(s + 1e-3::DOUBLE)")} AS up, {value("(s - 1e-3::DOUBLE)")} AS down,
      {total(f"a[i] * {residual}")} + {pen(f"{precision} * ln(r / l) / l")} AS g1, {total(f"b[i] * {residual}")} - {pen(f"{precision} * ln(r / l) / r")} AS g2,
      {total(f"a[i] * a[i] / {v}")} + {pen(f"{precision} / (l * l)")} AS i11, {total(f"a[i] * b[i] / {v}")} - {pen(f"{precision} / (l * r)")} AS i12, {total(f"b[i] * b[i] / {v}")} + {pen(f"{precision} / (r * r)")} AS i22 FROM fs WHERE step < {steps})),
fitted AS (SELECT *, {value("s")} {push} AS value, {total(f"y[i] * ln({mu}) - {mu} - lgamma(y[i] + 1)")} {push} AS limit_value FROM fs WHERE step = {steps})"""


_NB_OUT = "CASE WHEN limit_value < value - 5e-8 * len(y) THEN round(s, 3) END AS log_phi, limit_value >= value - 5e-8 * len(y) AS poisson, round(greatest(value, limit_value), 4) AS loglik, true AS success, 'success' AS status FROM fitted"
_ROWS1 = "e1 AS (SELECT series, t, x AS a, 0.0::DOUBLE AS b, deaths FROM x WHERE x > 1e-12 AND t >= {start})"
F1_SQL = f"WITH RECURSIVE {EXPOSED}, {_ROWS1.format(start=0)}, {_nb_sql(False, 0.0, 'e1')} SELECT series, round(l, 6) AS pi, {_NB_OUT}"
F1_DAYS_SQL = f"""WITH RECURSIVE {EXPOSED}, {_ROWS1.format(start=10)}, {_nb_sql(False, 0.0, 'e1')}
SELECT x.series, x.t, round(greatest(l * x, 1e-12), 4) AS mean, CASE WHEN limit_value < value - 5e-8 * len(y) AND l * x > 1e-3 THEN round(exp(-s), 4) END AS excess FROM x JOIN fitted USING (series)"""
F3_SQL = f"WITH RECURSIVE {DESIGN}, {_nb_sql(True, 0.0)} SELECT series, round(l, 6) AS left, round(r, 6) AS right, {_NB_OUT}"
F5_SQL = f"WITH RECURSIVE {DESIGN}, {_nb_sql(True, 1.0)} SELECT series, round(l, 6) AS left, round(r, 6) AS right, {_NB_OUT}"

_SUM = "list_sum(list_transform(range(1, len(y) + 1), lambda i: {e}))"
F4_SQL = f"""WITH RECURSIVE {DESIGN}, {_scoring_sql("{mu} + {mu} * {mu} / 25", 0.0)} SELECT series, round(l, 6) AS left, round(r, 6) AS right, 25.0::DOUBLE AS phi,
round({_SUM.format(e="lgamma(y[i] + 25) - lgamma(25) - lgamma(y[i] + 1) + 25 * ln(25 / (25 + l * a[i] + r * b[i])) + y[i] * ln((l * a[i] + r * b[i]) / (25 + l * a[i] + r * b[i]))")}, 4) AS loglik, true AS success, 'success' AS status FROM fitted"""
F6_SQL = f"""WITH RECURSIVE {DESIGN}, {_scoring_sql("{mu}", 1.0)} SELECT series, round(l, 6) AS left, round(r, 6) AS right,
round({_SUM.format(e="y[i] * ln(l * a[i] + r * b[i]) - (l * a[i] + r * b[i]) - lgamma(y[i] + 1)")} - 0.5 * ln(r / l) ** 2, 4) AS loglik, true AS success, 'success' AS status FROM fitted"""

A6_SQL = """WITH n AS (SELECT user_id % 10 AS series, max(CAST(ts AS DATE)) - min(CAST(ts AS DATE)) + 1 AS n FROM events GROUP BY ALL)
SELECT series, count(*) AS looks FROM n JOIN (SELECT unnest([10, 17, 24, 30]) AS p) ON p <= n GROUP BY series"""


def _spending_sql(looks: int, alpha: float) -> str:
    """A CTE per look: the boundary is the value at its rank among the paths still left, which are those below all boundaries so far."""
    out = f"""WITH mx AS (SELECT event_type AS series, event_id % 399 AS path, {", ".join(f"coalesce(max(value) FILTER (day(ts) % 4 + 1 = {j}), 0) AS v{j}" for j in range(1, looks + 1))} FROM events GROUP BY ALL),
s0 AS (SELECT *, true AS left_0, false AS over_0, count(*) OVER (PARTITION BY series) AS n FROM mx)"""
    rows = []
    for j in range(1, looks + 1):
        spent = f"({alpha}::DOUBLE * {j} / {looks})"
        rank = f"CAST(ceil((1 - {spent}) * (n + 1)) AS INTEGER)"
        out += f""",
b{j} AS (SELECT series, n, count(*) FILTER (left_{j - 1}) AS before, list_sort(list(v{j}) FILTER (left_{j - 1}))[{rank}] AS cut FROM s{j - 1} GROUP BY series, n),
s{j} AS (SELECT s.*, cut AS cut_{j}, before AS before_{j}, left_{j - 1} AND (cut IS NULL OR v{j} < cut) AS left_{j}, over_{j - 1} OR coalesce(v{j} > cut, false) AS over_{j} FROM s{j - 1} s JOIN b{j} USING (series, n))"""
        ties = " + ".join(f"count(*) FILTER (left_{i - 1} AND v{i} = cut_{i})" for i in range(1, j + 1))
        rows.append(f"""SELECT series, {j} AS look, round({spent}, 6) AS cumulative_alpha, {rank} AS rank, first(cut_{j}) AS boundary, first(cut_{j}) IS NOT NULL AS resolved, CAST(first(before_{j}) AS INTEGER) AS eligible_before,
  CAST(count(*) FILTER (left_{j}) AS INTEGER) AS eligible_after, CAST(count(*) FILTER (left_{j - 1} AND NOT left_{j}) AS INTEGER) AS discarded, CAST(count(*) FILTER (left_{j - 1} AND v{j} = cut_{j}) AS INTEGER) AS support_discarded,
  CAST({ties} AS INTEGER) AS support_discarded_total, CAST(count(*) FILTER (over_{j} AND NOT over_{j - 1}) AS INTEGER) AS crossed, CAST(count(*) FILTER (over_{j}) AS INTEGER) AS crossed_total, round(count(*) FILTER (over_{j}) / n, 6) AS crossing_fraction FROM s{looks} GROUP BY series, n""")
    return out + "\n" + " UNION ALL ".join(rows)


QUERIES = {
    "a1_case_feed": a1, "a1_feed_stream": a1_stream, "a2_chart_series": a2, "a2_malformed_charts": a2_malformed, "a3_a5_episode_files": a3, "a6_monitoring_files": a6, "f1_fit_null": f1, "f1_null_days": f1_days, "f3_fit_two_rate": f3, "f4_fixed_phi": f4, "f5_stabilized": f5, "f6_poisson_fit": f6,
    "f7_ls_fit": f7, "f8_two_stage_moments": f8, "f9_wald_intervals": f9, "f10_stabilized_intervals": f10, "f11_nb_loglik": f11, "f12_moment_phi": f12, "h4_profile_scale_glr": h4, "f13_nb_residuals": f13_nb, "h5_nb_chart_traces": h5_nb,
    "c1_multiplier_bank": c1, "c2_multiplier_maxima": c2, "c2_given_paths": c2_given, "c6_path_blocks": c6_blocks, "c4_fixed_look_test": c4, "c5_bonferroni": c5, "c6_c8_spending_boundary": c6, "m1_monitor": m1, "m4_post_alarm_estimates": m4, "m5_monitor_many": m5,
    "e1_evaluate_episodes": e1, "e1_chart_methods": e1_methods, "t1_to_long": t1, "t2_estimation_summary": t2, "t3_location_summary": t3, "t4_reference_comparison": t4, "t5_three_way": t5, "t6_equal_cell": t6, "t7_main_pair": t7,
    "t8_stability": t8, "t9_transform_roots": t9, "t10_calibrate_cutoffs": t10, "t11_apply_cutoffs": t11, "t12_interval_report": t12, "k10_interval_replay": k10,
    "z1_online_monitor": z1, "z2_online_counts": z2, "z3_online_cusum": z3, "z4_online_alarms": z4, "z5_online_focus": z5,
}

from riskloom.plans.episodes import MAXIMA  # noqa: E402
from riskloom.plans.series import H1_SQL, H5_SQL, SCANNED  # noqa: E402

E1_METHODS_SQL = (
    H1_SQL.split("SELECT series, t, round(greatest")[0].rstrip() + "," + H5_SQL.split("AS v FROM x JOIN rp USING (series)),")[1].split("SELECT series, look, prefix, round(max(lr)")[0]
    + """SELECT series, 'glr' AS method, CAST(look AS INTEGER) AS look, CAST(prefix AS INTEGER) AS prefix, round(max(lr), 6) AS statistic, CAST(sign(arg_max(y - m, lr)) AS INTEGER) AS direction, 'available' AS status FROM gl GROUP BY series, look, prefix
UNION ALL SELECT cu.series, 'page_cusum', CAST(look AS INTEGER), CAST(prefix AS INTEGER), round(greatest(su, sl), 6), CAST(CASE WHEN su <= 0 AND sl <= 0 THEN 0 WHEN su >= sl THEN 1 ELSE -1 END AS INTEGER), 'available' FROM cu JOIN lk ON lk.series = cu.series AND cu.t = prefix - 1"""
)

C2_GIVEN_SQL = f"""WITH {SCANNED}, inf AS (SELECT d.series, d.tau, d.t, (b - x * proj) / sqrt(mean) / sqrt(j) AS g FROM dense d JOIN pr USING (series, tau) JOIN gj USING (series, tau) JOIN sc USING (series, tau)),
pv AS (SELECT series, tau, path, sum(g * (((7919 * path + 104729 * t) % 2003) / 1001 - 1)) AS v FROM inf, (SELECT unnest(range({GIVEN})) AS path) GROUP BY ALL)
SELECT series, CAST(path AS INTEGER) AS path, round(max(v * v), 6) AS value FROM pv GROUP BY series, path"""

ORACLE_SQL = {
    "c2_given_paths": C2_GIVEN_SQL,
    "a6_monitoring_files": A6_SQL, "e1_chart_methods": E1_METHODS_SQL, "c6_c8_spending_boundary": _spending_sql(4, 0.2), "f1_fit_null": F1_SQL, "f1_null_days": F1_DAYS_SQL, "f3_fit_two_rate": F3_SQL, "f5_stabilized": F5_SQL, "f4_fixed_phi": F4_SQL, "f6_poisson_fit": F6_SQL,
    "a1_case_feed": A1_SQL, "a1_feed_stream": A1_SQL, "a2_chart_series": A2_SQL, "a2_malformed_charts": A2_MALFORMED_SQL,
    "a3_a5_episode_files": f"WITH {MAXIMA} SELECT scenario, method, replicate, episode_statistic FROM mx",
    "f7_ls_fit": f"WITH {DESIGN} SELECT series, round(l, 9) AS left, round(r, 9) AS right, round(yy - 2 * (l * ay + r * bb_y) + l * l * aa + 2 * l * r * ab + r * r * bb, 4) AS rss, 'none' AS active_set, 'success' AS status FROM ls",
    "f8_two_stage_moments": f"""WITH {DESIGN}, s AS (SELECT series, sum(deaths) FILTER (t < {TAU}) / sum(x) FILTER (t < {TAU}) AS l, sum(deaths) FILTER (t >= {TAU}) AS y1, sum(x - b) FILTER (t >= {TAU}) AS m1, sum(b) FILTER (t >= {TAU}) AS b1 FROM dg GROUP BY series)
SELECT series, round(l, 9) AS left, round((y1 - l * m1) / b1, 9) AS right, round((y1 - l * m1) / b1 / l, 9) AS ratio, 'success' AS status, true AS point_valid, l BETWEEN 0 AND 1 AND (y1 - l * m1) / b1 BETWEEN 0 AND 1 AS admissible FROM s""",
    "f9_wald_intervals": F9_SQL, "f10_stabilized_intervals": F10_SQL, "f11_nb_loglik": F11_SQL,
    "f12_moment_phi": f"WITH {FITTED}, s AS (SELECT series, sum(mean * mean) AS a, sum(greatest((deaths - mean) ** 2 - mean, 0)) AS b FROM m WHERE active GROUP BY series) SELECT series, round(CASE WHEN b > 0 THEN least(greatest(a / b, 0.1), 1e6) ELSE 1e6 END, 6) AS phi FROM s",
    "c5_bonferroni": f"WITH {SCANNED} SELECT series, round(max(q), 6) AS statistic, {boundary.bonferroni_boundary(345, 0.05, 7)[2]} AS tests, max(q) > {boundary.bonferroni_boundary(345, 0.05, 7)[0]!r} AS crossed FROM sc GROUP BY series",
    "t1_to_long": f"WITH {EST} SELECT scenario, replicate, method, round(e, 4) AS estimate, e IS NOT NULL AS point_valid, e IS NOT NULL AND n > 1 AS interval_valid FROM g",
    "t2_estimation_summary": T2_SQL,
    "t3_location_summary": f"WITH {EST} SELECT scenario, count(*) FILTER (alarm) AS alarms, round(avg(abs(replicate % 40 - 20)) FILTER (alarm), 6) AS mae, round(avg(replicate % 40 - 20) FILTER (alarm), 6) AS bias FROM t GROUP BY scenario",
    "t4_reference_comparison": T4_SQL, "t5_three_way": T5_SQL, "t6_equal_cell": T6_SQL, "t7_main_pair": T7_SQL, "t8_stability": T8_SQL,
    "t9_transform_roots": f"WITH {ROOT} SELECT scenario, replicate, method, round(center, 6) AS center, round(root, 6) AS root, center IS NOT NULL AS available FROM q",
    "t10_calibrate_cutoffs": f"WITH {ROOT}, {_T10} SELECT 'risk_ratio' AS target, round(lower, 6) AS lower, round(upper, 6) AS upper, false AS infeasible FROM ct",
    "t11_apply_cutoffs": f"WITH {ROOT}, {_T10} SELECT scenario, replicate, method, round(exp(center - upper * 0.25), 3) AS lower, round(exp(center - lower * 0.25), 3) AS upper, center IS NOT NULL AS interval_valid FROM q, ct",
    "t12_interval_report": T12_SQL,
    "k10_interval_replay": f"WITH {EST} SELECT scenario, replicate, method, 'lower' AS column FROM g WHERE replicate % 41 = 0 AND e IS NOT NULL",
    "z2_online_counts": Z2_SQL, "z3_online_cusum": H1_SQL, "z5_online_focus": Z5_SQL,
}
