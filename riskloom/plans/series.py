"""Registered queries on series: weekly orders per priority, daily line items per flag, and their SQL.

weekly: series = o_orderpriority, cases = orders of a week, deaths = those of status F.
daily: series = l_returnflag and l_linestatus, cases = lines shipped on a day, deaths = those of 45 units or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import charts, exposure, prepare, scan

LAW = [0.4, 0.3, 0.2, 0.1]
REFERENCE_END = 52


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("series"), "o_orderdate", "o_orderstatus")
    return prepare.daily_counts(orders, ["series"], "o_orderdate", F.lit(True), F.col("o_orderstatus") == "F", "week")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("series"), "l_shipdate", "l_quantity")
    return prepare.daily_counts(lines, ["series"], "l_shipdate", F.lit(True), F.col("l_quantity") >= 45, "day")


WEEKLY = """
o AS (SELECT o_orderpriority AS series, CAST(date_trunc('week', o_orderdate) AS DATE) AS d, o_orderstatus FROM orders),
e AS (SELECT series, min(d) AS lo, max(d) AS hi FROM o GROUP BY series),
sp AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS date FROM e),
c AS (SELECT series, d, count(*) AS cases, count(*) FILTER (o_orderstatus = 'F') AS deaths FROM o GROUP BY series, d),
w AS (SELECT sp.series, CAST(row_number() OVER (PARTITION BY sp.series ORDER BY date) - 1 AS BIGINT) AS t, date,
  CAST(coalesce(cases, 0) AS DOUBLE) AS cases, CAST(coalesce(deaths, 0) AS DOUBLE) AS deaths
  FROM sp LEFT JOIN c ON c.series = sp.series AND c.d = sp.date)"""

DAILY = """
o AS (SELECT l_returnflag || l_linestatus AS series, CAST(l_shipdate AS DATE) AS d, l_quantity FROM lineitem),
e AS (SELECT series, min(d) AS lo, max(d) AS hi FROM o GROUP BY series),
sp AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM e),
c AS (SELECT series, d, count(*) AS cases, count(*) FILTER (l_quantity >= 45) AS deaths FROM o GROUP BY series, d),
w AS (SELECT sp.series, CAST(row_number() OVER (PARTITION BY sp.series ORDER BY date) - 1 AS BIGINT) AS t, date,
  CAST(coalesce(cases, 0) AS DOUBLE) AS cases, CAST(coalesce(deaths, 0) AS DOUBLE) AS deaths
  FROM sp LEFT JOIN c ON c.series = sp.series AND c.d = sp.date)"""

_LAW_SQL = "f(lag, p) AS (VALUES " + ", ".join(f"({i + 1}, {p}::DOUBLE)" for i, p in enumerate(LAW)) + ")"
EXPOSED = f"""{WEEKLY}, {_LAW_SQL},
x AS (SELECT a.series, a.t, a.date, a.cases, a.deaths, sum(coalesce(b.cases * f.p, 0)) AS x FROM w a CROSS JOIN f
  LEFT JOIN w b ON b.series = a.series AND b.t = a.t - f.lag GROUP BY ALL)"""
FITTED = f"""{EXPOSED},
pi AS (SELECT series, sum(deaths) / sum(x) AS pi FROM x WHERE x > 1e-12 GROUP BY series),
m AS (SELECT x.*, pi, greatest(pi * x, 1e-12) AS mean, x > 1e-12 AS active FROM x JOIN pi USING (series))"""
SCANNED = f"""{FITTED},
taus AS (SELECT series, t AS tau FROM w WHERE t >= 1),
contrib AS (SELECT b.series, b.t AS u, b.t + f.lag AS s, b.cases * f.p AS v FROM w b CROSS JOIN f),
bb AS (SELECT taus.series, tau, s, sum(v) AS b FROM taus JOIN contrib ON contrib.series = taus.series AND u >= tau GROUP BY ALL),
dense AS (SELECT m.series, taus.tau, m.t, m.x, m.deaths, m.mean, coalesce(bb.b, 0) AS b FROM m JOIN taus ON taus.series = m.series
  LEFT JOIN bb ON bb.series = m.series AND bb.tau = taus.tau AND bb.s = m.t WHERE m.active),
pr AS (SELECT series, tau, sum(b * x / mean) / sum(x * x / mean) AS proj, count(*) AS n_active FROM dense GROUP BY ALL),
gj AS (SELECT d.series, d.tau, n_active, sum((b - x * proj) ** 2 / mean) AS j, max((b - x * proj) ** 2 / mean) AS top, sum((b - x * proj) * (deaths - mean) / mean) AS u
  FROM dense d JOIN pr USING (series, tau) GROUP BY ALL),
sc AS (SELECT series, tau, u / sqrt(j) AS z, u * u / j AS q, j AS information, top / j AS max_leverage FROM gj
  WHERE j > 1e-12 * greatest(1, (SELECT max(j) FROM gj g WHERE g.series = gj.series)) AND top / j <= 1 / sqrt(n_active))"""


def r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


def _fit(spark, sf_dir):
    return scan.poisson_null(exposure.total_exposure(weekly(spark, sf_dir), LAW))


def _dated(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def p1(spark, sf_dir):
    counts = weekly(spark, sf_dir).drop("t")
    return _dated(prepare.index_series(counts).select("series", "t", "date"))


def p2(spark, sf_dir):
    return _dated(daily(spark, sf_dir))


def _revised(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("series"), "l_shipdate", "l_quantity")
    counts = prepare.daily_counts(lines, ["series"], "l_shipdate", F.lit(True), F.col("l_quantity") < 10, "day")
    net = F.col("cases") - 3 * F.col("deaths") + F.when(F.col("t") == 0, 100000.0).otherwise(0.0)
    return counts.select("series", "t", net.alias("cases"))


def p3(spark, sf_dir):
    return prepare.reconcile_increments(_revised(spark, sf_dir))


P3_SQL = """WITH o AS (SELECT l_returnflag || l_linestatus AS series, CAST(l_shipdate AS DATE) AS d, l_quantity FROM lineitem),
e AS (SELECT series, min(d) AS lo, max(d) AS hi FROM o GROUP BY series),
sp AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM e),
c AS (SELECT series, d, count(*) - 3 * count(*) FILTER (l_quantity < 10) AS net FROM o GROUP BY series, d),
w AS (SELECT sp.series, CAST(row_number() OVER (PARTITION BY sp.series ORDER BY date) - 1 AS BIGINT) AS t, CAST(coalesce(net, 0) AS DOUBLE) AS net FROM sp LEFT JOIN c ON c.series = sp.series AND c.d = sp.date),
v AS (SELECT series, t, net + CASE WHEN t = 0 THEN 100000 ELSE 0 END AS net FROM w),
s AS (SELECT series, t, sum(net) OVER (PARTITION BY series ORDER BY t) AS total FROM v),
m AS (SELECT series, t, min(total) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least FROM s)
SELECT series, t, least - lag(least, 1, 0) OVER (PARTITION BY series ORDER BY t) AS cases FROM m"""


def p4(spark, sf_dir):
    return prepare.first_index_on_or_after(weekly(spark, sf_dir), "1997-01-01")


def p5(spark, sf_dir):
    return prepare.planned_looks(weekly(spark, sf_dir), first=35, every=50)


LOOKS_SQL = """
n AS (SELECT series, count(*) AS n FROM w GROUP BY series HAVING count(*) >= 3),
lk AS (SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY prefix) AS BIGINT) AS look, prefix FROM (
  SELECT series, unnest(list_distinct(list_concat(CASE WHEN n >= 35 THEN range(35, n + 1, 50) ELSE [] END, [n]))) AS prefix FROM n))"""


def p6(spark, sf_dir):
    table = weekly(spark, sf_dir)
    rows = prepare.prefix_expand(table, prepare.planned_looks(table, first=35, every=50))
    return rows.groupBy("series", "look", "prefix").agg(F.count("*").alias("n"), F.max("t").alias("last"), F.sum("cases").alias("cases"), F.sum("deaths").alias("deaths"))


def p7(spark, sf_dir):
    return _dated(prepare.reporting_lag(weekly(spark, sf_dir), 3))


def p8(spark, sf_dir):
    return _dated(prepare.weekend_transfer(daily(spark, sf_dir), 1.0))


def p9(spark, sf_dir):
    return _dated(prepare.ascertainment_shift(weekly(spark, sf_dir), 100, 0.75))


def p10(spark, sf_dir):
    return prepare.scale_to_max(weekly(spark, sf_dir)).select("series", "t", r("cases_scaled", 9))


def p11(spark, sf_dir):
    rows = _revised(spark, sf_dir).withColumn("deaths", F.when(F.col("t") % 97 == 5, None).otherwise(F.col("cases")))
    return prepare.validate_series(rows)


def p12(spark, sf_dir):
    return prepare.series_fingerprint(daily(spark, sf_dir))


def p13(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", prepare.episode_seed("episode", "v1", "o_orderpriority", 20260101, "o_orderkey", "evaluation").cast("string").alias("seed"))


P13_SQL = """WITH h AS (SELECT o_orderkey, sha256('{"component":"episode","contract":"v1","group":"' || o_orderpriority || '","master_seed":20260101,"replicate":' || o_orderkey || ',"split":"evaluation"}') AS x FROM orders)
SELECT o_orderkey, CAST(CAST('0x' || x[15:16] || x[13:14] || x[11:12] || x[9:10] || x[7:8] || x[5:6] || x[3:4] || x[1:2] AS UBIGINT) AS VARCHAR) AS seed FROM h"""


def _delay_counts(spark, sf_dir):
    """Empirical delay law per order status: days from order to shipping of its lines, 1 to 60."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    lag = F.pmod(F.datediff("l_shipdate", "o_orderdate"), F.lit(60)) + 1
    counts = lines.join(orders, "o_orderkey").groupBy(F.col("o_orderpriority").alias("delay_id"), lag.alias("lag")).agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    return counts.select("delay_id", "lag", (F.col("n") / F.sum("n").over(Window.partitionBy("delay_id"))).alias("p"))


_DELAY_SQL = """lg AS (SELECT o_orderpriority AS delay_id, CAST((CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE)) AS BIGINT) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cn AS (SELECT delay_id, CAST(((k % 60) + 60) % 60 + 1 AS INTEGER) AS lag, count(*) AS n FROM lg GROUP BY ALL),
dl AS (SELECT delay_id, lag, n / sum(n) OVER (PARTITION BY delay_id) AS p FROM cn)"""


def d3(spark, sf_dir):
    return exposure.normalize_pmf(_delay_counts(spark, sf_dir)).select("delay_id", "lag", r("p", 9))


def d4(spark, sf_dir):
    return exposure.delay_median(_delay_counts(spark, sf_dir), offset=0).select("delay_id", F.col("median").cast("int").alias("median"))


def d1(spark, sf_dir):
    law = exposure.delay_law("gamma", 14.0, 45)
    return exposure.total_exposure(daily(spark, sf_dir), law).select("series", "t", r("x"))


def d1_lognormal(spark, sf_dir):
    law = exposure.delay_law("lognormal", 14.0, 45, cv=0.5)
    return exposure.total_exposure(daily(spark, sf_dir), law).select("series", "t", r("x"))


def d1_bimodal(spark, sf_dir):
    law = exposure.delay_law("bimodal", 8.0, 45, second_mean=21.0)
    return exposure.total_exposure(daily(spark, sf_dir), law).select("series", "t", r("x"))


def p8_draw(spark, sf_dir):
    """Half of each weekend's deaths, by a draw, on the Monday after: what each week (Tuesday to Monday) has stays."""
    rows = prepare.weekend_transfer(daily(spark, sf_dir), 0.5, seed=11).withColumn("week", F.expr("(t + 6) div 7"))
    weeks = rows.groupBy("series", "week").agg(F.sum("deaths").alias("deaths"), F.max(F.col("t") % 7 == 0).alias("whole"), F.min(F.col("deaths") >= 0).alias("valid"))
    return weeks.where("whole").select("series", "week", "deaths", "valid")


def d2(spark, sf_dir):
    law = exposure.weekly_delay_law(10.0, 6)
    return exposure.total_exposure(weekly(spark, sf_dir), law, offset=0).select("series", "t", r("x"))


def _law_sql(mass: str, lags: str) -> str:
    """CTEs of the masses at lag i, and their law f(lag, p)."""
    return f"ms AS (SELECT lag, {mass} AS m FROM (SELECT unnest(range({lags})) AS lag)), f AS (SELECT lag, m / (SELECT sum(m) FROM ms) AS p FROM ms)"


_GAMMA4 = "CASE WHEN {x} <= 0 THEN 0 ELSE 1 - exp(-({x}) / 3.5::DOUBLE) * (1 + ({x}) / 3.5::DOUBLE + pow(({x}) / 3.5::DOUBLE, 2) / 2 + pow(({x}) / 3.5::DOUBLE, 3) / 6) END"
_GAMMA2 = "CASE WHEN {x} <= 0 THEN 0 ELSE 1 - exp(-({x}) / 5::DOUBLE) * (1 + ({x}) / 5::DOUBLE) END"
_CONVOLVED = "SELECT a.series, a.t, round(sum(coalesce(b.cases * f.p, 0)), 6) AS x FROM w a CROSS JOIN f LEFT JOIN w b ON b.series = a.series AND b.t = a.t - f.lag GROUP BY ALL"
D1_SQL = f"WITH {DAILY}, {_law_sql(f'({_GAMMA4.format(x="lag")}) - ({_GAMMA4.format(x="(lag - 1)")})', '1, 46')} {_CONVOLVED}"
_GAMMA = "CASE WHEN {x} <= 0 THEN 0 ELSE 1 - exp(-({x}) / {s}::DOUBLE) * (1 + ({x}) / {s}::DOUBLE + pow(({x}) / {s}::DOUBLE, 2) / 2 + pow(({x}) / {s}::DOUBLE, 3) / 6) END"
_TWO = " + ".join(f"({_GAMMA.format(x='lag', s=s)}) - ({_GAMMA.format(x='(lag - 1)', s=s)})" for s in (2.0, 5.25))
D1_BIMODAL_SQL = f"WITH {DAILY}, {_law_sql(_TWO, '1, 46')} {_CONVOLVED}"
_AT = "(lag - 1 + i / 256::DOUBLE)"
_LOGNORMAL = f"(SELECT sum(CASE WHEN i IN (0, 256) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * CASE WHEN {_AT} > 0 THEN exp(-pow(ln({_AT}) - ln(14::DOUBLE) + ln(1.25::DOUBLE) / 2, 2) / (2 * ln(1.25::DOUBLE))) / {_AT} ELSE 0 END) FROM (SELECT unnest(range(257)) AS i))"
D1_LOGNORMAL_SQL = f"WITH {DAILY}, {_law_sql(_LOGNORMAL, '1, 46')} {_CONVOLVED}"
P8_DRAW_SQL = f"""WITH {DAILY}, b AS (SELECT series, (t + 6) // 7 AS week, sum(deaths) AS deaths, max((t % 7 = 0)::INT) AS whole FROM w GROUP BY ALL)
SELECT series, week, deaths, true AS valid FROM b WHERE whole = 1"""
_WEEK = f"(SELECT avg(({_GAMMA2.format(x='(lag + 1 - (i + 0.5::DOUBLE) / 512)')}) - ({_GAMMA2.format(x='(lag - (i + 0.5::DOUBLE) / 512)')})) FROM (SELECT unnest(range(512)) AS i))"
D2_SQL = f"WITH {WEEKLY}, {_law_sql(_WEEK, '0, 7')} {_CONVOLVED}"


def x1(spark, sf_dir):
    return exposure.total_exposure(weekly(spark, sf_dir), LAW, start=10, end=200).select("series", "t", r("x"))


X1_SQL = f"""WITH {WEEKLY}, {_LAW_SQL}
SELECT a.series, a.t, round(sum(coalesce(b.cases * f.p, 0)), 6) AS x FROM w a CROSS JOIN f
LEFT JOIN w b ON b.series = a.series AND b.t = a.t - f.lag AND b.t >= 10 AND b.t < 200 GROUP BY a.series, a.t"""


def x2(spark, sf_dir):
    return exposure.expected_deaths(weekly(spark, sf_dir), LAW, exposure.risk_path("step", 0.02, 0.04, 100)).select("series", "t", r("expected"))


X2_SQL = f"""WITH {WEEKLY}, {_LAW_SQL}
SELECT a.series, a.t, round(sum(coalesce(b.cases * CASE WHEN b.t >= 100 THEN 0.04::DOUBLE ELSE 0.02::DOUBLE END * f.p, 0)), 6) AS expected FROM w a CROSS JOIN f
LEFT JOIN w b ON b.series = a.series AND b.t = a.t - f.lag GROUP BY a.series, a.t"""


def x3(spark, sf_dir):
    return weekly(spark, sf_dir).select("series", "t", F.round(exposure.risk_path("logistic", 0.02, 0.05, 120, 28.0), 9).alias("risk"))


X3_SQL = f"WITH {WEEKLY} SELECT series, t, round(0.02 + 0.03::DOUBLE / (1 + exp(-2 * ln(9) / 28 * (t - 120))), 9) AS risk FROM w"


def x4(spark, sf_dir):
    return exposure.post_exposure(weekly(spark, sf_dir), LAW).select("series", "tau", "s", r("b"))


X4_SQL = f"""WITH {WEEKLY}, {_LAW_SQL}, n AS (SELECT series, max(t) AS last FROM w GROUP BY series),
contrib AS (SELECT b.series, b.t AS u, b.t + f.lag AS s, b.cases * f.p AS v FROM w b CROSS JOIN f)
SELECT a.series, a.t AS tau, s, round(sum(v), 6) AS b FROM w a JOIN n USING (series) JOIN contrib ON contrib.series = a.series AND contrib.u >= a.t
WHERE a.t >= 1 AND s >= a.t + 1 AND s < a.t + 4 AND s <= n.last GROUP BY a.series, a.t, s"""


def x5(spark, sf_dir):
    return exposure.two_rate_design(weekly(spark, sf_dir), LAW, 100, observation_start=4).select("series", "t", (F.round("a", 6) + 0.0).alias("a"), r("b"))


X5_SQL = f"""WITH {EXPOSED},
late AS (SELECT a.series, a.t, sum(coalesce(b.cases * f.p, 0)) AS b FROM w a CROSS JOIN f LEFT JOIN w b ON b.series = a.series AND b.t = a.t - f.lag AND b.t >= 100 GROUP BY ALL)
SELECT x.series, x.t, round(x.x - late.b, 6) + 0.0 AS a, round(late.b, 6) AS b FROM x JOIN late USING (series, t) WHERE t >= 4 AND x > 1e-12"""


def f2(spark, sf_dir):
    return _fit(spark, sf_dir).select("series", "t", r("pi", 9), r("mean"))


def s1(spark, sf_dir):
    found = scan.score_scan(_fit(spark, sf_dir), LAW)
    return found.select("series", "tau", r("z"), r("q"), r("information"), r("max_leverage", 9))


def s1_winner(spark, sf_dir):
    return scan.scan_winner(scan.score_scan(_fit(spark, sf_dir), LAW)).select("series", r("statistic"), "tau_hat", "direction", "n_candidates")


def s3(spark, sf_dir):
    return scan.report_day_scan(_fit(spark, sf_dir), gate=False).select("series", "tau", r("z"), r("q"), r("information"), r("max_leverage", 9))


S3_SQL = f"""WITH {FITTED}, dn AS (SELECT m.series, a.t AS tau, m.x, m.deaths, m.mean, CASE WHEN m.t >= a.t THEN m.x ELSE 0 END AS b FROM m JOIN w a ON a.series = m.series AND a.t >= 1 WHERE m.active),
pr AS (SELECT series, tau, sum(b * x / mean) / sum(x * x / mean) AS proj FROM dn GROUP BY ALL),
g AS (SELECT d.series, d.tau, sum((b - x * proj) ** 2 / mean) AS j, max((b - x * proj) ** 2 / mean) AS top, sum((b - x * proj) * (deaths - mean) / mean) AS u FROM dn d JOIN pr USING (series, tau) GROUP BY ALL)
SELECT series, tau, round(u / sqrt(j), 6) AS z, round(u * u / j, 6) AS q, round(j, 6) AS information, round(top / j, 9) AS max_leverage FROM g
WHERE j > 1e-12 * greatest(1, (SELECT max(j) FROM g h WHERE h.series = g.series))"""


def s4(spark, sf_dir):
    fit = _fit(spark, sf_dir)
    return scan.fixed_candidate(scan.score_scan(fit, LAW), fit, 100).select("series", r("z"), r("q"))


def s5(spark, sf_dir):
    return scan.naive_chisq(scan.scan_winner(scan.score_scan(_fit(spark, sf_dir), LAW))).select("series", "naive_reject")


def s6(spark, sf_dir):
    return scan.matrix_free_scan(_fit(spark, sf_dir), LAW).select("series", "tau", r("q"))


S6_SQL = f"""WITH {SCANNED},
k AS (SELECT series, tau, sum(b * b / mean) AS bb, sum(b * x / mean) AS bx, sum(x * x / mean) AS xx, sum(b * (deaths - mean) / mean) AS bd, sum(x * (deaths - mean) / mean) AS xd FROM dense GROUP BY ALL)
SELECT series, tau, round((bd - bx / xx * xd) ** 2 / (bb - bx * bx / xx), 6) AS q FROM k
WHERE xx - 2 * bx + bb > 1e-12 AND (xx - 2 * bx + bb) * bb - (bx - bb) ** 2 > 1e-12 * greatest(1, (xx - 2 * bx + bb) * bb)"""


def _residuals(spark, sf_dir):
    return charts.poisson_residuals(exposure.total_exposure(weekly(spark, sf_dir), LAW), REFERENCE_END)


RESIDUALS = f"""{EXPOSED},
rp AS (SELECT series, sum(deaths) / sum(x) AS pi FROM x WHERE x > 1e-12 AND t < {REFERENCE_END} GROUP BY series),
rs AS (SELECT x.series, x.t, x.deaths, greatest(rp.pi * x.x, 1e-12) AS mean, (x.deaths - greatest(rp.pi * x.x, 1e-12)) / sqrt(greatest(rp.pi * x.x, 1e-12)) AS v FROM x JOIN rp USING (series))"""


def f13(spark, sf_dir):
    return _residuals(spark, sf_dir).select("series", "t", r("mean"), r("v"))


def h1(spark, sf_dir):
    return charts.page_cusum(_residuals(spark, sf_dir), REFERENCE_END).select("series", "t", r("statistic"), "start", "direction")


H1_SQL = f"""WITH RECURSIVE {RESIDUALS},
cu(series, t, su, sl, bu, bl) AS (
  SELECT series, {REFERENCE_END - 1}::BIGINT, 0::DOUBLE, 0::DOUBLE, {REFERENCE_END}::BIGINT, {REFERENCE_END}::BIGINT FROM (SELECT DISTINCT series FROM rs)
  UNION ALL SELECT cu.series, rs.t, greatest(0, su + v - 0.5), greatest(0, sl - v - 0.5),
    CASE WHEN su + v - 0.5 <= 0 THEN rs.t + 1 ELSE bu END, CASE WHEN sl - v - 0.5 <= 0 THEN rs.t + 1 ELSE bl END
  FROM cu JOIN rs ON rs.series = cu.series AND rs.t = cu.t + 1)
SELECT series, t, round(greatest(su, sl), 6) AS statistic, CASE WHEN su <= 0 AND sl <= 0 THEN t WHEN su >= sl THEN bu ELSE bl END AS start,
  CAST(CASE WHEN su <= 0 AND sl <= 0 THEN 0 WHEN su >= sl THEN 1 ELSE -1 END AS INTEGER) AS direction FROM cu WHERE t >= {REFERENCE_END}"""


def h2(spark, sf_dir):
    return charts.focus_scan(_residuals(spark, sf_dir), REFERENCE_END).select("series", r("statistic"), "start", "direction")


_SUFFIX = f"""sf AS (SELECT a.series, a.t AS start, sum(b.v) AS sv, count(*) AS n, sum(b.deaths) AS y, sum(b.mean) AS m FROM rs a JOIN rs b ON b.series = a.series AND b.t >= a.t WHERE a.t >= {REFERENCE_END} GROUP BY ALL),
gl AS (SELECT *, CASE WHEN y <= 0 THEN 2 * m ELSE 2 * (y * ln(y / m) - (y - m)) END AS lr FROM sf)"""
H2_SQL = f"""WITH {RESIDUALS}, {_SUFFIX}
SELECT series, round(max(sv * sv / n), 6) AS statistic, arg_max(start, sv * sv / n) AS start, CAST(sign(arg_max(sv, sv * sv / n)) AS INTEGER) AS direction FROM sf GROUP BY series"""


def h3(spark, sf_dir):
    return charts.glr_scan(_residuals(spark, sf_dir), REFERENCE_END).select("series", r("statistic"), "start", "direction")


H3_SQL = f"""WITH {RESIDUALS}, {_SUFFIX}
SELECT series, round(max(lr), 6) AS statistic, arg_max(start, lr) AS start, CAST(sign(arg_max(y - m, lr)) AS INTEGER) AS direction FROM gl GROUP BY series"""


def h5(spark, sf_dir):
    rows = _residuals(spark, sf_dir)
    found = charts.chart_traces(rows, prepare.planned_looks(rows, first=REFERENCE_END + 50, every=50), REFERENCE_END)
    return found.where("chart = 'glr'").select("series", "look", "prefix", r("statistic"), "start", "direction")


H5_SQL = f"""WITH {RESIDUALS}, n AS (SELECT series, count(*) AS n FROM w GROUP BY series),
lk AS (SELECT series, CAST(row_number() OVER (PARTITION BY series ORDER BY prefix) AS BIGINT) AS look, prefix FROM (
  SELECT series, unnest(list_distinct(list_concat(CASE WHEN n >= {REFERENCE_END + 50} THEN range({REFERENCE_END + 50}, n + 1, 50) ELSE [] END, [n]))) AS prefix FROM n)),
pf AS (SELECT lk.series, look, prefix, a.t AS start, sum(b.deaths) AS y, sum(b.mean) AS m FROM lk JOIN rs a ON a.series = lk.series AND a.t >= {REFERENCE_END} AND a.t < prefix
  JOIN rs b ON b.series = lk.series AND b.t >= a.t AND b.t < prefix GROUP BY ALL),
gl AS (SELECT *, CASE WHEN y <= 0 THEN 2 * m ELSE 2 * (y * ln(y / m) - (y - m)) END AS lr FROM pf)
SELECT series, look, prefix, round(max(lr), 6) AS statistic, arg_max(start, lr) AS start, CAST(sign(arg_max(y - m, lr)) AS INTEGER) AS direction FROM gl GROUP BY series, look, prefix"""


def h6(spark, sf_dir):
    return charts.chart_summary(_residuals(spark, sf_dir), REFERENCE_END).where("chart <> 'page_cusum'").select("series", "chart", r("statistic"), "start", "direction")


H6_SQL = f"""WITH {RESIDUALS}, {_SUFFIX}
SELECT series, 'focus' AS chart, round(max(sv * sv / n), 6) AS statistic, arg_max(start, sv * sv / n) AS start, CAST(sign(arg_max(sv, sv * sv / n)) AS INTEGER) AS direction FROM sf GROUP BY series
UNION ALL SELECT series, 'glr', round(max(lr), 6), arg_max(start, lr), CAST(sign(arg_max(y - m, lr)) AS INTEGER) FROM gl GROUP BY series"""


def h7(spark, sf_dir):
    found = charts.glr_scan(_residuals(spark, sf_dir), REFERENCE_END)
    return found.select("series", charts.cohort_proxy(F.col("start"), 2).cast("long").alias("cohort"))


def s2(spark, sf_dir):
    """The days' weights in the score of each series' winning candidate."""
    fit = _fit(spark, sf_dir)
    winner = scan.scan_winner(scan.score_scan(fit, LAW)).select("series", F.col("tau_hat").alias("tau"))
    return scan.influence(fit, winner, LAW).select("series", "tau", "t", r("influence"))


S2_SQL = f"""WITH {SCANNED}, wn AS (SELECT series, arg_max(tau, (round(q, 9), -tau)) AS tau FROM sc GROUP BY series)
SELECT d.series, d.tau, d.t, round((b - x * proj) / sqrt(mean) / sqrt(j), 6) AS influence FROM dense d JOIN wn USING (series, tau) JOIN pr USING (series, tau) JOIN gj USING (series, tau)"""


QUERIES = {
    "s2_influence": s2,
    "p1_index_series": p1, "p2_daily_counts": p2, "p3_reconcile_increments": p3, "p4_first_index": p4, "p5_planned_looks": p5, "p6_prefix_expand": p6,
    "p7_reporting_lag": p7, "p8_weekend_transfer": p8, "p9_ascertainment_shift": p9, "p10_scale_to_max": p10, "p11_validate_series": p11,
    "p12_series_fingerprint": p12, "p13_episode_seed": p13, "d1_gamma_exposure": d1, "d1_lognormal_exposure": d1_lognormal, "d1_bimodal_exposure": d1_bimodal, "p8_weekend_draw": p8_draw, "d2_weekly_delay_exposure": d2, "d3_normalize_pmf": d3, "d4_delay_median": d4,
    "x1_total_exposure": x1, "x2_expected_deaths": x2, "x3_risk_path": x3, "x4_post_exposure": x4, "x5_two_rate_design": x5,
    "f2_poisson_null": f2, "f13_baseline_residuals": f13, "s1_score_scan": s1, "s1_score_scan_winner": s1_winner, "s3_report_day_scan": s3,
    "s4_fixed_candidate": s4, "s5_naive_chisq": s5, "s6_matrix_free_scan": s6, "h1_page_cusum": h1, "h2_focus_scan": h2, "h3_glr_scan": h3,
    "h5_chart_traces": h5, "h6_chart_summary": h6, "h7_cohort_proxy": h7,
}

ORACLE_SQL = {
    "d1_gamma_exposure": D1_SQL, "d1_lognormal_exposure": D1_LOGNORMAL_SQL, "d1_bimodal_exposure": D1_BIMODAL_SQL, "p8_weekend_draw": P8_DRAW_SQL, "d2_weekly_delay_exposure": D2_SQL, "s2_influence": S2_SQL,
    "p1_index_series": f"WITH {WEEKLY} SELECT series, t, CAST(date AS VARCHAR) AS date FROM w",
    "p2_daily_counts": f"WITH {DAILY} SELECT series, CAST(date AS VARCHAR) AS date, cases, deaths, t FROM w",
    "p3_reconcile_increments": P3_SQL,
    "p4_first_index": f"WITH {WEEKLY} SELECT series, min(t) FILTER (date >= DATE '1997-01-01') AS start FROM w GROUP BY series",
    "p5_planned_looks": f"WITH {WEEKLY}, {LOOKS_SQL} SELECT series, look, prefix FROM lk",
    "p6_prefix_expand": f"WITH {WEEKLY}, {LOOKS_SQL} SELECT series, look, prefix, count(*) AS n, max(t) AS last, sum(cases) AS cases, sum(deaths) AS deaths FROM w JOIN lk USING (series) WHERE t < prefix GROUP BY ALL",
    "p7_reporting_lag": f"WITH {WEEKLY} SELECT series, t, CAST(date AS VARCHAR) AS date, cases, lag(deaths, 3, 0) OVER (PARTITION BY series ORDER BY t) AS deaths FROM w",
    "p8_weekend_transfer": f"""WITH {DAILY}, q AS (SELECT *, CASE WHEN t % 7 >= 5 THEN deaths ELSE 0 END AS mv FROM w)
SELECT series, t, CAST(date AS VARCHAR) AS date, cases, deaths - mv + CASE WHEN t % 7 = 0 THEN lag(mv, 1, 0) OVER (PARTITION BY series ORDER BY t) + lag(mv, 2, 0) OVER (PARTITION BY series ORDER BY t) ELSE 0 END AS deaths FROM q""",
    "p9_ascertainment_shift": f"WITH {WEEKLY} SELECT series, t, CAST(date AS VARCHAR) AS date, CASE WHEN t >= 100 THEN round_even(cases * 0.75, 0) ELSE cases END AS cases, deaths FROM w",
    "p10_scale_to_max": f"WITH {WEEKLY} SELECT series, t, round(cases / greatest(max(cases) OVER (PARTITION BY series), 1), 9) AS cases_scaled FROM w",
    "p11_validate_series": P3_SQL.split("s AS (SELECT")[0].rstrip().rstrip(",") + """
SELECT series, count(*) AS n, count(*) FILTER (t % 97 = 5) AS n_missing, count(*) FILTER (net < 0) AS n_negative FROM v GROUP BY series HAVING count(*) < 3 OR count(*) FILTER (t % 97 = 5) > 0 OR count(*) FILTER (net < 0) > 0""",
    "p12_series_fingerprint": f"WITH {DAILY} SELECT series, sha256(string_agg(strftime(date, '%Y-%m-%d') || '|' || CAST(cases AS BIGINT) || '|' || CAST(deaths AS BIGINT), ',' ORDER BY t)) AS fingerprint FROM w GROUP BY series",
    "p13_episode_seed": P13_SQL,
    "d3_normalize_pmf": f"WITH {_DELAY_SQL} SELECT delay_id, lag, round(p / sum(p) OVER (PARTITION BY delay_id), 9) AS p FROM dl",
    "d4_delay_median": f"WITH {_DELAY_SQL}, q AS (SELECT delay_id, lag, sum(p) OVER (PARTITION BY delay_id ORDER BY lag) AS run FROM dl) SELECT delay_id, min(lag) AS median FROM q WHERE run >= 0.5 GROUP BY delay_id",
    "x1_total_exposure": X1_SQL, "x2_expected_deaths": X2_SQL, "x3_risk_path": X3_SQL, "x4_post_exposure": X4_SQL, "x5_two_rate_design": X5_SQL,
    "f2_poisson_null": f"WITH {FITTED} SELECT series, t, round(pi, 9) AS pi, round(mean, 6) AS mean FROM m",
    "f13_baseline_residuals": f"WITH {RESIDUALS} SELECT series, t, round(mean, 6) AS mean, round(v, 6) AS v FROM rs",
    "s1_score_scan": f"WITH {SCANNED} SELECT series, tau, round(z, 6) AS z, round(q, 6) AS q, round(information, 6) AS information, round(max_leverage, 9) AS max_leverage FROM sc",
    "s1_score_scan_winner": f"WITH {SCANNED} SELECT series, round(max(q), 6) AS statistic, arg_max(tau, (round(q, 9), -tau)) AS tau_hat, CAST(sign(arg_max(z, (round(q, 9), -tau))) AS INTEGER) AS direction, count(*) AS n_candidates FROM sc GROUP BY series",
    "s3_report_day_scan": S3_SQL,
    "s4_fixed_candidate": f"WITH {SCANNED} SELECT s.series, round(z, 6) AS z, round(q, 6) AS q FROM (SELECT DISTINCT series FROM w) s LEFT JOIN sc ON sc.series = s.series AND tau = 100",
    "s5_naive_chisq": f"WITH {SCANNED} SELECT series, max(q) > 3.841458820694124 AS naive_reject FROM sc GROUP BY series",
    "s6_matrix_free_scan": S6_SQL,
    "h1_page_cusum": H1_SQL, "h2_focus_scan": H2_SQL, "h3_glr_scan": H3_SQL, "h5_chart_traces": H5_SQL, "h6_chart_summary": H6_SQL,
    "h7_cohort_proxy": f"WITH {RESIDUALS}, {_SUFFIX} SELECT series, greatest(0, arg_max(start, lr) - 2) AS cohort FROM gl GROUP BY series",
}
