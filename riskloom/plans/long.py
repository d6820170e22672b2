"""Registered queries on one long series: every order, by its key, as one series in blocks, and their SQL by windows.

cases = the order's price in units of 20,000, deaths = whether its status is F, v = the price above 250,000 in eighths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import blocks
from riskloom.plans.series import LAW

#: Some tens of blocks already at small sizes; a production series takes blocks.SIZE.
SIZE = 512


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.lit("orders").alias("series"), F.col("o_orderkey").alias("t"), F.rint(price / 20000).alias("cases"), (F.col("o_orderstatus") == "F").cast("double").alias("deaths"), (F.rint((price - 250000) / 20000) / 8).alias("v")
    )


ORDERS = """w AS (SELECT 'orders' AS series, o_orderkey AS t, round_even(o_totalprice / 20000, 0) AS cases, (o_orderstatus = 'F')::INT::DOUBLE AS deaths, round_even((o_totalprice - 250000) / 20000, 0) / 8 AS v FROM orders)"""


def x1(spark, sf_dir):
    out = blocks.total_exposure(orders(spark, sf_dir), LAW, size=SIZE)
    return out.select("series", "t", F.round("x", 6).alias("x"))


X1_SQL = f"""WITH {ORDERS} SELECT series, t, round({" + ".join(f"{p} * lag(cases, {i + 1}, 0) OVER (ORDER BY t)" for i, p in enumerate(LAW))}, 6) AS x FROM w"""


def p3(spark, sf_dir):
    rows = orders(spark, sf_dir)
    net = F.when(F.col("t") == 0, 1e9).otherwise(F.col("cases") - 14 * F.col("deaths") - F.col("t") % 9)
    return blocks.reconcile_increments(rows.select("series", "t", net.alias("cases")), size=SIZE)


P3_SQL = f"""WITH {ORDERS}, s AS (SELECT series, t, sum(CASE WHEN t = 0 THEN 1e9 ELSE cases - 14 * deaths - t % 9 END) OVER (ORDER BY t) AS total FROM w),
m AS (SELECT series, t, min(total) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least FROM s)
SELECT series, t, least - lag(least, 1, 0) OVER (ORDER BY t) AS cases FROM m"""


def h1(spark, sf_dir):
    return blocks.page_cusum(orders(spark, sf_dir), 28, size=SIZE)


H1_SQL = f"""WITH {ORDERS}, p AS (SELECT series, t, sum(v - 0.5) OVER (ORDER BY t) AS pu, sum(-v - 0.5) OVER (ORDER BY t) AS pl FROM w WHERE t >= 28),
s AS (SELECT series, t, pu - least(0, min(pu) OVER (ORDER BY t)) AS su, pl - least(0, min(pl) OVER (ORDER BY t)) AS sl FROM p),
b AS (SELECT *, coalesce(max(t) FILTER (su <= 0) OVER (ORDER BY t) + 1, 28) AS bu, coalesce(max(t) FILTER (sl <= 0) OVER (ORDER BY t) + 1, 28) AS bl FROM s)
SELECT series, t, greatest(su, sl) AS statistic, CASE WHEN su <= 0 AND sl <= 0 THEN t WHEN su >= sl THEN bu ELSE bl END AS start,
  CAST(CASE WHEN su <= 0 AND sl <= 0 THEN 0 WHEN su >= sl THEN 1 ELSE -1 END AS INTEGER) AS direction FROM b"""


def h2(spark, sf_dir):
    out = blocks.focus_scan(orders(spark, sf_dir), 28, size=SIZE)
    return out.select("series", F.round("statistic", 6).alias("statistic"), "start", "direction")


H2_SQL = f"""WITH {ORDERS}, f AS (SELECT series, t, sum(v) OVER (ORDER BY t DESC) AS s, count(*) OVER (ORDER BY t DESC) AS n FROM w WHERE t >= 28)
SELECT series, round(max(s * s / n), 6) AS statistic, arg_max(t, (s * s / n, -t)) AS start, CAST(sign(arg_max(s, (s * s / n, -t))) AS INTEGER) AS direction FROM f GROUP BY series"""


QUERIES = {"x1_long_exposure": x1, "p3_long_reconcile": p3, "h1_long_cusum": h1, "h2_long_focus": h2}
ORACLE_SQL = {"x1_long_exposure": X1_SQL, "p3_long_reconcile": P3_SQL, "h1_long_cusum": H1_SQL, "h2_long_focus": H2_SQL}
