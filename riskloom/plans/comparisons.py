"""Registered queries of the four-method and three-method comparisons on customers' mean order value, and their SQL.

Banks are even and odd customers, cells the order priorities. Method w is a fourth estimator, valid but for every 17th customer.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from riskloom.operators import comparison
from riskloom.plans.monitoring import EST, PREFIXES, t_long

FOUR = {**PREFIXES, "w": "w_"}
COHORTS = {"main": ["x", "y", "w"], "four": ["x", "y", "z", "w"]}
LS = {"x": "x_", "y": "y_", "z": "z_"}
GROUPS = ["bank", "scenario"]


def wide(spark, sf_dir):
    rows = t_long(spark, sf_dir).withColumn("bank", F.when(F.col("replicate") % 2 == 0, "even").otherwise("odd"))
    valid = (F.col("replicate") % 17 != 0) & F.col("alarm")
    return rows.withColumn("w_v_point_valid", valid).withColumn("w_v_estimate", F.when(valid, 90000.0 + 100 * (F.col("replicate") % 211)))


def r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


def _summary(spark, sf_dir):
    return comparison.cohort_summary(wide(spark, sf_dir), GROUPS, "v", FOUR, COHORTS)


def _contrasts(spark, sf_dir):
    return comparison.method_contrasts(wide(spark, sf_dir), GROUPS, "v", FOUR, COHORTS)


def t6_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select(*GROUPS, "method", "cohort", "n_alarm", "n", r("bias"), r("rmse"), r("rmse_mcse"))


def t6_contrasts(spark, sf_dir):
    return _contrasts(spark, sf_dir).select(*GROUPS, "method_a", "method_b", "cohort", "n_paired", r("difference"), r("bias_difference"), r("paired_mcse"))


def t6_aggregate(spark, sf_dir):
    return comparison.bank_aggregate(_summary(spark, sf_dir), ["bank"]).select("bank", "method", "cohort", "cells", "n_alarm", "n", r("availability"), r("rmse"), r("bias"))


def t6_wins(spark, sf_dir):
    return comparison.wins_and_ties(_contrasts(spark, sf_dir), ["bank"])


def t7_summary(spark, sf_dir):
    out = comparison.cohort_summary(wide(spark, sf_dir), GROUPS, "v", LS, {"three_way": ["x", "y", "z"], "main_pair": ["x", "z"]})
    return out.select(*GROUPS, "method", "cohort", "n", r("bias"), r("rmse"), r("rmse_mcse"))


def t7_contrasts(spark, sf_dir):
    out = comparison.method_contrasts(wide(spark, sf_dir), GROUPS, "v", LS, {"three_way": ["x", "y", "z"]})
    return out.select(*GROUPS, "method_a", "method_b", "cohort", "n_paired", r("difference"), r("bias_difference"), r("paired_mcse"))


WIDE = f"""{EST}, v AS (SELECT CASE WHEN replicate % 2 = 0 THEN 'even' ELSE 'odd' END AS bank, scenario, alarm, x / truth - 1 AS x, y / truth - 1 AS y, z / truth - 1 AS z,
  CASE WHEN alarm AND replicate % 17 <> 0 THEN (90000.0 + 100 * (replicate % 211)) / truth - 1 END AS w FROM t)"""


def _there(names) -> str:
    return "(" + " AND ".join(f"{n} IS NOT NULL" for n in names) + ")"


def _summary_sql(methods, cohorts) -> str:
    rows = []
    for m in methods:
        for c, names in {"own": [m], **cohorts}.items():
            f = f"FILTER ({_there([m, *names])})"
            rows.append(f"SELECT bank, scenario, '{m}' AS method, '{c}' AS cohort, count(*) FILTER (alarm) AS n_alarm, count(*) {f} AS n, avg({m}) {f} AS bias, avg({m} * {m}) {f} AS mse, stddev_samp({m} * {m}) {f} AS sd FROM v GROUP BY bank, scenario")
    return "sm AS (" + " UNION ALL ".join(rows) + ")"


def _contrasts_sql(methods, cohorts) -> str:
    rows = []
    for a, b in combinations(methods, 2):
        for c, names in {"pairwise": [], **cohorts}.items():
            f = f"FILTER ({_there([a, b, *names])})"
            rows.append(f"SELECT bank, scenario, '{a}' AS method_a, '{b}' AS method_b, '{c}' AS cohort, count(*) {f} AS n_paired, avg({a} * {a} - {b} * {b}) {f} AS difference, avg({a} - {b}) {f} AS bias_difference, stddev_samp({a} * {a} - {b} * {b}) {f} AS sd FROM v GROUP BY bank, scenario")
    return "ct AS (" + " UNION ALL ".join(rows) + ")"


_ERRORS = "round(bias, 6) AS bias, round(sqrt(mse), 6) AS rmse, round(CASE WHEN mse = 0 THEN 0 ELSE sd / sqrt(n) / (2 * sqrt(mse)) END, 6) AS rmse_mcse"
_PAIRS = "SELECT bank, scenario, method_a, method_b, cohort, n_paired, round(difference, 6) AS difference, round(bias_difference, 6) AS bias_difference, round(sd / sqrt(n_paired), 6) AS paired_mcse FROM ct"
_FOUR = f"WITH {WIDE}, {_summary_sql(FOUR, COHORTS)}, {_contrasts_sql(FOUR, COHORTS)}"
_LS = f"WITH {WIDE}, {_summary_sql(LS, {'three_way': list('xyz'), 'main_pair': list('xz')})}, {_contrasts_sql(LS, {'three_way': list('xyz')})}"

QUERIES = {"t6_cohort_summary": t6_summary, "t6_method_contrasts": t6_contrasts, "t6_bank_aggregate": t6_aggregate, "t6_wins": t6_wins, "t7_ls_summary": t7_summary, "t7_ls_contrasts": t7_contrasts}
ORACLE_SQL = {
    "t6_cohort_summary": f"{_FOUR} SELECT bank, scenario, method, cohort, n_alarm, n, {_ERRORS} FROM sm",
    "t6_method_contrasts": f"{_FOUR} {_PAIRS}",
    "t6_bank_aggregate": f"""{_FOUR} SELECT bank, method, cohort, count(*) AS cells, CAST(sum(n_alarm) AS BIGINT) AS n_alarm, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / sum(n_alarm), 6) AS availability,
  round(CASE WHEN count(mse) = count(*) THEN sqrt(avg(mse)) END, 6) AS rmse, round(CASE WHEN count(bias) = count(*) THEN avg(bias) END, 6) AS bias FROM sm GROUP BY ALL""",
    "t6_wins": f"""{_FOUR}, s AS (SELECT bank, method_a AS method, method_b AS opponent, difference AS d FROM ct WHERE cohort = 'pairwise' UNION ALL SELECT bank, method_b, method_a, -difference FROM ct WHERE cohort = 'pairwise')
SELECT bank, method, opponent, count(d) AS cells, count(*) FILTER (d < 0) AS wins, count(*) FILTER (d = 0) AS ties FROM s GROUP BY ALL""",
    "t7_ls_summary": f"{_LS} SELECT bank, scenario, method, cohort, n, {_ERRORS} FROM sm",
    "t7_ls_contrasts": f"{_LS} {_PAIRS}",
}
