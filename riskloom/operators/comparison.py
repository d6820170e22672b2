"""Comparisons of estimators on the wide row: cohorts, all pairs of methods, and banks of cells that weigh alike.

A row has every method's estimate, so which episodes two methods share is a condition on the row: all cohorts and pairs
are conditional aggregates of one grouping, with no join of the table to itself. A point counts on alarmed episodes alone.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OWN, PAIR = "own", "pairwise"


def _errors(target: str, methods: dict[str, str], truth: str, alarm: str) -> dict[str, Column]:
    """Relative error of each method, null where its point is not valid or there is no alarm."""
    ok = lambda p: F.col(alarm) & F.coalesce(F.col(f"{p}{target}_point_valid"), F.lit(False))
    return {m: F.when(ok(p), F.col(f"{p}{target}_estimate") / F.col(truth) - 1) for m, p in methods.items()}


def _all_there(errors: dict[str, Column], names) -> Column:
    return reduce(lambda a, b: a & b, (errors[m].isNotNull() for m in names))


def cohort_summary(df: DataFrame, groups: list[str], target: str, methods: dict[str, str], cohorts: dict[str, list[str]], truth: str = "truth", alarm: str = "alarm") -> DataFrame:
    """(groups, method, cohort, n_alarm, n, bias, mse, rmse, rmse_mcse) of relative errors.

    Cohort `own` has all valid points of a method; each of `cohorts` those of them where its methods are all valid.
    """
    errors = _errors(target, methods, truth, alarm)
    conditions = {OWN: F.lit(True), **{c: _all_there(errors, names) for c, names in cohorts.items()}}
    aggs, rows = [F.count_if(alarm).alias("n_alarm")], []
    for i, m in enumerate(methods):
        for j, c in enumerate(conditions):
            e = F.when(conditions[c], errors[m])
            parts = {"n": F.count(e), "bias": F.avg(e), "mse": F.avg(e * e), "sd": F.stddev_samp(e * e)}
            aggs += [x.alias(f"_{i}_{j}_{p}") for p, x in parts.items()]
            rows.append(F.struct(F.lit(m).alias("method"), F.lit(c).alias("cohort"), *(F.col(f"_{i}_{j}_{p}").alias(p) for p in parts)))
    out = df.groupBy(*groups).agg(*aggs).select(*groups, "n_alarm", F.inline(F.array(*rows)))
    root = F.sqrt("mse")
    mcse = F.when(root == 0, 0.0).otherwise(F.col("sd") / F.sqrt("n") / (2 * root))
    return out.select(*groups, "method", "cohort", "n_alarm", "n", "bias", "mse", root.alias("rmse"), mcse.alias("rmse_mcse"))


def method_contrasts(df: DataFrame, groups: list[str], target: str, methods: dict[str, str], cohorts: dict[str, list[str]], truth: str = "truth", alarm: str = "alarm") -> DataFrame:
    """(groups, method_a, method_b, cohort, n_paired, difference, bias_difference, paired_mcse) of every pair of methods.

    difference is the mean of a's squared relative error less b's, on episodes that both have: all of them (`pairwise`), and
    those of each cohort.
    """
    errors = _errors(target, methods, truth, alarm)
    conditions = {PAIR: F.lit(True), **{c: _all_there(errors, names) for c, names in cohorts.items()}}
    aggs, rows = [], []
    for i, (a, b) in enumerate(combinations(methods, 2)):
        for j, c in enumerate(conditions):
            both = conditions[c] & errors[a].isNotNull() & errors[b].isNotNull()
            d = F.when(both, errors[a] * errors[a] - errors[b] * errors[b])
            parts = {"n_paired": F.count(d), "difference": F.avg(d), "bias_difference": F.avg(F.when(both, errors[a] - errors[b])), "sd": F.stddev_samp(d)}
            aggs += [x.alias(f"_{i}_{j}_{p}") for p, x in parts.items()]
            rows.append(F.struct(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), F.lit(c).alias("cohort"), *(F.col(f"_{i}_{j}_{p}").alias(p) for p in parts)))
    out = df.groupBy(*groups).agg(*aggs).select(*groups, F.inline(F.array(*rows)))
    return out.select(*groups, "method_a", "method_b", "cohort", "n_paired", "difference", "bias_difference", (F.col("sd") / F.sqrt("n_paired")).alias("paired_mcse"))


def bank_aggregate(summary: DataFrame, banks: list[str], methods: list[str] | None = None) -> DataFrame:
    """(banks, method, cohort, cells, n_alarm, n, availability, mse, rmse, bias) of a cohort summary: cells weigh alike; null if
    one has no value."""
    every = lambda c: F.when(F.count(c) == F.count("*"), F.avg(c))
    rows = summary if methods is None else summary.where(F.col("method").isin(methods))
    out = rows.groupBy(*banks, "method", "cohort").agg(F.count("*").alias("cells"), F.sum("n_alarm").alias("n_alarm"), F.sum("n").alias("n"), every("mse").alias("mse"), every("bias").alias("bias"))
    return out.select(*banks, "method", "cohort", "cells", "n_alarm", "n", F.try_divide("n", "n_alarm").alias("availability"), "mse", F.sqrt("mse").alias("rmse"), "bias")


def wins_and_ties(contrasts: DataFrame, banks: list[str], cohort: str = PAIR) -> DataFrame:
    """(banks, method, opponent, cells, wins, ties): in how many cells a method's squared error is below the opponent's."""
    rows = contrasts.where(F.col("cohort") == cohort)
    sides = rows.select(*banks, F.inline(F.array(*(F.struct(F.col(f"method_{a}").alias("method"), F.col(f"method_{b}").alias("opponent"), (sign * F.col("difference")).alias("d")) for a, b, sign in (("a", "b", 1), ("b", "a", -1))))))
    return sides.groupBy(*banks, "method", "opponent").agg(F.count("d").alias("cells"), F.count_if(F.col("d") < 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"))
