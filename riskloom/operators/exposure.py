"""Delay laws and exposure: cases convolved with a delay law, as lagged window sums and as a band of cohort sums.

A delay law is a short list of probabilities (lag 1 first for daily series, lag 0 first where offset is 0), so its
terms are literals of the plan. `total_exposure` is one window per series: no rows are multiplied, nothing joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.special import gamma_cdf, normal_cdf
from riskloom.operators.prepare import K, by


def _differences(cdf, max_lag: int) -> list[float]:
    mass = [cdf(i + 1) - cdf(i) for i in range(max_lag)]
    return [m / sum(mass) for m in mass]


def delay_law(kind: str = "gamma", mean: float = 14.0, max_lag: int = 45, shape: float = 4.0, cv: float = 0.5, second_mean: float = 21.0) -> list[float]:
    """Delay masses for lags 1..max_lag of a gamma, a lognormal (by coefficient of variation) or an even mix of two gammas."""
    if kind == "gamma":
        return _differences(lambda x: gamma_cdf(x, shape, mean / shape), max_lag)
    if kind == "lognormal":
        s = math.sqrt(math.log(1 + cv * cv))
        return _differences(lambda x: normal_cdf((math.log(x) - math.log(mean) + s * s / 2) / s) if x > 0 else 0.0, max_lag)
    if kind == "bimodal":
        return _differences(lambda x: 0.5 * gamma_cdf(x, shape, mean / shape) + 0.5 * gamma_cdf(x, shape, second_mean / shape), max_lag)
    raise ValueError(f"unknown delay law {kind}")


def weekly_delay_law(mean: float, weeks: int, parts: int = 512) -> list[float]:
    """Masses for lags of 0..weeks weeks of a gamma of shape 2, averaged over a uniform day in the week (midpoints)."""
    cdf = lambda x: gamma_cdf(x, 2.0, mean / 2.0) if x > 0 else 0.0
    mass = [0.0] * (weeks + 1)
    for i in range(parts):
        start = (i + 0.5) / parts
        for k in range(weeks + 1):
            mass[k] += (cdf(k + 1 - start) - cdf(k - start)) / parts
    return [m / sum(mass) for m in mass]


def delay_table(spark: SparkSession, law: list[float], delay_id: str = "default", offset: int = 1) -> DataFrame:
    return spark.createDataFrame([(delay_id, i + offset, float(p)) for i, p in enumerate(law)], "delay_id string, lag int, p double")


def normalize_pmf(df: DataFrame, keys: list[str] | None = None, tolerance: float = 1e-8) -> DataFrame:
    """p made to sum to one; an error where a law is empty, negative, not finite, or sums to something else."""
    keys = keys or ["delay_id"]
    w = Window.partitionBy(*keys)
    total, least = F.sum("p").over(w), F.min("p").over(w)
    bad = F.coalesce(F.abs(total - 1) > tolerance, F.lit(True)) | (least < 0) | F.isnan(total)
    return df.withColumn("p", F.when(bad, F.raise_error(F.lit("not a delay law")).cast("double")).otherwise(F.col("p") / total))


def delay_median(df: DataFrame, keys: list[str] | None = None, offset: int = 0) -> DataFrame:
    """First lag with half of the mass or more, plus offset."""
    keys = keys or ["delay_id"]
    running = F.sum("p").over(by(keys, "lag").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_run", running).where("_run >= 0.5").groupBy(*keys).agg((F.min("lag") + offset).alias("median"))


def total_exposure(df: DataFrame, law: list[float], keys: list[str] = K, offset: int = 1, start: int | None = None, end: int | None = None, col: str = "cases", name: str = "x") -> DataFrame:
    """df (dense in t) with x_s = sum of cases_u * law(s - u), cohorts u in [start, end) only."""
    cohort = F.col(col)
    if start is not None:
        cohort = F.when(F.col("t") >= start, cohort).otherwise(0.0)
    if end is not None:
        cohort = F.when(F.col("t") < end, cohort).otherwise(0.0)
    out, w = df.withColumn("_cohort", cohort), by(keys)
    terms = [F.lag("_cohort", i + offset, 0.0).over(w) * p if i + offset else F.col("_cohort") * p for i, p in enumerate(law)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return out.withColumn(name, total).drop("_cohort")


def risk_path(kind: str, left: float, right: float, change: int, duration: float = 14.0) -> Column:
    """Risk by cohort day: a step at change, or a logistic path that goes from 10 to 90 % in `duration` days around it."""
    if kind == "step":
        return F.when(F.col("t") >= change, right).otherwise(left)
    slope = 2 * math.log(9.0) / duration
    return left + (right - left) / (1 + F.exp(-slope * (F.col("t") - change)))


def expected_deaths(df: DataFrame, law: list[float], risk: Column, keys: list[str] = K, offset: int = 1) -> DataFrame:
    return total_exposure(df.withColumn("_risked", F.col("cases") * risk), law, keys, offset, col="_risked", name="expected").drop("_risked")


def post_exposure(df: DataFrame, law: list[float], keys: list[str] = K, offset: int = 1) -> DataFrame:
    """The band of (keys, tau, s, b): exposure at s of cohorts from tau on, for s in [tau + offset, tau + L - 1 + offset).

    Before the band b is 0, after it b is the total exposure. n * L rows instead of n * n.
    """
    n = F.max("t").over(Window.partitionBy(*keys)) + 1
    masses = F.array(*(F.lit(float(p)) for p in law))
    rows = df.withColumn("_n", n).select(*keys, "_n", F.col("t").alias("tau"), "cases", F.posexplode(masses).alias("lag", "p"))
    rows = rows.withColumn("s", F.col("tau") + F.col("lag") + offset).where("s < _n")
    later = Window.partitionBy(*keys, "s").orderBy(F.col("tau").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("b", F.sum(F.col("cases") * F.col("p")).over(later))
    return out.where(f"tau >= 1 and lag < {len(law) - 1}").select(*keys, "tau", "s", "b")


def two_rate_design(df: DataFrame, law: list[float], tau: Column | int, keys: list[str] = K, offset: int = 1, observation_start: int = 0) -> DataFrame:
    """Rows with a = exposure of cohorts before tau and b = from tau on, from observation_start or with exposure."""
    tau = F.lit(tau) if isinstance(tau, int) else tau
    out = total_exposure(df, law, keys, offset)
    out = total_exposure(out.withColumn("_late", F.when(F.col("t") >= tau, F.col("cases")).otherwise(0.0)), law, keys, offset, col="_late", name="b").drop("_late")
    return out.withColumn("a", F.col("x") - F.col("b")).where((F.col("t") >= observation_start) & (F.col("x") > 1e-12))
