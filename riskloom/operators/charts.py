"""Comparator charts on residuals of a frozen reference fit: CUSUM, mean change and likelihood ratio, in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.prepare import K, by, onward

ALLOWANCE = 0.5


def poisson_residuals(df: DataFrame, reference_end: int = 28, keys: list[str] = K, observation_start: int = 0) -> DataFrame:
    """df (with x): constant risk fitted on t < reference_end only, then mean, variance and Pearson residual v on all t."""
    base = (F.col("t") < reference_end) & (F.col("t") >= observation_start) & (F.col("x") > 1e-12)
    w = Window.partitionBy(*keys)
    pi = F.try_divide(F.sum(F.when(base, F.col("deaths"))).over(w), F.sum(F.when(base, F.col("x"))).over(w))
    out = df.withColumn("mean", F.greatest(pi * F.col("x"), F.lit(1e-12))).withColumn("variance", F.col("mean"))
    return out.withColumn("v", (F.col("deaths") - F.col("mean")) / F.sqrt("variance"))


def page_cusum(df: DataFrame, reference_end: int = 28, allowance: float = ALLOWANCE, keys: list[str] = K) -> DataFrame:
    """(keys, t, statistic, start, direction) from reference_end on: two-sided CUSUM, reset at 0; the upper side wins ties.

    S = P - min(0, least P so far) with P the running sum of v - k: the recursion max(0, S + v - k) in closed form.
    """
    rows = df.where(F.col("t") >= reference_end)
    up = by(keys).rowsBetween(Window.unboundedPreceding, 0)
    for side, sign in (("u", 1), ("l", -1)):
        rows = rows.withColumn(f"_p{side}", F.sum(sign * F.col("v") - allowance).over(up))
        rows = rows.withColumn(f"_s{side}", F.col(f"_p{side}") - F.least(F.lit(0.0), F.min(f"_p{side}").over(up)))
        reset = F.max(F.when(F.col(f"_s{side}") <= 0, F.col("t"))).over(up)
        rows = rows.withColumn(f"_b{side}", F.coalesce(reset + 1, F.lit(reference_end)))
    upper = F.col("_su") >= F.col("_sl")
    none = (F.col("_su") <= 0) & (F.col("_sl") <= 0)
    start = F.when(none, F.col("t")).when(upper, F.col("_bu")).otherwise(F.col("_bl"))
    direction = F.when(none, 0).when(upper, 1).otherwise(-1)
    return rows.select(*keys, "t", F.greatest("_su", "_sl").alias("statistic"), start.cast("long").alias("start"), direction.alias("direction"))


def focus_scan(df: DataFrame, reference_end: int = 28, keys: list[str] = K) -> DataFrame:
    """(keys, statistic, start, direction): greatest (suffix sum)^2 / length of residuals over starts from reference_end."""
    down = onward(keys)
    rows = df.where(F.col("t") >= reference_end).withColumn("_sum", F.sum("v").over(down)).withColumn("_n", F.count("*").over(down))
    top = rows.groupBy(*keys).agg(F.max(F.struct((F.col("_sum") * F.col("_sum") / F.col("_n")).alias("q"), (-F.col("t")).alias("m"), "_sum")).alias("top"))
    return top.select(*keys, F.col("top.q").alias("statistic"), (-F.col("top.m")).alias("start"), F.signum("top._sum").cast("int").alias("direction"))


def poisson_glr(y: Column, m: Column) -> Column:
    """Twice the log likelihood ratio of a scaled against the given Poisson mean."""
    return F.when(y <= 0, 2 * m).otherwise(2 * (y * F.log(y / m) - (y - m)))


def glr_scan(df: DataFrame, reference_end: int = 28, keys: list[str] = K) -> DataFrame:
    """(keys, statistic, start, direction): greatest Poisson likelihood ratio of a scale change over starts."""
    down = onward(keys)
    rows = df.where(F.col("t") >= reference_end).withColumn("_y", F.sum("deaths").over(down)).withColumn("_m", F.sum("mean").over(down))
    top = rows.groupBy(*keys).agg(F.max(F.struct(poisson_glr(F.col("_y"), F.col("_m")).alias("q"), (-F.col("t")).alias("m"), (F.col("_y") - F.col("_m")).alias("d"))).alias("top"))
    return top.select(*keys, F.col("top.q").alias("statistic"), (-F.col("top.m")).alias("start"), F.signum("top.d").cast("int").alias("direction"))


def chart_traces(df: DataFrame, looks: DataFrame, reference_end: int = 28, allowance: float = ALLOWANCE, keys: list[str] = K) -> DataFrame:
    """(keys, look, prefix, chart, statistic, start, direction) at every planned look, from one frozen reference fit.

    The CUSUM is read from its daily trace. The likelihood ratio of (look, start) needs the sums over [start, prefix):
    differences of one running sum, joined on the series for the looks' ends.
    """
    daily = page_cusum(df, reference_end, allowance, keys)
    cusum = looks.join(daily, keys).where(F.col("t") == F.col("prefix") - 1).select(*keys, "look", "prefix", F.lit("page_cusum").alias("chart"), "statistic", "start", "direction")
    up = by(keys).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.where(F.col("t") >= reference_end).withColumn("_y", F.sum("deaths").over(up)).withColumn("_m", F.sum("mean").over(up))
    ends = looks.join(sums.select(*keys, F.col("t").alias("_e"), F.col("_y").alias("_ye"), F.col("_m").alias("_me")), keys).where("_e = prefix - 1")
    pairs = ends.join(sums.select(*keys, "t", (F.col("_y") - F.col("deaths")).alias("_y0"), (F.col("_m") - F.col("mean")).alias("_m0")), keys).where("t < prefix")
    y, m = F.col("_ye") - F.col("_y0"), F.col("_me") - F.col("_m0")
    top = pairs.groupBy(*keys, "look", "prefix").agg(F.max(F.struct(poisson_glr(y, m).alias("q"), (-F.col("t")).alias("m"), (y - m).alias("d"))).alias("top"))
    glr = top.select(*keys, "look", "prefix", F.lit("glr").alias("chart"), F.col("top.q").alias("statistic"), (-F.col("top.m")).alias("start"), F.signum("top.d").cast("int").alias("direction"))
    return cusum.union(glr)


def chart_summary(df: DataFrame, reference_end: int = 28, allowance: float = ALLOWANCE, keys: list[str] = K) -> DataFrame:
    """All charts at the series' end: (keys, chart, statistic, start, direction)."""
    last = page_cusum(df, reference_end, allowance, keys).groupBy(*keys).agg(F.max_by(F.struct("statistic", "start", "direction"), "t").alias("x")).select(*keys, "x.*")
    named = [(last, "page_cusum"), (focus_scan(df, reference_end, keys), "focus"), (glr_scan(df, reference_end, keys), "glr")]
    out = None
    for table, name in named:
        part = table.select(*keys, F.lit(name).alias("chart"), F.col("statistic"), F.col("start").cast("long"), F.col("direction").cast("int"))
        out = part if out is None else out.unionByName(part)
    return out


def cohort_proxy(day: Column, median: int) -> Column:
    """Cohort day of a report day: the delay's median earlier, 0 at least."""
    return F.greatest(F.lit(0), day - median)
