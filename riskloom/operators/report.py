"""Report tables over episode rows: grouped, joined and pivoted with DataFrame operations only, but for interval limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.intervals import mean_t_interval, null_quantile_bracket, probability_summary

CELL = ["stage", "scenario", "method"]


def timely_flag(window: int = 28, alarm: str = "alarm_day", change: str = "true_change") -> Column:
    day = F.col(alarm)
    return F.coalesce((day >= F.col(change)) & (day <= F.col(change) + window), F.lit(False))


def summarize_binary(df: DataFrame, groups: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    return probability_summary(df, groups, F.col(value).cast("boolean"), confidence)


def rejection_and_coverage(df: DataFrame, groups: list[str], p: str, alphas: list[float], lower: str, upper: str, truth: str, estimate: str) -> DataFrame:
    """(groups, measure, level, n, events, estimate): rejections per nominal alpha, coverage, and mean relative bias."""
    pieces = None
    for a in alphas:
        part = df.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(F.col(p) <= a).alias("events")).withColumn("measure", F.lit("rejection")).withColumn("level", F.lit(a))
        pieces = part if pieces is None else pieces.unionByName(part)
    covered = F.coalesce((F.col(lower) <= F.col(truth)) & (F.col(truth) <= F.col(upper)), F.lit(False))
    cover = df.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(covered).alias("events")).withColumn("measure", F.lit("coverage")).withColumn("level", F.lit(None).cast("double"))
    out = pieces.unionByName(cover).withColumn("estimate", F.col("events") / F.col("n"))
    relative = F.col(estimate) / F.col(truth) - 1
    bias = df.groupBy(*groups).agg(F.count(relative).alias("n"), F.avg(relative).alias("estimate")).withColumn("measure", F.lit("relative_bias")).withColumn("level", F.lit(None).cast("double")).withColumn("events", F.lit(None).cast("long"))
    return out.unionByName(bias).select(*groups, "measure", "level", "n", "events", "estimate")


def cumulative_error_paths(looks: DataFrame, groups: list[str], crossed: str = "crossed") -> DataFrame:
    """(groups, look, n, events, probability): episodes alarmed by each look; `falls` marks a look below the one before."""
    keyed = looks.groupBy(*groups, "replicate", "look").agg(F.bool_or(F.col(crossed)).alias("_c"))
    ever = F.max(F.col("_c").cast("int")).over(Window.partitionBy(*groups, "replicate").orderBy("look").rowsBetween(Window.unboundedPreceding, 0))
    out = keyed.withColumn("_e", ever).groupBy(*groups, "look").agg(F.count("*").alias("n"), F.sum("_e").alias("events"))
    out = out.withColumn("probability", F.col("events") / F.col("n"))
    before = F.lag("probability").over(Window.partitionBy(*groups).orderBy("look"))
    return out.withColumn("falls", F.coalesce(F.col("probability") < before - 1e-12, F.lit(False)))


def pooled_paths(paths: DataFrame, groups: list[str], path: str) -> DataFrame:
    """(groups, look, n, probability, least, most): n-weighted mean over paths and its range."""
    return paths.groupBy(*groups, "look").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("probability")) / F.sum("n")).alias("probability"), F.min("probability").alias("least"), F.max("probability").alias("most"), F.countDistinct(path).alias("paths")
    )


def final_looks(paths: DataFrame, groups: list[str]) -> DataFrame:
    """Each path at its last look."""
    return paths.groupBy(*groups).agg(F.max("look").alias("look"), F.max_by("n", "look").alias("n"), F.max_by("probability", "look").alias("probability"))


def operating_table(df: DataFrame, cells: DataFrame, groups: list[str], window: int = 28) -> DataFrame:
    """Timely share and conditional median localization error and delay of every cell; cells without rows stay."""
    timely = timely_flag(window)
    delay = F.col("alarm_day") - F.col("true_change")
    out = df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(timely.cast("double")).alias("timely"), F.percentile(F.when(timely, F.abs(F.col("tau_hat_at_alarm") - F.col("true_change"))), 0.5).alias("median_localization"),
        F.percentile(F.when(timely, delay), 0.5).alias("median_delay"),
    )
    return cells.select(*groups).distinct().join(out, groups, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def comparison_table(df: DataFrame, groups: list[str], outcome: str, primary: str, methods: list[str]) -> DataFrame:
    """(groups, comparator, n, difference): paired difference primary - comparator on replicates that have both; one pivot."""
    wide = df.groupBy(*groups, "replicate").pivot("method", methods).agg(F.max(F.col(outcome).cast("double")))
    out = None
    for m in methods:
        if m == primary:
            continue
        d = F.col(primary) - F.col(m)
        part = wide.groupBy(*groups).agg(F.count(d).alias("n"), F.avg(d).alias("difference"), F.stddev_samp(d).alias("sd")).withColumn("comparator", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out.select(*groups, "comparator", "n", "difference", "sd")


def tolerance_table(df: DataFrame, label: str, order: str, outcome_alternative: Column, outcome_null: Column, purpose: str = "purpose") -> DataFrame:
    """Outcome share per perturbation label (in its order) and purpose: the outcome that is asked of that purpose."""
    value = F.when(F.col(purpose) == "null", outcome_null).otherwise(outcome_alternative)
    return df.groupBy(order, label, purpose).agg(F.count("*").alias("n"), F.count_if(F.coalesce(value, F.lit(False))).alias("events")).withColumn("estimate", F.col("events") / F.col("n"))


def method_matrix(df: DataFrame, value: str, methods: list[str], row: str = "scenario") -> DataFrame:
    """A row per scenario, a column per method in the given order."""
    return df.groupBy(row).pivot("method", methods).agg(F.first(value))


def derive_flags(df: DataFrame) -> DataFrame:
    """One-based days, failed, any_alarm, alternative, premature, useful and delay; failed rows never alarm."""
    day = F.col("alarm_day") + 1
    out = df.withColumn("alarm_day_one", day).withColumn("failed", F.col("status") != "success").withColumn("any_alarm", F.col("alarm_day").isNotNull() & (F.col("status") == "success"))
    out = out.withColumn("alternative", F.abs(F.col("risk_ratio") - 1) > 1e-9)
    out = out.withColumn("premature", F.col("any_alarm") & F.col("alternative") & (day < F.col("true_change_day")))
    out = out.withColumn("useful", F.col("any_alarm") & F.col("alternative") & (day >= F.col("true_change_day")))
    return out.withColumn("delay", F.when(F.col("useful"), day - F.col("true_change_day")))


def episode_summary(flags: DataFrame, groups: list[str] = CELL) -> DataFrame:
    """(groups, metric, n, events, estimate) long: alarm for all, useful and premature for alternatives; every episode counts."""
    wide = flags.groupBy(*groups).agg(
        F.count("*").alias("n"), F.bool_or("alternative").alias("_alt"), F.count_if("any_alarm").alias("alarm_probability"), F.count_if("useful").alias("useful_power"),
        F.count_if("premature").alias("premature_probability"), F.count_if("failed").alias("failed"), F.count_if(~F.col("any_alarm")).alias("absent"),
    )
    metrics = ["alarm_probability", "useful_power", "premature_probability", "failed", "absent"]
    long = wide.unpivot([*groups, "n", "_alt"], metrics, "metric", "events").where("_alt or metric not in ('useful_power', 'premature_probability')")
    return long.drop("_alt").withColumn("estimate", F.col("events") / F.col("n"))


def cumulative_detection_curve(flags: DataFrame, groups: list[str] = CELL) -> DataFrame:
    """(groups, delay, n, events, estimate) for delays 0..horizon - change: a histogram and its running sum."""
    alt = flags.where("alternative")
    size = alt.groupBy(*groups).agg(F.count("*").alias("n"), F.max(F.col("horizon") - F.col("true_change_day")).alias("_last"))
    grid = size.select(*groups, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))).alias("delay"))
    seen = alt.where("useful").groupBy(*groups, F.col("delay").cast("long").alias("delay")).agg(F.count("*").alias("_k"))
    running = F.sum(F.coalesce("_k", F.lit(0))).over(Window.partitionBy(*groups).orderBy("delay").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(seen, [*groups, "delay"], "left").withColumn("events", running).select(*groups, "delay", "n", "events", (F.col("events") / F.col("n")).alias("estimate"))


def failure_table(df: DataFrame, groups: list[str] = CELL) -> DataFrame:
    return df.groupBy(*groups, "status").agg(F.count("*").alias("n"), F.sum("unavailable_looks").alias("invalid_looks"))


def paired_contrasts(flags: DataFrame, methods: list[str], outcome: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, a, b, n, difference, mcse, a_only, b_only) of every pair of methods in order; one pivot, then sums."""
    groups = groups or ["stage", "scenario"]
    wide = flags.groupBy(*groups, "replicate").pivot("method", methods).agg(F.max(F.col(outcome).cast("int")))
    out = None
    for i, a in enumerate(methods):
        for b in methods[i + 1 :]:
            d = F.col(a) - F.col(b)
            part = wide.groupBy(*groups).agg(F.count(d).alias("n"), F.avg(d).alias("difference"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("mcse"), F.count_if(d == 1).alias("a_only"), F.count_if(d == -1).alias("b_only"))
            part = part.select(*groups, F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "difference", "mcse", "a_only", "b_only")
            out = part if out is None else out.unionByName(part)
    return out


def localization_summary(flags: DataFrame, groups: list[str] = CELL) -> DataFrame:
    """Mean absolute location error at useful alarms, with a t interval; each method has its own denominator."""
    return mean_t_interval(flags.where("useful").withColumn("_e", F.abs(F.col("tau_hat_at_alarm") - F.col("true_change")).cast("double")), groups, "_e")


def trace_maxima(looks: DataFrame, keys: list[str], change: str = "true_change") -> DataFrame:
    """Greatest raw statistic before and from the change on, and unavailable looks; a repeated or misordered look is an error."""
    ok = F.col("status") == "available"
    out = looks.groupBy(*keys).agg(
        F.max(F.when(ok & (F.col("day") < F.col(change)), F.col("statistic"))).alias("before"), F.max(F.when(ok & (F.col("day") >= F.col(change)), F.col("statistic"))).alias("after"),
        F.count_if(~ok).alias("unavailable"), F.count("*").alias("_n"), F.countDistinct("day").alias("_d"),
    )
    checked = F.when(F.col("_n") != F.col("_d"), F.raise_error(F.lit("looks repeat")).cast("long")).otherwise(F.col("unavailable"))
    return out.select(*keys, "before", "after", checked.alias("unavailable"))


def standardized_power(maxima: DataFrame, null_maxima: DataFrame, value: str, groups: list[str], null_groups: list[str], q: float = 0.95, error: float = 0.02) -> DataFrame:
    """Useful = before <= c and after > c at the null's q quantile c, with envelopes from the bracket around it.

    The lower envelope takes an alarm before the change at the low end and after it at the high end; the upper the reverse.
    A missing end of the bracket is minus infinity below and infinity above.
    """
    cut = null_quantile_bracket(null_maxima, null_groups, value, q, error).select(*null_groups, "cutoff", "low", "high")
    before, after = F.coalesce("before", F.lit(float("-inf"))), F.coalesce("after", F.lit(float("-inf")))
    low, high = F.coalesce("low", F.lit(float("-inf"))), F.coalesce("high", F.lit(float("inf")))
    joined = maxima.join(cut, null_groups)
    useful = (before <= F.col("cutoff")) & (after > F.col("cutoff"))
    return joined.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(useful).alias("events"), F.count_if((before <= low) & (after > high)).alias("lower_events"), F.count_if((before <= high) & (after > low)).alias("upper_events"))


def sensitivity_union(banks: list[DataFrame], labels: list[str], drop: str = "ascertainment") -> tuple[DataFrame, DataFrame]:
    """All banks' rows but those of the dropped misspecification, and the roster of rows per bank."""
    out = None
    for bank, label in zip(banks, labels, strict=True):
        part = bank.where(F.coalesce(F.col("misspecification") != drop, F.lit(True))).withColumn("evidence_source", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out, out.groupBy("evidence_source", "scenario").agg(F.count("*").alias("rows"))


def sensitivity_selection(df: DataFrame, pattern: str = r"delay[_-](\w+)", column: str | None = None, phis: list[float] | None = None) -> DataFrame:
    """Delay setting from a column or the scenario's name; rows on model or with a delay error; the phi grid must be whole."""
    setting = F.regexp_extract("scenario", pattern, 1)
    setting = F.coalesce(F.col(column), setting) if column else setting
    out = df.withColumn("delay_setting", F.when(setting == "", "on_model").otherwise(setting)).where(F.coalesce(F.col("misspecification"), F.lit("none")).isin("none", "delay"))
    if phis is not None:
        grid = df.sparkSession.createDataFrame([(float(p),) for p in phis], "phi double")
        lacking = grid.join(out.select("phi").distinct(), "phi", "left_anti").take(3)
        if lacking:
            raise ValueError(f"no rows for phi {[x[0] for x in lacking]}")
    return out


def cell_index(cells: DataFrame, families: list[str]) -> DataFrame:
    """Design cells numbered from 1 by family in the given order, change and risk ratio."""
    order = F.array_position(F.array(*(F.lit(x) for x in families)), F.col("family"))
    rows = cells.select("family", "true_change", "risk_ratio").distinct().withColumn("_o", order)
    return rows.withColumn("cell", F.row_number().over(Window.orderBy("_o", "true_change", "risk_ratio"))).drop("_o")
