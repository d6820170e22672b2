"""Episode tables: one row per scenario, replicate and method, with a trace of looks; calibration, thresholds, alarms.

Traces stay nested (ARRAY<STRUCT>) unless looks are what is counted; thresholds are a small table, broadcast.
An unavailable look has no statistic (null here, -inf in the source): it never alarms and stays in denominators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPISODE = ["scenario", "replicate", "method"]
LOOK = "struct<look:int,day:int,statistic:double,boundary:double,tau_hat:int,direction:int,status:string>"
WINDOW = 28


def flatten_trace(episodes: DataFrame, trace: str = "trace") -> DataFrame:
    """A row per look; episodes without looks have none."""
    return episodes.select(*[c for c in episodes.columns if c != trace], F.inline(trace))


def nest_trace(looks: DataFrame, keys: list[str], fields: list[str], trace: str = "trace") -> DataFrame:
    """An episode row with its looks in order of the first field."""
    return looks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(trace))


def trace_to_json(episodes: DataFrame, trace: str = "trace") -> DataFrame:
    return episodes.withColumn("trace_json", F.to_json(trace)).drop(trace)


def read_traces(df: DataFrame, column: str = "trace_json", look: str = LOOK) -> DataFrame:
    """JSON traces as arrays of structs."""
    return df.withColumn("trace", F.from_json(column, f"array<{look}>")).drop(column)


def episode_maximum(episodes: DataFrame, trace: str = "trace") -> DataFrame:
    """Greatest available statistic with its first day, tau and direction; counts of unavailable looks."""
    order = "transform(filter({0}, x -> x.status = 'available'), x -> named_struct('s', x.statistic, 'd', -x.day, 'tau', x.tau_hat, 'dir', x.direction))".format(trace)
    top = F.array_max(F.expr(order))
    unavailable = F.size(F.expr(f"filter({trace}, x -> x.status <> 'available')"))
    return episodes.withColumn("_top", top).select(
        *[c for c in episodes.columns if c != trace], F.col("_top.s").alias("episode_statistic"), (-F.col("_top.d")).alias("day_max"), F.col("_top.tau").alias("tau_max"),
        F.col("_top.dir").alias("direction_max"), unavailable.alias("unavailable_looks"), F.col("_top").isNull().alias("all_looks_unavailable"),
    )


def calibrate(maxima: DataFrame, alpha: float = 0.05, keys: list[str] | None = None, statistic: str = "episode_statistic", expected: int | None = None, status: str | None = None, unit: list[str] | None = None) -> DataFrame:
    """(keys, n_calibration, order_rank, critical_value): rank ceil((n + 1)(1 - alpha)) of the episode maxima, in double arithmetic.

    Episodes without an available look rank below all (their value is null); a rank above n gives no value. Values that
    are no numbers, numbers of rows other than `expected`, rows whose `status` is not 'success' and episodes (`unit`)
    that come twice are refused. The order statistic of a group of any size is found by counting: quantiles that are
    known to a tenth of the bracket's width enclose the rank, what lies below is counted, and the values inside are
    counted by value, so that ties are one row; only these are put in order.
    """
    keys = keys or ["null_family", "method"]
    share, slack = 1 - alpha, 0.001
    rows = maxima.select(*keys, F.coalesce(F.col(statistic), F.lit(float("-inf"))).alias("_v"), (F.col(status) != "success" if status else F.lit(False)).alias("_failed"), *([F.struct(*unit).alias("_unit")] if unit else []))
    place = lambda p: F.expr(f"percentile_approx(_v, {min(max(p, 0.0), 1.0)}, 10000)")
    bad = F.count_if(F.isnan("_v") | (F.col("_v") == float("inf")) | F.coalesce("_failed", F.lit(True)))
    size = rows.groupBy(*keys).agg(F.count("*").alias("n_calibration"), place(share - slack).alias("_lo"), place(share + slack).alias("_near"), F.max("_v").alias("_top"), bad.alias("_bad"))
    # the rank is at most one above the share of n, which the upper quantile passes if its slack is a row or more
    size = size.withColumn("order_rank", F.ceil((F.col("n_calibration") + 1) * F.lit(share))).withColumn("_hi", F.when(F.col("n_calibration") * (slack - 1e-4) >= 2, F.col("_near")).otherwise(F.col("_top")))
    joined = rows.join(size.select(*keys, "_lo", "_hi"), keys)
    below = joined.groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"))
    inside = joined.where("_v >= _lo and _v <= _hi").groupBy(*keys, "_v").agg(F.count("*").alias("_m")).join(below, keys)
    upto = F.col("_below") + F.sum("_m").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).join(size.select(*keys, "order_rank"), keys)
    found = found.groupBy(*keys).agg(F.min(F.when(F.col("_upto") >= F.col("order_rank"), F.col("_v"))).alias("_value"), F.first("_below").alias("_below"))
    out = size.join(found, keys, "left")
    if unit:
        twice = rows.groupBy(*keys, "_unit").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("_most"))
        out = out.join(twice, keys)
    refused = (F.col("_bad") > 0) | (F.col("_most") > 1 if unit else F.lit(False)) | (F.col("n_calibration") != expected if expected is not None else F.lit(False))
    missed = (F.col("order_rank") <= F.col("n_calibration")) & (F.col("_value").isNull() | (F.col("_below") >= F.col("order_rank")))
    raised = lambda text: F.raise_error(F.lit(text)).cast("double")
    value = F.when(refused, raised("calibration rows are incomplete, failed, repeated or not numbers")).when(missed, raised("the quantiles do not enclose the rank"))
    value = value.when(F.col("order_rank") <= F.col("n_calibration"), F.when(F.col("_value") > float("-inf"), F.col("_value")))
    return out.select(*keys, "n_calibration", "order_rank", value.alias("critical_value"))


def threshold_version(thresholds: DataFrame) -> DataFrame:
    """First 16 hex digits of the SHA-256 of a threshold's identity."""
    text = F.concat_ws("|", "null_family", "method", F.col("n_calibration").cast("string"), F.col("order_rank").cast("string"), F.when(F.col("critical_value").isNull(), "none").otherwise(F.format_string("%.6f", "critical_value")))
    return thresholds.withColumn("threshold_version", F.left(F.sha2(text, 256), F.lit(16)))


def apply_thresholds(episodes: DataFrame, thresholds: DataFrame, trace: str = "trace") -> DataFrame:
    """First available look with statistic > critical value (strictly): alarm_day and tau_hat_at_alarm, else null.

    Looks compare statistic - boundary where they have a boundary. An episode that no threshold covers is an error.
    """
    table = thresholds.select("null_family", "method", "critical_value", F.lit(True).alias("_covered"))
    joined = episodes.join(table, ["null_family", "method"], "left")
    first = F.expr(f"filter({trace}, x -> x.status = 'available' and x.statistic - coalesce(x.boundary, 0D) > critical_value)")
    ordered = F.get(F.array_sort(first), F.lit(0))
    covered = F.when(F.col("_covered").isNull(), F.raise_error(F.lit("an episode has no threshold")).cast("boolean")).otherwise(F.lit(True))
    out = joined.withColumn("_first", F.when(covered, ordered))
    return out.withColumn("alarm_day", F.col("_first.day")).withColumn("tau_hat_at_alarm", F.col("_first.tau_hat")).drop("_first", "_covered")


def alarm_outcomes(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Flags of each episode: alarm, premature, postchange, no_postchange, no_alarm, within_window, and errors by alarm."""
    day, change = F.col("alarm_day"), F.col("true_change")
    alarm = day.isNotNull()
    post = alarm & (day >= change)
    return (
        df.withColumn("alarm", alarm).withColumn("premature", alarm & (day < change)).withColumn("postchange", post).withColumn("no_postchange", ~post)
        .withColumn("no_alarm", ~alarm).withColumn("within_window", post & (day <= change + window))
        .withColumn("localization_error", F.when(post, F.abs(F.col("tau_hat_at_alarm") - change)))
        .withColumn("restricted_delay", F.when(post, day - change).otherwise(F.col("horizon") - change))
    )


def size_gate(df: DataFrame, low: float = 0.04, high: float = 0.06, confidence: float = 0.9, keys: list[str] | None = None) -> DataFrame:
    """Alarm shares of audit cells, their exact interval, and whether it lies in [low, high]."""
    from riskloom.functions.special import binomial_interval

    keys = keys or ["null_family", "method"]
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("alarm_day").isNotNull()).alias("alarms"))
    out = out.withColumn("size", F.col("alarms") / F.col("n")).withColumn("_i", binomial_interval(F.col("alarms"), F.col("n"), confidence))
    return out.select(*keys, "n", "alarms", "size", "_i.lower", "_i.upper").withColumn("passes", (F.col("lower") >= low) & (F.col("upper") <= high))


def episode_metrics(df: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """Premature, post-change and timely shares, mean restricted and median delay, localization error and bias."""
    flags = alarm_outcomes(df, window)
    share = lambda c: F.avg(F.col(c).cast("double"))
    capped = F.when(F.col("postchange"), F.col("alarm_day") - F.col("true_change")).otherwise(F.col("horizon") - F.col("true_change") + 1)
    delay = F.when(F.col("postchange"), F.col("alarm_day") - F.col("true_change"))
    return flags.groupBy(*keys).agg(
        F.count("*").alias("n"), share("premature").alias("premature_probability"), share("postchange").alias("post_probability"), share("within_window").alias("timely_probability"),
        F.avg(capped).alias("restricted_mean_delay"), F.percentile(delay, 0.5).alias("median_delay"), F.percentile("localization_error", 0.5).alias("median_localization"),
        F.percentile("localization_error", 0.9).alias("p90_localization"), F.avg(F.when(F.col("postchange"), F.col("tau_hat_at_alarm") - F.col("true_change"))).alias("localization_bias"),
    )


def select_stage(df: DataFrame, stage: str, scenarios: list[str] | None = None) -> DataFrame:
    """Rows of one split (and of the named scenarios; a name that no row has is an error)."""
    out = df.where(F.col("split") == stage)
    if scenarios is None:
        return out
    names = df.sparkSession.createDataFrame([(x,) for x in scenarios], "scenario string")
    unknown = names.join(df.select("scenario").distinct(), "scenario", "left_anti").take(5)
    if unknown:
        raise ValueError(f"unknown scenarios: {[x[0] for x in unknown]}")
    return out.where(F.col("scenario").isin(scenarios))


def relabel_null(df: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    return df.withColumn("split", F.when(F.abs(F.col("risk_ratio") - 1) <= tolerance, "null").otherwise(F.col("split")))


def attach_fits(df: DataFrame, fits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fit columns joined one to one; a key with several fit rows is an error."""
    keys = keys or ["scenario", "replicate"]
    w = Window.partitionBy(*keys)
    once = fits.withColumn("_n", F.count("*").over(w))
    checked = once.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("several fits for one episode")).cast("long")).otherwise(F.col("_n")))
    return df.join(checked.where("_n = 1").drop("_n"), keys, "left")


def first_alarm(trace: DataFrame, keys: list[str], crossed: str | Column = "crossed") -> DataFrame:
    """Earliest look with a crossing per series; looks after it change nothing."""
    c = F.col(crossed) if isinstance(crossed, str) else crossed
    rest = [x for x in trace.columns if x not in keys]
    return trace.where(c).groupBy(*keys).agg(F.min_by(F.struct(*rest), "look").alias("x")).select(*keys, "x.*")


def monitor_until_alarm(trace: DataFrame, keys: list[str]) -> DataFrame:
    """The looks up to and with the first crossing."""
    first = F.min(F.when(F.col("crossed"), F.col("look"))).over(Window.partitionBy(*keys))
    return trace.withColumn("_first", first).where("_first is null or look <= _first").drop("_first")


def monitor_summary(trace: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Per series: dates, observations, looks, alarm, its date, change, statistic, boundary and share of alpha spent."""
    base = trace.groupBy(*keys).agg(F.min("start_date").alias("start_date"), F.max("date").alias("end_date"), F.max("prefix").alias("n_observations"), F.count("*").alias("n_looks"))
    alarm = first_alarm(trace, keys).select(*keys, F.lit(True).alias("_a"), F.col("look").alias("alarm_look"), F.col("date").alias("alarm_date"), F.col("tau_hat").alias("change"), F.col("statistic").alias("alarm_statistic"), F.col("boundary").alias("alarm_boundary"))
    out = base.join(alarm, keys, "left").withColumn("alarm", F.coalesce("_a", F.lit(False))).drop("_a")
    return out.withColumn("alpha_spent", alpha * F.col("alarm_look") / F.col("n_looks"))
