"""Data checks: each gives the rows that break a rule, and none where all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _any(conditions):
    return reduce(lambda a, b: a | b, conditions)


def check_contract(df: DataFrame, required: dict[str, list[str]], nullable: tuple[str, ...] = (), group: str = "experiment") -> DataFrame:
    """(group, column, n_bad): missing groups, NULLs in a group's required columns, statuses other than success."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(g,) for g in required], f"{group} string")
    absent = wanted.join(df.select(group).distinct(), group, "left_anti").select(group, F.lit("*").alias("column"), F.lit(1).cast("long").alias("n_bad"))
    counts = [F.count_if(F.col(group).isin([g for g, cols in required.items() if c in cols]) & F.col(c).isNull()).alias(c) for c in sorted({c for v in required.values() for c in v} - {*nullable})]
    status = F.count_if(F.col("status") != "success").alias("status!")
    wide = df.groupBy(group).agg(*counts, status)
    long = wide.unpivot(group, [c for c in wide.columns if c != group], "column", "n_bad").where("n_bad > 0")
    return absent.unionByName(long)


def check_binary(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Rows with values other than 0, 1, true or false (as text or not)."""
    ok = lambda c: F.coalesce(F.lower(F.col(c).cast("string")).isin("0", "1", "true", "false", "0.0", "1.0"), F.lit(False))
    return df.where(_any([~ok(c) for c in columns])).select(*keys, *columns)


def check_shared_streams(df: DataFrame, keys: list[str], digest: str = "stream_hash", method: str = "method", arm: list[str] | None = None) -> DataFrame:
    """(keys, problem): short hashes, several hashes on a key, repeated methods, and replicates whose methods differ from their arm's."""
    arm = arm or keys[:-1]
    cells = df.groupBy(*keys).agg(F.min(F.length(digest)).alias("_short"), F.countDistinct(digest).alias("_n"), F.count("*").alias("_rows"), F.array_sort(F.collect_set(method)).alias("_set"))
    sets = cells.groupBy(*arm).agg(F.countDistinct("_set").alias("_sets"))
    joined = cells.join(sets, arm)
    problems = F.array_compact(F.array(
        F.when(F.coalesce(F.col("_short") < 12, F.lit(True)), "short hash"), F.when(F.col("_n") > 1, "several hashes"),
        F.when(F.col("_rows") > F.size("_set"), "repeated method"), F.when(F.col("_sets") > 1, "methods differ"),
    ))
    return joined.select(*keys, F.explode(problems).alias("problem"))


def check_grid(df: DataFrame, n: int, methods: list[str], constant: list[str] | None = None, seed: str | None = None) -> DataFrame:
    """(scenario, method, replicate, problem): cells of scenario x method x 0..n-1 that lack or repeat, and others; metadata that vary."""
    spark = df.sparkSession
    table = spark.createDataFrame([(m,) for m in methods], "method string")
    grid = df.select("scenario").distinct().crossJoin(F.broadcast(table)).select("scenario", "method", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("replicate"))
    seen = df.groupBy("scenario", "method", F.col("replicate").cast("long").alias("replicate")).agg(F.count("*").alias("_n"))
    both = grid.withColumn("_g", F.lit(1)).join(seen, ["scenario", "method", "replicate"], "full")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_g").isNull(), "extra").when(F.col("_n") > 1, "repeated")
    out = both.select("scenario", "method", "replicate", problem.alias("problem")).where("problem is not null")
    none = lambda t: F.lit(None).cast(t)
    for c in constant or []:
        varied = df.groupBy("scenario").agg(F.countDistinct(c).alias("_n")).where("_n > 1")
        out = out.union(varied.select("scenario", none("string"), none("long"), F.lit(f"{c} varies")))
    if seed:
        varied = df.groupBy("scenario", "replicate").agg(F.countDistinct(seed).alias("_n")).where("_n > 1")
        out = out.union(varied.select("scenario", none("string"), F.col("replicate").cast("long"), F.lit("several seeds")))
    return out


def check_alarms(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose alarm is out of 1..horizon, stands on a failed or wholly unavailable row, or whose tau is out of 1..alarm."""
    alarm, tau = F.col("alarm_day"), F.col("tau_hat_at_alarm")
    bad = alarm.isNotNull() & (
        ~alarm.between(1, F.col("horizon")) | F.coalesce("all_looks_unavailable", F.lit(False)) | (F.col("status") != "success") | F.coalesce(~tau.between(1, alarm), F.lit(False))
    )
    return df.where(bad | (alarm.isNull() & tau.isNotNull())).select(*keys, "alarm_day", "tau_hat_at_alarm")


def check_estimation_cohort(estimates: DataFrame, evaluation: DataFrame, keys: list[str], targets: list[str]) -> DataFrame:
    """(keys, problem): rows that lack or exceed, alarms that differ, intervals without points, points without alarms, invented values."""
    left = evaluation.select(*keys, F.col("alarm_day").alias("_alarm"), F.lit(1).alias("_in"))
    both = estimates.withColumn("_out", F.lit(1)).join(left, keys, "full")
    tests = [
        F.when(F.col("_out").isNull(), "missing"), F.when(F.col("_in").isNull(), "extra"),
        F.when(F.col("_in").isNotNull() & F.col("_out").isNotNull() & ~F.col("alarm_day").eqNullSafe(F.col("_alarm")), "alarm differs"),
    ]
    for t in targets:
        point, interval = (F.coalesce(F.col(f"{t}_{k}_valid"), F.lit(False)) for k in ("point", "interval"))
        tests += [F.when(interval & ~point, f"{t} interval without point"), F.when(point & F.col("alarm_day").isNull(), f"{t} point without alarm"), F.when(~point & F.col(f"{t}_estimate").isNotNull(), f"{t} invented")]
    return both.select(*keys, F.explode(F.array_compact(F.array(*tests))).alias("problem"))


def check_frozen_columns(source: DataFrame, derived: DataFrame, keys: list[str], columns: list[str], rtol: float = 1e-12, atol: float = 0.0) -> DataFrame:
    """(keys, column): derived values that are not the source's within tolerance; rows that are missing give column *."""
    right = derived.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(1).alias("_in"))
    both = source.select(*keys, *columns).join(right, keys, "left")
    tests = [F.when(F.col("_in").isNull(), "*")]
    kinds = dict(source.dtypes)
    for c in columns:
        a, b = F.col(c), F.col(f"_{c}")
        same = a.eqNullSafe(b)
        if kinds[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False))
        tests.append(F.when(F.col("_in").isNotNull() & ~same, c))
    return both.select(*keys, F.explode(F.array_compact(F.array(*tests))).alias("column"))


def check_disjoint_banks(a: DataFrame, b: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Keys on which two banks share a content hash."""
    return a.select(*keys, digest).join(b.select(*keys, digest), [*keys, digest]).distinct()


def check_trace_replay(episodes: DataFrame, looks: list[int], keys: list[str], trace: str = "trace") -> DataFrame:
    """(keys, problem): saved first crossings that the trace does not give again, and look calendars that differ."""
    again = F.array_min(F.expr(f"transform(filter({trace}, x -> x.status = 'available' and x.statistic > critical_value), x -> x.day)"))
    days = F.expr(f"transform({trace}, x -> x.day)")
    tests = F.array(F.when(~again.eqNullSafe(F.col("alarm_day")), "alarm"), F.when(days != F.array(*(F.lit(x) for x in looks)), "calendar"))
    return episodes.select(*keys, F.explode(F.array_compact(tests)).alias("problem"))


def check_digest(df: DataFrame, declared: str, column: str = "scientific_digest") -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(F.lit(declared))).groupBy(column).agg(F.count("*").alias("n"))


def check_thresholds(thresholds: DataFrame, families: DataFrame, methods: list[str], n: int | None = None, alpha: float = 0.05) -> DataFrame:
    """(null_family, method, problem): cells that lack or repeat, counts other than n, ranks that do not follow from it."""
    table = thresholds.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    grid = families.select("null_family").distinct().crossJoin(F.broadcast(table)).withColumn("_g", F.lit(1))
    seen = thresholds.groupBy("null_family", "method").agg(F.count("*").alias("_n"), F.first("n_calibration").alias("_c"), F.first("order_rank").alias("_r"))
    both = grid.join(seen, ["null_family", "method"], "full")
    tests = F.array(
        F.when(F.col("_n").isNull(), "missing"), F.when(F.col("_g").isNull(), "extra"), F.when(F.col("_n") > 1, "repeated"),
        F.when(F.col("_c") != n, "count") if n is not None else F.lit(None).cast("string"), F.when(F.col("_r") != F.ceil((F.col("_c") + 1) * (1 - alpha)), "rank"),
    )
    return both.select("null_family", "method", F.explode(F.array_compact(tests)).alias("problem"))
