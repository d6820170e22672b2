"""Preparation of series: long tables (series, t, date, cases, deaths) from events or counts.

Windows are partitioned by the series' key columns, so a series lives in one task; counts are summed before the
shuffle, so a hot series costs one row per task and period.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = ["series"]


def by(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*(order or ("t",)))


def onward(keys: list[str], order: str = "t"):
    """The rows from the current one to the last, as a running window from the end: a frame that grows costs no recount."""
    return Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)


def index_series(df: DataFrame, keys: list[str] = K, date: str = "date") -> DataFrame:
    """Zero-based position t by date in each series."""
    return df.withColumn("t", F.row_number().over(by(keys, date)).cast("long") - 1)


def daily_counts(events: DataFrame, keys: list[str], when: str, case: Column, death: Column, freq: str = "day") -> DataFrame:
    """Dense counts per period of each series, from its first to its last period; absent periods count zero."""
    step = {"day": "interval 1 day", "week": "interval 7 days"}[freq]
    period = F.to_date(F.date_trunc(freq, F.col(when)))
    counts = events.groupBy(*keys, period.alias("date")).agg(F.count_if(case).alias("cases"), F.count_if(death).alias("deaths"))
    spine = counts.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    spine = spine.select(*keys, F.explode(F.expr(f"sequence(a, b, {step})")).alias("date"))
    dense = spine.join(counts, [*keys, "date"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    return index_series(dense.select(*keys, "date", zero("cases"), zero("deaths")), keys)


def reconcile_increments(df: DataFrame, keys: list[str] = K, col: str = "cases", strict: bool = True) -> DataFrame:
    """Negative revisions are paid by the latest earlier reports; totals stay.

    The running total is replaced by its least later value. A revision above all earlier reports is an error, or,
    if not strict, gives `revision_ok` false for the series.
    """
    running = F.sum(col).over(by(keys).rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_c", running)
    out = out.withColumn("_m", F.min("_c").over(onward(keys)))
    bad = F.min("_c").over(Window.partitionBy(*keys)) < -1e-8
    fixed = F.col("_m") - F.lag("_m", 1, 0.0).over(by(keys))
    if strict:
        fixed = F.when(bad, F.raise_error(F.lit("a revision exceeds all earlier reports")).cast("double")).otherwise(fixed)
        return out.withColumn(col, fixed).drop("_c", "_m")
    return out.withColumn(col, fixed).withColumn("revision_ok", ~bad).drop("_c", "_m")


def first_index_on_or_after(df: DataFrame, day: str, keys: list[str] = K, name: str = "start") -> DataFrame:
    """Per series the first position whose date is day or later; null if none is."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col("date") >= F.lit(day).cast("date"), F.col("t"))).alias(name))


def planned_looks(df: DataFrame, keys: list[str] = K, first: int = 35, every: int = 7) -> DataFrame:
    """(keys, look, prefix): looks at first, first + every, ... and always at the end; series under 3 rows have none."""
    ends = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 3")
    steps = F.when(F.col("n") >= max(first, 3), F.sequence(F.lit(max(first, 3)).cast("long"), F.col("n"), F.lit(every).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return ends.select(*keys, F.posexplode(F.array_sort(F.array_union(steps, F.array("n")))).alias("look", "prefix")).withColumn("look", F.col("look").cast("long") + 1)


def checked_looks(looks: list[int], horizon: int) -> list[int]:
    """An explicit list of prefix lengths, if it rises strictly within 3..horizon."""
    if not looks or looks[0] < 3 or looks[-1] > horizon or any(a >= b for a, b in zip(looks, looks[1:], strict=False)):
        raise ValueError("looks must rise strictly from 3 or more up to the horizon")
    return looks


def prefix_expand(df: DataFrame, looks: DataFrame, keys: list[str] = K) -> DataFrame:
    """Rows of each look's prefix only (t < prefix), with look and prefix."""
    return df.join(looks, keys).where(F.col("t") < F.col("prefix"))


def reporting_lag(df: DataFrame, k: int, keys: list[str] = K, col: str = "deaths") -> DataFrame:
    """The values as reported k days late; 0 before."""
    return df.withColumn(col, F.lag(col, k, 0.0).over(by(keys)))


def binomial_draws(counts: np.ndarray, names: np.ndarray, p: float, seed: int, most: int = 1 << 22) -> np.ndarray:
    """A Binomial(count, p) draw for each row, the same for the same seed and name: of its units, how many have a hash below p.

    The hash of a unit mixes seed, name and its number (the SplitMix64 finaliser); `most` units at once, all rows together.
    """
    counts = np.maximum(counts, 0)
    out, done, step = np.zeros(len(counts)), 0, max(1, most // max(len(counts), 1))
    base = names.view(np.uint64) + np.uint64(seed * 0xD1342543DE82EF95 & (1 << 64) - 1)
    while (counts > done).any():
        part = np.clip(counts - done, 0, step)
        owner = np.repeat(np.arange(len(counts)), part)
        unit = done + np.arange(len(owner)) - np.repeat(np.cumsum(part) - part, part)
        x = base[owner] + unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        out += np.bincount(owner, (x >> np.uint64(11)) * 2.0**-53 < p, len(counts))
        done += step
    return out


def weekend_transfer(df: DataFrame, p: float = 1.0, keys: list[str] = K, col: str = "deaths", seed: int = 0) -> DataFrame:
    """A share p of the counts of days 5 and 6 of the week (t mod 7) moves to the next Monday; what passes the end is lost.

    For p of 0 or 1 the moved part is exact; otherwise it is a Binomial(count, p) draw, the same for the same seed and row.
    """
    weekend = F.col("t") % 7 >= 5
    if p in (0.0, 1.0):
        moved = F.when(weekend, F.col(col) * p).otherwise(0.0)
    else:

        @F.pandas_udf("double")
        def draw(count: pd.Series, at: pd.Series) -> pd.Series:
            return pd.Series(binomial_draws(np.nan_to_num(count.to_numpy(float)).astype(np.int64), at.to_numpy(np.int64), p, seed))

        moved = F.when(weekend, draw(F.col(col), F.xxhash64(*keys, "t"))).otherwise(0.0)
    out = df.withColumn("_moved", moved)
    w = by(keys)
    arrives = F.when(F.col("t") % 7 == 0, F.lag("_moved", 1, 0.0).over(w) + F.lag("_moved", 2, 0.0).over(w)).otherwise(0.0)
    return out.withColumn(col, F.col(col) - F.col("_moved") + arrives).drop("_moved")


def ascertainment_shift(df: DataFrame, day: int, factor: float, rounded: bool = True, col: str = "cases") -> DataFrame:
    """Counts from day on times factor, rounded half to even if asked for."""
    scaled = F.col(col) * factor
    return df.withColumn(col, F.when(F.col("t") >= day, F.rint(scaled) if rounded else scaled).otherwise(F.col(col)))


def scale_to_max(df: DataFrame, col: str = "cases", keys: list[str] = K) -> DataFrame:
    return df.withColumn(f"{col}_scaled", F.col(col) / F.greatest(F.max(col).over(Window.partitionBy(*keys)), F.lit(1.0)))


def validate_series(df: DataFrame, keys: list[str] = K) -> DataFrame:
    """Series that break the input contract, with counts of short, missing and negative values."""
    missing = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    found = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(missing("cases") | missing("deaths")).alias("n_missing"), F.count_if((F.col("cases") < 0) | (F.col("deaths") < 0)).alias("n_negative")
    )
    return found.where("n < 3 or n_missing > 0 or n_negative > 0")


def series_fingerprint(df: DataFrame, keys: list[str] = K) -> DataFrame:
    """SHA-256 of each series' ordered date, case and death content."""
    row = F.struct("t", F.concat_ws("|", F.date_format("date", "yyyy-MM-dd"), F.col("cases").cast("long").cast("string"), F.col("deaths").cast("long").cast("string")).alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"])
    return df.groupBy(*keys).agg(F.sha2(F.concat_ws(",", ordered), 256).alias("fingerprint"))


def episode_seed(component: str, contract: str, group: str | Column, master: int, replicate: str | Column, split: str) -> Column:
    """Stable 64-bit seed: first 8 bytes, little-endian, of the SHA-256 of a canonical JSON text, as decimal(20)."""
    g = F.col(group) if isinstance(group, str) else group
    r = F.col(replicate) if isinstance(replicate, str) else replicate
    text = F.format_string(f'{{"component":"{component}","contract":"{contract}","group":"%s","master_seed":{master},"replicate":%d,"split":"{split}"}}', g, r)
    digest = F.sha2(text, 256)
    turned = F.concat(*(F.substring(digest, 15 - 2 * i, 2) for i in range(8)))
    return F.conv(turned, 16, 10).cast("decimal(20,0)")
