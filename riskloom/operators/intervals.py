"""Interval statistics: shares, means and order statistics of grouped rows."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.special import beta_cdf, binomial_interval, t_critical


def probability_summary(df: DataFrame, groups: list[str], event: Column, confidence: float = 0.95) -> DataFrame:
    """n, events, estimate, Monte Carlo standard error and exact interval per group; NULL groups are groups."""
    out = df.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(F.coalesce(event, F.lit(False))).alias("events"))
    out = out.withColumn("estimate", F.col("events") / F.col("n"))
    out = out.withColumn("mcse", F.sqrt(F.col("estimate") * (1 - F.col("estimate")) / F.col("n")))
    return out.withColumn("_i", binomial_interval(F.col("events"), F.col("n"), confidence)).select(*groups, "n", "events", "estimate", "mcse", "_i.lower", "_i.upper")


def mean_t_interval(df: DataFrame, groups: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """Mean of finite values with a t interval; null limits under two values."""
    finite = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    out = df.groupBy(*groups).agg(F.count(finite).alias("n"), F.avg(finite).alias("mean"), F.stddev_samp(finite).alias("sd"))
    half = F.when(F.col("n") >= 2, t_critical(F.col("n") - 1, confidence) * F.col("sd") / F.sqrt("n"))
    return out.withColumn("_h", half).select(*groups, "n", "mean", (F.col("mean") - F.col("_h")).alias("lower"), (F.col("mean") + F.col("_h")).alias("upper"))


#: Parts that a group's values are cut into, twice over, to find an order statistic.
PARTS = 4096


def _narrowed(rows: DataFrame, keys: list[str], places: DataFrame, part: str, log: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of those parts of each group that hold a wanted place, and the places counted within the part.

    rows: (keys, _v, _n), places: (keys, _places array<struct<rank, at>>). A part is a step between the group's least and
    greatest value, of a scale that is logarithmic on both sides of 0 or linear; infinities are parts of their own.
    """
    v = F.col("_v")
    finite = (F.abs(v) < float("inf")) & ~F.isnan(v)
    scale = F.signum(v) * F.log1p(F.abs(v)) if log else v
    ends = rows.where(finite).groupBy(*keys).agg(F.min(scale).alias("_lo"), F.max(scale).alias("_hi"))
    inside = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((scale - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS), F.lit(PARTS - 1))).otherwise(0)
    cut = rows.join(ends, keys, "left").withColumn(part, F.when(finite, inside).when(v < 0, -1).otherwise(PARTS).cast("int")).drop("_lo", "_hi")
    counts = cut.groupBy(*keys, part).agg(F.sum("_n").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # PARTS rows a group
    held = F.transform(F.filter("_places", lambda p: (p["at"] > F.col("_b")) & (p["at"] <= F.col("_b") + F.col("_m"))), lambda p: F.struct(p["rank"].alias("rank"), (p["at"] - F.col("_b")).alias("at")))
    found = counts.withColumn("_b", before).join(places, keys).select(*keys, part, held.alias("_places")).where(F.size("_places") > 0)
    return cut.join(found.select(*keys, part), [*keys, part]), found


def order_values(df: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """(keys, rank, value): the rank-th smallest value of each group, for the ranks of (keys, ranks array<bigint>).

    Equal values are one row with a count before anything is shuffled. A group is cut into PARTS parts and counted, the
    parts that hold a rank are cut and counted again, and only their parts are put in order: so no task holds a group,
    whatever its size. Nulls are not counted; NaN is the greatest value; ranks beyond the group have no row.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    places = ranks.select(*keys, F.transform(F.array_distinct("ranks"), lambda r: F.struct(r.cast("long").alias("rank"), r.cast("long").alias("at"))).alias("_places"))
    own = list(keys)
    for part, log in (("_p1", True), ("_p2", False)):
        rows, places = _narrowed(rows, own, places, part, log)
        own.append(part)
    up = F.sum("_n").over(Window.partitionBy(*own).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    met = F.filter("_places", lambda p: (p["at"] > F.col("_c") - F.col("_n")) & (p["at"] <= F.col("_c")))
    out = rows.withColumn("_c", up).join(places, own).withColumn("_met", met)
    return out.select(*keys, F.explode("_met.rank").alias("rank"), F.col("_v").alias("value"))


def bootstrap_ranks(n: int, draws: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the two middle values (the same one twice, for odd n) of resamples of n values, without any values.

    A resample draws n places uniformly, so its m-th smallest place is the m-th of n uniforms: a beta variable; the next
    one is the least of the n - m uniforms above it.
    """
    m = (n + 1) // 2
    low = rng.beta(m, n - m + 1, draws)
    high = low if n % 2 else low + (1 - low) * rng.beta(1, n - m, draws)
    return tuple(np.clip(np.ceil(n * u), 1, n).astype(np.int64) for u in (low, high))  # type: ignore[return-value]


def median_bootstrap_interval(df: DataFrame, groups: list[str], value: str, draws: int = 2000, confidence: float = 0.95) -> DataFrame:
    """(groups, n, median, lower, upper): median and percentile bootstrap limits of each cell, from a seed made of its label.

    No value is drawn: each draw is a rank or two (`bootstrap_ranks`), which `order_values` looks up. A task gets a cell's
    count, then its draws' values: 2 * draws at most. Cells without values have n 0 and nulls.
    """
    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)
    sizes = df.groupBy(*groups).agg(F.count(value).alias("n"))

    def drawn(batches):
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                label = "|".join(str(v) for v in row[:-1])
                rng = np.random.default_rng(int.from_bytes(hashlib.sha256(label.encode()).digest()[:8], "little"))
                n = int(row[-1])
                low, high = bootstrap_ranks(n, draws, rng)
                found.append((low.tolist(), high.tolist(), sorted({*low.tolist(), *high.tolist(), (n + 1) // 2, n // 2 + 1})))
            yield pdf.assign(low=[x[0] for x in found], high=[x[1] for x in found], ranks=[x[2] for x in found])

    plans = sizes.where("n > 0").mapInPandas(drawn, f"{fields}, n long, low array<long>, high array<long>, ranks array<long>")
    names = [f"_g{i}" for i in range(len(groups))]  # null labels are cells too
    safe = [F.struct(F.col(g)).alias(n) for g, n in zip(groups, names, strict=True)]
    found = order_values(df.select(*safe, F.col(value).alias("_x")), names, "_x", plans.select(*safe, "ranks"))
    values = found.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("_v"))  # as many as a cell's ranks

    def limits(batches):
        for pdf in batches:
            out = []
            for n, low, high, known, values in zip(pdf.n, pdf.low, pdf.high, pdf.known, pdf["values"], strict=True):
                at = lambda r: values[np.searchsorted(known, r)]  # noqa: B023, E731
                medians = (at(low) + at(high)) / 2
                out.append(((at((n + 1) // 2) + at(n // 2 + 1)) / 2, *np.quantile(medians, [(1 - confidence) / 2, (1 + confidence) / 2])))
            yield pdf[[*groups, "n"]].assign(**{k: [x[i] for x in out] for i, k in enumerate(("median", "lower", "upper"))})

    joined = plans.select(*groups, *safe, "n", "low", "high").join(values, names).select(*groups, "n", "low", "high", F.col("_v.rank").alias("known"), F.col("_v.value").alias("values"))
    done = joined.mapInPandas(limits, f"{fields}, n long, median double, lower double, upper double")
    none = F.lit(None).cast("double")
    return done.union(sizes.where("n = 0").select(*groups, "n", none, none, none))


def paired_difference_interval(df: DataFrame, groups: list[str], a: str, b: str, confidence: float = 0.95) -> DataFrame:
    """Mean of a - b on complete pairs, with a normal interval of the paired differences."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    d = F.col(a).cast("double") - F.col(b).cast("double")
    out = df.groupBy(*groups).agg(F.count(d).alias("n"), F.avg(d).alias("difference"), F.stddev_samp(d).alias("_sd"))
    half = z * F.col("_sd") / F.sqrt("n")
    return out.select(*groups, "n", "difference", (F.col("difference") - half).alias("lower"), (F.col("difference") + half).alias("upper"))


def relative_error_scores(df: DataFrame, groups: list[str], estimate: str, truth: str) -> DataFrame:
    """Relative mean squared error, its root, and the root's delta-method standard error."""
    e = F.pow(F.col(estimate) / F.col(truth) - 1, 2)
    out = df.groupBy(*groups).agg(F.count(e).alias("n"), F.avg(e).alias("relative_mse"), F.stddev_samp(e).alias("_sd"))
    root = F.sqrt("relative_mse")
    mcse = F.when(root > 0, F.col("_sd") / F.sqrt("n") / (2 * root)).otherwise(0.0)
    return out.select(*groups, "n", "relative_mse", root.alias("relative_rmse"), mcse.alias("rmse_mcse"))


def quantile_ranks(n: int, q: float, error: float) -> tuple[int, int, int]:
    """Rank ceil(q n) and the ranks around it that bracket the q quantile but for `error` in all (0 and n + 1 for none)."""
    k = np.arange(1, n + 1)
    below = 1 - beta_cdf(np.full(n, q), k, n - k + 1)  # P(fewer than k of n at or below the quantile)
    low = int(np.sum(1 - below >= 1 - error / 2))  # greatest k with P(at least k) >= 1 - error / 2
    over = np.flatnonzero(below >= 1 - error / 2)
    return math.ceil(q * n - 1e-12), low, int(over[0]) + 1 if len(over) else n + 1


def null_quantile_bracket(df: DataFrame, groups: list[str], value: str, q: float = 0.95, error: float = 0.02) -> DataFrame:
    """(groups, n, rank, low_rank, high_rank, cutoff, low, high): order statistics; null ends where the ranks have none."""

    @F.udf("rank int, low_rank int, high_rank int")
    def ranks(n):
        return quantile_ranks(int(n), q, error)

    sizes = df.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("_nulls")).withColumn("_r", ranks("n")).select(*groups, "n", "_nulls", "_r.*")
    names = ("rank", "low_rank", "high_rank")
    wanted = sizes.select(*groups, F.filter(F.array(*(F.col(c) - F.col("_nulls") for c in names)), lambda r: r > 0).alias("ranks"))  # nulls are the lowest
    found = order_values(df, groups, value, wanted).groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    out = sizes.join(found, groups, "left")
    at = lambda c: F.try_element_at("_at", F.col(c) - F.col("_nulls"))
    return out.select(*groups, "n", *names, at("rank").alias("cutoff"), at("low_rank").alias("low"), at("high_rank").alias("high"))


def critical_value(df: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    """Order statistic ceil((1 - alpha)(B + 1)) per key; null (never crossed) if the rank exceeds B."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("rank", F.ceil((F.col("n") + 1) * (1 - alpha)))
    found = order_values(df, keys, value, sizes.select(*keys, F.array("rank").alias("ranks")))
    return sizes.join(found.select(*keys, F.col("value").alias("critical_value")), keys, "left")


def legacy_boundary(df: DataFrame, keys: list[str], value: str, alpha: float, looks: int) -> DataFrame:
    """Per look the critical value at alpha / looks."""
    return critical_value(df, keys, value, alpha / looks)


def shortest_interval(roots: DataFrame, alarms: DataFrame, group: list[str], cell: str = "cell", root: str = "root", share: float = 0.95) -> DataFrame:
    """(group, lower, upper, infeasible): shortest interval that covers ceil(share * alarms) roots in every cell.

    Roots are numbered per cell. For each candidate lower end, a cell needs its root number (roots below it) + m as
    upper end; the greatest over cells is the interval's, and the first shortest wins. The as-of lookup of roots below
    a candidate is one running count over the union of candidates and roots in each cell: every candidate meets every
    cell of its group once, and a cell is ordered in one window (cells are bank sized).
    """
    keys = [*group, cell]
    need = alarms.select(*keys, F.ceil(F.col("n_alarms") * share).alias("m"))
    own = Window.partitionBy(*keys)
    ranked = roots.select(*keys, F.col(root).alias("_r")).withColumn("_i", F.row_number().over(own.orderBy("_r")))
    candidates = roots.select(*group, F.col(root).alias("_c")).distinct().join(need.select(*keys, "m"), group)
    marks = ranked.select(*keys, F.col("_r").alias("_x"), F.lit(1).alias("_is")).unionByName(candidates.select(*keys, F.col("_c").alias("_x"), F.lit(0).alias("_is")))
    below = F.sum("_is").over(own.orderBy("_x", "_is").rowsBetween(Window.unboundedPreceding, 0))
    starts = marks.withColumn("_below", below).where("_is = 0").join(need, keys).withColumn("_i", (F.col("_below") + F.col("m")).cast("int"))
    ends = starts.join(ranked.select(*keys, "_i", F.col("_r").alias("_end")), [*keys, "_i"], "left")
    spans = ends.groupBy(*group, "_x").agg(F.max("_end").alias("_u"), F.count_if(F.col("_end").isNull()).alias("_none"))
    found = spans.where("_none = 0").groupBy(*group).agg(F.min(F.struct((F.col("_u") - F.col("_x")).alias("w"), F.col("_x").alias("lower"), F.col("_u").alias("upper"))).alias("b"))
    return alarms.select(*group).distinct().join(found, group, "left").select(*group, "b.lower", "b.upper", F.col("b").isNull().alias("infeasible"))
