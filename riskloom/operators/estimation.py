"""Estimates after alarms: closed-form fits as keyed sums, intervals as column algebra, and paired reports."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.intervals import shortest_interval

LOW, HIGH = 1e-10, 1 - 1e-10


def design_sums(design: DataFrame, keys: list[str], y: str = "deaths") -> DataFrame:
    """Saa, Sab, Sbb, Say, Sby, Syy and n of rows (a, b, y)."""
    pairs = {"aa": ("a", "a"), "ab": ("a", "b"), "bb": ("b", "b"), "ay": ("a", y), "by": ("b", y), "yy": (y, y)}
    return design.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.col(p) * F.col(q)).alias(k) for k, (p, q) in pairs.items()))


def fit_two_rate_ls(sums: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Box-constrained least squares: the free solution if it lies inside, else the best of the four edges' optima.

    Adds left, right, rss, active_set and status (unidentifiable if the design is singular).
    """
    aa, ab, bb, ay, by, yy = (F.col(c) for c in ("aa", "ab", "bb", "ay", "by", "yy"))
    det = aa * bb - ab * ab
    free_l, free_r = (bb * ay - ab * by) / det, (aa * by - ab * ay) / det
    clip = lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    rss = lambda p, q: yy - 2 * (p * ay + q * by) + p * p * aa + 2 * p * q * ab + q * q * bb

    def option(p: Column, q: Column, name: str, order: int) -> Column:
        return F.struct(rss(p, q).alias("rss"), F.lit(order).alias("o"), p.alias("left"), q.alias("right"), F.lit(name).alias("active_set"))

    edges = []
    for i, edge in enumerate((low, high)):
        e = F.lit(edge)
        edges.append(option(e, clip((by - e * ab) / bb), f"left={'low' if i == 0 else 'high'}", i))
        edges.append(option(clip((ay - e * ab) / aa), e, f"right={'low' if i == 0 else 'high'}", i + 2))
    singular = F.coalesce(det <= 1e-12 * aa * bb, F.lit(True)) | (aa <= 0) | (bb <= 0)
    inside = free_l.between(low, high) & free_r.between(low, high)
    best = F.when(~singular, F.when(inside, option(free_l, free_r, "none", 0)).otherwise(F.array_min(F.array(*edges))))
    out = sums.withColumn("_b", best)
    return out.withColumns({"left": F.col("_b.left"), "right": F.col("_b.right"), "rss": F.greatest("_b.rss", F.lit(0.0)), "active_set": F.col("_b.active_set"), "status": F.when(singular, "unidentifiable").otherwise("success")}).drop("_b")


def two_stage_moments(df: DataFrame, keys: list[str], tau: Column, y: str = "deaths") -> DataFrame:
    """left = early deaths / early exposure; right = what early risk leaves of the later deaths, per later cohorts' exposure.

    df has t, x (all cohorts) and b (cohorts from tau on). Not clipped; point_valid and admissible are told apart.
    """
    early = F.col("t") < tau
    s = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    sums = df.groupBy(*keys).agg(s(early, F.col("x")).alias("_x0"), s(early, F.col(y)).alias("_y0"), s(~early, F.col(y)).alias("_y1"), s(~early, F.col("x") - F.col("b")).alias("_m1"), s(~early, F.col("b")).alias("_b1"))
    left = F.try_divide(F.col("_y0"), F.col("_x0"))
    right = F.try_divide(F.col("_y1") - left * F.col("_m1"), F.col("_b1"))
    status = F.when(F.col("_x0") <= 0, "missing_pre_exposure").when(F.col("_b1") <= 0, "missing_post_exposure").when(F.col("_y0") <= 0, "zero_pre_risk").otherwise("success")
    out = sums.withColumn("left", F.when(F.col("_x0") > 0, left)).withColumn("right", F.when(F.col("_b1") > 0, right)).withColumn("status", status)
    ratio = F.when(F.col("status") == "success", F.col("right") / F.col("left"))
    out = out.withColumn("ratio", ratio).withColumn("point_valid", F.col("status") == "success")
    return out.withColumn("admissible", F.coalesce(F.col("left").between(0, 1) & F.col("right").between(0, 1), F.lit(False))).drop("_x0", "_y0", "_y1", "_m1", "_b1")


def nb_variance(mean: Column, phi: Column) -> Column:
    """mean + mean^2 / phi; the Poisson limit from phi = 1e7 on."""
    return F.when(phi >= 1e7, mean).otherwise(mean + mean * mean / phi)


def moment_phi(df: DataFrame, keys: list[str], y: str = "deaths", mean: str = "mean") -> DataFrame:
    """Sum of squared means over the sum of excess squared residuals, within [0.1, 1e6]; 1e6 where there is no excess."""
    m = F.col(mean)
    over = F.greatest(F.pow(F.col(y) - m, 2) - m, F.lit(0.0))
    out = df.groupBy(*keys).agg(F.sum(m * m).alias("_a"), F.sum(over).alias("_b"))
    phi = F.least(F.greatest(F.try_divide(F.col("_a"), F.col("_b")), F.lit(0.1)), F.lit(1e6))
    return out.select(*keys, F.when((F.col("_b") > 0) & (F.col("_a") > 0), phi).otherwise(1e6).alias("phi"))


def information_sums(design: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """fits (left, right, phi) with iaa, iab, ibb: sums of aa, ab, bb over the variance at the fit."""
    rows = design.join(fits, keys)
    mean = F.greatest(F.col("left") * F.col("a") + F.col("right") * F.col("b"), F.lit(1e-12))
    v = nb_variance(mean, F.col("phi"))
    sums = rows.groupBy(*keys).agg(F.sum(F.col("a") * F.col("a") / v).alias("iaa"), F.sum(F.col("a") * F.col("b") / v).alias("iab"), F.sum(F.col("b") * F.col("b") / v).alias("ibb"))
    return fits.join(sums, keys)


def _limits(center: Column, se: Column, z: float, inverse) -> tuple[Column, Column]:
    return inverse(center - z * se), inverse(center + z * se)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def wald_intervals(info: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Delta-method intervals from the 2 x 2 inverse: risks on the logit scale, their ratio on the log scale; null if singular."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    det = F.col("iaa") * F.col("ibb") - F.col("iab") * F.col("iab")
    ok = (det > 1e-12 * F.col("iaa") * F.col("ibb")) & F.col("left").between(1e-9, 1 - 1e-9) & F.col("right").between(1e-9, 1 - 1e-9)
    vl, vr, c = F.col("ibb") / det, F.col("iaa") / det, -F.col("iab") / det
    p, q = F.col("left"), F.col("right")
    out = info.withColumn("interval_valid", F.coalesce(ok, F.lit(False)))
    for name, est, se, inv, fwd in (
        ("left", p, F.sqrt(vl) / (p * (1 - p)), expit, logit), ("right", q, F.sqrt(vr) / (q * (1 - q)), expit, logit),
        ("ratio", q / p, F.sqrt(vl / (p * p) + vr / (q * q) - 2 * c / (p * q)), F.exp, F.log),
    ):
        low, high = _limits(fwd(est), se, z, inv)
        out = out.withColumn(f"{name}_lower", F.when(ok, low)).withColumn(f"{name}_upper", F.when(ok, high))
    return out


def stabilized_intervals(info: DataFrame, precision: float = 1.0, confidence: float = 0.95, sandwich: bool = True) -> DataFrame:
    """Log-scale intervals of a fit with penalty precision/2 (log right/left)^2: A^-1 I A^-1, or I^-1 as the unpenalised diagnostic.

    I is the information on (log left, log right); A adds precision to its diagonal and takes it off the other cells.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    p, q = F.col("left"), F.col("right")
    i11, i12, i22 = F.col("iaa") * p * p, F.col("iab") * p * q, F.col("ibb") * q * q
    a11, a12, a22 = (i11 + precision, i12 - precision, i22 + precision) if sandwich else (i11, i12, i22)
    det = a11 * a22 - a12 * a12
    b11, b12, b22 = a22 / det, -a12 / det, a11 / det
    if sandwich:
        m11, m12, m21, m22 = i11 * b11 + i12 * b12, i11 * b12 + i12 * b22, i12 * b11 + i22 * b12, i12 * b12 + i22 * b22
        v11, v12, v22 = b11 * m11 + b12 * m21, b11 * m12 + b12 * m22, b12 * m12 + b22 * m22
    else:
        v11, v12, v22 = b11, b12, b22
    ok = F.coalesce((det > 1e-12 * a11 * a22) & (p > 0) & (q > 0), F.lit(False))
    out = info.withColumn("interval_valid", ok)
    for name, est, var in (("left", p, v11), ("right", q, v22), ("ratio", q / p, v11 + v22 - 2 * v12)):
        se = F.sqrt(F.greatest(var, F.lit(0.0)))
        out = out.withColumn(f"{name}_lower", F.when(ok, F.exp(F.log(est) - z * se))).withColumn(f"{name}_upper", F.when(ok, F.exp(F.log(est) + z * se)))
    return out


def to_long(df: DataFrame, keys: list[str], prefixes: dict[str, str], targets: list[str], parts: tuple[str, ...] = ("estimate", "lower", "upper", "point_valid", "interval_valid")) -> DataFrame:
    """Wide {prefix}{target}_{part} columns as (keys, method, target, parts): one array of structs, exploded."""
    rows = [F.struct(F.lit(m).alias("method"), F.lit(t).alias("target"), *(F.col(f"{p}{t}_{x}").alias(x) for x in parts)) for m, p in prefixes.items() for t in targets]
    return df.select(*keys, F.inline(F.array(*rows)))


def estimation_summary(long: DataFrame, groups: list[str], truth: str = "truth", alarm: str = "alarm") -> DataFrame:
    """Availability, bias, root mean squared and relative error, coverage over all alarms and over valid intervals, widths."""
    a = F.col(alarm)
    point, interval = a & F.coalesce("point_valid", F.lit(False)), a & F.coalesce("interval_valid", F.lit(False))
    e = F.when(point, F.col("estimate") - F.col(truth))
    rel = F.when(point, F.col("estimate") / F.col(truth) - 1)
    covered = interval & (F.col("lower") <= F.col(truth)) & (F.col(truth) <= F.col("upper"))
    width = F.when(interval, F.col("upper") - F.col("lower"))
    return long.groupBy(*groups).agg(
        F.count("*").alias("episodes"), F.count_if(a).alias("alarms"), F.count_if(point).alias("points"), F.count_if(interval).alias("intervals"),
        F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(rel).alias("relative_bias"), F.sqrt(F.avg(rel * rel)).alias("relative_rmse"),
        F.try_divide(F.count_if(covered), F.count_if(a)).alias("coverage"), F.try_divide(F.count_if(covered), F.count_if(interval)).alias("valid_coverage"),
        F.percentile(width, 0.5).alias("width_median"), F.percentile(width, 0.25).alias("width_q25"), F.percentile(width, 0.75).alias("width_q75"), F.avg(width).alias("width_mean"), F.max(width).alias("width_max"),
    )


def location_summary(df: DataFrame, groups: list[str]) -> DataFrame:
    e = F.when(F.col("alarm"), (F.col("tau_hat_at_alarm") - F.col("true_change")).cast("double"))
    return df.groupBy(*groups).agg(F.count_if("alarm").alias("alarms"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def _relative_square(method: str, target: str, truth: str) -> Column:
    """Squared relative error of a method on a wide row, null where its point is not valid."""
    return F.when(F.coalesce(F.col(f"{method}{target}_point_valid"), F.lit(False)), F.pow(F.col(f"{method}{target}_estimate") / F.col(truth) - 1, 2))


def reference_comparison(df: DataFrame, groups: list[str], target: str, a: str, b: str, truth: str) -> DataFrame:
    """Two methods on the wide row: counts, root errors, and the paired difference of squared errors on common episodes."""
    sa, sb = _relative_square(a, target, truth), _relative_square(b, target, truth)
    d = sa - sb
    return df.groupBy(*groups).agg(
        F.count(sa).alias("n_a"), F.count(sb).alias("n_b"), F.count(d).alias("n_common"), F.sqrt(F.avg(sa)).alias("rmse_a"), F.sqrt(F.avg(sb)).alias("rmse_b"),
        F.avg(d).alias("difference"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("mcse"),
    )


def common_cohort(df: DataFrame, groups: list[str], target: str, methods: dict[str, str], truth: str, least: list[str] | None = None) -> DataFrame:
    """(groups, method, n, rmse, bias) on the episodes where all of `least` (all methods by default) are valid."""
    squares = {m: _relative_square(p, target, truth) for m, p in methods.items()}
    both = reduce(lambda x, y: x & y, [squares[m].isNotNull() for m in (least or methods)])
    aggs = []
    for m, p in methods.items():
        relative = F.when(both & squares[m].isNotNull(), F.col(f"{p}{target}_estimate") / F.col(truth) - 1)
        aggs += [F.count(relative).alias(f"{m}_n"), F.sqrt(F.avg(relative * relative)).alias(f"{m}_rmse"), F.avg(relative).alias(f"{m}_bias")]
    wide = df.groupBy(*groups).agg(*aggs)
    return wide.select(*groups, F.inline(F.array(*(F.struct(F.lit(m).alias("method"), F.col(f"{m}_n").alias("n"), F.col(f"{m}_rmse").alias("rmse"), F.col(f"{m}_bias").alias("bias")) for m in methods))))


def equal_cell_aggregate(cells: DataFrame, groups: list[str], n_cells: int) -> DataFrame:
    """(groups, method, cells, rmse, wins, ties): cells weigh alike (null if one is missing); wins and ties of the least error.

    cells: (groups, cell, method, n, rmse).
    """
    w = Window.partitionBy(*groups, "cell")
    best = F.min("rmse").over(w)
    marked = cells.withColumn("_best", F.abs(F.col("rmse") - best) <= 1e-12)
    marked = marked.withColumn("_ties", F.sum(F.col("_best").cast("int")).over(w))
    out = marked.groupBy(*groups, "method").agg(F.count("rmse").alias("cells"), F.avg(F.col("rmse") * F.col("rmse")).alias("_m"), F.count_if(F.col("_best") & (F.col("_ties") == 1)).alias("wins"), F.count_if(F.col("_best") & (F.col("_ties") > 1)).alias("ties"))
    return out.withColumn("rmse", F.when(F.col("cells") == n_cells, F.sqrt("_m"))).drop("_m")


def stability_validation(long: DataFrame, groups: list[str], cell: str, truth: str = "truth") -> DataFrame:
    """(groups, mse, rmse, se): equal-cell mean squared relative error with a standard error clustered by replicate."""
    good = F.coalesce("point_valid", F.lit(False))
    sq = F.when(good, F.pow(F.col("estimate") / F.col(truth) - 1, 2))
    by = Window.partitionBy(*groups, cell)
    rows = long.withColumn("_s", sq).withColumn("_mean", F.avg("_s").over(by)).withColumn("_n", F.count("*").over(by)).withColumn("_good", F.count("_s").over(by))
    sizes = rows.groupBy(*groups).agg(F.countDistinct(cell).alias("_cells"))
    rows = rows.join(sizes, groups).withColumn("_infl", F.coalesce(F.col("_n") / F.col("_good") * (F.col("_s") - F.col("_mean")) / F.col("_cells"), F.lit(0.0)))
    mse = rows.select(*groups, cell, "_mean").distinct().groupBy(*groups).agg(F.avg("_mean").alias("mse"))
    per = rows.groupBy(*groups, "replicate").agg(F.sum("_infl").alias("_i"))
    se = per.groupBy(*groups).agg((F.stddev_samp("_i") / F.sqrt(F.count("*"))).alias("mse_se"))
    return mse.join(se, groups).withColumn("rmse", F.sqrt("mse")).withColumn("rmse_se", F.try_divide(F.col("mse_se"), 2 * F.col("rmse")))


def transform_roots(long: DataFrame, se: str = "se", truth: str = "truth") -> DataFrame:
    """center (logit of risks, log of ratios), available and root = (center - transformed truth) / se."""
    ratio = F.col("target") == "risk_ratio"
    f = lambda c: F.when(ratio, F.when(F.col(c) > 0, F.log(c))).otherwise(F.when((F.col(c) > 0) & (F.col(c) < 1), logit(F.col(c))))
    out = long.withColumn("center", f("estimate"))
    out = out.withColumn("available", F.col("center").isNotNull() & F.coalesce(F.col(se) > 0, F.lit(False)))
    return out.withColumn("root", F.when(F.col("available"), (F.col("center") - f(truth)) / F.col(se)))


def calibrate_cutoffs(roots: DataFrame, share: float = 0.95, cell: str = "cell") -> DataFrame:
    """One pair of cutoffs per target over all cells: the shortest interval of roots that covers the share of every cell's alarms."""
    alarms = roots.where("alarm").groupBy("target", cell).agg(F.count("*").alias("n_alarms"))
    return shortest_interval(roots.where("alarm and available"), alarms, ["target"], cell, "root", share)


def apply_cutoffs(long: DataFrame, cutoffs: DataFrame, se: str = "se") -> DataFrame:
    """lower, upper = inverse(center - cutoff * se); truth is not used; an infinite upper end is an available interval."""
    joined = long.join(cutoffs.select("target", F.col("lower").alias("_cl"), F.col("upper").alias("_cu")), "target", "left")
    inverse = lambda x: F.when(F.col("target") == "risk_ratio", F.exp(x)).otherwise(expit(x))
    ok = F.coalesce(F.col("available"), F.lit(False))
    out = joined.withColumn("lower", F.when(ok, inverse(F.col("center") - F.col("_cu") * F.col(se)))).withColumn("upper", F.when(ok, inverse(F.col("center") - F.col("_cl") * F.col(se))))
    return out.withColumn("interval_valid", ok & F.col("lower").isNotNull() & F.col("upper").isNotNull()).drop("_cl", "_cu")


def interval_report(df: DataFrame, groups: list[str], rules: dict[str, tuple[str, str]], truth: str = "truth") -> DataFrame:
    """(groups, rule, alarms, available, infinite, covered, coverage, width_mean, width_median): interval rules side by side."""
    rows = df.where("alarm").select(*groups, truth, F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(lo).alias("lo"), F.col(hi).alias("hi")) for r, (lo, hi) in rules.items()))))
    have = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    infinite = have & (F.col("hi") == float("inf"))
    width = F.when(have & ~infinite, F.col("hi") - F.col("lo"))
    covered = have & (F.col("lo") <= F.col(truth)) & (F.col(truth) <= F.col("hi"))
    return rows.groupBy(*groups, "rule").agg(F.count("*").alias("alarms"), F.count_if(have).alias("available"), F.count_if(infinite).alias("infinite"), F.count_if(covered).alias("covered"), F.avg(F.coalesce(covered, F.lit(False)).cast("double")).alias("coverage"), F.avg(width).alias("width_mean"), F.percentile(width, 0.5).alias("width_median"))
