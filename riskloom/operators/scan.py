"""Change scan: an efficient score for every candidate cohort change, in prefix and suffix windows and a short band.

With w = x^2 / V and r = x (d - m) / V on active rows, a candidate's sums split at the band's ends: before it b is 0,
after it b is x. So the scan is two windows per series and n * L band rows, never n * n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.special import normal_quantile
from riskloom.operators.exposure import post_exposure, total_exposure
from riskloom.operators.prepare import K, by, onward

FLOOR = 1e-12


def poisson_null(df: DataFrame, keys: list[str] = K, observation_start: int = 0) -> DataFrame:
    """df (with x) and the constant-risk Poisson fit: pi = sum d / sum x over active rows; mean and variance pi x, floored."""
    active = (F.col("t") >= observation_start) & (F.col("x") > FLOOR)
    w = Window.partitionBy(*keys)
    pi = F.try_divide(F.sum(F.when(active, F.col("deaths"))).over(w), F.sum(F.when(active, F.col("x"))).over(w))
    out = df.withColumn("active", active).withColumn("pi", pi).withColumn("fit_ok", F.count_if("active").over(w) >= 3)
    return out.withColumn("mean", F.greatest(F.col("pi") * F.col("x"), F.lit(FLOOR))).withColumn("variance", F.col("mean"))


def _pieces(fit: DataFrame) -> DataFrame:
    on = F.col("active")
    w = F.when(on, F.col("x") * F.col("x") / F.col("variance")).otherwise(0.0)
    r = F.when(on, F.col("x") * (F.col("deaths") - F.col("mean")) / F.col("variance")).otherwise(0.0)
    return fit.withColumn("_w", w).withColumn("_r", r)


def _ends(rows: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """Per tau: sums and greatest w of rows before tau + low and from tau + high on; the series' totals."""
    up, down = by(keys).rowsBetween(Window.unboundedPreceding, 0), onward(keys)
    whole = Window.partitionBy(*keys)
    out = rows
    for name, f, over in (("pw", F.sum("_w"), up), ("pr", F.sum("_r"), up), ("pm", F.max("_w"), up), ("sw", F.sum("_w"), down), ("sr", F.sum("_r"), down), ("sm", F.max("_w"), down)):
        out = out.withColumn(name, f.over(over))
    out = out.withColumn("info", F.sum("_w").over(whole)).withColumn("n_active", F.count_if("active").over(whole))
    at = lambda c, k: F.lead(c, k).over(by(keys)) if k > 0 else F.lag(c, -k).over(by(keys)) if k < 0 else F.col(c)
    picks = [F.coalesce(at(c, low - 1), F.lit(0.0)).alias(c) for c in ("pw", "pr", "pm")] + [F.coalesce(at(c, high), F.lit(0.0)).alias(c) for c in ("sw", "sr", "sm")]
    return out.select(*keys, F.col("t").alias("tau"), *picks, "info", "n_active", "fit_ok").where("tau >= 1")


def _validated(scored: DataFrame, keys: list[str], candidate_start: int, gate: bool) -> DataFrame:
    scored = scored.withColumn("_top", F.max("information").over(Window.partitionBy(*keys)))
    ok = (F.col("information") > FLOOR * F.greatest(F.lit(1.0), F.col("_top"))) & (F.col("tau") >= candidate_start) & F.col("max_leverage").isNotNull()
    if gate:
        ok = ok & (F.col("max_leverage") <= 1 / F.sqrt("n_active"))
    out = scored.where(ok).withColumn("z", F.col("u") / F.sqrt("information"))
    return out.select(*keys, "tau", "z", (F.col("z") * F.col("z")).alias("q"), "information", "max_leverage")


def score_scan(fit: DataFrame, law: list[float], keys: list[str] = K, offset: int = 1, candidate_start: int = 1, gate: bool = True) -> DataFrame:
    """(keys, tau, z, q, information, max_leverage) of every valid candidate; fit has x, mean, variance, active, fit_ok."""
    rows = _pieces(fit)
    ends = _ends(rows, keys, offset, len(law) - 1 + offset).where("fit_ok")
    here = rows.select(*keys, F.col("t").alias("s"), "x", "deaths", "mean", "variance", "active")
    band = post_exposure(fit, law, keys, offset).join(here, [*keys, "s"]).where("active")
    one = Window.partitionBy(*keys, "tau")
    band = band.join(ends.select(*keys, "tau", "sw", "info"), [*keys, "tau"])
    band = band.withColumn("proj", (F.sum(F.col("b") * F.col("x") / F.col("variance")).over(one) + F.col("sw")) / F.col("info"))
    band = band.withColumn("g", F.col("b") - F.col("x") * F.col("proj"))
    g2 = F.col("g") * F.col("g") / F.col("variance")
    sums = band.groupBy(*keys, "tau").agg(F.first("proj").alias("proj"), F.sum(g2).alias("bj"), F.max(g2).alias("bm"), F.sum(F.col("g") * (F.col("deaths") - F.col("mean")) / F.col("variance")).alias("bu"))
    out = ends.join(sums, [*keys, "tau"], "left")
    p = F.coalesce("proj", F.col("sw") / F.col("info"))
    rest = 1 - p
    info = F.coalesce("bj", F.lit(0.0)) + rest * rest * F.col("sw") + p * p * F.col("pw")
    top = F.greatest(F.coalesce("bm", F.lit(0.0)), rest * rest * F.col("sm"), p * p * F.col("pm"))
    u = F.coalesce("bu", F.lit(0.0)) + rest * F.col("sr") - p * F.col("pr")
    out = out.select(*keys, "tau", "n_active", info.alias("information"), F.try_divide(top, info).alias("max_leverage"), u.alias("u"))
    return _validated(out, keys, candidate_start, gate)


def report_day_scan(fit: DataFrame, keys: list[str] = K, candidate_start: int = 1, gate: bool = True, candidates: list[int] | None = None) -> DataFrame:
    """The scan with the direction x from tau on, by report day: an empty band, suffix sums alone."""
    ends = _ends(_pieces(fit), keys, 0, 0).where("fit_ok")
    p = F.col("sw") / F.col("info")
    rest = 1 - p
    info = rest * rest * F.col("sw") + p * p * F.col("pw")
    top = F.greatest(rest * rest * F.col("sm"), p * p * F.col("pm"))
    out = ends.select(*keys, "tau", "n_active", info.alias("information"), F.try_divide(top, info).alias("max_leverage"), (rest * F.col("sr") - p * F.col("pr")).alias("u"))
    if candidates is not None:
        if len(set(candidates)) != len(candidates) or any(int(c) != c or c < 1 for c in candidates):
            raise ValueError("candidates must be distinct whole numbers from 1 on")
        out = out.where(F.col("tau").isin(list(candidates)))
    return _validated(out, keys, candidate_start, gate)


def matrix_free_scan(fit: DataFrame, law: list[float], keys: list[str] = K, offset: int = 1, candidate_start: int = 1) -> DataFrame:
    """(keys, tau, q): u^2 / j of candidates whose information on the two risks is positive definite; no gate."""
    rows = _pieces(fit)
    ends = _ends(rows, keys, offset, len(law) - 1 + offset).where("fit_ok")
    here = rows.select(*keys, F.col("t").alias("s"), "x", "deaths", "mean", "variance", "active")
    band = post_exposure(fit, law, keys, offset).join(here, [*keys, "s"]).where("active")
    v = F.col("variance")
    sums = band.groupBy(*keys, "tau").agg(F.sum(F.col("b") * F.col("b") / v).alias("bb"), F.sum(F.col("b") * F.col("x") / v).alias("bx"), F.sum(F.col("b") * (F.col("deaths") - F.col("mean")) / v).alias("bd"))
    out = ends.join(sums, [*keys, "tau"], "left").fillna(0.0, ["bb", "bx", "bd"])
    bb, bx = F.col("bb") + F.col("sw"), F.col("bx") + F.col("sw")
    score_x = F.sum("_r").over(Window.partitionBy(*keys))
    out = out.join(rows.select(*keys, F.col("t").alias("tau"), score_x.alias("rx")), [*keys, "tau"])
    j = bb - bx * bx / F.col("info")
    u = F.col("bd") + F.col("sr") - bx / F.col("info") * F.col("rx")
    left = F.col("info") - 2 * bx + bb
    ok = (left > FLOOR) & (left * bb - (bx - bb) * (bx - bb) > FLOOR * F.greatest(F.lit(1.0), left * bb)) & (F.col("tau") >= candidate_start)
    return out.where(ok).select(*keys, "tau", (u * u / j).alias("q"))


def scan_winner(scan: DataFrame, keys: list[str] = K) -> DataFrame:
    """Per series the greatest q, its first tau and the sign of z.

    Changes at days without cases in between have the same score but for the order of its sums, so q is compared by
    nine decimals.
    """
    top = F.max(F.struct(F.round("q", 9).alias("k"), (-F.col("tau")).alias("m"), "q", "z"))
    out = scan.groupBy(*keys).agg(top.alias("top"), F.count("*").alias("n_candidates"))
    return out.select(*keys, F.col("top.q").alias("statistic"), (-F.col("top.m")).alias("tau_hat"), F.signum("top.z").cast("int").alias("direction"), "n_candidates")


def influence(fit: DataFrame, at: DataFrame, law: list[float], keys: list[str] = K, offset: int = 1) -> DataFrame:
    """(keys, tau, t, influence): each active day's weight in the score of the candidates in at (keys, tau); squares sum to one."""
    band = post_exposure(fit, law, keys, offset).select(*keys, "tau", F.col("s").alias("t"), "b")
    rows = fit.where("fit_ok and active").join(at.select(*keys, "tau"), keys).join(band, [*keys, "tau", "t"], "left")
    b = F.when(F.col("t") >= F.col("tau") + len(law) - 1 + offset, F.col("x")).otherwise(F.coalesce("b", F.lit(0.0)))
    one = Window.partitionBy(*keys, "tau")
    rows = rows.withColumn("b", b).withColumn("_proj", F.sum(F.col("b") * F.col("x") / F.col("variance")).over(one) / F.sum(F.col("x") * F.col("x") / F.col("variance")).over(one))
    rows = rows.withColumn("_g", (F.col("b") - F.col("x") * F.col("_proj")) / F.sqrt("variance"))
    return rows.select(*keys, "tau", "t", F.try_divide(F.col("_g"), F.sqrt(F.sum(F.col("_g") * F.col("_g")).over(one))).alias("influence"))


def fixed_candidate(scan: DataFrame, series: DataFrame, tau: int, keys: list[str] = K) -> DataFrame:
    """z and q of every series at one prespecified tau; null where it was screened out."""
    return series.select(*keys).distinct().join(scan.where(F.col("tau") == tau), keys, "left").select(*keys, "z", "q")


def chisq_quantile(alpha: float) -> float:
    """Quantile 1 - alpha of a chi-squared with one degree of freedom."""
    return normal_quantile(1 - alpha / 2) ** 2


def naive_chisq(winner: DataFrame, alpha: float = 0.05) -> DataFrame:
    return winner.withColumn("naive_reject", F.col("statistic") > chisq_quantile(alpha))


def scanned(df: DataFrame, law: list[float], keys: list[str] = K, offset: int = 1, observation_start: int = 0, candidate_start: int = 1, gate: bool = True) -> DataFrame:
    """Exposure, Poisson null and score scan of a table of dense series."""
    return score_scan(poisson_null(total_exposure(df, law, keys, offset), keys, observation_start), law, keys, offset, candidate_start, gate)
