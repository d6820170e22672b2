"""One long series in many tasks: a series is cut by t into blocks, and only a summary per block passes between them.

The windows of `prepare`, `exposure` and `charts` hold a series in one task, which suits many series of some thousand
days. Here rows are shuffled once by (series, block). Where what a block needs of the earlier ones (or the later ones) is
a few numbers that combine associatively, those are aggregated per block, scanned over the blocks of a series (n / SIZE
rows) and joined back:

* revisions: a block's sum and its least running sum; each block then knows the total before it and the least after it.
* CUSUM: the sum, the least running sum and its last place, for each side; known then are the walk's height, its least so
  far and the last reset.
* mean change: the sum, and of all starts those that can still win. With P the running sum before a start s, the statistic
  at any end T is (P_T - P)^2 / (T - s), a convex function of the point (s, P), so that its maximum is at a corner of the
  points' convex hull. Hulls merge: the corners of a union are among the corners of the parts.
* exposure looks back no further than the delay law: a block gets copies of that many rows from the block before.

Rows are dense in t, from any first day; null values count as the windows count them; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators import exposure
from riskloom.operators.charts import ALLOWANCE
from riskloom.operators.prepare import K, by, onward

SIZE = 1 << 17


def _cut(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("_block", F.expr(f"t div {size}"))


def _earlier(keys: list[str]):
    return by(keys, "_block").rowsBetween(Window.unboundedPreceding, -1)


def total_exposure(df: DataFrame, law: list[float], keys: list[str] = K, offset: int = 1, size: int = SIZE, col: str = "cases", name: str = "x") -> DataFrame:
    """df with the exposure of `exposure.total_exposure`; a block reads the last rows of the one before, as far as the law reaches."""
    reach = len(law) - 1 + offset
    if reach > size:
        raise ValueError("a block must be longer than the delay law")
    own = F.expr(f"t div {size}")
    again = F.when(F.col("t") % size >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    rows = df.withColumn("_own", own).withColumn("_block", F.explode(again))
    out = exposure.total_exposure(rows, law, [*keys, "_block"], offset, col=col, name=name)
    return out.where("_block = _own").drop("_block", "_own")


def reconcile_increments(df: DataFrame, keys: list[str] = K, col: str = "cases", strict: bool = True, size: int = SIZE) -> DataFrame:
    """The rows of `prepare.reconcile_increments`, block by block."""
    inside = by([*keys, "_block"])
    rows = _cut(df, size).withColumn("_run", F.sum(col).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy(*keys, "_block").agg(F.max_by("_run", "t").alias("_total"), F.min("_run").alias("_least"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_total").over(_earlier(keys)), F.lit(0.0)))
    sums = sums.withColumn("_later", F.min(F.col("_before") + F.col("_least")).over(Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.withColumn("_prior", F.coalesce(F.lag(F.least(F.col("_before") + F.col("_total"), "_later")).over(by(keys, "_block")), F.lit(0.0)))
    sums = sums.withColumn("_bad", F.min(F.col("_before") + F.col("_least")).over(Window.partitionBy(*keys)) < -1e-8)
    out = rows.join(sums.select(*keys, "_block", "_before", "_later", "_prior", "_bad"), [*keys, "_block"])
    least = F.min(F.col("_before") + F.col("_run")).over(onward([*keys, "_block"]))
    out = out.withColumn("_m", F.least(least, "_later"))
    fixed = F.col("_m") - F.coalesce(F.lag("_m").over(inside), "_prior")
    if strict:
        fixed = F.when(F.col("_bad"), F.raise_error(F.lit("a revision exceeds all earlier reports")).cast("double")).otherwise(fixed)
    out = out.withColumn(col, fixed)
    return out.select(df.columns) if strict else out.select(*df.columns, (~F.col("_bad")).alias("revision_ok"))


def page_cusum(df: DataFrame, reference_end: int = 28, allowance: float = ALLOWANCE, keys: list[str] = K, size: int = SIZE) -> DataFrame:
    """The rows of `charts.page_cusum`, block by block."""
    rows = _cut(df.where(F.col("t") >= reference_end), size)
    up = by([*keys, "_block"]).rowsBetween(Window.unboundedPreceding, 0)
    sides = {"u": 1, "l": -1}
    for side, sign in sides.items():
        rows = rows.withColumn(f"_p{side}", F.sum(sign * F.col("v") - allowance).over(up))
    low = {s: F.max(F.struct((-F.col(f"_p{s}")).alias("p"), "t")).alias(f"_x{s}") for s in sides}
    sums = rows.groupBy(*keys, "_block").agg(*low.values(), *(F.max_by(f"_p{s}", "t").alias(f"_total{s}") for s in sides))
    for s in sides:
        sums = sums.withColumn(f"_before{s}", F.coalesce(F.sum(f"_total{s}").over(_earlier(keys)), F.lit(0.0)))
        sums = sums.withColumn(f"_here{s}", F.col(f"_before{s}") - F.col(f"_x{s}.p"))
        sums = sums.withColumn(f"_low{s}", F.least(F.coalesce(F.min(f"_here{s}").over(_earlier(keys)), F.lit(0.0)), F.lit(0.0)))
        reset = F.when(F.col(f"_here{s}") <= F.col(f"_low{s}"), F.col(f"_x{s}.t"))
        sums = sums.withColumn(f"_reset{s}", reset).withColumn(f"_reset{s}", F.max(f"_reset{s}").over(_earlier(keys)))
    out = rows.join(sums.select(*keys, "_block", *(f"_{n}{s}" for n in ("before", "low", "reset") for s in sides)), [*keys, "_block"])
    for s in sides:
        out = out.withColumn(f"_p{s}", F.col(f"_before{s}") + F.col(f"_p{s}"))
        out = out.withColumn(f"_s{s}", F.col(f"_p{s}") - F.least(F.col(f"_low{s}"), F.min(f"_p{s}").over(up)))
        reset = F.coalesce(F.max(F.when(F.col(f"_s{s}") <= 0, F.col("t"))).over(up), f"_reset{s}")
        out = out.withColumn(f"_b{s}", F.coalesce(reset + 1, F.lit(reference_end)))
    none, upper = (F.col("_su") <= 0) & (F.col("_sl") <= 0), F.col("_su") >= F.col("_sl")
    start = F.when(none, F.col("t")).when(upper, F.col("_bu")).otherwise(F.col("_bl"))
    direction = F.when(none, 0).when(upper, 1).otherwise(-1)
    return out.select(*keys, "t", F.greatest("_su", "_sl").alias("statistic"), start.cast("long").alias("start"), direction.alias("direction"))


def corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull of points with rising x, in order."""
    xs, ys = x.tolist(), y.tolist()
    kept: set[int] = set()
    for sign in (1, -1):
        chain: list[int] = []
        for i in range(len(xs)):
            while len(chain) > 1:
                a, b = chain[-2], chain[-1]
                if sign * ((xs[b] - xs[a]) * (ys[i] - ys[a]) - (ys[b] - ys[a]) * (xs[i] - xs[a])) > 0:
                    break
                chain.pop()
            chain.append(i)
        kept.update(chain)
    return np.array(sorted(kept), int)


def best_start(starts: np.ndarray, sums: np.ndarray, end: int, total: float) -> tuple[float, int, int]:
    """(statistic, start, direction) over candidates with the running sums before them, for a walk that is `total` after day `end`."""
    gap = total - sums
    q = gap * gap / (end + 1 - starts)
    i = int(np.argmax(q))
    return float(q[i]), int(starts[i]), int(np.sign(gap[i]))


def focus_candidates(df: DataFrame, reference_end: int = 28, keys: list[str] = K, size: int = SIZE) -> DataFrame:
    """(keys, _block, start, p, total, last): the starts of each block that can win at some end, with the sum of v in the
    block before them, the block's sum and its last day."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("t")
        t, walk = rows.t.to_numpy(), np.cumsum(np.nan_to_num(rows.v.to_numpy(float)))
        before = np.concatenate([[0.0], walk[:-1]])
        at = corners(t, before)
        head = {k: pdf[k].iloc[0] for k in [*keys, "_block"]}
        return pd.DataFrame({**head, "start": t[at], "p": before[at], "total": walk[-1], "last": t[-1]})

    rows = _cut(df.where(F.col("t") >= reference_end).select(*keys, F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v")), size)
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys, "_block").applyInPandas(one, f"{fields}, _block long, start long, p double, total double, last long")


def focus_scan(df: DataFrame, reference_end: int = 28, keys: list[str] = K, size: int = SIZE) -> DataFrame:
    """The rows of `charts.focus_scan`, from the candidates of each block alone."""
    found = focus_candidates(df, reference_end, keys, size)
    sums = found.groupBy(*keys, "_block").agg(F.first("total").alias("_t"), F.first("last").alias("_l"))
    whole = Window.partitionBy(*keys)
    sums = sums.select(*keys, "_block", F.coalesce(F.sum("_t").over(_earlier(keys)), F.lit(0.0)).alias("_before"), F.sum("_t").over(whole).alias("_end"), (F.max("_l").over(whole) + 1).alias("_stop"))
    gap = F.col("_end") - F.col("_before") - F.col("p")
    top = found.join(sums, [*keys, "_block"]).groupBy(*keys).agg(F.max(F.struct((gap * gap / (F.col("_stop") - F.col("start"))).alias("q"), (-F.col("start")).alias("m"), gap.alias("d"))).alias("top"))
    return top.select(*keys, F.col("top.q").alias("statistic"), (-F.col("top.m")).alias("start"), F.signum("top.d").cast("int").alias("direction"))
