"""One long series cut into blocks gives the rows of the windows, for any number of blocks."""

import numpy as np
import pytest
from conftest import rows_of, same_rows
from pyspark.sql import functions as F

from riskloom.operators import blocks, charts, exposure, prepare

N = 5000


@pytest.fixture(scope="module")
def series(spark):
    """A long walk with changes, one that falls all the time, one of three days, and one whose days start late."""
    rng = np.random.default_rng(4)
    t = np.arange(N)
    walk = np.rint(rng.normal(0, 8, N) + 4 * (t > 3200) - 3 * ((t > 900) & (t < 1500))) / 8
    rows = [("long", int(i), float(rng.poisson(9)), float(v)) for i, v in zip(t, walk, strict=True)]
    rows += [("falls", int(i), 1.0, -0.25) for i in range(777)] + [("tiny", i, 2.0, 0.5 * i) for i in range(3)] + [("late", i, 3.0, float(i % 3 - 1)) for i in range(4000, 4400)]
    return spark.createDataFrame(rows, "series string, t long, cases double, v double").repartition(5).cache()


SIZES = [N, -(-N // 7), -(-N // 50)]


@pytest.mark.parametrize("size", SIZES)
def test_cusum(series, size):
    same_rows(rows_of(blocks.page_cusum(series, 28, size=size).toPandas()), rows_of(charts.page_cusum(series, 28).toPandas()))
    same_rows(rows_of(blocks.page_cusum(series, 0, 0.125, size=size).toPandas()), rows_of(charts.page_cusum(series, 0, 0.125).toPandas()))


@pytest.mark.parametrize("size", SIZES)
def test_exposure(series, size):
    law = [0.1] * 10
    for offset in (0, 1):
        same_rows(rows_of(blocks.total_exposure(series, law, offset=offset, size=size).toPandas()), rows_of(exposure.total_exposure(series, law, offset=offset).toPandas()))
    with pytest.raises(ValueError):
        blocks.total_exposure(series, law, size=5)


@pytest.mark.parametrize("size", SIZES)
def test_revisions(series, size):
    rows = series.withColumn("cases", F.when(F.col("t") == 0, 9000.0).otherwise(F.col("cases") - F.col("t") % 20)).where("series <> 'late'")
    same_rows(rows_of(blocks.reconcile_increments(rows, size=size).toPandas()), rows_of(prepare.reconcile_increments(rows).toPandas()))
    odd = rows.withColumn("cases", F.when(F.col("series") == "tiny", -F.col("cases")).otherwise(F.col("cases")))
    same_rows(rows_of(blocks.reconcile_increments(odd, strict=False, size=size).toPandas()), rows_of(prepare.reconcile_increments(odd, strict=False).toPandas()))
    with pytest.raises(Exception, match="exceeds all earlier"):
        blocks.reconcile_increments(odd, size=size).collect()


@pytest.mark.parametrize("size", SIZES)
def test_focus(series, size):
    same_rows(rows_of(blocks.focus_scan(series, 28, size=size).toPandas()), rows_of(charts.focus_scan(series, 28).toPandas()))


def plain_focus(v):
    total = np.concatenate([[0.0], np.cumsum(v)])
    q = [(total[-1] - total[s]) ** 2 / (len(v) - s) for s in range(len(v))]
    return max(q), int(np.argmax(q))


def test_candidates_win_at_every_end():
    """Random and adversarial walks: what the hull drops never wins, now or later; merged hulls are the hull of all."""
    rng = np.random.default_rng(8)
    walks = [np.rint(rng.normal(0, 6, 400)), np.ones(300), -np.ones(300), np.tile([1.0, -1.0], 150), np.linspace(-3, 3, 301) ** 3, np.concatenate([np.zeros(100), np.full(100, 2.0), np.full(100, -2.0)])]
    for v in walks:
        before = np.concatenate([[0.0], np.cumsum(v)])
        held = np.zeros(0, int)
        for end in range(len(v)):
            held = np.append(held, end)
            held = held[blocks.corners(held, before[held])]
            q, start, _ = blocks.best_start(held, before[held], end, before[end + 1])
            assert np.allclose((q, start), plain_focus(v[: end + 1]))
        cut = len(v) // 3
        parts = [np.arange(a, b) for a, b in ((0, cut), (cut, len(v)))]
        merged = np.concatenate([p[blocks.corners(p, before[p])] for p in parts])
        assert merged[blocks.corners(merged, before[merged])].tolist() == blocks.corners(np.arange(len(v)), before[:-1]).tolist()


def test_candidates_are_few(spark):
    """A random walk of n days has about 4 log n corners, a straight one two."""
    rows = spark.range(200_000).select(F.lit("a").alias("series"), F.col("id").alias("t"), (F.hash("id") % 17 / 8.0).alias("v"))
    found = blocks.focus_candidates(rows, 0, size=20_000).groupBy("_block").count().collect()
    assert len(found) == 10 and max(r["count"] for r in found) < 100


def test_one_series_is_in_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = spark.range(2000).select(F.lit("a").alias("series"), F.col("id").alias("t"), F.lit(1.0).alias("cases"), F.lit(0.5).alias("v"))
        for out in (blocks.page_cusum(rows, 0, size=50), blocks.reconcile_increments(rows, size=50), blocks.total_exposure(rows, [0.5, 0.5], size=50)):
            assert out.select(F.spark_partition_id().alias("p")).distinct().count() >= 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
