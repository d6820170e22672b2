"""Streams against their batch forms: restart from a checkpoint, what state writes, the alarm table's replay."""

import math
import os
from dataclasses import replace

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from riskloom.operators import charts, monitor
from riskloom.plans import monitoring
from riskloom.streaming import online

K = ["series"]


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(3)
    rows = [(s, t, float(rng.poisson(50)), float(rng.poisson(5 + 6 * (s == "b" and t > 12)))) for s in "abc" for t in range(40) if (s, t) != ("c", 7)]
    return spark.createDataFrame(rows, "series string, t long, cases double, deaths double").cache()


def run(stream, out, state):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_monitor_goes_on_from_its_checkpoint(spark, counts, tmp_path):
    """Three runs of one stream, over days that come as they go: the rows of the batch monitor, skipped days as zeros."""
    config = replace(monitoring.ONLINE, looks=(10, 17, 24, 31, 38))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for a, b in ((0, 9), (9, 26), (24, 40)):  # the last run brings two days again
        counts.where(F.col("t").between(a, b - 1)).coalesce(1).write.mode("append").parquet(source)
        run(online.online_monitor(spark.readStream.schema(counts.schema).parquet(source), K, config), out, state)
    got = {(r.series, r.look): r for r in spark.read.parquet(out).collect()}
    dense = counts.union(spark.createDataFrame([("c", 7, 0.0, 0.0)], counts.schema))
    want = {(r.series, r.look): r for r in monitor.monitor(dense, K, config, until_alarm=True).collect()}
    assert {*got} == {*want} and ("b", 5) not in got
    for k, r in want.items():
        assert got[k].crossed == r.crossed and got[k].tau_hat == r.tau_hat and math.isclose(got[k].statistic, r.statistic, rel_tol=1e-9)
    assert got["a", 4].dropped == 2 and got["a", 1].dropped == 0


def test_what_a_day_writes_does_not_grow(spark, tmp_path):
    """Between looks every batch of one day writes change logs of one size, however long the prefix is."""
    config = replace(monitoring.ONLINE, looks=(60,))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    sizes = []
    for part in range(8):
        spark.createDataFrame([("a", t, 5.0, 1.0) for t in range(4 * part, 4 * part + 4)], "series string, t long, cases double, deaths double").coalesce(1).write.mode("append").parquet(source)
        run(online.online_monitor(spark.readStream.schema("series string, t long, cases double, deaths double").parquet(source), K, config), out, state)
        logs = [os.path.join(d, f) for d, _, files in os.walk(state) for f in files if f.endswith(".changelog")]
        sizes.append(sum(map(os.path.getsize, logs)))
    steps = np.diff(sizes)
    assert len(steps) == 7 and steps.min() > 0 and steps[-3:].max() <= 1.3 * steps[:3].max()


def test_focus_is_the_batch_scan_of_every_prefix(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(s, t, float(np.rint(rng.normal(0, 8) + 5 * (t > 60)) / 8)) for s in "ab" for t in range(90)], "series string, t long, v double").cache()
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for a, b in ((0, 30), (30, 31), (31, 90)):
        rows.where(F.col("t").between(a, b - 1)).coalesce(1).write.mode("append").parquet(source)
        run(online.online_focus(spark.readStream.schema(rows.schema).parquet(source), K), out, state)
    got = {(r.series, r.t): r for r in spark.read.parquet(out).collect()}
    assert len(got) == 180 and max(r.candidates for r in got.values()) < 40
    for end in (1, 17, 30, 61, 89):
        for r in charts.focus_scan(rows.where(F.col("t") <= end), 0).collect():
            found = got[r.series, end]
            assert (found.statistic, found.start, found.direction) == (r.statistic, r.start, r.direction)


def alarms(spark, *rows):
    return spark.createDataFrame([(s, look, 7 * look, 3, 1.0 * look, 0.5, crossed) for s, look, crossed in rows], f"series string, {online.AlarmTable.FIELDS}, crossed boolean")


def test_alarm_table_replays_and_merges(spark, tmp_path):
    table = online.AlarmTable(spark, str(tmp_path / "alarms"), K, "series string", every=3)
    assert table.read().count() == 0
    batches = [[("a", 2, True), ("b", 1, False)], [("a", 1, True)], [("c", 4, True)], [], [("b", 3, True), ("b", 5, True)], [("d", 1, True)], [("a", 9, True)], [("e", 2, True)], [], []]
    want = {}
    for number, rows in enumerate(batches):
        for _ in range(2):  # every batch runs twice
            table.merge(alarms(spark, *rows) if rows else alarms(spark, ("x", 1, False)), number)
        for s, look, crossed in rows:
            if crossed:
                want[s] = min(look, want.get(s, look))
        assert {r.series: r.look for r in table.read().collect()} == want
    names = sorted(os.listdir(tmp_path / "alarms"))
    assert [x for x in names if x.startswith("base=")] == ["base=5", "base=8"] and len(names) <= 2 + 2 * 3
    assert online.AlarmTable(spark, str(tmp_path / "alarms"), K, "series string").read().count() == 5


def test_query_has_alarms(spark):
    rows = monitoring.z4(spark, SF.replace("sf0.001", "sf0.01")).collect()
    assert len(rows) >= 3 and all(r.statistic > r.boundary for r in rows)
