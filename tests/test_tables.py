"""Episode, estimation and check tables on small hand-made rows."""

import math

import pandas as pd
import pytest

from riskloom.operators import checks, episodes, estimation, report

TRACE = "array<struct<look:int,day:int,statistic:double,boundary:double,tau_hat:int,direction:int,status:string>>"


def test_calibration_rank(spark):
    rows = [("f", "m", None)] + [("f", "m", float(i)) for i in range(19)]
    df = spark.createDataFrame(rows, "null_family string, method string, episode_statistic double")
    got = episodes.calibrate(df, 0.05, expected=20).first()
    assert (got.n_calibration, got.order_rank, got.critical_value) == (20, 20, 18.0)
    with pytest.raises(Exception, match="incomplete"):
        episodes.calibrate(df.limit(19), 0.05, expected=20).collect()
    with pytest.raises(Exception, match="incomplete"):
        episodes.calibrate(df.fillna(math.inf), 0.05).collect()
    rows = df.selectExpr("*", "'success' AS status", "coalesce(episode_statistic, -1) AS replicate")
    assert episodes.calibrate(rows, 0.05, status="status", unit=["replicate"]).first() == got
    for odd in (rows.union(rows.limit(1)), rows.withColumn("status", rows.episode_statistic.cast("string"))):
        with pytest.raises(Exception, match="incomplete, failed, repeated"):
            episodes.calibrate(odd, 0.05, status="status", unit=["replicate"]).collect()


def test_calibration_rank_of_large_groups_with_ties(spark):
    """The same counting path at every size: against numpy, with ties and missing looks at the rank and around it."""
    import numpy as np

    rng = np.random.default_rng(2)
    groups = {"plain": rng.normal(size=150_001), "ties": np.repeat([1.0, 2.0, 3.0], [142_000, 7_000, 1_000]), "missing": np.concatenate([np.full(145_000, -np.inf), rng.normal(size=3_000)]), "edge": np.arange(1999.0), "one": np.array([4.0]), "few": np.arange(39.0)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"null_family": k, "method": "m", "episode_statistic": v}) for k, v in groups.items()])).repartition(7)
    for alpha in (0.05, 0.2, 0.5, 0.001):
        for r in episodes.calibrate(df, alpha).collect():
            v = np.sort(groups[r.null_family])
            rank = math.ceil((len(v) + 1) * (1 - alpha))
            want = None if rank > len(v) or v[rank - 1] == -np.inf else v[rank - 1]
            assert (r.n_calibration, r.order_rank, r.critical_value) == (len(v), rank, want), (r, want)


def test_strict_crossing_and_outcomes(spark):
    cases = [(83, 3.0, "available", (1, 1, 0, 0)), (91, 3.0, "available", (1, 0, 1, 1)), (181, 3.0, "available", (1, 0, 1, 0)), (91, 2.0, "available", (0, 0, 0, 0)), (91, None, "unavailable", (0, 0, 0, 0))]
    rows = [(i, "f", "m", 91, 182, [(1, d, s, None, 80, 1, st)]) for i, (d, s, st, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"replicate int, null_family string, method string, true_change int, horizon int, trace {TRACE}")
    cut = spark.createDataFrame([("f", "m", 2.0)], "null_family string, method string, critical_value double")
    got = episodes.alarm_outcomes(episodes.apply_thresholds(df, cut)).orderBy("replicate").collect()
    assert [(r.alarm, r.premature, r.postchange, r.within_window) for r in got] == [c[3] for c in cases]
    assert got[4].restricted_delay == 91 and got[3].tau_hat_at_alarm is None
    with pytest.raises(Exception, match="no threshold"):
        episodes.apply_thresholds(df.withColumn("method", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x")), cut).collect()


def three_episodes(spark, status="success"):
    rows = []
    for m, alarms in (("a", (91, 90, None)), ("b", (91, 90, None)), ("c", (None, 90, None))):
        for k, alarm in enumerate(alarms):
            rows.append(("evaluation", "s", m, k, status if k == 2 else "success", alarm, 91, 92, 182, 1.5, 0))
    return spark.createDataFrame(rows, "stage string, scenario string, method string, replicate int, status string, alarm_day int, true_change int, true_change_day int, horizon int, risk_ratio double, unavailable_looks int")


def test_three_episode_study(spark):
    flags = report.derive_flags(three_episodes(spark, "failed:x"))
    summary = {(r.method, r.metric): (r.n, r.events, r.estimate) for r in report.episode_summary(flags).collect()}
    assert summary["a", "useful_power"] == (3, 1, pytest.approx(1 / 3)) and summary["a", "premature_probability"][1] == 1 and summary["a", "absent"][1] == 1 and summary["a", "failed"][1] == 1
    curve = report.cumulative_detection_curve(flags).where("method = 'a'").collect()
    assert len(curve) == 91 and all(r.events == 1 and r.n == 3 for r in curve)
    pair = {(r.a, r.b): r for r in report.paired_contrasts(flags, ["a", "b", "c"], "useful").collect()}
    r = pair["a", "c"]
    assert (r.n, r.a_only, r.b_only) == (3, 1, 0) and r.difference == pytest.approx(1 / 3) and r.mcse == pytest.approx(1 / 3)


def test_trace_maxima(spark):
    looks = [(0, 10, 0.0, "available"), (0, 20, 2.0, "available"), (1, 10, 2.0, "available"), (1, 20, 3.0, "available"), (2, 10, None, "unavailable"), (2, 20, None, "unavailable")]
    df = spark.createDataFrame([(r, d, s, st, 15) for r, d, s, st in looks], "replicate int, day int, statistic double, status string, true_change int")
    got = {r.replicate: (r.before, r.after, r.unavailable) for r in report.trace_maxima(df, ["replicate"]).collect()}
    assert got == {0: (0.0, 2.0, 0), 1: (2.0, 3.0, 0), 2: (None, None, 2)}
    with pytest.raises(Exception, match="repeat"):
        report.trace_maxima(df.union(df), ["replicate"]).collect()


def test_estimation_denominators(spark):
    truth = 0.02
    rows = [
        (0, True, truth, 1.1 * truth, 0.9 * truth, 1.2 * truth, True, True), (1, True, truth, 1.2 * truth, None, None, True, False),
        (2, True, truth, None, None, None, False, False), (3, False, truth, None, None, None, False, False),
    ]
    df = spark.createDataFrame(rows, "replicate int, alarm boolean, truth double, estimate double, lower double, upper double, point_valid boolean, interval_valid boolean")
    got = estimation.estimation_summary(df, []).first()
    assert (got.episodes, got.alarms, got.points, got.intervals) == (4, 3, 2, 1)
    assert got.relative_bias == pytest.approx(0.15) and got.relative_rmse == pytest.approx(math.sqrt((0.1**2 + 0.2**2) / 2)) and got.coverage == pytest.approx(1 / 3) and got.valid_coverage == 1
    none = estimation.estimation_summary(df.where("replicate = 3"), []).first()
    assert none.bias is None and none.coverage is None


def test_cutoffs_give_infinite_and_missing_intervals(spark):
    rows = [("risk_ratio", 0.0, 1000.0, True), ("risk_ratio", 1000.0, 1.0, True), ("risk_ratio", 0.0, 1.0, False)]
    df = spark.createDataFrame(rows, "target string, center double, se double, available boolean")
    cut = spark.createDataFrame([("risk_ratio", -1.0, 1.0)], "target string, lower double, upper double")
    got = [(r.lower, r.upper, r.interval_valid) for r in estimation.apply_cutoffs(df, cut).collect()]
    assert got[0] == (0.0, math.inf, True) and got[1] == (math.inf, math.inf, True) and got[2] == (None, None, False)


def test_equal_cells_and_ties(spark):
    cells = spark.createDataFrame([("b", "c1", "x", 2, 0.1), ("b", "c2", "x", 2, 1.0), ("b", "c1", "y", 2, 0.1), ("b", "c2", "y", 2, 1.0), ("b", "c1", "z", 2, 0.2)], "bank string, cell string, method string, n int, rmse double")
    got = {r.method: r for r in estimation.equal_cell_aggregate(cells, ["bank"], 2).collect()}
    assert got["x"].rmse == pytest.approx(math.sqrt((0.01 + 1) / 2)) and got["x"].ties == 2 and got["x"].wins == 0 and got["z"].rmse is None


def test_checks_find_one_mutated_cell(spark):
    good = [("s", m, k, "h" * 12, 1.5) for m in ("a", "b") for k in range(3)]
    schema = "scenario string, method string, replicate int, stream_hash string, risk_ratio double"
    df = spark.createDataFrame(good, schema)
    assert checks.check_grid(df, 3, ["a", "b"], ["risk_ratio"]).count() == 0 and checks.check_shared_streams(df, ["scenario", "replicate"]).count() == 0
    lacks = spark.createDataFrame([*good[:-1], good[0], ("s", "c", 1, "h" * 12, 1.6)], schema)
    found = {(r.method, r.replicate, r.problem) for r in checks.check_grid(lacks, 3, ["a", "b"], ["risk_ratio"]).collect()}
    assert found == {("b", 2, "missing"), ("a", 0, "repeated"), ("c", 1, "extra"), (None, None, "risk_ratio varies")}
    short = spark.createDataFrame([(*good[0][:3], "h", 1.5), *good[1:]], schema)
    assert {r.problem for r in checks.check_shared_streams(short, ["scenario", "replicate"]).collect()} == {"short hash", "several hashes"}


def test_frozen_columns_and_alarms(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-14), (2, 0.0)], "k int, v double")
    assert {(r.k, r.column) for r in checks.check_frozen_columns(a, b, ["k"], ["v"]).collect()} == {(2, "v"), (3, "*")}
    rows = [(1, 5, 3, 10, False, "success"), (2, 11, 3, 10, False, "success"), (3, 5, 6, 10, False, "success"), (4, 5, 3, 10, True, "success"), (5, None, 3, 10, False, "success"), (6, None, None, 10, True, "failed")]
    df = spark.createDataFrame(rows, "k int, alarm_day int, tau_hat_at_alarm int, horizon int, all_looks_unavailable boolean, status string")
    assert sorted(r.k for r in checks.check_alarms(df, ["k"]).collect()) == [2, 3, 4, 5]


def test_nb_charts_do_not_look_ahead(spark):
    import numpy as np

    from riskloom.operators import exposure, fit, monitor

    rng = np.random.default_rng(9)
    cases = np.full(84, 400.0)
    x = monitor.total_exposure(cases, np.array([0.5, 0.5]), 1)
    deaths = rng.negative_binomial(10, 10 / (10 + 0.05 * np.maximum(x, 1e-9))).astype(float)
    later = deaths + 20 * (np.arange(84) >= 56)
    traces = []
    for y in (deaths, later):
        df = spark.createDataFrame([("a", t, float(c), float(d)) for t, (c, d) in enumerate(zip(cases, y, strict=True))], "series string, t long, cases double, deaths double")
        rows = fit.baseline_residuals(exposure.total_exposure(df, [0.5, 0.5]), ["series"], 28)
        traces.append({(r.chart, r.prefix): (r.statistic, r.start, r.direction) for r in fit.chart_traces_nb(rows, ["series"], [35, 56, 84], 28).collect()})
    for chart in ("page_cusum", "glr"):
        assert traces[0][chart, 35] == traces[1][chart, 35] and traces[0][chart, 56] == traces[1][chart, 56] and traces[1][chart, 84][0] > traces[0][chart, 84][0]
